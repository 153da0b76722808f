"""Statement text to transaction rows.

Input: owner_id, document_id, text, opening_balance (minor units or null), doc_type. A document is
one text value, so windows over its lines are bounded by it, and all of them share one shuffle on
the document key. Rows that are not transactions come back with a `reject` reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, period, text
from ledgerloom.functions.vectors import let
from ledgerloom.session import stored

CHARS_PER_TASK = 8_000_000  # of statement text whose lines one task sorts at once, on average

DOC = ["owner_id", "document_id"]


def _p(regex: str, ignore_case: bool = False) -> str:
    return text.pattern(regex, ignore_case)


def edge_trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^{text.BLANKS}+|{text.BLANKS}+$", "")


def date_of(value: Column) -> Column:
    """The first dd/mm/yy(yy) in a text as a date; null when there is none or it is no real day."""
    # its three numbers are read from the whole match, and only of a text that has one
    matched = F.regexp_extract(value, _p(fv.STATEMENT_DATE_PATTERN), 0)
    parts = lambda m: period.statement_date(F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4))
    return let(matched, lambda m: F.when(m != "", parts(m)))


def leads_with_date(line: Column) -> Column:
    return date_of(F.substring(line, 1, 12)).isNotNull()


def has_exact_money(value: Column) -> Column:
    return F.rlike(value, F.lit(_p(fv.EXACT_MONEY_PATTERN)))


# ---------------------------------------------------------------------------- stitching
def stitched_rows(documents: DataFrame) -> DataFrame:
    """One text per dated row: wrapped lines appended, orphan narrations moved to the next row."""
    flat = F.regexp_replace(F.regexp_replace("text", "\r", ""), "[ \t]+", " ")
    lines = F.filter(F.transform(F.split(flat, "\n"), edge_trim), lambda l: l != "")
    rows = documents.select(*DOC, F.posexplode(lines).alias("line_no", "line")).withColumns(
        {
            "dated": leads_with_date(F.col("line")),
            "complete": F.col("line").rlike(_p(fv.ROW_COMPLETE_PATTERN, True)),
            "orphan": F.col("line").rlike(_p(fv.NARRATION_PATTERN, True)) & ~has_exact_money(F.col("line")),
        }
    )
    by_line = Window.partitionBy(*DOC).orderBy("line_no")
    rows = rows.withColumn("row_no", F.sum(F.col("dated").cast("int")).over(by_line)).filter("row_no > 0")
    earlier = Window.partitionBy(*DOC, "row_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    complete_before = F.coalesce(F.max("complete").over(earlier), F.lit(False))
    rows = rows.withColumns(
        {
            "narration": ~F.col("dated") & F.col("orphan") & complete_before,
            "last_row": F.max("row_no").over(Window.partitionBy(*DOC)),
        }
    )
    left_over = F.col("narration") & (F.col("row_no") == F.col("last_row"))
    place = F.when(F.col("dated"), 0).when(left_over, 3).when(F.col("narration"), 1).otherwise(2)
    target = F.when(F.col("narration") & ~left_over, F.col("row_no") + 1).otherwise(F.col("row_no"))
    parts = F.array_sort(F.collect_list(F.struct("place", "line_no", "line")))  # lines of one row of one document
    placed = rows.select(*DOC, target.alias("row_no"), place.alias("place"), "line_no", "line")
    return placed.groupBy(*DOC, "row_no").agg(F.array_join(F.transform(parts, lambda x: x["line"]), " ").alias("row"))


def split_merged(row: Column) -> Column:
    """Pieces of a row that holds several transactions: cut at a real date after an exact amount."""
    regex = _p(fv.STATEMENT_DATE_PATTERN)
    dates = F.regexp_extract_all(row, F.lit(regex), F.lit(0))
    gaps = F.split(row, regex, -1)
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.concat(gaps[0], dates[0], gaps[1]).alias("open"),
        gaps[1].alias("since"),
    )

    def step(state: Column, i: Column) -> Column:
        date, after = F.get(dates, i), F.get(gaps, i + 1)
        tail = F.concat(date, after)
        real = date_of(date).isNotNull()
        cut = real & has_exact_money(state["since"])
        return F.struct(
            F.when(cut, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(cut, tail).otherwise(F.concat(state["open"], tail)).alias("open"),
            F.when(real, after).otherwise(F.concat(state["since"], tail)).alias("since"),
        )

    pieces = F.aggregate(
        F.sequence(F.lit(1), F.size(dates) - 1), start, step, lambda s: F.concat(s["done"], F.array(s["open"]))
    )
    several = F.size(dates) > 1
    return F.filter(F.transform(F.when(several, pieces).otherwise(F.array(row)), edge_trim), lambda p: p != "")


def candidate_rows(documents: DataFrame) -> DataFrame:
    rows = stitched_rows(documents)
    return rows.select(*DOC, "row_no", F.posexplode(split_merged(F.col("row"))).alias("piece_no", "raw"))


# ------------------------------------------------------------------------------ parsing
def without_first_date(raw: Column) -> Column:
    return F.array_join(F.split(raw, _p(fv.STATEMENT_DATE_PATTERN), 2), " ")


def money_tokens(value: Column) -> Column:
    """Money-like tokens; exact ones (decimal point or comma) push out bare integers."""
    every = F.regexp_extract_all(value, F.lit(_p(fv.MONEY_PATTERN)), F.lit(0))
    exact = F.filter(every, lambda t: t.contains(".") | t.contains(","))
    return F.when(F.size(exact) > 0, exact).otherwise(every)


def describe(raw: Column, tokens: Column) -> Column:
    def drop_first(rest: Column, token: Column) -> Column:
        at = F.call_function("locate", token, rest)
        cut = F.concat(F.substr(rest, F.lit(1), at - 1), F.lit(" "), F.substr(rest, at + F.length(token)))
        return F.when(at > 0, cut).otherwise(rest)

    left = F.aggregate(tokens, without_first_date(raw), drop_first)
    for regex in (f"(?i){fv.SIDE_GROUP_PATTERN}", f"(?i){fv.SIDE_WORD_PATTERN}", fv.COLUMN_SIGN_PATTERN, text.BLANKS + "+"):
        left = F.regexp_replace(left, regex, " ")
    return F.trim(left)


def counterparty(raw: Column) -> Column:
    vpa = F.nullif(F.regexp_extract(raw, _p(fv.VPA_PATTERN, True), 1), F.lit(""))
    named = F.nullif(F.trim(F.regexp_extract(raw, _p(fv.BENEFICIARY_PATTERN, True), 1)), F.lit(""))
    return F.coalesce(vpa, named)


def dealt(documents: DataFrame, chars_per_task: int = CHARS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """The documents written once, and the same by document over as many tasks as keep the text of one near `chars_per_task`.

    The sorts of a task hold its lines several times over, and Spark's number of partitions does not follow the size of a text.
    """
    kept, _ = stored(documents, "documents")
    chars = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(kept.sparkSession.sparkContext.defaultParallelism, -(-chars // chars_per_task))
    return kept, kept.repartition(tasks, *DOC)


def parse_statements(documents: DataFrame, chars_per_task: int = CHARS_PER_TASK) -> DataFrame:
    """All candidate rows with date, amount, balance, description, counterparty and `reject`."""
    kept, spread = dealt(documents, chars_per_task)
    opening = kept.select(*DOC, F.col("opening_balance"))
    rows = candidate_rows(spread).withColumn("txn_date", date_of(F.col("raw")))
    tokens = money_tokens(without_first_date(F.col("raw")))
    furniture = F.col("raw").rlike(_p(fv.FURNITURE_PATTERN, True))
    rows = rows.withColumns({"tokens": tokens, "furniture": furniture})
    early = (
        F.when(F.col("txn_date").isNull(), "no date").when(F.col("furniture"), "furniture").when(F.size("tokens") == 0, "no money")
    )
    rows = rows.withColumn("reject", early)
    usable = F.col("reject").isNull()
    whole = Window.partitionBy(*DOC)
    many = usable & (F.size("tokens") >= 2)
    share = F.count_if(many).over(whole) / F.nullif(F.count_if(usable).over(whole), F.lit(0))
    rows = rows.withColumn("balance_layout", F.coalesce(share >= fv.BALANCE_LAYOUT_SHARE, F.lit(False)))
    with_balance = usable & F.col("balance_layout") & (F.size("tokens") >= 2)
    last = money.to_minor(F.element_at("tokens", F.when(F.size("tokens") > 0, -1)))
    second = money.to_minor(F.get("tokens", F.size("tokens") - 2))
    rows = rows.withColumns(
        {"balance": F.when(with_balance, last), "magnitude": F.when(with_balance, second).when(usable, last)}
    )
    order = Window.partitionBy(*DOC).orderBy("row_no", "piece_no")
    before = F.last("balance", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).join(opening, DOC)
    previous = F.coalesce("before", "opening_balance")
    credit_word = F.col("raw").rlike(_p(fv.CREDIT_WORD_PATTERN, True)) & ~F.col("raw").rlike(_p(fv.DEBIT_WORD_PATTERN, True))
    credit = F.when(F.col("balance").isNotNull() & previous.isNotNull(), F.col("balance") >= previous).otherwise(credit_word)
    rows = rows.withColumn("amount", F.when(credit, F.col("magnitude")).otherwise(-F.col("magnitude")))
    out_of_range = F.col("magnitude").isNull() | (F.col("magnitude") == 0) | (F.abs("amount") > fv.MAX_STATEMENT_MINOR)
    rows = rows.withColumns(
        {
            "reject": F.coalesce("reject", F.when(out_of_range, "amount out of range")),
            "raw_description": F.when(usable, describe(F.col("raw"), F.col("tokens"))),
            "counterparty_raw": F.when(usable, counterparty(F.col("raw"))),
        }
    )
    mark = F.substring(F.regexp_replace(F.lower("raw_description"), fv.REPEAT_MARK_NOISE_PATTERN, ""), 1, fv.REPEAT_MARK_CHARS)
    rows = rows.withColumn("mark", F.when(F.col("reject").isNull(), mark))
    same = Window.partitionBy(*DOC, "txn_date", "amount", "mark").orderBy("row_no", "piece_no")
    repeat = F.col("reject").isNull() & (F.row_number().over(same) > 1)
    rows = rows.withColumn("reject", F.when(repeat, "repeat").otherwise(F.col("reject")))
    number = F.count_if(F.col("reject").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("number", number).select(
        *DOC, "row_no", "piece_no", "raw", "reject",
        F.when(F.col("reject").isNull(), F.concat_ws("_", F.lit("txn"), "document_id", "number")).alias("txn_id"),
        "txn_date", "amount", F.lit("INR").alias("currency"), "raw_description", "balance", "counterparty_raw", "balance_layout",
    )


def transactions(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject is null").drop("reject", "raw", "row_no", "piece_no")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject is not null").select(*DOC, "row_no", "piece_no", "raw", "reject")


# ------------------------------------------------------------------------------- header
def _number_in_line(line: Column) -> Column:
    """Last four digits of a labelled account number, or of a bare masked number."""
    labelled = F.regexp_replace(F.regexp_extract(line, _p(fv.ACCOUNT_HEADER_PATTERN, True), 1), r"\D", "")

    def masked(bare: Column) -> Column:
        def last(compact: Column) -> Column:
            masks = F.length(F.regexp_replace(compact, fv.MASK_SIGN_NOISE_PATTERN, ""))
            ends = F.rlike(compact, F.lit(fv.MASKED_END_PATTERN))
            return F.when(
                F.length(compact).between(*fv.MASKED_LENGTHS) & (masks >= fv.MASKED_LEAST_SIGNS) & ends, F.right(compact, F.lit(4))
            )

        return F.when(F.rlike(bare, F.lit(fv.MASKED_LINE_PATTERN)), let(F.regexp_replace(bare, "[ -]", ""), last))

    return let(labelled, lambda n: F.when(F.length(n) >= 4, F.right(n, F.lit(4))).otherwise(let(edge_trim(line), masked)))


def header_facts(documents: DataFrame) -> DataFrame:
    """account_last4 from the lines above the table, and the document type its opening lines state."""
    lines = F.slice(F.split(F.regexp_replace("text", "\r", ""), "\n"), 1, fv.HEADER_LINES)

    def above(every: Column) -> Column:
        first = F.array_position(F.transform(every, lambda l: has_exact_money(l) & leads_with_date(edge_trim(l))), F.lit(True))
        return let(first, lambda n: F.when(n > 0, F.slice(every, F.lit(1), (n - 1).cast("int"))).otherwise(every))

    # each of these is bound, as a column that is named twice inside a lambda is computed twice
    numbers = F.filter(F.transform(let(lines, above), _number_in_line), lambda n: n.isNotNull())
    opening = F.array_join(F.slice(F.split("text", "\n"), 1, fv.CARD_HEADER_LINES), " ")
    card = opening.rlike(_p(fv.CARD_STATEMENT_PATTERN, True))
    return documents.select(
        *DOC, F.get(numbers, F.lit(0)).alias("account_last4"), F.when(card, "card_statement").otherwise(F.col("doc_type")).alias("doc_type")
    )


# ------------------------------------------------------------------------------ dispatch
def parse_with(documents: DataFrame, parsers: dict | None = None) -> DataFrame:
    """Parses each document with the parser registered for 'provider:type', '*:type', or the default.

    `parsers` maps such keys to DataFrame -> DataFrame functions with the columns of
    `parse_statements`; documents carry provider_id.
    """
    registered = parsers or {}
    exact = F.concat_ws(":", "provider_id", "doc_type")
    any_provider = F.concat(F.lit("*:"), F.col("doc_type"))
    names = list(registered)
    chosen = F.when(exact.isin(names), exact).when(any_provider.isin(names), any_provider).otherwise("") if names else F.lit("")
    keyed = documents.withColumn("_parser", chosen)
    if registered:  # written once, as every parser takes its documents out of all
        keyed, _ = stored(keyed, "keyed-documents")
    out = parse_statements(keyed.filter("_parser = ''").drop("_parser"))
    for name, parser in registered.items():
        out = out.unionByName(parser(keyed.filter(F.col("_parser") == name).drop("_parser")))
    return out

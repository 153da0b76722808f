"""Questions in plain text routed to one of seven ledger answers, as a batch job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import text
from ledgerloom.operators import search
from ledgerloom.operators.rollups import sum_if
from ledgerloom.session import checkpointed, stored

ALL = "all"


def found(question: Column, regex: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(question, text.pattern(regex), group), F.lit(""))


def category_hint(question: Column) -> Column:
    first, *rest = fv.QUESTION_CATEGORIES
    hint = F.when(text.matches(question, first[0]), first[1])
    for regex, name in rest:
        hint = hint.when(text.matches(question, regex), name)
    return hint


def merchant_hint(question: Column) -> Column:
    raw = F.regexp_replace(found(question, fv.QUESTION_MERCHANT_PATTERN), "[?.!,]+$", "")
    return F.nullif(F.trim(raw), F.lit(""))


def route(questions: DataFrame) -> DataFrame:
    """Adds tool, fy, section, category, merchant and txn_id to rows with a `question` text."""
    edges = f"^{text.BLANKS}+|{text.BLANKS}+$"
    rows = questions.withColumn("q", F.regexp_replace(F.lower("question"), edges, ""))
    q = F.col("q")
    # a category is only looked for where the question asks for spending
    hint = F.when(text.matches(q, fv.SPEND_QUESTION_PATTERN), category_hint(q))
    rows = rows.withColumns({"category_hint": hint, "merchant_hint": merchant_hint(q)})
    tool = (
        F.when((q == "") | text.matches(q, fv.UNSAFE_QUESTION_PATTERN), "unsupported")
        .when(text.matches(q, fv.REVIEW_QUESTION_PATTERN), "review_queue")
        .when(text.matches(q, fv.SUBSCRIPTION_QUESTION_PATTERN), "subscriptions")
        .when(text.matches(q, fv.TAX_QUESTION_PATTERN), "tax_evidence")
        .when(text.matches(q, fv.PROVENANCE_QUESTION_PATTERN), "provenance")
        .when(text.matches(q, fv.CASHFLOW_QUESTION_PATTERN), "cashflow")
        .when(F.col("category_hint").isNotNull(), "category_spend")
        .when(F.col("merchant_hint").isNotNull(), "merchant_search")
        .otherwise("unsupported")
    )
    rows = rows.withColumn("tool", tool)
    year, end = found(q, fv.QUESTION_PERIOD_PATTERN, 1), found(q, fv.QUESTION_PERIOD_PATTERN, 2)
    with_period = F.col("tool").isin("cashflow", "category_spend", "merchant_search", "tax_evidence", "subscriptions")
    txn = found(q, fv.QUESTION_TXN_PATTERN)
    searches = (F.col("tool") == "merchant_search") | ((F.col("tool") == "provenance") & txn.isNull())
    return rows.withColumns(
        {
            "fy": F.when(with_period, F.concat(year, F.lit("-"), end)),
            "section": F.when(F.col("tool") == "tax_evidence", F.upper(found(q, fv.QUESTION_SECTION_PATTERN))),
            "category": F.when(F.col("tool") == "category_spend", F.col("category_hint")),
            "merchant": F.when(searches, F.col("merchant_hint")),
            "txn_id": F.when(F.col("tool") == "provenance", txn),
        }
    ).drop("q", "category_hint", "merchant_hint")


def search_counts(asked: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of the owner whose merchant or description contains the needle, per question.

    `asked`: question_id, owner_id, merchant, fy (null: all) and merchant_only, where the description does not count.
    """
    needle = F.regexp_replace(F.lower("merchant"), "[%_]", "")
    wanted = asked.select("question_id", "owner_id", F.col("fy").alias("q_fy"), "merchant_only", needle.alias("needle")).filter("needle <> ''")
    needles = wanted.select("owner_id", "needle").distinct()
    rows = ledger.select(
        "owner_id", "txn_id", "fy_key", F.lower(F.coalesce("merchant", F.lit(""))).alias("m"),
        F.lower(F.coalesce("raw_description", F.lit(""))).alias("d"),
    )
    # only of owners that asked; counted per distinct text, so that repeated texts are compared once
    rows = rows.join(needles.select("owner_id").distinct(), "owner_id", "left_semi")
    counted = rows.groupBy("owner_id", "m", "d", "fy_key").agg(F.count("*").alias("n"))
    hits = search.scan(counted, needles, ["m", "d"]).groupBy("owner_id", "needle", "fy_key").agg(
        F.sum("n").alias("either"), F.sum(F.when(F.col("in_m"), F.col("n"))).alias("merchant_rows")
    )
    period = F.col("q_fy").isNull() | (F.col("q_fy") == F.col("fy_key"))
    n = F.when(F.col("merchant_only"), F.col("merchant_rows")).otherwise(F.col("either"))
    return wanted.join(hits, ["owner_id", "needle"]).filter(period & n.isNotNull()).groupBy("question_id").agg(F.sum(n).alias("matches"))


def answer(routed: DataFrame, ledger: DataFrame, evidence: DataFrame, subscriptions: DataFrame, review_items: DataFrame) -> DataFrame:
    """question_id, tool, answered, total and items for every routed question.

    `evidence`: owner_id, fy_key, section, amount. Totals per period and over all periods come from
    one rollup each and are joined by key.
    """
    # every kind of answer reads the routed questions: route them once
    routed = checkpointed(routed)
    # facts of owners that asked
    owners = routed.select("owner_id").distinct()
    ledger, evidence, subscriptions, review_items = (
        df.join(owners, "owner_id", "left_semi") for df in (ledger, evidence, subscriptions, review_items)
    )
    # flows, categories, texts and ids are looked up apart: the rows are joined once
    ledger, _ = stored(ledger.select("owner_id", "txn_id", "fy_key", "flow", "category", "amount", "merchant", "raw_description"), "asked-ledger")
    period = F.coalesce("fy_key", F.lit(ALL)).alias("fy")
    flow = F.col("flow")
    flows = ledger.rollup("owner_id", "fy_key").agg(
        sum_if(flow == "income").alias("income"), sum_if(flow == "expense").alias("expense"), sum_if(flow == "investment").alias("investment")
    ).filter("owner_id is not null")
    cash = flows.select(
        "owner_id", period, F.lit("cashflow").alias("tool"), F.lit("").alias("detail"),
        (F.col("income") - F.abs("expense") - F.abs("investment")).alias("total"), F.lit(None).cast("bigint").alias("items"),
    )
    spend = ledger.groupBy("owner_id", "category", "fy_key").agg(F.sum(F.abs("amount")).alias("total"), F.count("*").alias("items"))
    spend = spend.rollup("owner_id", "category", "fy_key").agg(F.sum("total").alias("total"), F.sum("items").alias("items"))
    spend = spend.filter("category is not null and total > 0").select(
        "owner_id", period, F.lit("category_spend").alias("tool"), F.col("category").alias("detail"), "total", "items"
    )
    proof = evidence.withColumn("section", F.explode(F.array(F.col("section"), F.lit("")))).rollup("owner_id", "section", "fy_key").agg(
        F.sum("amount").alias("total"), F.count("*").alias("items")
    ).filter("section is not null")
    proof = proof.select("owner_id", period, F.lit("tax_evidence").alias("tool"), F.col("section").alias("detail"), "total", "items")
    no_total = F.lit(None).cast("bigint").alias("total")
    listed = subscriptions.groupBy("owner_id").agg(F.count("*").alias("items")).select(
        "owner_id", F.lit(ALL).alias("fy"), F.lit("subscriptions").alias("tool"), F.lit("").alias("detail"), no_total, "items"
    )
    waiting = review_items.filter("status = 'open'").groupBy("owner_id").agg(F.count("*").alias("items")).select(
        "owner_id", F.lit(ALL).alias("fy"), F.lit("review_queue").alias("tool"), F.lit("").alias("detail"), no_total, "items"
    )
    facts = cash.unionByName(spend).unionByName(proof).unionByName(listed).unionByName(waiting)

    whole_ledger = F.col("tool").isin("subscriptions", "review_queue")
    keyed = routed.select(
        "question_id", "owner_id", "tool", F.when(whole_ledger, ALL).otherwise(F.coalesce("fy", F.lit(ALL))).alias("fy"),
        F.coalesce("category", "section", F.lit("")).alias("detail"),
    )
    answered = keyed.join(facts, ["owner_id", "fy", "tool", "detail"], "left").select(
        "question_id", "tool", F.col("total").alias("fact_total"), F.col("items").alias("fact_items"),
        (F.col("total").isNotNull() | F.col("items").isNotNull()).alias("has_fact"),
    )
    provenance = F.col("tool") == "provenance"
    looking = routed.filter((F.col("tool") == "merchant_search") | (provenance & F.col("merchant").isNotNull()))
    searched = search_counts(looking.withColumns({"fy": F.when(~provenance, F.col("fy")), "merchant_only": provenance}), ledger)
    by_id = routed.filter("txn_id is not null").select("question_id", "owner_id", "txn_id").join(
        ledger.select("owner_id", "txn_id"), ["owner_id", "txn_id"]
    ).groupBy("question_id").agg(F.count("*").alias("matches"))
    limit = F.when(F.col("tool") == "merchant_search", 25).otherwise(10)
    lookups = searched.unionByName(by_id)
    shown = answered.join(lookups, "question_id", "left")
    items = F.when(F.col("tool").isin("merchant_search", "provenance"), F.when(F.col("matches").isNotNull(), F.least("matches", limit))).otherwise(F.col("fact_items"))
    # an empty review queue is an answer too
    items = F.when(F.col("tool") == "review_queue", F.coalesce(items, F.lit(0).cast("bigint"))).otherwise(items)
    ok = F.col("has_fact") | F.col("matches").isNotNull() | (F.col("tool") == "review_queue")
    return shown.select("question_id", "tool", ok.alias("answered"), F.col("fact_total").alias("total"), items.cast("bigint").alias("items"))

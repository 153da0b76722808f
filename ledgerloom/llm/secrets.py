"""Secret scan with column functions only: key patterns, and sliding-window entropy per character class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order. A failing match of `assign` still takes its characters, so its
#: value is tested after matching; a failing match of the others ends where its run ends, so the bound can stand in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
HEX_RUN = r"[0-9a-fA-F]{20,}"  # inside a candidate
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
WINDOW = 20  # characters
HEX_BITS, BASE64_BITS = 3.0, 3.7  # least entropy of a window, bits a character
#: Candidates, and hex runs in them, that are not secrets.
ALLOWED = [
    r"^[^0-9]+$",  # words, paths, rules
    r"^[0-9=_+/-]+$",  # numbers
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709"
    r"|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",  # digests of nothing
]
#: A part of a candidate, between separators, with one of these words or rows of signs is no secret; the other parts may be.
WORDS = "example|sample|dummy|placeholder|changeme"
ROWS = "0123456789abcdef|abcdefghijklmnop"
PART = "[^/=_-]+|[/=_-]"
#: A long part with such a word is a key made up as an example: nothing of its candidate is a secret.
MADE_UP = f"(?i)(?<![^/=_-])(?=[^/=_-]{{16}})[^/=_-]*?(?:{WORDS})"
SCALE = 1 << 30
STRETCH = 256  # windows of a candidate that one scan covers
STEP = 1000  # matches of a text whose places are summed up together
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _places(parts: Column) -> Column:
    """Start of each (gap, size) part's match: running sums over runs of STEP parts, so the work stays near linear."""
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STEP).cast("int")), lambda i: F.slice(parts, i * STEP + 1, STEP)
    )

    def summed(items: Column, begin: Column, first, width) -> Column:
        """Starts of the items when the first begins at `begin`."""
        seed = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            items, seed, lambda acc, x: F.struct((acc["at"] + width(x)).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + first(x))).alias("starts"))
        )["starts"]

    total = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
    begins = summed(total, F.lit(0), lambda x: F.lit(0), lambda x: x)
    return F.flatten(F.zip_with(runs, begins, lambda run, at: summed(run, at, lambda x: x["gap"], lambda x: x["gap"] + x["size"])))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches: start and end in code points, the match, and one of its groups."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    parts = F.zip_with(
        F.slice(gaps, 1, F.size(found)), F.zip_with(found, values, lambda m, v: F.struct(m.alias("text"), v.alias("value"))),
        lambda gap, m: F.struct(gap.alias("gap"), F.char_length(m["text"]).alias("size"), m["value"].alias("value")),
    )
    named = F.zip_with(
        parts, _places(parts),
        lambda p, at: F.struct(at.alias("start"), (at + p["size"]).alias("end"), p["value"].alias("value")),
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), named).otherwise(empty)


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hot_ends(codes: Column, first: Column, ceiling: Column) -> Column:
    """Ends of the hot windows that end at character `first` (from 1) or one of the STRETCH - 1 after it.

    The scan starts WINDOW characters earlier with empty counts, so each stretch stands on its own.
    """
    table = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0).cast("long") for c in range(WINDOW + 2)])
    begin = F.greatest(first - WINDOW, F.lit(1))
    seed = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("ends")
    )

    def slide(acc, i):
        full = i - begin >= WINDOW  # a character leaves
        enters, leaves = F.get(codes, i - 1), F.when(full, F.get(codes, i - WINDOW - 1)).otherwise(F.lit(len(ALPHABET)))
        grown = F.transform(acc["counts"], lambda c, j: c + (j == enters).cast("int") - ((j == leaves) & full).cast("int"))
        old_in, old_out = F.get(acc["counts"], enters), F.get(acc["counts"], leaves)
        change = F.get(table, old_in + 1) - F.get(table, old_in) + F.when(full, F.get(table, old_out - 1) - F.get(table, old_out)).otherwise(0)
        total = acc["sum"] + F.when(full & (enters == leaves), F.lit(0)).otherwise(change)
        hot = (i >= first) & (i >= WINDOW) & (total <= ceiling)
        return F.struct(grown.alias("counts"), total.alias("sum"), F.when(hot, F.concat(acc["ends"], F.array(i))).otherwise(acc["ends"]).alias("ends"))

    return F.aggregate(F.sequence(begin, F.least(first + STRETCH - 1, F.size(codes))), seed, slide)["ends"]


def hot_windows(value: Column, bits: Column) -> Column:
    """(start, end) ranges of `value` covered by windows whose entropy is at least `bits`.

    The window slides by one character; its counts and the sum of c*log2(c) change by the character that
    enters and the one that leaves. The sum is kept in whole numbers, so it does not drift. The characters are numbered once, the
    scan runs in stretches, and ranges are formed from the ends of hot windows afterwards: the work for a character does not
    depend on the length of the value.
    """
    ceiling = F.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE).cast("long")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def ranges(ends):
        # a range begins where a hot window does not touch the one before
        begins = F.filter(
            F.sequence(F.lit(0), F.size(ends) - 1), lambda k: (k == 0) | (F.get(ends, k) - F.get(ends, F.greatest(k - 1, F.lit(0))) > WINDOW)
        )

        def spans(at):
            return F.transform(
                at,
                lambda k, n: F.struct(
                    (F.get(ends, k) - WINDOW).alias("start"), F.get(ends, F.coalesce(F.get(at, n + 1), F.size(ends)) - 1).alias("end")
                ),
            )

        return F.when(F.size(ends) > 0, _let(begins, spans)).otherwise(none)

    def scanned(numbers):
        stretches = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(STRETCH))
        return _let(F.flatten(F.transform(stretches, lambda first: _hot_ends(numbers, first, ceiling))), ranges)

    return F.when(F.char_length(value) >= WINDOW, _let(codes, scanned)).otherwise(none)


def _masked(value: Column) -> Column:
    """`value` with every part that the allow-list names replaced by as many dashes, so that no window is hot by it."""
    named = f"(?i){WORDS}|{ROWS}"
    parts = F.regexp_extract_all(value, F.lit(PART), F.lit(0))
    kept = F.transform(parts, lambda p: F.when(p.rlike(named), F.repeat(F.lit("-"), F.char_length(p))).otherwise(p))
    return F.when(value.rlike(named), F.array_join(kept, "")).otherwise(value)


def _entropy_spans(candidates: Column, base: Column) -> Column:
    """Hot ranges of candidates outside the base spans, without the parts that the allow-list names.

    A candidate that is all hex digits is held against HEX_BITS. Any other is held against BASE64_BITS, and so are its
    runs of hex digits against HEX_BITS, each without its own allow-list entries.
    """
    suspect = F.filter(candidates, lambda c: ~_allowed(c["value"]) & ~c["value"].rlike(MADE_UP))

    def placed(hot, start, kind):
        return F.transform(hot, lambda h: F.struct((start + h["start"]).alias("start"), F.lit(kind).alias("kind"), (start + h["end"]).alias("end")))

    def ranges(c):
        def of(value):
            runs = F.filter(_matches(value, HEX_RUN), lambda r: ~_allowed(r["value"]))
            by_hex = F.flatten(F.transform(runs, lambda r: placed(hot_windows(r["value"], F.lit(HEX_BITS)), c["start"] + r["start"], 3)))
            whole = F.when(value.rlike("^[0-9a-fA-F]+$"), F.array().cast(SPANS)).otherwise(
                placed(hot_windows(value, F.lit(BASE64_BITS)), c["start"], 4)
            )
            return F.concat(by_hex.cast(SPANS), whole.cast(SPANS))

        return _let(_masked(c["value"]), of)

    spans = F.flatten(F.transform(suspect, ranges))
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))


def _allowed(value: Column) -> Column:
    test = F.lit(False)
    for pattern in ALLOWED:
        test = test | value.rlike(pattern)
    return test


def find(docs: DataFrame) -> DataFrame:
    """`docs` (with `text`) plus `secrets`: spans (start, kind, end) in code points, by start, kind and end.

    kind is an index into KINDS. The base kinds are the leftmost matches of their patterns; the entropy kinds
    are the hot ranges of long candidate strings and of the hex runs in them, but for those inside a base span. The allow-list takes out the
    parts between separators that hold its words, and not what else a candidate holds. A null or empty text has
    none; texts are scanned whole; rows and other columns stay as they are (a column `secrets` is replaced).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("secrets").withColumns(
        {
            "_assign": F.filter(_matches(text, ASSIGN, 2), lambda m: F.char_length(m["value"]) >= ASSIGN_VALUE),
            "_access": _matches(text, ACCESS), "_hex": _matches(text, HEX), "_long": _matches(text, CANDIDATE),
        }
    )
    rows = rows.withColumn("_base", F.concat(_spans(F.col("_assign"), 0), _spans(F.col("_access"), 1), _spans(F.col("_hex"), 2)))
    rows = rows.withColumn("secrets", F.array_sort(F.concat("_base", _entropy_spans(F.col("_long"), F.col("_base")))).cast(SPANS))
    return rows.drop("_assign", "_access", "_hex", "_long", "_base")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each run of overlapping secret spans in `text` replaced by `mark` (`n_chars` renewed where it is a column)."""
    found = find(docs)
    seed = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc, s):
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.coalesce(s["start"] < last["end"], F.lit(False)), joined).otherwise(
            F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        )

    found = found.withColumn("_cuts", F.aggregate("secrets", seed, merge))
    cuts, text = F.col("_cuts"), F.col("text")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(cuts)),
        lambda i: F.substring(
            text, F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0)) + 1,
            F.coalesce(F.get(cuts, i)["start"], F.char_length(text)) - F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0)),
        ),
    )
    found = found.withColumn("_text", F.when(F.size("_cuts") > 0, F.array_join(pieces, mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.size("_cuts") > 0, size).otherwise(F.col("n_chars")))
    return found.withColumn("text", F.col("_text")).select(*docs.columns)

"""Fill-in-middle against a plain tokenisation, exact round trips, and the skip list against prefix sums."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import middles


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab Z\n0é漢😀<S>", max_size=300))
def test_skip_list_against_sums(text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    starts, n = middles.unit_starts(text)
    lanes = middles.SkipList(starts, n)
    assert n == len(text) and lanes.units == len(units)
    for rank in range(len(units) + 1):
        assert lanes.code_point(rank) == len("".join(units[:rank]))


def test_lanes_grow_with_the_logarithm():
    starts, n = middles.unit_starts("a1 " * 200_000)
    lanes = middles.SkipList(starts, n)
    assert 6 <= len(lanes.lanes) <= 14
    assert all(len(up[0]) < 0.3 * len(low[0]) + 20 for low, up in zip(lanes.lanes, lanes.lanes[1:], strict=False))
    assert lanes.code_point(500_000) == int(starts[500_000])


TEXTS = [
    None, "", " ", "a", "<", "one two three", "x<P>y", "<S>", "a<M>", "é漢😀 mixed ab12", "<<P <S >M> < P>", "line\r\nline z\x00q",
    "word " * 40_000, "w" * 100_000, "ab<", ">ab", "same", "same",
]


def test_rows_against_plain(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id here"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit(1), "output": F.lit("old"), "_h": F.lit(0), "other": F.lit("x")})
    made = middles.transform(docs).withColumn("back", middles.restored(F.col("form"), F.col("output"))).collect()
    got = sorted(((r.doc_id, r.text, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=repr)
    assert got == sorted(((d, t, *plain(d, t)) for d, t in rows), key=repr)
    assert all(r.back == (r.text or "") and r.other == "x" for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert middles.transform(empty).collect() == []


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_every_cut_comes_back(spark, form):
    text = "<a< b>>c é<S"
    starts, n = middles.unit_starts(text)
    h3 = 0 if form == "spm" else 50
    rows = [(form, middles.arranged(text, [a, b, 0, h3])[4]) for a in range(len(starts) + 1) for b in range(len(starts) + 1)]
    frame = spark.createDataFrame(rows, "form string, output string")
    assert frame.select(middles.restored(F.col("form"), F.col("output")).alias("t")).distinct().collect() == [(text,)]

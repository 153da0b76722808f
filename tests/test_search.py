"""Substring search against a scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.operators import routing, search


def case(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    # one window, `zzz`, stands in every text of owner 1, who holds most of them
    texts = [(1, "zzz " + word(rng.randint(0, 12)), word(rng.randint(0, 6))) for _ in range(300)]
    texts += [(o, word(rng.randint(0, 12)), rng.choice([None, word(3)])) for o in (2, 3) for _ in range(40)] + [texts[0], (1, "zzzzzz", "zzz"), (4, None, None), (4, "", "")]
    needles = [(o, word(rng.randint(1, 6))) for o in (1, 2, 3, 4, 5) for _ in range(25)] + [(1, "zzz"), (1, "zz"), (1, "z"), (1, "zzz a"), (2, "zzz"), (1, ""), (1, None), (1, "é" * 50)]
    return texts, needles


@pytest.mark.parametrize("part_texts", [7, 100_000])
@pytest.mark.parametrize("whole_index", [False, True])
def test_against_a_scan(spark, part_texts, whole_index):
    texts, needles = case(part_texts)
    frame = search.numbered(spark.createDataFrame(texts, "owner_id long, m string, d string"), "m", "d").distinct()
    asked = spark.createDataFrame(needles, "owner_id long, needle string")
    index = search.gram_index(frame, ["m", "d"], None if whole_index else asked, part_texts)
    found = search.candidates(asked, index).join(frame, ["owner_id", "text_id"]).filter(F.contains("m", "needle") | F.contains("d", "needle"))
    got = sorted(((r.owner_id, r.needle, r.m, r.d) for r in found.collect()), key=repr)
    want = {(o, n, m, d) for o, n in needles if n for p, m, d in texts if o == p and (n in (m or "") or n in (d or ""))}
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("limits", [{}, {"part_chars": 9, "slice_texts": 7}])
def test_scan(spark, limits):
    texts, needles = case(3)
    frame = spark.createDataFrame(texts, "owner_id long, m string, d string").withColumn("needles", F.lit("own"))
    found = search.scan(frame, spark.createDataFrame(needles, "owner_id long, needle string"), ["m", "d"], **limits)
    assert found.columns == ["owner_id", "m", "d", "needles", "needle", "in_m", "in_d"]
    got = sorted(((r.owner_id, r.m, r.d, r.needle, r.in_m, r.in_d) for r in found.collect()), key=repr)
    want = [
        (o, m, d, n, n in (m or ""), n in (d or ""))
        for o, m, d in texts for p, n in set(needles) if p == o and n and (n in (m or "") or n in (d or ""))
    ]
    assert got == sorted(want, key=repr)
    assert search.scan(frame, found.limit(0), ["m"]).count() == search.scan(frame.limit(0), spark.createDataFrame(needles, "owner_id long, needle string"), ["m"]).count() == 0


def test_a_window_in_every_text(spark):
    """A window of all texts is cut into numbered lists, and a needle that holds it is looked up by a rarer one."""
    texts = search.numbered(spark.range(5000).select(F.lit(1).cast("long").alias("owner_id"), F.concat(F.lit("zzz"), F.col("id")).alias("m")), "m")
    index = search.gram_index(texts, ["m"], part_texts=100).cache()
    lists = index.filter("gram = 'zzz'").agg(F.count("*"), F.max(F.size("text_ids")), F.sum(F.size("text_ids"))).first()
    assert lists[0] == 50 and lists[1] < 200 and lists[2] == 5000
    needle = spark.createDataFrame([(1, "zzz4999"), (1, "zzzq")], "owner_id long, needle string")
    best = search.rarest_grams(needle, index).collect()
    assert [r.needle for r in best] == ["zzz4999"] and best[0].texts <= 20
    assert search.candidates(needle, index).count() <= 20


def test_empty(spark):
    none = spark.createDataFrame([], "owner_id long, text_id long, m string")
    asked = spark.createDataFrame([(1, "a")], "owner_id long, needle string")
    assert search.candidates(asked, search.gram_index(none, ["m"], asked)).count() == 0
    assert search.candidates(asked.limit(0), search.gram_index(none, ["m"])).count() == 0


def test_search_counts(spark):
    ledger = spark.createDataFrame(
        [(1, "a", "2024-25", "Café Uno", "PAID x"), (1, "b", "2024-25", "Café Uno", "PAID x"), (1, "c", "2025-26", None, "café again"), (2, "d", "2024-25", "Café", None)],
        "owner_id long, txn_id string, fy_key string, merchant string, raw_description string",
    )
    asked = spark.createDataFrame(
        [(1, 1, "café", None, False), (2, 1, "café", "2024-25", False), (3, 1, "café", None, True), (4, 1, "zzz", None, False), (5, 2, "C_A%f", None, False), (6, 1, "x", None, True), (7, 1, "x", None, False), (8, 1, "%", None, False)],
        "question_id long, owner_id long, merchant string, fy string, merchant_only boolean",
    )
    got = {r.question_id: r.matches for r in routing.search_counts(asked, ledger).collect()}
    assert got == {1: 3, 2: 2, 3: 2, 5: 1, 7: 2}


def test_only_windows_that_are_asked_for_become_rows(spark):
    """Lists of windows of any size give the index that the whole one, cut to those windows, gives; null and empty needles ask for nothing."""
    texts = search.numbered(spark.createDataFrame([(1, "blue gear"), (1, "gear gear"), (2, "old ring"), (None, "blue")], "owner_id long, d string"), "d")
    needles = spark.createDataFrame([(1, "gear"), (1, "e"), (1, ""), (1, None), (2, "gear"), (2, "ri"), (None, "blue")], "owner_id long, needle string")
    rows = lambda df: sorted((r.owner_id, r.gram, sorted(r.text_ids)) for r in df.collect())
    wanted = {(o, g) for o, grams in ((1, ["gea", "ear", "e"]), (2, ["gea", "ear", "ri"])) for g in grams}
    want = [r for r in rows(search.gram_index(texts, ["d"])) if r[:2] in wanted]
    index = search.gram_index(texts, ["d"], needles)
    assert rows(index) == want
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "array_intersect" in plan
    was, search.LIST_WINDOWS = search.LIST_WINDOWS, 1
    try:
        assert rows(search.gram_index(texts, ["d"], needles)) == want
    finally:
        search.LIST_WINDOWS = was


def test_scan_hands_back_the_columns_that_are_kept(spark):
    """Hits of all texts, null, empty and repeated ones too, without the text itself where only the owner is asked for."""
    texts = spark.createDataFrame([(1, "blue gear"), (1, "blue gear"), (1, None), (1, ""), (2, "old ring"), (None, "blue")], "owner_id long, d string")
    needles = spark.createDataFrame([(1, "gear"), (1, "e"), (1, ""), (2, "gear"), (2, "ri"), (2, None)], "owner_id long, needle string")
    kept = search.scan(texts, needles, ["d"], keep=["owner_id"])
    assert kept.columns == ["owner_id", "needle", "in_d"]
    whole = search.scan(texts, needles, ["d"])
    assert sorted(map(tuple, kept.collect())) == sorted((r.owner_id, r.needle, r.in_d) for r in whole.collect()) == sorted(
        [(1, "gear", True), (1, "e", True)] * 2 + [(2, "ri", True)]
    )


@pytest.mark.parametrize("windows", [1, 4_096])
def test_rarest_windows_from_lists_of_counts(spark, monkeypatch, windows):
    """Counts in lists of any size tell the rarest window; a window of no text, null and unknown owners find nothing."""
    monkeypatch.setattr(search, "LIST_WINDOWS", windows)
    texts = search.numbered(spark.createDataFrame([(1, "blue gear"), (1, "gear"), (1, "blue"), (2, "old ring"), (None, "blue")], "owner_id long, m string"), "m")
    asked = spark.createDataFrame([(1, "gear"), (1, "e"), (1, "e gear"), (1, "zgear"), (1, None), (2, "ring"), (2, "blue"), (3, "blue"), (None, "blue")], "owner_id long, needle string")
    whole = search.gram_index(texts, ["m"])
    best = search.rarest_grams(asked, spark.createDataFrame(whole.collect(), whole.schema))
    assert best.columns == ["owner_id", "needle", "gram", "texts"] and best.schema["texts"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, best.collect())) == [(1, "e", "e", 3), (1, "e gear", " ge", 1), (1, "gear", "ear", 2), (2, "ring", "ing", 1)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == plan.count("Generate explode(sequence(") == 1


def test_texts_and_needles_are_put_together_once(spark):
    found = entry.queries()["search_index"](spark, "/root/testdata/sf0.001")
    assert not any(f.endswith("/lineitem.parquet") for f in found.inputFiles())

"""The k-d tree against a plain one that sorts, and what a shard layout must hold."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import sharding


def documents(n, seed=1):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        size = int(2 ** rng.uniform(0, 9))
        made.append((i, "".join(rng.choice("abcdé ") for _ in range(size)), rng.choice(["en", "fr", "de", None]), rng.choice(["web", "web", "web", "book"])))
    return made


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def laid_out(spark, rows, **options):
    got = sharding.shard(frame(spark, rows), **options).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def weights(got, shards):
    found = Counter({i: 0 for i in range(shards)})
    for r in got:
        found[r.shard] += r["size"]
    return found


def plain_tree(points, first, leaves, whole):
    """{tie: shard} by sorting; points: (values by dimension, tie, weight)."""
    if leaves == 1 or not points:
        return {p[1]: first for p in points}
    spread = [(max(p[0][d] for p in points) - min(p[0][d] for p in points)) / whole[d] for d in range(4)]
    d = max(range(4), key=lambda x: (spread[x], -x))
    points = sorted(points, key=lambda p: (p[0][d], p[1]))
    goal = sum(p[2] for p in points) * (leaves // 2) / leaves
    under = 0
    for cut, p in enumerate(points):
        if under + p[2] >= goal:
            if under + p[2] - goal <= goal - under:
                cut += 1
            break
        under += p[2]
    low, high = points[:cut], points[cut:]
    return plain_tree(low, first, leaves // 2, whole) | plain_tree(high, first + leaves // 2, leaves - leaves // 2, whole)


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_tree_against_sorting(spark, shards):
    rows = sharding.measured(frame(spark, documents(600)))
    _, table = sharding.points(rows, 1e18)
    table = table.cache()
    tree = sharding.grow(table, shards, slack=0.0)
    got = {r.tie: r.shard for r in table.select("tie", tree.shard().alias("shard")).collect()}
    points = [([r[d] for d in sharding.DIMENSIONS], r.tie, r.weight) for r in table.collect()]
    whole = [(max(p[0][d] for p in points) - min(p[0][d] for p in points)) or 1.0 for d in range(4)]
    assert got == plain_tree(points, 0, shards, whole)


def test_shards_are_near_equal(spark):
    rows = documents(2000)
    got = laid_out(spark, rows, shards=8)
    found = weights(got, 8)
    largest = max(r["size"] for r in got)
    assert max(found.values()) - min(found.values()) <= 4 * largest
    again = laid_out(spark, list(reversed(rows)), shards=8)
    assert {r.doc_id: r.shard for r in got} == {r.doc_id: r.shard for r in again}


def test_few_copies_stay_together_and_many_are_split(spark):
    rows = documents(1500)
    texts = [t for _, t, *_ in rows[:40]]
    rows += [(2000 + i, t, "fr", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(5000 + i, "one text that a third of all rows repeat", "en", "hot") for i in range(2500)]
    rows += [(None, "a row that comes again and again", None, None)] * 900
    got = laid_out(spark, rows, shards=10)
    found = weights(got, 10)
    mean = sum(found.values()) / 10
    assert max(found.values()) < 1.05 * mean and min(found.values()) > 0.95 * mean
    copies = defaultdict(set)
    for r in got:
        if r.doc_id is not None and (r.doc_id < 40 or 2000 <= r.doc_id < 2040) and r["size"] > 60:
            copies[(r.text_crc32, r["size"])].add(r.shard)
    assert copies and all(len(s) == 1 for s in copies.values())
    assert len({r.shard for r in got if r.doc_id is None}) > 1


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, "", "", ""), (2, "a", None, "x"), (2, "a", None, "x"), (-(1 << 62), "é" * 50_000, "en", "s")]
    assert max(weights(laid_out(spark, rows, shards=3), 3).values()) == 100_016
    assert len(laid_out(spark, [(7, "same", "en", "s")] * 20, shards=4)) == 20
    assert laid_out(spark, rows[:1])[0].slot == 0
    assert sharding.shard(frame(spark, rows).limit(0)).collect() == []
    clashing = frame(spark, rows).withColumns({"size": F.lit("x"), "cell": F.lit(1), "shard": F.lit(2), "tie": F.lit(3), "digest": F.lit(4)})
    assert sharding.shard(clashing, shards=3).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sharding.shard(clashing, shards=3).count() == 6
    assert sharding.shard(frame(spark, rows).select("doc_id", "text"), shards=3).count() == 6


def test_equal_rows_are_split_evenly(spark):
    found = weights(laid_out(spark, [(7, "same", "en", "s")] * 400, shards=4), 4)
    assert max(found.values()) - min(found.values()) <= 20 * 3 and math.fsum(found.values()) == 8000

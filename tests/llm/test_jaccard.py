import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import jaccard
from ledgerloom.llm.components import components
from tests.llm.test_simhash import plain_fingerprint

SCHEMA = "doc_id long, text string, extra string"


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def plain_kept(rows):
    """Smallest id of each component over all pairs."""
    sets = [(d, plain_set(t)) for d, t, *_ in rows]
    to = list(range(len(rows)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            if alike(a, sets[j][1]):
                to[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "one", "ONE", "two words", "a b c d e f"]
    for n in [*range(20, 200, 12), 1500]:
        base = [rng.choice(words) for _ in range(n)]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.05, 0.1):
            c = list(base)
            for _ in range(max(1, round(n * share))):
                c[rng.randrange(n)] = rng.choice(words)
            texts.append("\n".join(c))
    group = [rng.choice(words) for _ in range(150)]  # a large group of near copies
    for _ in range(150):
        c = list(group)
        c[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(c))
    rng.shuffle(texts)
    return [(i, t, "x") for i, t in enumerate(texts)]


def test_near_dedup_stage_against_all_pairs(spark):
    rows = corpus()
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert out.columns == ["doc_id", "text", "extra"]
    assert sorted(r.doc_id for r in out.collect()) == plain_kept(rows)


def test_copies_with_an_edited_word_go(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    copy = [*base[:30], "edited", *base[31:]]
    rows = [(1, " ".join(base), "x"), (2, " ".join(copy), "x")]
    assert alike(plain_set(rows[0][1]), plain_set(rows[1][1]))
    assert bin(plain_fingerprint(rows[0][1]) ^ plain_fingerprint(rows[1][1])).count("1") > 4  # beyond op5's radius
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [1]


def test_close_fingerprints_go(spark):
    """Texts that SimHash links go too, also over a chain of both kinds of links."""
    run = "again " * 200
    tails = [" ".join(f"t{i}x{j}" for j in range(40)) for i in range(2)]
    far = " ".join(f"t1x{j}" for j in range(40)) + " again" * 9
    rows = [(5, run + tails[0], "x"), (4, run + tails[1], "x"), (3, far, "x"), (8, "nothing like the others here", "x")]
    sets = [plain_set(t) for _, t, _ in rows]
    assert not alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    assert bin(prints[0] ^ prints[1]).count("1") <= 4 < bin(prints[1] ^ prints[2]).count("1")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == [3, 8]


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(None, "nobody has this text at all", "a"), (None, "nobody has this  text at all", "b"), (None, long, "c"), (7, long + " end", "d"), (7, "other", "e"), (9, "OTHER", "f")]
    out = jaccard.representatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text.split()[0]) for r in out)[0] == (0, "nobody")
    assert len([r for r in out if r.doc_id is None]) == 1 and {r.doc_id for r in out} == {None, 7}
    assert jaccard.representatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_units_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.choice(1 << 40, 400, replace=False)
    sets = []
    for _ in range(120):  # around 0.8 to each other
        sets.append(np.unique(np.concatenate([rng.choice(base, rng.integers(300, 400), replace=False), rng.integers(1 << 41, 1 << 42, rng.integers(0, 60))])))
    sets += [np.array([1]), np.array([1]), np.array([2, 3]), np.arange(5)]
    roots = np.arange(len(sets))
    roots[:20] = 0

    def joined(pairs, crossing=None):
        to = roots.copy()
        for a, b in pairs:
            if crossing is None or crossing[a] != crossing[b]:
                to[to == to[a]] = to[b]
        return {frozenset(np.flatnonzero(to == r).tolist()) for r in set(to.tolist())}

    every = [(a, b) for a in range(len(sets)) for b in range(a) if (c := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9]
    one_side = np.zeros(len(sets), np.int64)
    got = list(zip(*jaccard.unit_links(sets, roots, one_side, 0.8), strict=True))
    assert set(map(frozenset, got)) <= set(map(frozenset, every)) and len(got) < len(sets)
    assert joined(got) == joined(every) and 1 < len(joined(every)) < len(sets) - 19
    sides = np.arange(len(sets)) % 2
    assert joined(zip(*jaccard.unit_links(sets, roots, sides, 0.8), strict=True)) == joined(every, sides)


def test_many_small_units_find_the_same(spark):
    """Hot slots cut into many blocks: components as with one block a slot, and as by all pairs."""
    rows = corpus(9)
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = docs.select("doc_id", "text").mapInArrow(jaccard._signatures(5), "doc_id long, bits long, size long, bands array<long>")
    nodes = prints.groupBy("bits").agg(F.min("doc_id").alias("least_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    found = [components(jaccard.links(docs, nodes, 5, 0.8, unit)).groupBy("root").agg(F.count("*").alias("n")).collect() for unit in (500_000, 300)]
    assert sorted(map(tuple, found[0])) == sorted(map(tuple, found[1])) and max(n for _, n in found[0]) > 100

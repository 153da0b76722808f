import random

import numpy as np
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components

SCHEMA = "doc_id long, text string, bits long, component_id string"


def plain_fingerprint(text):
    import re

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    """prints: list of (doc_id, bits); all pairs."""
    to = list(range(len(prints)))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= distance:
                to[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, bits, least.get(root(i))) for i, (doc, bits) in enumerate(prints)), key=repr)


def unsigned(x):
    return x % (1 << 64)


def got(df, **options):
    return sorted(((r.doc_id, unsigned(r.bits), r.component_id) for r in simhash.near_duplicates(df, **options).collect()), key=repr)


def documents(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    texts = [None, "", " \t\n", "one", "ONE", "two words", "two  words", "é É", "x" * 5000]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(6):
            c = list(b)
            c[rng.randrange(len(c))] = "changed"
            texts.append("\n".join(c))
    rows = [(i, t, i, "extra") for i, t in enumerate(texts)]
    return [*rows, (5, "two words", 0, None), (None, " ".join(base[0]), 0, "y"), (None, "nobody else here", 1, "y")]


def test_against_all_pairs(spark):
    rows = documents()
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == want
    assert got(df, bucket_rows=3) == want  # the path for hot block values


def test_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    bits = [int(b) for b in base]
    for b in base[:20]:
        for _ in range(8):
            x = int(b)
            for place in rng.choice(63, rng.integers(1, 6), replace=False):
                x ^= 1 << int(place)
            bits.append(x)
    bits = sorted(set(bits))
    df = spark.createDataFrame([(b,) for b in bits], "bits long")
    want = {(b, c) for b, _, c in plain_components([(b, b) for b in bits])}
    for limit in (2, 10_000):
        found = components(simhash.links(df, bucket_rows=limit)).collect()
        mine = {r.node: r.root for r in found}
        assert {(b, mine.get(b, b)) for b in bits} == want


def test_components_of_a_path_and_nothing(spark):
    path = spark.range(0, 60).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.root) for r in components(path).collect()} == {(i, 0) for i in range(61)}
    assert components(path.where("a < 0")).count() == 0
    assert components(spark.createDataFrame([(3, 3), (None, 2)], "a long, b long")).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.representatives(df).count() == 0


def test_representatives_keep_one_row_of_each_component(spark):
    rows = documents()
    rows += [(5, documents()[20][1], 0, None), (None, "nobody else  here", 2, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    classes = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    named = sorted({c for _, _, c in classes if c is not None})
    out = simhash.representatives(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == named
    assert [r.text.split() for r in kept if r.doc_id is None] == [["nobody", "else", "here"]]

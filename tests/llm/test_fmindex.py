import random
import re

import numpy as np

from ledgerloom.llm import fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, window):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        spans = [m.span() for m in WORD.finditer(lower(text))]
        w = [lower(text)[a:b] for a, b in spans]
        hit, owners = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    owners |= {str(x) for x in windows[tuple(w[i : i + size])] if x is not None}
        cut, at = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                cut += (text or "")[at : spans[i][0]]
            at = spans[i][1]
        out.append((doc, len(w), len(hit), tuple(sorted(owners)), cut + (text or "")[at:] if text is not None else None))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    words = ["a", "b", "Ça", "été", "d4", "zz", "Q"]
    def line(n):
        return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 3, 5, 9]))) for i in range(6)] + [(None, line(5)), (7, None), (8, "?!"), (2, line(4))]
    docs = [(i, line(rng.choice([0, 2, 30, 200]))) for i in range(25)] + [(3, items[3][1]), (None, items[4][1]), (99, None), (100, "\U0001f600 été")]
    return docs, items


def test_against_every_window(spark):
    for seed in range(3):
        docs, items = case(seed)
        df = spark.createDataFrame([(d, t, 0, "c") for d, t in docs], "doc_id long, text string, n_chars long, contamination string").repartition(3)
        bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
        want = plain(docs, items, 4)
        for options in ({}, {"shard_words": 50}, {"block_bytes": 20}):
            found = fmindex.find(df, bench, window=4, **options)
            got = [
                (r.doc_id, r.contamination.n_words, sum(h.words for h in r.contamination.hits), tuple(sorted(r.contamination["items"])))
                for r in found.collect()
            ]
            assert sorted(got, key=repr) == [w[:4] for w in want]
            cut = fmindex.decontaminated(df, bench, window=4, **options)
            assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == sorted(((w[0], w[4]) for w in want), key=repr)
            assert cut.columns == df.columns
            assert {r.contamination for r in cut.collect()} == {"c"}  # the documents' own column stays


def test_blocks_in_the_shared_folder(spark):
    """A block holds a bounded share of the benchmark, and the plan one pass whatever their number."""
    _, items = case(5)
    bench = spark.createDataFrame([(i, f"{t} {n}") for n in range(40) for i, t in items], "item_id long, text string")
    folder, blocks = fmindex.phrase_blocks(bench, 500)
    sizes = [sum(len(text) for text in fmindex.read_phrases(folder, b, 4).words) for b in range(blocks)]
    assert blocks > 5 and max(sizes) <= 1500
    docs = spark.createDataFrame([(1, items[3][1])], "doc_id long, text string")
    plan = fmindex.find(docs, bench, window=4, block_bytes=500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_window_owners():
    phrases = fmindex.Phrases([("a", b"x y z x y"), ("b", b"x y"), (None, b"z x"), ("c", b"?!")], 2)
    spelled = {tuple(phrases.words[i] for i in row): phrases.items_of(2, n) for n, row in enumerate(phrases.rows[2])}
    assert spelled == {(b"x", b"y"): ["a", "b"], (b"y", b"z"): ["a"], (b"z", b"x"): ["a"]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = fmindex.find(docs, none).first()
    assert (row.contamination.n_words, row.contamination.hits, row.contamination["items"]) == (2, [], [])
    assert fmindex.find(docs.limit(0), none).count() == 0
    assert fmindex.decontaminated(docs, none).collect() == docs.collect()


def test_suffix_array_and_rank():
    rng = np.random.default_rng(0)
    for top in (1, 2, 5, 300):
        symbols = rng.integers(0, top + 1, 700)
        symbols[100:300] = symbols[300:500]
        symbols[-1] = 0
        keys = [[(0, i) if s == 0 else (1, int(s)) for i, s in enumerate(symbols)][i:] for i in range(len(symbols))]
        assert fmindex.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: keys[i])
        tree = fmindex.WaveletMatrix(symbols, top)
        at, which = rng.integers(0, 701, 200), rng.integers(0, top + 1, 200)
        assert tree.rank(which, at).tolist() == [int((symbols[:a] == s).sum()) for a, s in zip(at, which, strict=True)]

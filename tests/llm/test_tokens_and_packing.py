import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(4)
    letters = list("abcXYZ éÉßñÑçÿ'’\"!?.,-_0129\n\t\x0b\x1c\x00\x85\xa0 «»…€ΣσİﬁǺ ẛ漢😀<|>") + ["'s", "'re", "<|endoftext|>", "  ", "the ", "don't "]
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    plain = list("abcde éÉßñ'.,!? \n01") + ["'s", "'ll ", "the ", "n't "]
    made += ["".join(rng.choice(plain) for _ in range(rng.randrange(200))) for _ in range(400)]
    return ["", " ", "'", "ΑΣ", "x" * 3000, *made]


def test_ids_are_the_tokenizers():
    tokenizer = Tokenizer.from_file(PATH)
    words = tokens.WordIds(PATH)
    for text in texts():
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == struct.pack(f"<{len(want)}I", *want), repr(text)


def test_pieces(spark):
    made = texts()[:60] + [None, "word " * 300]
    df = spark.createDataFrame([(i % 50, t, 3) for i, t in enumerate(made)], "doc_id long, text string, piece int").repartition(4)
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in enumerate(made):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((i % 50, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = [tuple(r) for r in tokens.pieces(df, PATH, 64).collect()]
    assert sorted(got) == sorted(want)


def check(rows, lengths, capacity):
    """Every piece once, sequences gapless from 0 and within the capacity; the number of sequences."""
    assert sorted(r.length for r in rows) == sorted(lengths)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset, r.length)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(x <= capacity for x in at.values())
    return len(at)


def test_pack(spark):
    rng = random.Random(2)
    lengths = [rng.choice([rng.randrange(1, 101), rng.randrange(1, 30), 100]) for _ in range(1500)]
    df = spark.createDataFrame([(i % 700, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, sequence_id string")
    least = math.ceil(sum(lengths) / 100)
    assert check(packing.pack(df, 100).collect(), lengths, 100) <= least + 1
    assert check(packing.pack(df, 100, block=64, generations=3).collect(), lengths, 100) <= least * 1.01 + 2
    big = [51] * 300  # no two fit together
    df = spark.createDataFrame([(i, n) for i, n in enumerate(big)], "doc_id long, length long")
    assert check(packing.pack(df, 100, block=32).collect(), big, 100) == 300
    assert packing.pack(df.limit(0), 100).count() == 0


def test_islands_improve_on_best_fit():
    rng = np.random.default_rng(7)
    lengths = np.sort(rng.integers(20, 60, 300))[::-1].astype(np.int64)
    options = {"population": 4, "generations": 60}
    start = packing.evolve(lengths, [], 100, 1, {**options, "generations": 0})
    end = packing.evolve(lengths, start, 100, 2, options)
    assert packing.fitness(lengths, end[0]) <= packing.fitness(lengths, start[0])
    for p in end:
        assert np.bincount(p, weights=lengths).max() <= 100 and set(p) == set(range(p.max() + 1))
    child = packing.crossover(lengths, start[0], start[-1], 100, rng)
    assert np.bincount(child, weights=lengths).max() <= 100 and len(child) == 300 and child.min() == 0

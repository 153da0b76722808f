import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers

from ledgerloom.llm import licenses, syncmers, wordpiece

DOC = "doc_id long, text string, n_chars string"


def plain_syncmers(text):
    code = [ord(c) for c in text]

    def poly(part):
        h = 0
        for c in part:
            h = (h * syncmers._BASE + c) % (1 << 64)
        return int(syncmers._mixed(np.array([h], np.uint64))[0])

    found = []
    for i in range(len(code) - 11):
        inner = [poly(code[i + j : i + j + 4]) for j in range(9)]
        if min(inner) in (inner[0], inner[8]):
            found.append((i, poly(code[i : i + 12])))
    return found


def plain_sketch(text):
    first = {}
    for place, h in plain_syncmers(text):
        first.setdefault(h, place)
    return [(h << 32) | p for h, p in sorted(first.items())[:48]]


def texts():
    rng = random.Random(8)
    return ["".join(rng.choice("abcd é漢😀") for _ in range(n)) for n in (1, 11, 12, 13, 40, 200, 900)] + ["a" * 100, "", "ab" * 60]


def test_sketches_against_every_kmer():
    made = syncmers.sketches(texts())
    for text, got in zip(texts(), made, strict=True):
        want = plain_sketch(text)
        assert got.tolist() == want or (not want and len(got) == bool(text))
    assert syncmers.sketches(texts()[4:5])[0].tolist() == made[4].tolist()  # neighbours don't matter


def test_likeness():
    a, b = syncmers.sketches([texts()[6], texts()[6] + texts()[5] + texts()[4]])
    assert syncmers.likeness(a, a) == 1 and 0.5 < syncmers.likeness(a, b) < 1
    none = np.zeros(0, np.uint64)
    assert syncmers.likeness(none, none) == 1 and syncmers.likeness(none, a) == 0
    turned = np.sort((a & np.uint64(0xFFFFFFFF00000000)) | np.uint64(900) - (a & np.uint64(0xFFFFFFFF)))
    assert syncmers.likeness(a, turned) < 0.1  # the same anchors the other way round


def test_compare(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10_000), rng.choice([*texts(), "x" * 500]), "x") for _ in range(150)]
    rows += [(None, "no id", None), (5, None, None), (10_001, "😀" * 31, None), (10_001, "same id", None)]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    order = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = syncmers.sketches([text, edited, after])
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), syncmers.written(own), syncmers.written(changed), syncmers.likeness(own, changed), syncmers.likeness(own, other)))
    got = [tuple(r) for r in syncmers.compare(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    one = syncmers.compare(df.where("doc_id = 5")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(0, 1.0)]
    assert syncmers.compare(df.limit(0)).count() == 0


def greedy(word, tokens):
    count, at = 0, 0
    data = b" " + word
    while at < len(data):
        size = max(n for n in range(1, min(len(data) - at, 130) + 1) if data[at : at + n] in tokens)
        at, count = at + size, count + 1
    return count


def test_token_counts_against_longest_match(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = {base64.b64decode(x.split()[0]) for x in open(path, "rb")}
    rng = random.Random(6)
    sample = sorted(t for t in tokens if b" " not in t)
    made = [b" ".join(b"".join(rng.choice(sample)[:9] for _ in range(rng.randrange(1, 6))) for _ in range(20)).decode("utf-8", "ignore") for _ in range(60)]
    made += [None, "", " \n", "the", "antidisestablishmentarianism" * 40, "=" * 300, "\x00é漢😀", "\xa0\x85"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(made)], "doc_id long, text string, n_tokens string")
    for r in wordpiece.token_counts(df, path).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (made[r.doc_id] or "").encode())
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(w, tokens) for w in words))
    assert wordpiece.token_counts(df.limit(0), path).count() == 0


def test_automaton_on_small_vocabularies():
    rng = random.Random(1)
    for _ in range(20):
        tokens = [bytes([b]) for b in range(256)] + [bytes(rng.choice(b"ab ") for _ in range(rng.randrange(2, 7))) for _ in range(12)]
        words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(50)]
        machine = wordpiece.Automaton(tokens)
        n, count = wordpiece.text_counts([b" ".join(words), *words], machine)
        want = [greedy(w, set(tokens)) for w in words]
        assert n.tolist() == [50] + [1] * 50 and count.tolist() == [sum(want), *want]


def plain_licenses(text):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda b: bytes(x + 32 if 65 <= x <= 90 else x for x in b)
    pairs = lambda b: (lambda w: set(zip(w, w[1:], strict=False)))(word.findall(lower(b)))
    data = (text or "").encode()
    out = {}
    for breaks in (*licenses.BREAKS, None):
        ends = [m.end() for m in breaks.finditer(data)] if breaks else []
        for a, b in zip([0, *ends], [*ends, len(data)], strict=True):
            mine = pairs(data[a:b])
            for name, template in licenses.TEMPLATES:
                theirs = pairs(template.encode())
                score = 2 * len(mine & theirs) / (len(mine) + len(theirs))
                if score >= licenses.LIKENESS:
                    out[name] = max(score, out.get(name, 0))
    return out


def test_licenses_against_all_templates(spark):
    rng = random.Random(9)
    notes = [t for _, t in licenses.TEMPLATES]
    made = [None, "", "word", "a b", "the the the the", *notes, "\n\n".join(notes)]
    for _ in range(120):
        words = rng.choice(notes).split()
        for _ in range(rng.randrange(0, max(1, len(words) // 4))):
            words[rng.randrange(len(words))] = rng.choice(["é", "the", "X", "license"])
        made.append(rng.choice(["", "Intro line.\n", "As said. ", "x\n \n"]) + rng.choice([" ", "  ", "\n"]).join(words) + rng.choice(["", "\nmore text here", " and so on"]))
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(made)], "doc_id long, text string, licenses string").repartition(2)
    for r in licenses.scan(df).collect():
        assert {x.license: x.score for x in r.licenses} == plain_licenses(made[r.doc_id]), made[r.doc_id]
        for x in r.licenses:
            assert plain_licenses(made[r.doc_id].encode()[x.start : x.end].decode())[x.license] == x.score
    assert licenses.scan(df.limit(0)).count() == 0

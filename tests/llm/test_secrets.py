import math
import random
import re

from ledgerloom.llm import secrets

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def passes(kind, m):
    return {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]()


def entropy(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in (window.count(x) for x in set(window)))


def plain(text):
    text = text or ""
    spans = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in p.finditer(text) if passes(k, m)]
    base = list(spans)
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text):
        if allowed(m[0]):
            continue
        parts = re.split("([/=_-])", m[0])
        if any(len(p) > 15 and re.search(secrets.WORDS, p, re.I) for p in parts):
            continue
        value = "".join("-" * len(p) if re.search(f"{secrets.WORDS}|{secrets.ROWS}", p, re.I) else p for p in parts)
        found = [(3, h.start(), h[0], secrets.HEX_BITS) for h in re.finditer("[0-9a-fA-F]{20,}", value) if not allowed(h[0])]
        if not re.fullmatch("[0-9a-fA-F]+", value):
            found.append((4, 0, value, secrets.BASE64_BITS))
        for kind, offset, run, bits in found:
            hot = set()
            for i in range(len(run) - 19):
                if entropy(run[i : i + 20]) >= bits - 1e-9:
                    hot |= set(range(i, i + 20))
            for a in sorted(i for i in hot if i - 1 not in hot):
                b = next(j for j in range(a, len(run) + 1) if j not in hot)
                a, b = a + m.start() + offset, b + m.start() + offset
                if not any(x <= a and b <= y for x, _, y in base):
                    spans.append((a, kind, b))
    return sorted(spans)


def allowed(value):
    return any(re.search(p, value) for p in secrets.ALLOWED)


PREFIXES = ["docs/sample/", "sample_key=", "path/example/", "example=", "x/dummy-", "changeme/0123456789abcdef="]


def cases():
    rng = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [
        None, "", "nothing here", 'token = "abc"', "PassWord:'hunter22' é token=token=abcdefgh", "secret:token :abcdefg",
        "\U0001f600\U0001f600 api_key: " + draw(b64, 30) + " é", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "AKIAXAKIA" + "0" * 20,
        "f" * 24 + " " + "f" * 23 + " " + draw("0123456789abcdef", 64), draw("0123456789ABCDEF", 40), draw(b64, 60) + "a" * 40 + draw(b64, 60),
        "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "x" * 60 + "1", "wordwordwordwordwordwordword",
        "example" + draw(b64, 40), "apikey=" + "ſ" * 3 + "paſſword=abcdefg", "k " * 3000 + draw(b64, 50) + " end" * 900,
        "passwd:abcdef," * 2500, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "0123456789abcdef/" + draw(b64, 40), "v=" + draw("0123456789ABCDEF", 40),
        draw(b64, 300) + "a" * 300 + draw(b64, 300), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "".join(draw(b64, 24) + "b" * 41 for _ in range(20)),
    ]
    texts += [prefix + draw("0123456789ABCDEF", 40) for prefix in PREFIXES] + [prefix + draw(b64, 40) for prefix in PREFIXES]
    for _ in range(30):
        texts.append(" ".join(draw(b64 + "=_- ", rng.randrange(60)) + rng.choice(["", " secret=", "AKIA", " token: '", "deadbeef"]) for _ in range(6)))
    return texts


def test_against_plain_scan(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, secrets string")
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secrets] for r in secrets.find(df).collect()}
    for i, t in enumerate(texts):
        assert found[i] == plain(t), (i, (t or "")[:80])
    names = secrets.find(df).select("doc_id", secrets.listed(secrets.F.col("secrets")).alias("spans")).collect()
    assert {r.doc_id: r.spans for r in names}[3] == ""


def test_redacted(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    out = {r.doc_id: r for r in secrets.redacted(df).collect()}
    for i, t in enumerate(texts):
        spans, want, at = plain(t), "", 0
        for a, _, b in spans:
            if a >= at:
                want += t[at:a] + "[SECRET]"
            at = max(at, b)
        want = want + t[at:] if t is not None else None
        assert out[i].text == want
        assert out[i].n_chars == (len(want) if spans else 0)
    assert secrets.redacted(df.limit(0)).count() == 0


def test_the_allow_list_does_not_swallow_a_neighbour(spark):
    rng = random.Random(6)
    keys = ["".join(rng.choice(letters) for _ in range(40)) for letters in ("0123456789ABCDEF", "ABCDEFGHIJKLMabcdefghijklm0123456789") for _ in PREFIXES]
    texts = [f"see {PREFIXES[i % len(PREFIXES)]}{key} there" for i, key in enumerate(keys)]
    out = {r.doc_id: r.text for r in secrets.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all("[SECRET]" in out[i] and not any(key[j : j + 10] in out[i] for j in range(31)) for i, key in enumerate(keys)), out


def test_very_long_candidates(spark):
    rng = random.Random(7)
    letters = secrets.ALPHABET[:62]
    hot = "".join(rng.choice(letters) for _ in range(200_000))
    mixed = "".join("".join(rng.choice(letters) for _ in range(24)) + "a" * 45 for _ in range(2900))
    df = spark.createDataFrame([(1, hot), (2, mixed)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == 4] for r in secrets.find(df).collect()}
    assert sum(b - a for a, b in found[1]) > 199_000
    assert 2850 < len(found[2]) <= 2900 and all(b <= c for (_, b), (c, _) in zip(found[2], found[2][1:], strict=False))

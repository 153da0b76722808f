import random
import re

from ledgerloom.llm import licenses

KNOWN = licenses.Templates(licenses.TEMPLATES, licenses.LIKENESS)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(data):
    """Best score of each licence over all runs of sentences and lines."""
    ends = [*(m.end() for m in licenses.BREAKS[0].finditer(data)), len(data)]
    starts = [0, *ends[:-1]]
    out = {}
    for i, a in enumerate(starts):
        for b in ends[i:]:
            for name, score in KNOWN.best(WORD.findall(data[a:b].lower())).items():
                out[name] = max(score, out.get(name, 0))
    return out


def found(texts):
    return [{m["license"]: m["score"] for m in some} for some in licenses.matches(texts, KNOWN, joined=True)]


def template(name):
    return max((t for n, t in licenses.TEMPLATES if n == name), key=len)


def test_whole_licences_between_other_text():
    other = "\n\n".join("Some words about %d other things that stand here. And more of it" % i for i in range(40))
    mit = template("MIT").replace(": The above", ":\n\nThe above").replace(" THE SOFTWARE IS PROVIDED", "\n\nTHE SOFTWARE IS PROVIDED")
    assert mit.count("\n\n") == 2
    for name, text in (("MIT", mit), *((n, template(n).replace(". ", ".\n\n")) for n in ("Apache-2.0", "ISC"))):
        data = f"{other}\n\n{text}\n\n{other}".encode()
        assert name not in {m["license"] for m in licenses.matches([data], KNOWN)[0] if m["score"] > 0.99}
        assert found([data])[0][name] > 0.99


def test_against_all_runs():
    rng = random.Random(3)
    notes = [t for _, t in licenses.TEMPLATES]
    texts = [b"", b"word", b"the software. " * 30]
    for _ in range(60):
        words = " ".join(rng.choice(notes) for _ in range(rng.randrange(1, 4))).split()
        for _ in range(rng.randrange(len(words) // 5 + 1)):
            words[rng.randrange(len(words))] = rng.choice(["the", "X", "license.", "of"])
        made = "".join(w + rng.choice([" ", " ", " ", " ", " ", "\n", "\n\n", ". "]) for w in words)
        texts.append((made + rng.choice(["", made[:200], "more text. Here and there."])).encode())
    assert found(texts) == [plain(t) for t in texts]

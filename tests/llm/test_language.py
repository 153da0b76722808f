import random

import numpy as np
from ledgerloom.llm import language

SYLLABLES = {"aa": ["ka", "ri", "mo", "tu"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["çon", "été", "oui", "eau"]}


def line(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(lang, line(rng, lang, rng.randrange(3, 40))) for lang in SYLLABLES for _ in range(150)]
    rows += [("aa", rows[0][1])] * 300  # copies, a third of all rows
    train = spark.createDataFrame([*rows, (None, "ignored"), ("aa", None), ("aa", "")], "lang string, text string").repartition(4)
    model = language.train(train, per_language=100)
    assert model.languages == ["aa", "bb", "cc"]
    assert (model.weights == 0).mean() > 0.9  # sparse
    test = [(lang, line(rng, lang, 12)) for lang in SYLLABLES for _ in range(40)]
    odd = [None, "", "  \n", "123 !?", "É", "ka " * 200_000]
    df = spark.createDataFrame([(l, t, "z") for l, t in test] + [(None, t, None) for t in odd], "lang string, text string, score string")
    out = language.predict(df, model).collect()
    assert len(out) == len(test) + len(odd)
    assert sum(r.lang_pred == r.lang for r in out if r.lang) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in out)
    found = {r.text: r for r in out}
    assert [found[t].lang_pred for t in odd[:4]] == ["und"] * 4 and found[None].score == 0
    assert found["É"].lang_pred != "und" and found[odd[5]].lang_pred == "aa"


def test_no_rows(spark):
    df = spark.createDataFrame([("some text", None)], "text string, lang string")
    model = language.train(df)
    assert [(r.lang_pred, r.score) for r in language.predict(df, model).collect()] == [("und", 0.0)]
    assert language.predict(df.limit(0), model).count() == 0


def test_document_frequencies_count_each_text_once(spark):
    df = spark.createDataFrame([("aba",), ("ab ab",), (None,), ("x",)], "text string").repartition(3)
    count, seen = language.document_frequencies(df)
    grams = language.Grams(["a"])
    assert count == 4 and seen[grams.of(0)[0]] == 2


def test_the_fitting_task_holds_six_bytes_a_gram():
    rng = random.Random(2)
    texts = [line(rng, "aa", 50) for _ in range(20)]
    rows = language._counted(texts)
    assert all(at.itemsize + count.itemsize == 6 for at, count in rows)
    for text, (at, count) in zip(texts, rows, strict=True):
        want = np.unique(language.Grams([text]).of(0), return_counts=True)
        assert (at == want[0]).all() and (count == want[1]).all()

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from ledgerloom.llm import language
from tests.compare import compare, duck
from tests.llm.test_fmindex import plain as plain_hits
from tests.llm.test_jaccard import plain_kept
from tests.llm.test_language import line
from tests.llm.test_secrets import plain as plain_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SF_DIR = "/root/testdata/sf0.001"
LLM_QUERIES = sorted(q for q in entry.queries() if q[:2] == "op" and q[2].isdigit())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [(lang, line(rng, lang, rng.randrange(40, 90))) for lang in ("aa", "bb", "cc") for _ in range(25)]
    items = [" ".join(f"item{i}word{j}" for j in range(14)) for i in range(5)]
    rows = []
    for lang, text in texts:
        rows.append((lang, text))
        if rng.random() < 0.3:
            rows.append((lang, text))
        if rng.random() < 0.2:
            rows.append((lang, text + ", " + rng.choice(items) + ". " + line(rng, lang, 60)))
        if rng.random() < 0.2:
            rows.append((lang, line(rng, lang, 70) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + line(rng, lang, 5)))
    rows += [("aa", None), ("bb", ""), ("cc", "123 456"), (None, texts[3][1])]
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("corpus"))
    table = [(i, text, lang, f"s{i % 3}", len(text or "")) for i, (lang, text) in enumerate(rows)]
    spark.createDataFrame(table, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, table, items


def test_stages_against_brute_force(spark, corpus):
    folder, table, items = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = docs = spark.createDataFrame((out := stage(spark, docs, folder)).collect(), out.schema)
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted(r.doc_id for r in made[name].collect())
    # language: every text with letters is in a known language here
    assert ids("language_id") == [r[0] for r in table if any(c.isalpha() for c in r[1] or "")]
    kept = [r for r in table if r[0] in set(ids("language_id"))]
    assert ids("near_dedup") == plain_kept(kept) and len(ids("near_dedup")) < len(kept)
    kept = [r for r in kept if r[0] in set(ids("near_dedup"))]
    clean = {d: text for d, _, _, _, text in plain_hits([(r[0], r[1]) for r in kept], list(enumerate(items)), 10)}
    assert {r.doc_id: r.text for r in made["decontamination"].collect()} == clean
    assert any(clean[r[0]] != r[1] for r in kept)
    want = {}
    for doc, text in clean.items():
        out, at = "", 0
        for a, _, b in plain_spans(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        want[doc] = out + text[at:]
    got = {r.doc_id: r for r in made["secret_scan"].collect()}
    assert {d: r.text for d, r in got.items()} == want and any("[SECRET]" in t for t in want.values())
    assert all(r.n_chars == len(r.text) for r in got.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    total = {}
    for r in made["best_fit_packing"].collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == sizes


def test_language_stage_against_single_texts(spark, corpus):
    folder, table, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(docs.where(~corpus_pipeline.held_out()).select("text", "lang"))
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for doc, text, *_ in table:
        if any(c.isalpha() for c in text or ""):
            p = language.softmax(model.logits(language.Grams([text]))[0] / model.temperature)
            assert out[doc].lang_pred == model.languages[int(np.argmax(p))] and abs(out[doc].score - p.max()) < 1e-9


def test_language_stage_sends_texts_to_python_once(spark, corpus, monkeypatch):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").withColumn("score", F.col("n_chars") * 2)  # a column predict() has, too
    seen = []
    predict = language.predict
    monkeypatch.setattr(language, "predict", lambda rows, model: seen.append(rows.schema.simpleString()) or predict(rows, model))
    kept = corpus_pipeline.language_id(spark, docs, corpus[0])
    assert [s.count("text:") for s in seen] == [1]
    assert kept.columns == docs.columns
    want = (tuple(r) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_run(spark, corpus):
    out = entry.queries()["pipeline"](spark, corpus[0])
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


@pytest.mark.parametrize("name", LLM_QUERIES)
def test_query(spark, name):
    assert len(LLM_QUERIES) == 13
    problem = compare(spark, duck(SF_DIR), entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert problem is None, problem

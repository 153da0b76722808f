"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams (FTRL-proximal)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import stored

ORDERS = (1, 2, 3)  # characters of an n-gram
BUCKETS = 1 << 16
SAMPLE_PER_LANGUAGE = 2000  # labelled texts of a language that the weights are fitted on; other statistics use all
SALTS = 1024  # parts of a language whose smallest hashes are sought on their own
CHUNK_CHARS = 1_000_000  # of texts whose n-grams are found at once
PARTS = 64  # of the vector of document frequencies
EPOCHS = 2
SCALE = 10.0  # of the L1-normalised TF-IDF values
#: FTRL-proximal: learning rate, its smoothing, and the elastic-net penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


class Grams:
    """Bucket of every character n-gram of a list of texts, lower-cased, all but letters as one blank sign."""

    def __init__(self, texts: list[str]):
        folded = [t.lower() for t in texts]
        code = np.frombuffer("\n".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(t) + 1 for t in folded), np.int64, len(folded))
        self.start = np.cumsum(sizes) - sizes
        letter = letters()[code]
        code = np.where(letter, code, 32).astype(np.uint32)
        self.has_letter = np.add.reduceat(letter, self.start) > 0
        self.total = np.zeros(len(texts), np.int64)
        self.buckets = []
        n = len(code)
        for order in ORDERS:
            mixed = np.full(n, order, np.uint32)
            for i in range(order):
                mixed[: n - i] = (mixed[: n - i] ^ code[i:]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
            bucket = (mixed & np.uint32(BUCKETS - 1)).astype(np.int64)
            for i in range(order):  # n-grams that would reach into the next text
                bucket[np.maximum(self.start + sizes - 1 - i, self.start)] = BUCKETS
            self.total += np.maximum(sizes - order, 0)
            self.buckets.append(bucket)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Per text and column, the sum of weights over its n-grams; row BUCKETS of `weights` is zero."""
        return sum(np.add.reduceat(weights[b], self.start, axis=0) for b in self.buckets)

    def of(self, i: int) -> np.ndarray:
        """Buckets of one text's n-grams."""
        end = self.start[i + 1] if i + 1 < len(self.start) else len(self.buckets[0])
        found = np.concatenate([b[self.start[i] : end] for b in self.buckets])
        return found[found < BUCKETS]


def _chunks(texts: list[str]):
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > CHUNK_CHARS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def _frequencies(batches):
    """One row per part: in how many texts of this task each bucket occurs."""
    found = np.zeros(BUCKETS, np.int64)
    count = 0
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for _, some in _chunks(texts):
            grams = Grams(some)
            for i in range(len(some)):
                seen = np.zeros(BUCKETS, bool)
                seen[grams.of(i)] = True
                found += seen
        count += len(texts)
    if count:
        parts = found.reshape(PARTS, -1)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(range(PARTS), pa.int32()), "texts": pa.array([count] * PARTS, pa.int64()), "seen": pa.array(parts.tolist(), pa.list_(pa.int64()))}
        )


def _added(key, frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": [key[0]], "texts": [frame.texts.sum()], "seen": [np.sum(np.stack(frame.seen.to_numpy()), axis=0)]})


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and per bucket in how many of them it occurs. The vectors of the tasks are added in two steps, part by part."""
    schema = "part int, texts long, seen array<long>"
    made = texts.select("text").mapInArrow(_frequencies, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = made.groupBy("part", "salt").applyInPandas(_added, schema)
    rows = some.groupBy("part").applyInPandas(_added, schema).collect()  # PARTS rows
    if not rows:
        return 0, np.zeros(BUCKETS, np.int64)
    by = sorted(rows, key=lambda r: r.part)
    return int(by[0].texts), np.concatenate([np.asarray(r.seen, np.int64) for r in by])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + 1, languages), with the inverse document frequencies
    bias: np.ndarray
    temperature: float

    def logits(self, grams: Grams) -> np.ndarray:
        total = np.maximum(grams.total, 1)[:, None]
        return SCALE * grams.sums(self.weights) / total + self.bias


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and how often they occur, in 6 bytes each: these rows are most of what the fitting task holds."""
    rows = []
    for _, some in _chunks(texts):
        grams = Grams(some)
        for i in range(len(some)):
            at, count = np.unique(grams.of(i), return_counts=True)
            rows.append((at.astype(np.uint16), count.astype(np.uint32)))
    return rows


def fit(texts: list[str], labels: np.ndarray, classes: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, biases and temperature. The last fifth of the texts sets the temperature alone."""
    rows = _counted(texts)
    cut = max(1, len(rows) * 4 // 5)
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))  # the last row is the bias

    def valued(i):
        at, count = rows[i][0].astype(np.int64), rows[i][1].astype(np.int64)
        return at, SCALE * idf[at] * count / max(1, count.sum())

    def current(at):
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - np.where(at < BUCKETS, L1, 0.0)[:, None], 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(cut).tolist():
            at, value = valued(i)
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            w = current(at)
            p = softmax(value @ w)
            p[labels[i]] -= 1
            g = np.outer(value, p)
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    w = current(np.arange(BUCKETS + 1))
    held = range(cut, len(rows)) if cut < len(rows) else range(len(rows))
    logits = np.array([value @ w[at] + w[BUCKETS] for at, value in map(valued, held)])
    truth = labels[list(held)]

    def loss(t):
        return -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()

    temperature = min((float(t) for t in np.geomspace(0.05, 20, 121)), key=loss)
    bias = w[BUCKETS].copy()
    w[:BUCKETS] *= idf[:BUCKETS, None]
    w[BUCKETS] = 0
    return w, bias, temperature


def _fit_task(languages: list[str], idf: np.ndarray):
    def run(frames):
        frame = pd.concat(list(frames), ignore_index=True)
        if not len(frame):
            return
        frame = frame.sort_values("order", ignore_index=True)
        number = {x: i for i, x in enumerate(languages)}
        w, bias, temperature = fit(frame.text.tolist(), frame.lang.map(number).to_numpy(), len(languages), idf)
        at, column = np.nonzero(w)
        yield pd.DataFrame({"bucket": at, "language": column, "value": w[at, column]})
        yield pd.DataFrame({"bucket": -1, "language": range(len(languages)), "value": bias})
        yield pd.DataFrame({"bucket": [-2], "language": [0], "value": [temperature]})

    return run


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the languages of `labelled` (text, lang); rows without either are left out.

    Document frequencies cover all of them. The weights are fitted in one task on at most `per_language`
    distinct texts of each language, those with the smallest hashes; this bound is all that task and the
    driver ever hold, besides BUCKETS numbers a language. Without rows the model knows no language.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    count, seen = document_frequencies(rows)
    if not count:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros(0), 1.0)
    idf = np.append(np.log((1 + count) / (1 + seen)) + 1.0, 0.0)
    keyed = rows.withColumn("order", F.xxhash64("text", "lang"))
    # the least of each salt first: no task sorts more than a salt of a language, or per_language rows of every salt
    ranked = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("order"))
    few = keyed.select("lang", "order").distinct().withColumn("salt", F.pmod("order", F.lit(SALTS)))
    few = few.withColumn("rank", ranked("lang", "salt")).where(F.col("rank") <= per_language)
    chosen = stored(few.withColumn("rank", ranked("lang")).where(F.col("rank") <= per_language).select("lang", "order"), "language-sample")
    sample = stored(keyed.join(chosen, ["lang", "order"], "left_semi").dropDuplicates(["lang", "order"]), "language-texts")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    fitted = sample.repartition(1).mapInPandas(_fit_task(languages, idf), "bucket long, language int, value double").toPandas()
    w = np.zeros((BUCKETS + 1, len(languages)))
    bias = np.zeros(len(languages))
    real = fitted[fitted.bucket >= 0]
    w[real.bucket.to_numpy(), real.language.to_numpy()] = real.value
    low = fitted[fitted.bucket == -1]
    bias[low.language.to_numpy()] = low.value
    return Model(languages, w, bias, float(fitted[fitted.bucket == -2].value.iloc[0]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (with `text`) plus lang_pred and score, from the whole text alone.

    lang_pred is `und` with score 0 if the text is null or has no letter, or the model knows no language; score is
    the calibrated probability of lang_pred. Rows and other columns stay (columns of these names are replaced).
    """
    rows = docs.drop("lang_pred", "score")
    schema = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best = np.full(len(texts), len(model.languages))
            score = np.zeros(len(texts))
            for first, some in _chunks(texts) if model.languages else ():
                grams = Grams(some)
                p = softmax(model.logits(grams) / model.temperature)
                known = np.flatnonzero(grams.has_letter)
                best[first + known] = p[known].argmax(axis=1)
                score[first + known] = np.clip(p[known].max(axis=1), 0, 1)
            made = [pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)

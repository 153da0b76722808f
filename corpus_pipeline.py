"""A training corpus from `documents`: language, near-duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import fmindex, jaccard, language, packing, secrets, tokens
from ledgerloom.llm.queries import held_out
from ledgerloom.llm.storage import stored

LEAST_SCORE = 0.5  # calibrated probability of its language that a document must reach


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows. It learns from the labelled documents that are not held out; where there are
    none, no language is known and only documents without a letter go."""
    model = language.train(docs.where(~held_out()).select("text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")  # texts go to Python and back once
    kept = language.predict(docs.select("text", rest), model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("text" if c == "text" else f"rest.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id. Linked are texts whose SimHash fingerprints are
    close (`simhash.links`) and texts whose five-word shingles have a Jaccard coefficient of 0.8 or more."""
    return jaccard.representatives(docs, fingerprints=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; the rest of a contaminated text stays."""
    return fmindex.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of 4096."""
    cut = tokens.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), tokens.CAPACITY)
    return packing.pack(cut, tokens.CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Training, connected components and evolution are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all rows its predecessor kept, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Incremental ingest: a file stream of parsed rows, each micro-batch through the batch operators.

There is no stream state to lose. What makes a retried batch harmless is that ids are
deterministic and every write replaces one partition: batch N owns `ledger/batch=N` and `parses/batch=N`. Late rows
need no watermark, because stored keys are read again for every batch.

A batch reads only the history it touches. Its partition is cut by owner bucket and year: a row can only be claimed by one of its
owner and date, so other buckets and years are pruned. Which parse of a document is the latest may be known from another
year's rows; that is kept in the small table `parses`, cut by owner bucket.

A document is replaced by parse, not by batch: rows carry `parse_id` (null counts as 0) and the rows of a
document's highest parse are current, in however many files and batches they came. A parse
that found nothing lands one row with a null txn_id, so that it too replaces the earlier one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.operators import accounts, dedup, labels, partitions, recurrence, review, rules, transfers
from ledgerloom.session import checkpointed

LANDED = (
    "owner_id bigint, txn_id string, document_id string, own_account_id string, own_account_kind string, "
    "institution_id string, txn_date date, amount bigint, currency string, raw_description string, "
    "counterparty_raw string, seq bigint, fy_key string, parse_id bigint"
)
PARSE = ["owner_id", "document_id", "parse_id"]


Table = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class LabelModel:
    """What the label step learns from and scores."""

    vectors: Table  # owner_id, txn_id, embedding
    examples: Table
    dimensions: int
    model_id: str


@dataclass(frozen=True)
class Knowledge:
    """Rule tables, read once per batch so that a change applies to the next one.

    Without `accounts` rows keep the account they came with, without `label_model` their verdict.
    """

    profiles: Table
    overrides: Table
    aliases: Table
    counterparties: Table
    documents: Table | None = None  # owner_id, document_id, seq, institution_id, account_last4, doc_type, txn_count
    accounts: Table | None = None
    own_names: Table | None = None  # owner_id, names array<string>: one row per owner
    label_model: LabelModel | None = None


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All batches written so far under `path`; empty before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # the folder appears with the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def stored_ledger(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All ledger rows written so far."""
    return _stored(spark, f"{folder}/ledger", schema).select(*schema.names)


def touched_ledger(spark: SparkSession, folder: str, schema: StructType, places: list[tuple]) -> DataFrame:
    """The stored rows of the owner buckets and years in `places`; directories of others are pruned."""
    whole = StructType([*schema, *spark.createDataFrame([], "owner_bucket int, place_year int").schema])
    return _stored(spark, f"{folder}/ledger", whole).filter(partitions.within(places)).select(*schema.names)


def touched_parses(spark: SparkSession, folder: str, buckets: list[tuple]) -> DataFrame:
    """The parses that earlier batches brought for the owners of these buckets."""
    schema = spark.createDataFrame([], "owner_id bigint, document_id string, parse_id bigint, batch int, owner_bucket int").schema
    return _stored(spark, f"{folder}/parses", schema).filter(partitions.within(buckets, ["owner_bucket"]))


def ingest(batch: DataFrame, stored: DataFrame, knowledge: Knowledge, stored_parses: DataFrame | None = None) -> DataFrame:
    """One batch to stored ledger rows: attribute, dedup, classify, label, link, finalise.

    `stored` are the earlier rows of the batch's owners and dates at least; `stored_parses` the earlier parses of its owners, where
    `stored` does not hold all of them.

    Superseded rows are no claims, and rows of a parse that is already superseded are left out. Rows
    that announce an empty parse are kept as they are.
    """
    spark = batch.sparkSession
    parses = latest_parses((stored if stored_parses is None else stored_parses).select(*PARSE).unionByName(batch.select(*PARSE)))
    rows = of_latest(batch.filter("txn_id is not null"), parses)
    claims = of_latest(stored.filter("txn_id is not null"), parses)
    if knowledge.accounts is not None and knowledge.documents is not None:
        rows = attributed(rows, accounts.resolve_accounts(knowledge.documents(spark), knowledge.accounts(spark)))
    unique = dedup.mark_duplicates(rows, claims, own_document=False).filter("kept").drop("kept", "signature", "account_key", "doc_key")
    classified = rules.classify(
        unique, knowledge.profiles(spark), knowledge.overrides(spark), knowledge.aliases(spark), recurrence.recurrence_index(unique)
    )
    # classified once and written: scoring and linking read these rows several times
    known = checkpointed(rules.resolve_counterparty(classified, knowledge.counterparties(spark)))
    if knowledge.label_model is None:
        known = known.withColumns({"final": F.col("verdict"), "source": F.lit("deterministic"), "prediction_id": F.lit(None).cast("string")})
    else:
        model = knowledge.label_model
        known = labels.label_step(known, model.vectors(spark), model.examples(spark), model.dimensions, model.model_id)
        known = checkpointed(known)
    legs = known.withColumns({"flow": F.col("verdict.flow"), "merchant": F.col("verdict.merchant")})
    named, own = legs, None
    if knowledge.own_names is not None:
        named, own = legs.join(knowledge.own_names(spark).withColumnRenamed("names", "_own_names"), "owner_id", "left"), F.col("_own_names")
    linked = transfers.link_transfers(named, own).select(*legs.columns, "is_transfer", "suspected")
    decided = linked.withColumn("prev_category", F.lit(None).cast("string"))
    return rules.finalize(decided).unionByName(batch.filter("txn_id is null"), allowMissingColumns=True)


def attributed(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows with the account of their document; where none was found they keep what they came with."""
    found = resolved.select("owner_id", "document_id", F.col("own_account_id").alias("_account"), F.col("own_account_kind").alias("_kind"))
    return rows.join(found, ["owner_id", "document_id"], "left").withColumns(
        {"own_account_id": F.coalesce("_account", "own_account_id"), "own_account_kind": F.coalesce("_kind", "own_account_kind")}
    ).select(*rows.columns)


def batch_writer(folder: str, schema: StructType, knowledge: Knowledge) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = [f.name for f in schema if f.name != "batch"]
        places = partitions.touched(partitions.placed(batch))
        buckets = sorted({p[:1] for p in places})
        others = F.col("batch") != batch_id
        stored = touched_ledger(spark, folder, schema, places).filter(others)
        parses = touched_parses(spark, folder, buckets).filter(others)
        rows = partitions.placed(ingest(batch, stored, knowledge, parses).select(*columns))
        # one partition per batch, replaced as a whole when the batch is retried
        named = batch.select(*PARSE).distinct().withColumn("owner_bucket", partitions.owner_bucket())
        named.write.mode("overwrite").partitionBy("owner_bucket").parquet(f"{folder}/parses/batch={batch_id}")
        rows.hint("rebalance", *[F.col(c) for c in partitions.PLACE]).write.mode("overwrite").partitionBy(*partitions.PLACE).parquet(
            f"{folder}/ledger/batch={batch_id}"
        )

    return write


def start(
    spark: SparkSession,
    landing: str,
    folder: str,
    ledger_schema: StructType,
    knowledge: Knowledge,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Follows a landing folder until what is there has been ingested, then stops."""
    reader = spark.readStream.schema(LANDED)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(landing).writeStream.foreachBatch(batch_writer(folder, ledger_schema, knowledge))
        .option("checkpointLocation", f"{folder}/_stream").trigger(availableNow=True).start()
    )


def latest_parses(rows: DataFrame) -> DataFrame:
    return rows.groupBy("owner_id", "document_id").agg(F.max(F.coalesce("parse_id", F.lit(0).cast("bigint"))).alias("_latest"))


def of_latest(rows: DataFrame, parses: DataFrame) -> DataFrame:
    """Rows of their document's latest parse; a row without a document is never superseded."""
    newest = F.col("_latest").isNull() | (F.coalesce("parse_id", F.lit(0).cast("bigint")) == F.col("_latest"))
    return rows.join(parses, ["owner_id", "document_id"], "left").filter(newest).select(*rows.columns)


def current_rows(ledger: DataFrame) -> DataFrame:
    """Stored rows of the latest parse of every document."""
    return of_latest(ledger, latest_parses(ledger)).filter("txn_id is not null")


def project(
    ledger: DataFrame, items: DataFrame, previous: DataFrame | None = None, decisions: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Derived tables over the whole ledger: relinked rows, links, subscriptions, review items, duplicate decisions.

    `previous` are the stored subscriptions, `decisions` the stored duplicate decisions; the statuses of both survive.
    """
    current = checkpointed(current_rows(ledger))
    linked = checkpointed(transfers.link_transfers(current))
    relinked = transfers.relink(linked)
    pairs = dedup.suspected_pairs(current.limit(0), current)
    known = pairs.limit(0).withColumn("status", F.lit("")) if decisions is None else decisions
    return {
        "duplicates": dedup.record_decisions(known, pairs),
        "ledger": relinked,
        "links": transfers.links_of(linked),
        "subscriptions": recurrence.detect_subscriptions(relinked, previous),
        "review_items": review.rebuild_items(items, relinked),
    }

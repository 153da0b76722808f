"""Landing tables: pending scans, content dedup, size gates and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money
from ledgerloom.operators.rollups import top_per


def pending_scan(attachments: DataFrame, messages: DataFrame) -> DataFrame:
    """Pending attachments with the provider of their message, when the message is known."""
    provider = messages.select("message_id", "provider_id")
    return attachments.filter("status = 'pending'").join(provider, "message_id", "left")


def first_match(listings: DataFrame) -> DataFrame:
    """A message found by several queries counts once, for the first of them.

    `listings`: message_id, query_seq and anything else.
    """
    return top_per(listings, ["message_id"], [F.col("query_seq")], 1)


def content_dedup(incoming: DataFrame, stored: DataFrame, content: Column, order: list[str]) -> DataFrame:
    """New attachments whose content is neither stored nor earlier in the batch."""
    hashed = incoming.withColumn("sha256", F.sha2(content, 256))
    fresh = top_per(hashed, ["sha256"], [F.col(c) for c in order], 1)
    return fresh.join(stored.select("sha256").distinct(), "sha256", "left_anti").withColumn(
        "stored_id", F.concat(F.lit("att_"), F.substring("sha256", 1, 16))
    )


def size_gate(messages: DataFrame, keys: list[str], threshold: int = fv.CONSENT_THRESHOLD_BYTES) -> DataFrame:
    """Estimated bytes per run and whether they need consent (strictly above the threshold)."""
    return messages.groupBy(*keys).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumns(
        {"required": F.col("bytes") > threshold, "size": money.human_bytes(F.col("bytes"))}
    )


def run_metrics(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Per run: messages, attachments and bytes stored, failures and the resulting status."""
    seen = messages.groupBy("run_id").agg(F.count("*").alias("messages"))
    landed = attachments.groupBy("run_id").agg(
        F.count("*").alias("attachments"), F.sum("n_chars").alias("bytes"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    zero = F.lit(0).cast("bigint")
    return seen.join(landed, "run_id", "full_outer").select(
        "run_id", *[F.coalesce(c, zero).alias(c) for c in ("messages", "attachments", "bytes", "failed")]
    ).withColumn("status", F.when(F.col("failed") > 0, "error").otherwise("done"))

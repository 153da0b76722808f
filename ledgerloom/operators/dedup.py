"""Duplicates across documents: exact keys, weak signature drift, and durable decisions.

Input rows carry owner_id, txn_id, document_id, own_account_id, txn_date, amount,
raw_description and `seq`, the position that says which row came first. A key can hold any
number of rows: its claimer is an aggregate (one row per key) joined back, so a hot key is
split by the skew-join handling instead of being sorted in one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import text
from ledgerloom.operators.rollups import top_per
from ledgerloom.session import stored as stored_rows

KEY = ["owner_id", "txn_date", "amount", "signature", "account_key"]
PLACE = ["owner_id", "own_account_id", "txn_date", "amount"]
BASIS = "signature_token_prefix"


def with_key(rows: DataFrame) -> DataFrame:
    """Adds the key columns; a stored `signature` column is used as it is."""
    described = F.col("signature") if "signature" in rows.columns else text.signature(F.coalesce("raw_description", F.lit("")))
    return rows.withColumns(
        {
            "signature": described,
            "account_key": F.coalesce("own_account_id", F.lit("")),
            "doc_key": F.coalesce("document_id", F.lit("")),
        }
    )


def key_text(rows: DataFrame) -> Column:
    return F.concat_ws("|", F.col("txn_date").cast("string"), F.col("amount").cast("string"), "signature", "account_key")


def joined_on_key(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` with the other columns of `groups` (one row per key); a null date, amount or owner equals itself."""
    renamed = groups.withColumnsRenamed({c: f"_{c}" for c in KEY})
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(renamed[f"_{c}"]) for c in KEY])
    return rows.join(renamed, same, how).drop(*[f"_{c}" for c in KEY])


def mark_duplicates(incoming: DataFrame, stored: DataFrame, own_document: bool = True) -> DataFrame:
    """Adds `kept`: false when a stored row, or another document earlier in the batch, has the key.

    With `own_document` false a stored row of the same document is no claim, as when a document
    arrives in several files. Every incoming row comes back once.
    """
    rows = with_key(incoming)
    claims = rows.groupBy(*KEY).agg(F.min_by("doc_key", F.struct("seq", "txn_id")).alias("claimer"))
    known = with_key(stored).groupBy(*KEY).agg(F.min("doc_key").alias("low_doc"), F.max("doc_key").alias("high_doc"))
    other = (F.col("low_doc") != F.col("doc_key")) | (F.col("high_doc") != F.col("doc_key"))
    free = F.col("low_doc").isNull() if own_document else ~F.coalesce(other, F.lit(False))
    marked = joined_on_key(joined_on_key(rows, claims), known, "left")
    return marked.withColumn("kept", free & (F.col("doc_key") == F.col("claimer"))).drop("low_doc", "high_doc", "claimer")


def historical_excess(stored: DataFrame) -> DataFrame:
    """Rows to remove: of keys seen in several documents only the earliest row's document stays."""
    rows = with_key(stored)
    groups = rows.groupBy(*KEY).agg(
        F.min_by("doc_key", F.struct("seq", "txn_id")).alias("keeper_doc"),
        (F.min("doc_key") != F.max("doc_key")).alias("spread"),
    )
    return joined_on_key(rows, groups.filter("spread").drop("spread")).filter("doc_key <> keeper_doc")


def suspected_pairs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose signature is a token-prefix variant of an earlier row's, with that row.

    Prefix tests become equality: a row is looked up by its whole signature ('whole') and by each
    of its proper token prefixes ('part'). Per lookup string only the two earliest rows of
    different documents can ever be an answer, so no group is expanded into pairs.
    """
    usable = (F.col("doc_key") != "") & (F.col("account_key") != "") & (F.col("signature") != "")
    # narrow and written once: places, whole signatures, prefixes and candidates all read it
    rows, _ = stored_rows(
        with_key(stored.withColumn("phase", F.lit(0)))
        .unionByName(with_key(incoming.withColumn("phase", F.lit(1))))
        .filter(usable)
        .select(*PLACE, "doc_key", "signature", F.struct("phase", "seq", "txn_id").alias("position")),
        "places",
    )
    # a pair takes two documents and two signatures: rows of other places are never looked up and never probed for
    spread = rows.groupBy(*PLACE).agg(
        ((F.min("doc_key") < F.max("doc_key")) & (F.min("signature") < F.max("signature"))).alias("spread")
    )
    rows, _ = stored_rows(rows.join(spread.filter("spread").select(*PLACE), PLACE, "left_semi"), "pairable")
    parts = F.filter(text.proper_token_prefixes(F.col("signature")), lambda p: p.isNotNull())
    first = rows.groupBy(*PLACE, "signature", "doc_key").agg(F.min("position").alias("position"))
    whole = first.select(*PLACE, "doc_key", "position", F.lit("whole").alias("kind"), F.col("signature").alias("probe"))
    part = first.select(*PLACE, "doc_key", "position", F.lit("part").alias("kind"), F.explode(parts).alias("probe"))
    probe_key = [*PLACE, "kind", "probe"]
    per_doc = whole.unionByName(part).groupBy(*probe_key, "doc_key").agg(F.min("position").alias("position"))
    two = top_per(per_doc, probe_key, [F.col("position")], 2, "nth").groupBy(*probe_key).agg(
        F.max(F.when(F.col("nth") == 1, F.col("doc_key"))).alias("doc_1"),
        F.max(F.when(F.col("nth") == 1, F.col("position"))).alias("position_1"),
        F.max(F.when(F.col("nth") == 2, F.col("position"))).alias("position_2"),
    )
    candidate = rows.filter("position.phase = 1")
    # a candidate's prefixes are looked up among whole signatures, its whole one among prefixes
    probes = F.concat(
        F.transform(parts, lambda p: F.struct(F.lit("whole").alias("kind"), p.alias("probe"))),
        F.array(F.struct(F.lit("part").alias("kind"), F.col("signature").alias("probe"))),
    )
    asked = candidate.select(*PLACE, "doc_key", "position", F.inline(probes))
    keeper = F.when(F.col("doc_1") != F.col("doc_key"), F.col("position_1")).otherwise(F.col("position_2"))
    found = asked.join(two, probe_key).withColumn("keeper", keeper).filter(F.col("keeper") < F.col("position"))
    return (
        found.groupBy("owner_id", F.col("position.txn_id").alias("txn_id")).agg(F.min("keeper").alias("keeper"))
        .select(
            "owner_id",
            F.concat(F.lit("dup_"), F.col("txn_id")).alias("duplicate_id"),
            F.col("keeper.txn_id").alias("keeper_txn_id"),
            F.col("txn_id").alias("candidate_txn_id"),
            F.lit(BASIS).alias("basis"),
        )
    )


def cleanup_plan(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suspected pairs over the whole ledger, with `skipped` for candidates a user chose to keep."""
    kept = decisions.filter("status = 'kept'").select("owner_id", "candidate_txn_id").distinct()
    pairs = suspected_pairs(ledger.limit(0), ledger)
    return pairs.join(kept.withColumn("skipped", F.lit(True)), ["owner_id", "candidate_txn_id"], "left").withColumn(
        "skipped", F.coalesce("skipped", F.lit(False))
    )


def record_decisions(decisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds new pairs as open; an existing decision is never reopened."""
    fresh = pairs.join(decisions.select("duplicate_id"), "duplicate_id", "left_anti")
    return decisions.unionByName(fresh.withColumn("status", F.lit("open")).select(*decisions.columns))


def decide(decisions: DataFrame, choices: DataFrame) -> DataFrame:
    """Applies user choices (duplicate_id, choice of 'removed' or 'kept') to open decisions."""
    valid = choices.filter(F.col("choice").isin("removed", "kept"))
    chosen = F.when((F.col("status") == "open") & F.col("choice").isNotNull(), F.col("choice")).otherwise(F.col("status"))
    return decisions.join(valid, "duplicate_id", "left").withColumn("status", chosen).drop("choice")

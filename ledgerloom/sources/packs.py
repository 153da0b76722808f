"""Rule packs: nested JSON files to institution and merchant-alias tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import text
from ledgerloom.operators import tables
from ledgerloom.operators.rollups import top_per

ROW = (
    "struct<id:string,display_name:string,legal_name:string,category:string,type:string,aliases:array<string>,"
    "sources:array<struct<name:string,url:string,source_type:string,retrieved_at:string>>,"
    "confidence:string,status:string,issuer_id:string>"
)
PACK_SCHEMA = (
    f"file string, version string, category string, providers array<{ROW}>, issuers array<{ROW}>, "
    f"products array<{ROW}>, merchants array<{ROW}>"
)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """One row per pack file."""
    shape = PACK_SCHEMA.split(", ", 1)[1]
    return spark.read.schema(shape).json(path, multiLine=True).withColumn("file", F.input_file_name())


def _rows(packs: DataFrame) -> DataFrame:
    """Every entry of every list with the position that decides which of two equal ids wins."""

    def tagged(kind: str) -> Column:
        entries = F.coalesce(F.col(kind), F.array().cast(f"array<{ROW}>"))
        return F.transform(entries, lambda row: F.struct(F.lit(kind).alias("kind"), row.alias("row")))

    listed = F.flatten(F.array(*[tagged(kind) for kind in ("providers", "issuers", "products", "merchants")]))
    return packs.select("file", "version", F.col("category").alias("taxonomy"), F.posexplode(listed).alias("no", "entry")).select(
        "file", "version", "taxonomy", "no", "entry.kind", "entry.row.*"
    )


def confidence(value: Column) -> Column:
    return F.when(value == "low", "low").when(value.isin("med", "medium"), "med").otherwise("high")


def institutions(packs: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    latest = top_per(_rows(packs), ["id"], [F.desc("file"), F.desc("no")], 1)
    return latest.select(
        "id", "display_name", "legal_name", "category", "type", F.coalesce("aliases", none).alias("aliases"),
        confidence(F.col("confidence")).alias("confidence"), F.coalesce("status", F.lit("active")).alias("status"),
        F.lit(fv.PACK_SOURCE).alias("source"), F.col("version").alias("pack_version"),
    )


def merchant_aliases(packs: DataFrame) -> DataFrame:
    """One pattern per merchant name or alias of at least four characters."""
    merchants = _rows(packs).filter("kind = 'merchants'")
    named = F.array_distinct(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = merchants.select("*", F.posexplode(named).alias("alias_no", "alias")).filter(F.length(F.trim("alias")) >= fv.MIN_ALIAS_CHARS)
    rows = rows.withColumns({"alias_id": F.concat_ws(":", "id", text.slug(F.col("alias"))), "split": text.split_taxonomy(F.col("taxonomy"))})
    latest = top_per(rows, ["alias_id"], [F.desc("file"), F.desc("no"), F.desc("alias_no")], 1)
    return latest.select(
        "alias_id", F.lower("alias").alias("pattern"), F.col("display_name").alias("canonical_merchant"), "split.category",
        "split.subcategory", F.lit(fv.PACK_SOURCE).alias("source"), confidence(F.col("confidence")).alias("confidence"),
    )


def load(stored: DataFrame, loaded: DataFrame, key: str, purge: bool) -> DataFrame:
    """Upserts pack rows, never over a row a user owns; with `purge`, drops pack rows no longer emitted."""
    changed = [c for c in loaded.columns if c != key]
    merged = tables.upsert(stored, loaded, [key], changed, may_update=f"source = '{fv.PACK_SOURCE}'")
    return tables.purge_absent(merged, loaded, [key], F.col("source") == fv.PACK_SOURCE) if purge else merged

"""Stored tables that are updated partition by partition: an update reads and writes only what it touches.

A table is a Parquet folder with one directory per value of its place columns, by default an owner bucket and the year
of the row. Spark's dynamic overwrite stages the new files beside the old ones and moves them in when the job commits; directories
that no new row falls into are neither read nor listed for writing, so their files keep their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.operators import tables

BUCKETS = 64  # owner buckets of a table; fixed for its life
PLACE = ["owner_bucket", "place_year"]


def owner_bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("owner_id"), F.lit(buckets)).cast("int").alias("owner_bucket")


def placed(rows: DataFrame, date: str = "txn_date", buckets: int = BUCKETS) -> DataFrame:
    """`rows` with their place: owner bucket, and calendar year (0 without a date)."""
    return rows.withColumns({"owner_bucket": owner_bucket(buckets), "place_year": F.coalesce(F.year(date), F.lit(0))})


def touched(rows: DataFrame, place: list[str] | None = None) -> list[tuple]:
    """The places that `rows` fall into: at most owner buckets x years, whatever the number of rows."""
    columns = place or PLACE
    return sorted(tuple(r) for r in rows.select(*columns).distinct().collect())


def within(places: list[tuple], columns: list[str] | None = None) -> Column:
    """A condition on place columns alone, so that Spark prunes the directories of all other places."""
    names = columns or PLACE
    if not places:
        return F.lit(False)
    if len(names) == 1:
        return F.col(names[0]).isin([p[0] for p in places])
    by_last: dict = {}
    for p in places:
        by_last.setdefault(p[1:], []).append(p[0])
    tests = [F.col(names[0]).isin(firsts) & reduce(lambda a, b: a & b, [F.col(n) == v for n, v in zip(names[1:], rest, strict=True)]) for rest, firsts in by_last.items()]
    return reduce(lambda a, b: a | b, tests)


def write_new(rows: DataFrame, folder: str, date: str = "txn_date", buckets: int = BUCKETS) -> None:
    """The first load of a table."""
    _balanced(placed(rows, date, buckets)).write.mode("errorifexists").partitionBy(*PLACE).parquet(folder)


def _balanced(rows: DataFrame) -> DataFrame:
    """Few files a place, and a large place in several tasks."""
    return rows.hint("rebalance", *[F.col(c) for c in PLACE])


def _overwrite(rows: DataFrame, folder: str) -> None:
    _balanced(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def upsert_stored(folder: str, incoming: DataFrame, keys: list[str], update: list[str], may_update: str | None = None, date: str = "txn_date", buckets: int = BUCKETS) -> list[tuple]:
    """`tables.upsert` on a stored table; the places that were rewritten come back.

    A key must determine its place: owner_id is one of `keys`, and equal keys have dates of one year, as ids made of a
    document and its rows have. Rows of `incoming` replace or join those of their place only.
    """
    spark = incoming.sparkSession
    fresh = placed(incoming, date, buckets)
    places = touched(fresh)
    if not places:
        return []
    existing = read(spark, folder).filter(within(places))
    _overwrite(tables.upsert(existing, fresh, [*keys, *PLACE], update, may_update), folder)
    return places


def replace_documents_stored(folder: str, rows: DataFrame, documents: DataFrame, date: str = "txn_date", buckets: int = BUCKETS) -> list[tuple]:
    """`tables.replace_documents` on a stored table; the places that were rewritten come back.

    Only the owner buckets of the documents are searched for their old rows, by two columns; then the places that hold old or new
    rows are rewritten. A place whose last rows went is removed.
    """
    spark = rows.sparkSession
    names = documents.select("owner_id", "document_id").distinct().withColumn("owner_bucket", owner_bucket(buckets))
    stored = read(spark, folder)
    asked = stored.filter(within(touched(names, ["owner_bucket"]), ["owner_bucket"]))
    fresh = placed(rows, date, buckets)
    old = asked.select("owner_id", "document_id", *PLACE).join(names.drop("owner_bucket"), ["owner_id", "document_id"], "left_semi")
    places = touched(old.select(*PLACE).unionByName(fresh.select(*PLACE)))
    if not places:
        return []
    kept = tables.replace_documents(stored.filter(within(places)), fresh, documents).select(*stored.columns)
    # counted by place before the files go, since a place without rows is not overwritten
    full = set(touched(kept))
    _overwrite(kept, folder)
    _remove(spark, folder, [p for p in places if p not in full])
    return places


def _remove(spark: SparkSession, folder: str, places: list[tuple]) -> None:
    """Deletes the directories of these places, which the table owns."""
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/" + "/".join(f"{n}={v}" for n, v in zip(PLACE, place, strict=True)))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

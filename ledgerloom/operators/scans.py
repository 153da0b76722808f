"""Prefix scans over groups of any size: rows are cut into ordered slices, and what a slice leaves over is carried on.

Rows are range-partitioned by key and order, so one key may span many slices. A scan runs inside each
(key, slice); a slice's summary (its sum, its last or first known value) is then carried to the later or earlier
slices of the key. At most one key continues from one slice into the next, so the carried table has fewer rows
than there are slices, whatever the data: that bound is why it may be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import checkpointed

SLICE = "_slice"


def sliced(rows: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """`rows` with the ordered slice each is in, written once so that every scan sees the same slices.

    `order` should tell all rows of a key apart; rows that it does not may fall on either side of a slice's edge.
    """
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id()))


def _same(keys: list[str]) -> Column:
    """Equality on keys and slice; a null key equals itself."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, SLICE]])


def _carried(rows: DataFrame, keys: list[str], summary: dict[str, Column], carry: dict[str, Column], backward: bool) -> DataFrame:
    """`rows` with the `carry` columns: what the key's slices before (or after) this one hand on; null where there are none."""
    each = rows.groupBy(*keys, SLICE).agg(*[column.alias(name) for name, column in summary.items()])
    place = F.desc(SLICE) if backward else F.asc(SLICE)
    others = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(place)) == 1
    handed = each.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(SLICE).alias(f"_{SLICE}"), first.alias("_first"),
        *[column.over(others).alias(name) for name, column in carry.items()],
    ).filter(~F.col("_first")).drop("_first")
    joined = rows.join(F.broadcast(handed), _same(keys), "left")
    return joined.drop(*[f"_{k}" for k in keys], f"_{SLICE}")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `column` over the key's rows up to and with this one; nulls count as 0."""
    value = F.coalesce(F.col(column), F.lit(0))
    local = F.sum(value).over(Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    with_carry = _carried(rows, keys, {"_sum": F.sum(value)}, {"_handed": F.sum("_sum")}, backward=False)
    return with_carry.withColumn(name, local + F.coalesce("_handed", F.lit(0))).drop("_handed")


def previous_known(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Adds `name`: the last value of `column` that is not null in the key's rows before this one."""
    local = F.last(column, ignorenulls=True).over(
        Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    place = F.struct(*order)
    known = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), place))
    with_carry = _carried(rows, keys, {"_known": known}, {"_handed": F.last("_known", ignorenulls=True)}, backward=False)
    return with_carry.withColumn(name, F.coalesce(local, F.col("_handed"))).drop("_handed")


def next_known(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Adds `name`: the first value of `column` that is not null in the key's rows after this one."""
    local = F.first(column, ignorenulls=True).over(
        Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    )
    place = F.struct(*order)
    known = F.min_by(F.col(column), F.when(F.col(column).isNotNull(), place))
    with_carry = _carried(rows, keys, {"_known": known}, {"_handed": F.last("_known", ignorenulls=True)}, backward=True)
    return with_carry.withColumn(name, F.coalesce(local, F.col("_handed"))).drop("_handed")


def next_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, tie: list[str], value: list[str], name: str, slices: int | None = None) -> DataFrame:
    """As-of join: `left` plus the struct `name` of the first row of `right` with the same keys and a later `at`, or null.

    Both sides are merged into one order of (keys, at) and scanned from the end, so a key with very many rows on
    either side spans slices and no pairs are formed. Of right rows with the same `at` the one with the least `tie` counts. A row of
    `right` at the very time of a left row is not later; a left row without `at` finds nothing, a right row without it is never found.
    """
    row = F.struct(*[F.col(c) for c in left.columns]).alias("_row")
    found = F.struct(*[F.col(c) for c in (at, *value)]).alias("_found")
    # at the same time the right rows stand first, so only later ones come after a left row
    one = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.xxhash64(*left.columns).alias("_tie"), row)
    ranked = right.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*tie).alias("_by"), found)
    # rows that agree on everything are one; of one time only the least tie can be an answer
    least = ranked.groupBy(*keys, "_at", "_side").agg(F.min_by("_found", "_by").alias("_found"))
    both = one.filter("_at is not null").unionByName(least.withColumn("_tie", F.lit(0).cast("long")), allowMissingColumns=True)
    merged = next_known(sliced(both, keys, ["_at", "_side", "_tie"], slices), keys, ["_at", "_side", "_tie"], "_found", name)
    timed = merged.filter("_side = 1").select("_row.*", name)
    kind = timed.schema[name].dataType
    return timed.unionByName(left.filter(F.col(at).isNull()).withColumn(name, F.lit(None).cast(kind)))

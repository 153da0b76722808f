"""Shards of near-equal bytes: a k-d tree over document metadata, split at distributed weighted medians."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import stored

SHARDS = 40
ROW_BYTES = 16  # of a row besides its text
GROUP_SHARE = 0.1  # of a shard's bytes: equal texts up to this stay in one shard
SLACK = 0.0005  # of a shard's bytes by which a cut may miss its weight
BUCKETS = 4096  # of a histogram; every pass narrows a cut to one of them
DIMENSIONS = ("id_key", "source_key", "lang_key", "size_key")
GROUP = ["digest", "text_crc32", "size"]  # equal texts


@dataclass
class Node:
    """A part of the tree: `leaves` shards from number `first` on. A cut sends keys (value, tie) under its place to `low`."""

    first: int
    leaves: int
    dimension: str | None = None
    value: float = 0.0
    tie: int | None = None  # None: all ties of `value` go low
    low: Node | None = None
    high: Node | None = None

    def goes_low(self) -> Column:
        d = F.col(self.dimension)
        if self.tie is None:
            return d <= F.lit(self.value)
        return (d < F.lit(self.value)) | ((d == F.lit(self.value)) & (F.col("tie") <= F.lit(self.tie)))

    def shard(self) -> Column:
        """Number of the first shard of the part that a point is in."""
        if self.dimension is None:
            return F.lit(self.first)
        return F.when(self.goes_low(), self.low.shard()).otherwise(self.high.shard())


def _string_key(name: str) -> Column:
    """A number in the order of the strings' first six bytes; null is empty."""
    raw = F.rpad(F.hex(F.substring(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"), 1, 6)), 12, "0")
    return F.conv(raw, 16, 10).cast("double")


def _keys() -> list[Column]:
    return [
        F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("id_key"), _string_key("source").alias("source_key"),
        _string_key("lang").alias("lang_key"), F.log2(F.col("size").cast("double")).alias("size_key"),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """What the tree needs of each row: metadata, bytes, digests of the text, and where the row was read (cell, line)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("doc_id", "lang", "source")]
    return docs.select(
        *columns, (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("digest"), F.spark_partition_id().alias("cell"), F.monotonically_increasing_id().alias("line"),
    )


def points(rows: DataFrame, heaviest: float) -> tuple[DataFrame, DataFrame]:
    """(groups, points): one point for each text, with its group's least id, source and language; the rows of a text whose
    copies weigh more than `heaviest` are points of their own, so that cuts may pass between them."""
    one = F.col("digest").bitwiseXOR(F.col("text_crc32"))
    groups = rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("doc_id").alias("doc_id"), F.min("source").alias("source"), F.min("lang").alias("lang")
    )
    groups = stored(groups.withColumn("heavy", (F.col("n") > 1) & (F.col("weight") > F.lit(heaviest))), "shard-groups")
    single = groups.where("not heavy").select(*GROUP, *_keys(), one.alias("tie"), "weight")
    split = rows.join(F.broadcast(heavy_texts(groups)), GROUP).select(
        *GROUP, *_keys(), F.xxhash64("digest", "cell", "line").alias("tie"), F.col("size").alias("weight")
    )
    return groups, single.union(split)


def heavy_texts(groups: DataFrame) -> DataFrame:
    """Texts whose copies are split: fewer than shards / GROUP_SHARE (400), since together they weigh no more than everything."""
    return groups.where("heavy").select(*GROUP)


@dataclass
class Search:
    """Where a node's cut is looked for: an interval of the dimension's values, then of the ties of one value."""

    node: Node
    goal: float  # weight to go low
    low: float
    high: float
    before: int = 0  # weight under the interval
    value: float | None = None  # set once only its ties are left

    def here(self) -> Column:
        d = F.col(self.node.dimension)
        if self.value is None:
            return (d >= F.lit(self.low)) & (d <= F.lit(self.high))
        return (d == F.lit(self.value)) & (F.col("tie") >= F.lit(self.low)) & (F.col("tie") <= F.lit(self.high))

    def key(self) -> Column:
        return F.col(self.node.dimension) if self.value is None else F.col("tie").cast("double")

    def bucket(self) -> Column:
        span = float(self.high) - float(self.low)
        return F.when(self.here(), F.least(F.floor((self.key() - F.lit(float(self.low))) / F.lit(span or 1.0) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))

    def cut(self, key) -> None:
        """The keys up to `key` go low."""
        if self.value is None:
            self.node.value, self.node.tie = key, None
        else:
            self.node.value, self.node.tie = self.value, key

    def narrowed(self, rows: list, slack: float) -> bool:
        """Whether the cut is found, by the weights of this pass's buckets; else the interval is the bucket that it lies in."""
        under, last = self.before, None
        for r in rows:
            if under + r.weight >= self.goal or r is rows[-1]:
                break
            under, last = under + r.weight, r
        over = under + r.weight - self.goal
        lo, hi = (r.low, r.high) if self.value is None else (r.tie_low, r.tie_high)
        if min(self.goal - under, over) > slack:
            if float(lo) < float(hi):
                self.before, self.low, self.high = under, lo, hi
                return False
            if self.value is None and float(r.tie_low) < float(r.tie_high):
                self.before, self.value, self.low, self.high = under, lo, r.tie_low, r.tie_high
                return False
        # the nearer edge of the bucket
        if over <= self.goal - under:
            self.cut(hi)
        elif last is not None:
            self.cut(last.high if self.value is None else last.tie_high)
        elif self.value is not None and lo > -(1 << 63):
            self.cut(lo - 1)
        else:  # values under the interval's
            lowest = lo if self.value is None else self.value
            self.value = None
            self.cut(math.nextafter(lowest, -math.inf))
        return True


def grow(table: DataFrame, shards: int, slack: float = SLACK) -> Node:
    """The tree over `table` (DIMENSIONS, tie, weight). All nodes of a level are cut in the same passes; what the driver gets
    is one row a node and bucket."""
    ends = table.agg(F.sum("weight").alias("weight"), *[f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).first()
    root = Node(0, shards)
    if ends.weight is None:
        return root
    whole = {d: (ends[f"{d}_high"] - ends[f"{d}_low"]) or 1.0 for d in DIMENSIONS}
    target = ends.weight / shards
    level = [root] if shards > 1 else []
    while level:
        placed = table.withColumn("part", root.shard())
        spans = placed.groupBy("part").agg(F.sum("weight").alias("weight"), *[f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))])
        known = {r.part: r for r in spans.collect()}
        open_ = []
        for node in level:
            r = known.get(node.first)
            if r is None:  # no points: any cut does
                node.dimension, node.value = DIMENSIONS[0], 0.0
                continue
            width = {d: (r[f"{d}_high"] - r[f"{d}_low"]) / whole[d] for d in DIMENSIONS}
            node.dimension = max(DIMENSIONS, key=lambda d: (width[d], -DIMENSIONS.index(d)))
            node.value, low, high = 0.0, r[f"{node.dimension}_low"], r[f"{node.dimension}_high"]
            open_.append(Search(node, r.weight * (node.leaves // 2) / node.leaves, low, high))
        while open_:
            by = {s.node.first: s for s in open_}
            part = F.col("part")
            bucket, key = F.lit(None).cast("int"), F.lit(None).cast("double")
            for first, s in by.items():
                bucket = F.when(part == first, s.bucket()).otherwise(bucket)
                key = F.when(part == first, F.col(s.node.dimension)).otherwise(key)
            rows = placed.select("part", bucket.alias("bucket"), key.alias("key"), "tie", "weight").where("bucket is not null")
            counted = rows.groupBy("part", "bucket").agg(
                F.sum("weight").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("tie").alias("tie_low"), F.max("tie").alias("tie_high")
            )
            found: dict[int, list] = {}
            for r in sorted(counted.collect(), key=lambda r: (r.part, r.bucket)):
                found.setdefault(r.part, []).append(r)
            open_ = [s for first, s in by.items() if not s.narrowed(found[first], slack * target)]
        for node in level:
            less = node.leaves // 2
            node.low, node.high = Node(node.first, less), Node(node.first + less, node.leaves - less)
        level = [child for node in level for child in (node.low, node.high) if child.leaves > 1]
    return root


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` plus `slot`, gapless from 0 in each shard. Rows are numbered within what one task read (cell), by its line; the
    counts of the cells are summed up, so no shard is ever one task's group."""
    rows = stored(rows, "shard-rows")
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("line")).cast("long") - 1
    return rows.withColumn("place", place).join(begins, ["shard", "cell"]).withColumn("slot", F.col("begin") + F.col("place")).drop("begin", "place")


def shard(docs: DataFrame, shards: int = SHARDS, group_share: float = GROUP_SHARE, slack: float = SLACK) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of `docs` (doc_id, text; lang and source where they are columns).

    Shards are the leaves of a k-d tree over id, source, language and size (logarithm): a part of k shards is cut along the
    dimension in which it is widest, as a share of the whole extent, at the weight of k//2 of its shards. Ties go by a hash
    of the text. Shards' bytes differ by what cannot be cut: a row, or copies of a text up to `group_share` of a shard,
    which stay together; rows of more copies are placed one by one. A null text has no bytes and is the same as an empty one; null
    metadata count as 0 or empty; repeated rows each have a slot; fewer texts than shards leave shards empty.
    """
    rows = stored(measured(docs), "shard-measured")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups, table = points(rows, group_share * total / shards)
    table = stored(table, "shard-points")
    tree = grow(table, shards, slack)
    heavy = F.broadcast(heavy_texts(groups))
    split = rows.join(heavy, GROUP).select("*", *_keys(), F.xxhash64("digest", "cell", "line").alias("tie"))
    whole = table.join(heavy, GROUP, "left_anti").select(*GROUP, tree.shard().alias("shard"))
    wanted = ["doc_id", "size", "text_crc32", "cell", "line", "shard"]
    placed = split.withColumn("shard", tree.shard()).select(*wanted).union(rows.join(heavy, GROUP, "left_anti").join(whole, GROUP).select(*wanted))
    return numbered(placed).select("doc_id", "size", "text_crc32", "shard", "slot")

"""Substring search over many texts.

* `scan` answers one batch of needles: each distinct text is passed once by an automaton of its owner's needles.
* `gram_index` is stored and asked again and again: lists of texts per character window, those of frequent windows cut into
  numbered parts. A needle is looked up by the rarest of its windows, so only texts that hold that window are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from ledgerloom.functions import text

WIDTH = 3  # characters of a window; shorter needles are looked up by windows of their own width
PART_TEXTS = 100_000  # texts of one posting list, on average
PART_CHARS = 1_000_000  # of needles in one automaton, on average
LIST_WINDOWS = 4_096  # windows asked for that a text is held against at once, on average
SLICE_TEXTS = 50_000  # texts of an owner that one task passes with one automaton, on average


def _passes(columns: list[str], fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the needles inside their fields. A list of needles stands before the rows that it is for; one automaton is held at a time."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, needles = None, []
        for batch in batches:
            texts = list(zip(*[batch.column(f).to_pylist() for f in fields], strict=True))
            rows: list[int] = []
            found: list[str] = []
            where: list[list[bool]] = [[] for _ in fields]
            for row, listed in enumerate(batch.column("_needles").to_pylist()):
                if listed is not None and not listed:
                    automaton = None
                elif listed is not None:
                    automaton, needles = ahocorasick.Automaton(), listed
                    for i, needle in enumerate(listed):
                        automaton.add_word(needle, i)
                    automaton.make_automaton()
                elif automaton is not None:
                    hits = [{i for _, i in automaton.iter(t)} if t else set() for t in texts[row]]
                    any_hit = hits[0] if len(hits) == 1 else set().union(*hits)
                    rows.extend([row] * len(any_hit))
                    found.extend([needles[i] for i in any_hit])
                    for side, hit in zip(where, hits, strict=True):
                        side.extend([i in hit for i in any_hit])
            kept = batch.select(columns).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(found, pa.string()), *[pa.array(side, pa.bool_()) for side in where]],
                names=[*columns, "needle", *[f"in_{f}" for f in fields]],
            )

    return match


def scan(
    texts: DataFrame, needles: DataFrame, fields: list[str], part_chars: int = PART_CHARS, slice_texts: int = SLICE_TEXTS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row of `texts` (owner_id, fields, others) with each of its owner's needles that a field holds, and `in_<field>` for each field.

    The needles of an owner (owner_id, needle) are cut into parts of bounded text, the texts into slices; a task holds one part at a
    time and passes the rows of a slice one by one, so neither has to fit a task. A text comes back once for every needle it holds, with
    the columns `keep` of `texts` (all by default), so who counts hits asks for no text. Empty and null needles find nothing, null fields hold
    nothing, rows repeat as they came.
    """
    asked = needles.filter("needle <> ''").select("owner_id", "needle").distinct()
    parts = asked.groupBy("owner_id").agg(F.ceil(F.sum(F.length("needle")) / part_chars).cast("int").alias("_parts"))
    slices = texts.groupBy("owner_id").agg(F.ceil(F.count("*") / slice_texts).cast("int").alias("_slices"))
    sizes = parts.join(slices, "owner_id")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = asked.join(parts, "owner_id").groupBy("owner_id", F.pmod(F.xxhash64("needle"), F.col("_parts")).cast("int").alias("_part")).agg(
        F.collect_list("needle").alias("_needles")
    )
    # a part that no needle fell into has an empty list, so that its rows do not meet the one before
    told = sizes.select("owner_id", "_slices", upto("_parts").alias("_part")).join(lists, ["owner_id", "_part"], "left").select(
        "owner_id", "_part", upto("_slices").alias("_slice"), F.coalesce("_needles", F.array().cast("array<string>")).alias("_needles")
    )
    mine = F.pmod(F.xxhash64(*fields), F.col("_slices")).cast("int").alias("_slice")
    dealt = texts.join(sizes, "owner_id").select(*texts.columns, mine, upto("_parts").alias("_part")).unionByName(told, allowMissingColumns=True)
    key = ["owner_id", "_part", "_slice"]
    # the sort puts each list before its own rows
    sorted_ = dealt.repartition(*key).sortWithinPartitions(*key, F.col("_needles").isNull())
    kept = texts.columns if keep is None else keep
    schema = StructType([texts.schema[c] for c in kept]).add("needle", StringType())
    for f in fields:
        schema = schema.add(f"in_{f}", BooleanType())
    return sorted_.select(*dict.fromkeys([*kept, *fields]), "_needles").mapInArrow(_passes(kept, fields), schema)


def needle_grams(needle: Column) -> Column:
    """Windows that a text with the needle must hold."""
    return F.when(F.length(needle) >= WIDTH, text.grams(needle, WIDTH)).otherwise(F.array(needle))


def text_grams(*fields: Column) -> Column:
    """Windows of every width that needles are looked up by, of all fields."""
    return F.array_distinct(F.concat(*[text.grams(F.coalesce(f, F.lit("")), w) for f in fields for w in range(1, WIDTH + 1)]))


def numbered(texts: DataFrame, *fields: str) -> DataFrame:
    """Adds `text_id`, the same for rows of the same texts."""
    return texts.withColumn("text_id", F.xxhash64(*fields))


def gram_index(texts: DataFrame, fields: list[str], needles: DataFrame | None = None, part_texts: int = PART_TEXTS) -> DataFrame:
    """Posting lists (owner_id, gram, part, text_ids) of `texts` (owner_id, text_id, fields).

    The texts of an owner are dealt into parts by their id, as many as keep a part near `part_texts` texts, and a list holds the
    texts of one window and part: a window that stands in every text is as many lists as its owner has parts. With `needles`
    (owner_id, needle) only their windows are indexed. Repeated texts are listed once; null fields have no windows.
    """
    parts = texts.groupBy("owner_id").agg(F.ceil(F.count("*") / part_texts).cast("int").alias("_parts"))
    placed = texts.join(parts, "owner_id").withColumn("part", F.pmod(F.col("text_id"), F.col("_parts")).cast("int"))
    windows = text_grams(*[F.col(f) for f in fields])
    if needles is not None:
        # an owner's windows meet its texts in lists of bounded size, so that windows nobody asks for never become rows
        wanted = needles.select("owner_id", F.explode(needle_grams(F.col("needle"))).alias("gram")).distinct()
        sizes = wanted.groupBy("owner_id").agg(F.ceil(F.count("*") / LIST_WINDOWS).cast("int").alias("_lists"))
        share = F.pmod(F.xxhash64("gram"), F.col("_lists"))
        placed = placed.join(wanted.join(sizes, "owner_id").groupBy("owner_id", share).agg(F.collect_list("gram").alias("_wanted")).select("owner_id", "_wanted"), "owner_id")
        windows = F.array_intersect(windows, "_wanted")
    postings = placed.select("owner_id", "text_id", "part", F.explode(windows).alias("gram"))
    return postings.groupBy("owner_id", "gram", "part").agg(F.collect_set("text_id").alias("text_ids"))


def rarest_grams(needles: DataFrame, index: DataFrame) -> DataFrame:
    """Each needle (owner_id, needle) with its window of fewest texts and their number; needles with a window of no text go."""
    sizes = index.groupBy("owner_id", "gram").agg(F.sum(F.size("text_ids")).alias("texts"))
    # the counts of an owner meet its needles in lists of bounded size, so that the windows of needles never become rows;
    # a window is looked for in the one list that its hash names
    share = lambda gram: F.pmod(F.xxhash64(gram), F.col("_lists"))
    lists = sizes.groupBy("owner_id").agg(F.ceil(F.count("*") / LIST_WINDOWS).cast("int").alias("_lists"))
    told = sizes.join(lists, "owner_id").groupBy("owner_id", "_lists", share("gram").alias("_list")).agg(
        F.map_from_entries(F.collect_list(F.struct("gram", "texts"))).alias("_told")
    )
    every = lists.select("owner_id", "_lists", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_lists").cast("bigint") - 1)).alias("_list"))
    counts = every.join(told, ["owner_id", "_lists", "_list"], "left")
    asked = needles.select("owner_id", "needle", F.array_distinct(needle_grams(F.col("needle"))).alias("_grams")).join(counts, "owner_id")
    mine = F.filter("_grams", lambda gram: share(gram) == F.col("_list"))
    found = F.transform(mine, lambda gram: F.struct(F.coalesce(F.try_element_at("_told", gram), F.lit(0).cast("bigint")).alias("texts"), gram.alias("gram")))
    best = asked.groupBy("owner_id", "needle").agg(F.min(F.array_min(found)).alias("best"))
    return best.select("owner_id", "needle", "best.gram", "best.texts").filter("texts > 0")


def candidates(needles: DataFrame, index: DataFrame) -> DataFrame:
    """(owner_id, needle, text_id) of all texts that may hold a needle; the caller compares the texts themselves.

    `needles` are distinct (owner_id, needle) pairs; empty and null needles find nothing.
    """
    asked = needles.filter("needle <> ''").select("owner_id", "needle").distinct()
    lists = rarest_grams(asked, index).drop("texts").join(index, ["owner_id", "gram"])
    return lists.select("owner_id", "needle", F.explode("text_ids").alias("text_id"))

"""Best-fit packing by a grouping genetic algorithm: islands per block of pieces, with elite migration."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import stored

BLOCK = 8192  # pieces that islands pack together, on average
ISLANDS = 3
EPOCHS = 2  # between them each island gets its neighbour's best
POPULATION = 4
GENERATIONS = 8  # crossovers of an island in an epoch
WASTE = 1 / 32  # share of the capacity a finished sequence may leave free; others are packed again with other blocks'


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Put the pieces of `order` into `bins` (in place): each where least stays free, else into a new bin."""
    open_ = sorted((room, b) for b, room in enumerate(free))
    n = len(free)
    for i in order.tolist():
        size = int(lengths[i])
        at = bisect_left(open_, (size, -1))
        if at < len(open_):
            room, b = open_.pop(at)
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        if room > size:
            insort(open_, (room - size, b))


def numbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Fewer bins first, then fuller ones; smaller is better."""
    fill = np.bincount(bins, weights=lengths)
    return len(fill), -float((fill * fill).sum())


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    return max(math.ceil(int(lengths.sum()) / capacity), int((2 * lengths > capacity).sum()))


def crossover(lengths: np.ndarray, one: np.ndarray, two: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Whole well-filled bins of `two` go into `one`; bins of `one` that share a piece with them are dissolved,
    and the pieces that thereby lost their bin are put back best fit, longest first."""
    fill = np.bincount(two, weights=lengths)
    full = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = rng.choice(full, size=int(rng.integers(1, max(2, len(full) // 4 + 1))), replace=False)
    taken = np.zeros(len(fill), bool)
    taken[chosen] = True
    injected = taken[two]
    broken = np.zeros(int(one.max()) + 1, bool)
    broken[one[injected]] = True
    displaced = broken[one] & ~injected
    child = np.where(injected, two + len(broken), one)
    child[displaced] = -1
    placed = child >= 0
    child[placed] = numbered(child[placed])
    free = (capacity - np.bincount(child[placed], weights=lengths[placed])).astype(int).tolist()
    homeless = np.flatnonzero(displaced)
    best_fit(lengths, homeless[np.argsort(-lengths[homeless], kind="stable")], child, free, capacity)
    return child.astype(np.int32)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, options: dict) -> list[np.ndarray]:
    """An island's next population, the best first. It stops early once no packing can have fewer bins."""
    rng = np.random.default_rng(seed)
    least = least_bins(lengths, capacity)
    if not population:
        for i in range(options["population"]):
            bins = np.full(len(lengths), -1, np.int64)
            shaken = lengths * (1 + (0 if i == 0 else 0.1 * i) * (rng.random(len(lengths)) - 0.5))
            best_fit(lengths, np.argsort(-shaken, kind="stable"), bins, [], capacity)
            population.append(numbered(bins))
            if population[-1].max() + 1 <= least:
                break
    scored = sorted(((fitness(lengths, p), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    for generation in range(options["generations"]):
        if scored[0][0][0] <= least or len(scored) < 2:
            break
        mother, father = (scored[int(i)][2] for i in rng.choice(len(scored), 2, replace=False))
        child = crossover(lengths, mother, father, capacity, rng)
        entry = (fitness(lengths, child), len(population) + generation, child)
        if entry[0] < scored[-1][0]:
            scored = sorted([*scored[:-1], entry], key=lambda x: x[:2])
    return [p for _, _, p in scored[: options["population"]]]


def _epoch(capacity: int, level: int, epoch: int, options: dict):
    def run(frames):
        for frame in frames:
            grown = []
            for row in frame.itertuples():
                lengths = np.asarray(row.lengths, np.int64)
                population = [np.asarray(p, np.int32) for p in (row.population if row.population is not None else [])]
                if row.migrant is not None:
                    population.append(np.asarray(row.migrant, np.int32))
                seed = hash((level, epoch, row.block, row.island)) & 0x7FFFFFFF
                grown.append(evolve(lengths, population, capacity, seed, options))
            yield pd.DataFrame({"block": frame.block, "island": frame.island, "lengths": frame.lengths, "population": [[p.tolist() for p in g] for g in grown]})

    return run


def _placed(capacity: int):
    """Rows (rid, block, bin, offset, room) of the best individual of each block."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                bins, lengths = np.asarray(row.best, np.int64), np.asarray(row.lengths, np.int64)
                by = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[by])
                first = np.concatenate([[True], bins[by][1:] != bins[by][:-1]])
                base = np.repeat((ends - lengths[by])[first], np.diff(np.append(np.flatnonzero(first), len(by))))
                fill = np.bincount(bins, weights=lengths).astype(np.int64)
                yield pd.DataFrame(
                    {
                        "rid": np.asarray(row.rids, np.int64)[by], "length": lengths[by], "block": row.block, "bin": bins[by],
                        "offset": ends - lengths[by] - base, "room": capacity - fill[bins[by]],
                    }
                )

    return run


STATE = "block long, island int, lengths array<int>, population array<array<int>>"


def _level(items: DataFrame, blocks: int, level: int, capacity: int, options: dict) -> DataFrame:
    """Best packing found of each block of `items` (rid, length)."""
    block = F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(blocks)).alias("block")
    held = items.select(block, F.struct((-F.col("length")).cast("int").alias("size"), "rid").alias("item")).groupBy("block").agg(
        F.sort_array(F.collect_list("item")).alias("items")
    )
    held = stored(held.select("block", F.transform("items", lambda x: -x["size"]).alias("lengths"), F.col("items.rid").alias("rids")), "packing-blocks")
    state = held.select("block", "lengths", F.explode(F.sequence(F.lit(0), F.lit(options["islands"] - 1))).alias("island"))
    state = state.withColumn("population", F.lit(None).cast("array<array<int>>")).withColumn("migrant", F.lit(None).cast("array<int>"))
    for epoch in range(options["epochs"]):
        if epoch:
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(options["islands"])).alias("island"), F.col("population")[0].alias("migrant"))
            state = state.join(elite, ["block", "island"])
        spread = state.repartition("block", "island").select("block", "island", "lengths", "population", "migrant")
        state = stored(spread.mapInPandas(_epoch(capacity, level, epoch, options), STATE), "packing-islands")
    sized = state.select("block", "island", F.col("population")[0].alias("best")).withColumn("bins", F.array_max("best"))
    first = sized.groupBy("block").agg(F.min_by("best", F.struct("bins", "island")).alias("best"))
    return stored(
        held.join(first, "block").mapInPandas(_placed(capacity), "rid long, length int, block long, bin long, offset long, room long"), "packing-placed"
    )


def pack(
    pieces: DataFrame, capacity: int, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS,
    population: int = POPULATION, generations: int = GENERATIONS, waste: float = WASTE,
) -> DataFrame:
    """`pieces` (with `length`, 0 to `capacity`) plus sequence_id and offset, in as few sequences as found.

    Full pieces are sequences of their own. The others are dealt by a hash of their row number into blocks of
    about `block` pieces; every island of a block evolves packings of it from best-fit ones, and
    gives its best to the next island after each epoch. The sequences of a block that leave more than `waste` of the
    capacity free are dissolved, and their pieces packed anew in larger company, until one block holds
    all of them or that no longer halves them. Every row gets exactly one place; no group outgrows a block.
    """
    options = {"islands": islands, "epochs": epochs, "population": population, "generations": generations}
    rows = stored(pieces.drop("sequence_id", "offset").withColumn("_rid", F.monotonically_increasing_id()), "packing-pieces")
    items = rows.where(F.col("length") < capacity).select(F.col("_rid").alias("rid"), F.col("length").cast("int").alias("length"))
    places = rows.where(F.col("length") >= capacity).select(F.col("_rid").alias("rid"), (-1 - F.col("_rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    count, level = items.count(), 0
    while count:
        blocks = math.ceil(count / block)
        placed = _level(items, blocks, level, capacity, options)
        loose = placed.where(F.col("room") > waste * capacity).select("rid", "length")
        left = loose.count() if blocks > 1 else 0
        again = blocks > 1 and 0 < 2 * left <= count
        final = placed.where(F.col("room") <= waste * capacity) if again else placed
        number = F.lit(level << 56) + F.shiftleft("block", 20) + F.col("bin")
        places = places.union(final.select("rid", number.alias("sequence_id"), "offset"))
        if not again:
            break
        items, count, level = loose, left, level + 1
    return rows.join(places.withColumnRenamed("rid", "_rid"), "_rid").drop("_rid")

"""Near-duplicates by the Jaccard coefficient of word shingles: MinHash bands find candidates, whole sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components
from ledgerloom.llm.storage import stored

SHINGLE = 5  # words
LIKENESS = 0.8  # least Jaccard coefficient
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band with probability (1 - 0.8**4)**24, 3 in a million
UNIT_HASHES = 500_000  # shingles of the nodes that one block of a slot holds, about
_RNG = np.random.default_rng(simhash.SEED)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; none without words."""
    return np.unique(simhash.shingle_hashes(text, width))


def node(hashes: np.ndarray) -> int:
    """Signed 64-bit digest of a set: texts with equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED)).view(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One value a band, its number mixed in, from the least of each permuted set; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64).view(np.int64)


def _texts(batch):
    for t in batch.column("text").cast(pa.large_binary()).to_pylist():
        yield t or b""


def _digests(width: int):
    """Each row's `text` replaced by the digest of its set, `bits`."""

    def run(batches):
        for batch in batches:
            made = pa.array([node(shingle_set(t, width)) for t in _texts(batch)], pa.int64())
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], names=[*names, "bits"])

    return run


def _signatures(width: int, prints: bool = False):
    """Each row's node, size of its set and bands; with `prints` also the SimHash fingerprint of its text."""
    fields = {"bits": pa.int64(), "size": pa.int64(), "bands": pa.list_(pa.int64())} | ({"print": pa.int64()} if prints else {})
    def run(batches):
        for batch in batches:
            sets = ((t, shingle_set(t, width)) for t in _texts(batch))
            made = [(node(s), len(s), bands(s), *([simhash.fingerprint(t)] if prints else [])) for t, s in sets]
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *fields])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for t in _texts(batch):
                s = shingle_set(t, width)
                yield pa.RecordBatch.from_arrays([pa.array([node(s)], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["bits", "hashes"])

    return run


def _sized(a, b, likeness: float):
    """Whether sets of these sizes can be alike at all."""
    return F.least(a, b) >= F.lit(likeness) * F.greatest(a, b) - F.lit(1e-9)


def _alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) whose whole sets reach `likeness`."""
    both = pairs.join(sets.select(F.col("bits").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("bits").alias("b"), F.col("hashes").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(likeness) * (F.size("x") + F.size("y") - shared) - F.lit(1e-9)).select("a", "b")


def unit_links(sets: list[np.ndarray], roots: np.ndarray, sides: np.ndarray, likeness: float) -> tuple[list[int], list[int]]:
    """Links (index, index) between sets of different roots that reach `likeness`: enough of them to join what they join.

    Sets are held in order of size, so only a run of sizes can be alike to each. The shingles of one set are marked, and
    the marks under all sets of the run are counted at once; sets that are joined already are skipped. If the sides differ at all, only
    sets of different sides are compared.
    """
    by = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in by])
    _, code = np.unique(np.concatenate([sets[i] for i in by]), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes)])
    side = sides[by]
    crossed = len(np.unique(side)) > 1
    joined = np.unique(roots[by], return_inverse=True)[1]
    mark = np.zeros(int(code.max()) + 1, np.int32)
    left, right = [], []
    top = np.searchsorted(sizes, sizes / likeness + 1e-9, side="right")
    for x in range(len(by) - 1):
        low, high = x + 1, int(top[x])
        other = joined[low:high] != joined[x]
        if crossed:
            other &= side[low:high] != side[x]
        if not other.any():
            continue
        own = code[start[x] : start[x + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[code[start[low] : start[high]]], start[low:high] - start[low])
        mark[own] = 0
        near = np.flatnonzero(other & (common >= likeness * (sizes[x] + sizes[low:high] - common) - 1e-9))
        labels, at = np.unique(joined[low + near], return_index=True)
        left += [int(by[x])] * len(at)
        right += by[low + near[at]].tolist()
        if len(labels):
            joined[np.isin(joined, labels)] = joined[x]
    return left, right


def _units(likeness: float):
    """Links inside the units of a partition sorted by (slot, one, two); one unit is held at a time."""

    def compared(held):
        sets = [x for _, _, _, part in held for x in part]
        bits, roots, sides = (np.concatenate([h[i] for h in held]) for i in range(3))
        left, right = unit_links(sets, roots, sides, likeness) if len(sets) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(bits[left], pa.int64()), pa.array(bits[right], pa.int64())], names=["a", "b"])

    def run(batches):
        held, unit = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("slot", "one", "two")], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            bits, roots, sides = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bits", "root", "side"))
            hashes = batch.column("hashes")
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key = tuple(keys[begin])
                if held and key != unit:
                    yield compared(held)
                    held = []
                unit = key
                part = hashes.slice(begin, end - begin)
                at = np.cumsum([0, *pa.compute.list_value_length(part).to_pylist()])
                flat = part.flatten().to_numpy(zero_copy_only=False)
                held.append((bits[begin:end], roots[begin:end], sides[begin:end], [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]))
        if held:
            yield compared(held)

    return run


def _mixed_links(placed: DataFrame, sets: DataFrame, likeness: float, unit_hashes: int) -> DataFrame:
    """Links between the different roots of a slot. `placed`: slot, bits, size, root.

    A slot's nodes are dealt into blocks of some `unit_hashes` shingles; every two blocks, and each with itself, are a unit
    that one task compares. So the rows are the nodes times the blocks of their slot, and never its pairs.
    """
    slots = placed.groupBy("slot").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("weight")).where("low <> high")
    blocks = F.ceil(F.col("weight") / unit_hashes).cast("int")
    dealt = placed.join(slots.select("slot", blocks.alias("blocks")), "slot").withColumn("side", F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = dealt.withColumn("other", other).select(
        "slot", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "bits", "root"
    )
    whole = units.join(sets, "bits").select("slot", "one", "two", "side", "bits", "root", "hashes")
    return whole.repartition("slot", "one", "two").sortWithinPartitions("slot", "one", "two").mapInArrow(_units(likeness), "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, width: int, likeness: float, unit_hashes: int = UNIT_HASHES) -> DataFrame:
    """(a, b): links between nodes that hold every candidate pair of at least `likeness` together.

    Candidates share a value of a band. First all nodes of a value are held against its least one; the values whose nodes are
    still in different components after that are compared in units of bounded size, which give back a forest and no pairs.
    """
    slots = nodes.select("bits", "size", "least_id", F.explode("bands").alias("slot"))
    least = slots.groupBy("slot").agg(F.min(F.struct("bits", "size")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = stored(slots.join(least, "slot"), "jaccard-slots")
    wanted = shared.select("bits", "least_id").distinct()
    texts = docs.select("doc_id", "text")
    texts = texts.join(wanted.select(F.col("least_id").alias("doc_id")).distinct(), "doc_id", "left_semi").union(texts.where("doc_id is null"))
    sets = texts.select("text").mapInArrow(_sets(width), "bits long, hashes array<long>").join(wanted.select("bits"), "bits", "left_semi")
    sets = stored(sets.groupBy("bits").agg(F.first("hashes").alias("hashes")), "jaccard-sets")
    star = shared.where((F.col("first.bits") != F.col("bits")) & _sized(F.col("first.size"), F.col("size"), likeness))
    near = stored(_alike(star.select(F.col("first.bits").alias("a"), F.col("bits").alias("b")).distinct(), sets, likeness), "jaccard-near")
    roots = components(near).withColumnRenamed("node", "bits")
    placed = shared.where("first.bits <> bits").join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits")).select("slot", "bits", "size", "root")
    return near.union(_mixed_links(stored(placed, "jaccard-placed"), sets, likeness, unit_hashes))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between nodes whose texts have SimHash fingerprints that `simhash.links` links. `prints`: bits, print.

    A fingerprint stands for the least of its nodes, which the others of the same fingerprint are linked with.
    """
    nodes = stored(prints.select("bits", "print").distinct(), "jaccard-fingerprints")
    least = stored(nodes.groupBy("print").agg(F.min("bits").alias("to")), "jaccard-least")
    same = nodes.join(least, "print").where("bits <> to").select(F.col("bits").alias("a"), F.col("to").alias("b"))
    near = simhash.links(least.select(F.col("print").alias("bits")))
    near = near.join(least.select(F.col("print").alias("a"), F.col("to").alias("_a")), "a")
    near = near.join(least.select(F.col("print").alias("b"), F.col("to").alias("_b")), "b")
    return same.union(near.select("_a", "_b"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, likeness: float = LIKENESS, fingerprints: bool = False) -> DataFrame:
    """(doc_id, bits, component_id, root) for every row of `docs` (doc_id, text).

    bits names the row's set of shingles, root its component; component_id is the smallest doc_id in it, null where no
    member has an id. Equal sets are one node. Texts without words share the empty set. Repeated rows each come back.
    With `fingerprints` texts are also linked whose SimHash fingerprints are close, as by `simhash.near_duplicates`.
    """
    schema = "doc_id long, bits long, size long, bands array<long>" + (", print long" if fingerprints else "")
    prints = stored(docs.select("doc_id", "text").mapInArrow(_signatures(width, fingerprints), schema), "jaccard-prints")
    nodes = prints.groupBy("bits").agg(F.min("doc_id").alias("least_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "jaccard-nodes")
    found = links(docs, nodes, width, likeness)
    found = components(found.union(fingerprint_links(prints)) if fingerprints else found)
    member = nodes.select("bits", "least_id").join(found.withColumnRenamed("node", "bits"), "bits", "left")
    member = stored(member.withColumn("root", F.coalesce("root", "bits")), "jaccard-members")
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.select("doc_id", "bits").join(member.join(least, "root").select("bits", "component_id", "root"), "bits").select("doc_id", "bits", "component_id", "root")


def representatives(docs: DataFrame, width: int = SHINGLE, likeness: float = LIKENESS, fingerprints: bool = False) -> DataFrame:
    """`docs` with one row of each component, chosen as by `simhash.representatives`."""
    classes = stored(near_duplicates(docs, width, likeness, fingerprints), "jaccard-classes")
    nameless = classes.where("component_id is null").groupBy("root").agg(F.min("bits").alias("bits")).select("bits")
    return simhash.kept(docs, classes, nameless, _digests(width))

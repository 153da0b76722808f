"""SimHash near-duplicates: 64-bit majority fingerprints linked at a bounded Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.storage import stored

BLOCKS = 6  # parts of a fingerprint
DISTANCE = 4  # differing bits at which two fingerprints still link
BUCKET_ROWS = 16384  # fingerprints of one block value that one task compares directly
SHINGLE = 4
SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of the text's word shingles in their order, repeats included.

    Words are runs of bytes other than white space, A-Z lower-cased; a text with fewer words than
    `width` has its whole sequence as the only shingle.
    """
    words = text.lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the text's word shingles; 0 without words. A bit is set if over half the shingles' hashes have it."""
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        made = pa.array([fingerprint(t or b"") for t in texts], pa.int64())
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*kept, made], names=[*names, "bits"])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n indices over the links a[i]-b[i]."""
    to = np.arange(n)
    while len(a):
        x, y = to[a], to[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(to, up := to[to]):
            to = up
    return to


def near_links(run: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (index, root) of the pairs inside equal runs that differ in at most `distance` bits.

    `run` is sorted. Every pair inside a run is compared, but links are folded into the forest as
    they come, so what is kept grows with the rows and not with the pairs.
    """
    n = len(run)
    to = np.arange(n)
    left, right, held = [], [], 0
    at = np.arange(n)
    step = 1
    while True:
        at = at[at + step < n]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        close = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= distance]
        if len(close):
            left.append(close)
            right.append(close + step)
            held += len(close)
        if held > 4 * n:
            moved = np.flatnonzero(to != np.arange(n))
            to = roots(n, np.concatenate([moved, *left]), np.concatenate([to[moved], *right]))
            left, right, held = [], [], 0
        step += 1
    if held:
        moved = np.flatnonzero(to != np.arange(n))
        to = roots(n, np.concatenate([moved, *left]), np.concatenate([to[moved], *right]))
    moved = np.flatnonzero(to != np.arange(n))
    return moved, to[moved]


def _bucket_links(distance: int, bucket_rows: int):
    """Links inside the block values of a partition sorted by (block, value). A value with more than
    `bucket_rows` fingerprints gives them back as (bits, null), for the variants."""

    def links(block, value, bits):
        change = np.flatnonzero((block[1:] != block[:-1]) | (value[1:] != value[:-1])) + 1
        sizes = np.diff(np.concatenate([[0], change, [len(bits)]]))
        run = np.repeat(np.arange(len(sizes)), sizes)
        alone = np.repeat(sizes, sizes) < 2
        run, bits = run[~alone], bits[~alone]
        i, root = near_links(run, bits.view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(bits[i]), pa.array(bits[root])], names=["a", "b"])

    def hot(bits):
        return pa.RecordBatch.from_arrays([pa.array(bits), pa.nulls(len(bits), pa.int64())], names=["a", "b"])

    def run(batches):
        held: list[tuple] = []  # rows not yet compared; the last value may go on in the next batch
        rows, over = 0, None  # over: the value that is being given back
        for batch in batches:
            block, value, bits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "value", "bits"))
            if over is not None:
                same = (block == over[0]) & (value == over[1])
                if same.any():
                    yield hot(bits[same])
                    block, value, bits = block[~same], value[~same], bits[~same]
                if not len(bits):
                    continue
                over = None
            if not len(bits):
                continue
            held.append((block, value, bits))
            rows += len(bits)
            if rows < 2 * bucket_rows:
                continue
            block, value, bits = (np.concatenate(x) for x in zip(*held, strict=True))
            tail = len(bits) - int(np.argmin(((block == block[-1]) & (value == value[-1]))[::-1])) if (block[0], value[0]) != (block[-1], value[-1]) else 0
            yield from whole(block[:tail], value[:tail], bits[:tail])
            if len(bits) - tail > bucket_rows:
                over = (block[-1], value[-1])
                yield hot(bits[tail:])
                held, rows = [], 0
            else:
                held, rows = [(block[tail:], value[tail:], bits[tail:])], len(bits) - tail
        if held:
            yield from whole(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def whole(block, value, bits):
        if not len(bits):
            return
        change = np.flatnonzero((block[1:] != block[:-1]) | (value[1:] != value[:-1])) + 1
        sizes = np.diff(np.concatenate([[0], change, [len(bits)]]))
        big = np.repeat(sizes, sizes) > bucket_rows
        if big.any():
            yield hot(bits[big])
        yield links(block[~big], value[~big], bits[~big])

    return run


def _variants(flips: int):
    """Each fingerprint with up to `flips` bits turned: two fingerprints at most 2 * flips apart share one."""
    one = [1 << i for i in range(64)]
    masks = np.array([sum(c) for k in range(flips + 1) for c in combinations(one, k)], np.uint64)

    def run(batches):
        for batch in batches:
            bits = batch.column("a").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(bits), 256):
                part = bits[i : i + 256]
                made = (part[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part, len(masks)).view(np.int64)), pa.array(made)], names=["a", "variant"]
                )

    return run


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (`bits`) that differ in at most `distance` bits.

    Fingerprints are cut into `blocks` parts; a close pair agrees on at least `blocks - distance` of them, so
    it meets under one choice of that many parts. The links of a block value are a spanning forest of all its
    close pairs. A value with more than `bucket_rows` fingerprints is not compared in one task: its
    fingerprints are spread over all variants with distance/2 turned bits, where any two that share a
    variant are close. That is linear in their number and exact, and a variant has a bounded group.
    """
    if distance % 2 or blocks <= distance:
        raise ValueError("distance must be even and smaller than the number of blocks")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    masks = [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select(
        "bits", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("bits").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)])).alias("key")
    ).select("key.block", "key.value", "bits")
    found = stored(
        keyed.repartition("block", "value").sortWithinPartitions("block", "value").mapInArrow(_bucket_links(distance, bucket_rows), "a long, b long"),
        "simhash-links",
    )
    spread = found.where("b is null").select("a").distinct().mapInArrow(_variants(distance // 2), "a long, variant long")
    least = spread.groupBy("variant").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("variant", "b")
    return found.where("b is not null").union(spread.join(least, "variant").where("a <> b").select("a", "b"))


def near_duplicates(
    docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(doc_id, bits, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable over links, itself included. Equal fingerprints are
    one node, so copies cost nothing. Texts without words (null, empty, white space) share fingerprint 0
    and link like any other. Repeated rows each come back. A null doc_id never names a component unless
    no member has an id. Other columns are ignored.
    """
    prints = stored(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, bits long"), "simhash-prints")
    nodes = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    found = components(links(nodes.select("bits"), distance, blocks, bucket_rows))
    member = found.withColumnRenamed("node", "bits").join(nodes, "bits", "right").withColumn("root", F.coalesce("root", "bits"))
    member = stored(member, "simhash-members")
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = member.join(least, "root").select("bits", "component_id")
    return prints.join(classes, "bits").select("doc_id", "bits", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each component: the row with its smallest id, and of rows that repeat that id one.

    A component without any id keeps one row. Rows whose id is null or repeated are told apart by their
    fingerprint and then by the least of their columns (which must be of types that can be ordered).
    """
    classes = stored(near_duplicates(docs, **options), "simhash-classes")
    unnamed = classes.where("component_id is null")  # fingerprints that link to no id; few, if any
    first = components(links(unnamed.select("bits").distinct(), **options)).where("node <> root").select(F.col("node").alias("bits"))
    return kept(docs, classes, unnamed.select("bits").distinct().join(first, "bits", "left_anti"), _fingerprints)


def kept(docs: DataFrame, classes: DataFrame, nameless: DataFrame, fingerprints) -> DataFrame:
    """The rows of `docs` that `classes` (doc_id, bits, component_id) name, and one of each of the `nameless` fingerprints (bits).
    `fingerprints` replaces a row's `text` by its `bits`."""
    named = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.min("bits").alias("bits"))
    nameless = nameless.select(F.lit(None).cast("long").alias("doc_id"), "bits")
    again = stored(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-repeated")
    single = docs.join(named.select("doc_id"), "doc_id", "left_semi").join(again, "doc_id", "left_anti")
    odd = docs.join(again, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    printed = odd.select("doc_id", "text", row.alias("row"))
    schema = printed.drop("text").withColumn("bits", F.lit(0).cast("long")).schema
    printed = printed.mapInArrow(fingerprints, schema)
    chosen = named.join(again, "doc_id", "left_semi").union(nameless)
    same = (F.col("p.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("p.bits") == F.col("c.bits"))
    rest = printed.alias("p").join(chosen.alias("c"), same, "left_semi").groupBy("doc_id", "bits").agg(F.min("row").alias("row")).select("row.*")
    return single.select(*docs.columns).union(rest)

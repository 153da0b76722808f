"""Document fingerprints from closed syncmers: k-mers whose least inner substring lies at an edge."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, S = 12, 4  # code points of a k-mer and of its inner substrings
ANCHORS = 48  # of a fingerprint: those with the smallest hashes
CHUNK_CHARS = 1_000_000  # of texts that are worked on at once
_BASE = 0x9E3779B97F4A7C15
_LEAST = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def closed_syncmers(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, 32-bit hash) of every k-mer of `code` that is a closed syncmer; a k-mer's own signs alone decide."""
    n = len(code)
    one = np.concatenate([code.astype(np.uint64), np.zeros(16, np.uint64)])
    base = [pow(_BASE, e, 1 << 64) for e in (1, 2, 4)]
    two = one[:-1] * np.uint64(base[0]) + one[1:]
    four = two[:-2] * np.uint64(base[1]) + two[2:]
    eight = four[:-4] * np.uint64(base[2]) + four[4:]
    order = _mixed(four)
    # least of the K - S + 1 = 9 substrings that begin at i
    least = np.minimum(order[:-1], order[1:])
    least = np.minimum(least[:-2], least[2:])
    least = np.minimum(least[:-4], least[4:])
    m = max(0, n - K + 1)
    least = np.minimum(least[:m], order[8 : 8 + m])
    at = np.flatnonzero((least == order[:m]) | (least == order[8 : 8 + m]))
    return at, _mixed(eight[at] * np.uint64(base[2]) + four[at + 8])


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Per text its anchors (hash << 32 | position of its first occurrence) with the ANCHORS smallest hashes, ascending.

    An empty text has none; a text without a syncmer is one anchor as a whole.
    """
    if not texts:
        return []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(sizes) - sizes
    at, value = closed_syncmers(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    text = np.searchsorted(start, at, side="right") - 1
    inside = at + K <= (start + sizes)[text]  # not across two texts; of equal starts the last has the signs
    at, value, text = at[inside], value[inside], text[inside]
    key = (text << 32) | value.astype(np.int64)
    by = np.argsort(key)
    key, at = key[by], at[by]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key = key[head]
    first = np.minimum.reduceat(at, head) if len(head) else at
    bounds = np.searchsorted(key, np.arange(len(texts) + 1) << 32)
    out = []
    for i, t in enumerate(texts):
        low, high = bounds[i], min(bounds[i + 1], bounds[i] + ANCHORS)
        if low < high:
            out.append((((key[low:high] & 0xFFFFFFFF) << 32) | (first[low:high] - start[i])).astype(np.uint64))
        else:
            out.append(np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) << 32] if t else [], np.uint64))
    return out


def written(sketch: np.ndarray) -> str:
    """16 hex digits an anchor: 8 of its hash, 8 of its position."""
    return sketch.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of both sketches that both have, in the same order of positions (0 to 1)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    one = dict(zip((a >> np.uint64(32)).tolist(), (a & np.uint64(0xFFFFFFFF)).tolist(), strict=True))
    two = dict(zip((b >> np.uint64(32)).tolist(), (b & np.uint64(0xFFFFFFFF)).tolist(), strict=True))
    union = sorted(one.keys() | two.keys())[:ANCHORS]
    chain: list[int] = []  # least ends of increasing runs: its length is that of the longest common order
    for _, place in sorted((one[h], two[h]) for h in union if h in one and h in two):
        i = bisect_left(chain, place)
        chain[i : i + 1] = [place]
    return len(chain) / len(union)


def _compared(batches):
    """Rows sorted by (bucket, tail, doc_id, text): each with its edited text and its next one. Tails are given back no more."""
    held: list[tuple] = []
    size = 0

    def flush(rows):
        """Results of all rows that their next one follows; the last waits for it."""
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        texts = [r[1] for r in rows]
        edited = []
        for i, j in pairs:
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[j][:half])
        own, changed = sketches(texts), sketches(edited)
        columns = [
            [rows[i][0] for i, _ in pairs], [len(texts[i]) for i, _ in pairs],
            [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            [written(own[i]) for i, _ in pairs], [written(c) for c in changed],
            [likeness(own[i], c) for (i, _), c in zip(pairs, changed, strict=True)], [likeness(own[i], own[j]) for i, j in pairs],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail")), strict=True):
            held.append(row)
            size += len(row[1])
            if size > CHUNK_CHARS and len(held) > 1:
                yield flush(held)
                held, size = held[-1:], len(held[-1][1])
    if held:
        yield flush(held)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most `value`: first among every so many of them, then between two."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    all_ = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[step - 1 :: step]])
    full = F.size(F.filter(coarse, lambda b: b <= value)) * step
    return full + F.size(F.filter(F.slice(all_, full + 1, step), lambda b: b <= value))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, bucket, tail) dealt by ranges of doc_id and sorted; the first row of a range also ends the
    one before, marked `tail`, and that of the first range ends the last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_LEAST).cast("long")).alias("place"))
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("place", shares, 10_000).alias("b")).first()[0] if shares else None
    bounds = sorted(set(found or []))
    rows = rows.withColumn("bucket", _bucket(F.col("place"), bounds))
    lows = sorted((r.bucket, r.low) for r in rows.groupBy("bucket").agg(F.min("place").alias("low")).collect())  # at most `parts` rows
    before = {b: lows[i - 1][0] for i, (b, _) in enumerate(lows)}
    main = rows.select("doc_id", "text", "bucket", F.lit(False).alias("tail"))
    if lows:
        named = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        tails = rows.where(F.col("place").isin([low for _, low in lows])).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
        main = main.union(tails.select("doc_id", "text", named[F.col("bucket")].alias("bucket"), F.lit(True).alias("tail")))
    return main.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text (doc_id, text) and of its edited form, and their likeness to each other and to the next.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next
    document in ascending (doc_id, text) order, after the last the first; a lone document is its own next one.
    Null texts are empty, a null doc_id comes first, repeated rows follow each other. Other columns are ignored.
    One shuffle deals the texts by ranges of doc_id; tasks read their rows as a stream.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return with_next(docs, parts).mapInArrow(_compared, SCHEMA)

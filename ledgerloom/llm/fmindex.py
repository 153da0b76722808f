"""Benchmark decontamination: an FM-index over the words of each training shard, searched for all test phrases."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import work_folder
from ledgerloom.llm.warc import file_system
from ledgerloom.llm.words import ALNUM, Words, chunks

WINDOW = 10  # consecutive words of a phrase
SHARD_WORDS = 1_000_000  # words of one index; a longer document has an index of its own
CHUNK_BYTES = 2_000_000  # text whose words are found and hashed at once
SAMPLE = 16  # every so many positions of a shard are kept for locating
PHRASE_BYTES = 8_000_000  # benchmark text of one block; more text makes more blocks, searched one after another


class WaveletMatrix:
    """Rank over a sequence of small integers: one bit row per level, with counts every 64 bits."""

    def __init__(self, values: np.ndarray, top: int):
        self.n = len(values)
        self.levels = []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.pad(packed, (0, 8 * (self.n // 64 + 1) - len(packed))).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            zeros = self.n - int(bit.sum())
            self.levels.append((level, packed, before, zeros))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(packed, before, at):
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position `at`."""
        begin, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, packed, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            b, e = self._ones(packed, before, begin), self._ones(packed, before, end)
            begin, end = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, end - e)
        return end - begin


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Text positions in the order of their suffixes. Each 0 counts as a sign of its own, less than all words
    and in text order, so suffixes never compare past one; the last symbol is 0."""
    n = len(symbols)
    first = symbols.astype(np.int64)
    zero = first == 0
    zeros = int(zero.sum())
    first += zeros
    first[zero] = np.arange(zeros)
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begin = np.flatnonzero(head)
    group = np.repeat(begin, np.diff(np.append(begin, n)))  # slot of each group's first member
    rank = np.empty(n, np.int64)
    rank[order] = group
    size = np.diff(np.append(begin, n))
    open_ = order[np.repeat(size, size) > 1]
    step = 1
    while len(open_):
        one, two = rank[open_], rank[open_ + step]
        by = np.argsort(one * n + two)
        open_, one, two = open_[by], one[by], two[by]
        new = np.concatenate([[True], one[1:] != one[:-1]])
        at = np.flatnonzero(new)
        slot = one + np.arange(len(open_)) - np.repeat(at, np.diff(np.append(at, len(open_))))
        order[slot] = open_
        split = new.copy()
        split[1:] |= two[1:] != two[:-1]
        at = np.flatnonzero(split)
        size = np.diff(np.append(at, len(open_)))
        rank[open_] = np.repeat(slot[at], size)
        open_ = open_[np.repeat(size, size) > 1]
        step *= 2
    return order


class FMIndex:
    """Counts and places of word phrases in one shard, by backward search and sampled suffix positions."""

    def __init__(self, symbols: np.ndarray, top: int):
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.last = symbols[order - 1]  # of position 0 the closing 0 stands before it
        counts = np.bincount(symbols, minlength=top + 1)
        self.less = np.cumsum(counts) - counts
        self.tree = WaveletMatrix(self.last, top)
        kept = (order % SAMPLE == 0) | (self.last == 0)  # a walk to the left never has to pass a 0
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.places = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffix rows that begin with each phrase (a row of symbols, all of one length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            low[live] = self.less[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        gone = np.ones(len(phrases), bool)
        gone[live] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps to the left until a sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.kept[rows])
        while len(live):
            symbol = self.last[rows[live]]
            rows[live] = self.less[symbol] + self.tree.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.kept[rows[live]]]
        return self.places[self.kept_before[rows]] + steps


class Phrases:
    """Distinct windows of a block of benchmark items as rows of symbols, by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        words = Words([text for _, text in items], ALNUM, lower=True)
        spelled = [words.word(i) for i in range(len(words.start))]
        number = {w: i + 1 for i, w in enumerate(sorted(set(spelled)))}
        self.words = [b"", *number]
        self.top = len(number)
        symbols = np.array([number[w] for w in spelled], np.int64)
        names = [item for item, _ in items]
        self.items = sorted({item for item in names if item is not None})
        place = {item: i for i, item in enumerate(self.items)}
        item_no = np.array([place.get(item, -1) for item in names], np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        length = np.minimum(words.count, window)
        for size in np.unique(length[length > 0]).tolist():
            texts = np.flatnonzero(length == size)
            many = words.count[texts] - size + 1  # 1 for a text shorter than the window
            start = np.arange(many.sum()) + np.repeat(words.first[texts] - (np.cumsum(many) - many), many)
            rows, which = np.unique(symbols[start[:, None] + np.arange(size)], axis=0, return_inverse=True)
            owner = np.repeat(item_no[texts], many)
            owned = np.unique(np.stack([which.ravel()[owner >= 0], owner[owner >= 0]]), axis=1)
            self.rows[size] = rows
            self.owners[size] = (np.searchsorted(owned[0], np.arange(len(rows) + 1)), owned[1])
        if number:
            known = Words(self.words[1:], ALNUM, lower=False).hashes()
            by = np.argsort(known, kind="stable")
            self.known, self.symbol = known[by], by + 1

    def items_of(self, size: int, row: int) -> list[str]:
        """Items that hold a window."""
        begin, item = self.owners[size]
        return [self.items[i] for i in item[begin[row] : begin[row + 1]].tolist()]

    def symbols(self, words: Words) -> np.ndarray:
        """Symbol of each word; 0 for a word of no phrase."""
        if not self.top or not len(words.start):
            return np.zeros(len(words.start), np.int64)
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.symbol[at], 0)


def occurrences(phrases: Phrases, shard: list[tuple[Words, np.ndarray]]):
    """Per text of a shard (in order): the words inside an occurrence as ranges, and the items found.

    Words are matched by hash in the index; every located word is then compared by its bytes.
    """
    texts = [(w, t) for w, _ in shard for t in range(len(w.first))]
    counts = np.concatenate([w.count for w, _ in shard])
    begin = np.cumsum(counts + 1) - (counts + 1)  # each text is closed by a 0
    symbols = np.zeros(int((counts + 1).sum()), np.int64)
    place = np.arange(counts.sum()) + np.repeat(np.arange(len(counts)), counts)
    symbols[place] = np.concatenate([s for _, s in shard])
    hits: list[list] = [[] for _ in texts]
    items: list[dict] = [{} for _ in texts]
    if not symbols.any():
        return hits, items
    index = FMIndex(symbols, phrases.top)
    change = np.zeros(len(symbols) + 1, np.int64)
    good: dict[int, bool] = {}

    def spelled(at: int, text: int) -> bool:
        if at not in good:
            words, t = texts[text]
            good[at] = words.word(int(words.first[t]) + at - int(begin[text])) == phrases.words[symbols[at]]
        return good[at]

    for size, rows in phrases.rows.items():
        low, high = index.search(rows)
        found = np.flatnonzero(low < high)
        for part in np.array_split(found, max(1, int((high - low).sum()) // 1_000_000)):
            many = high[part] - low[part]
            if not len(many):
                continue
            which = np.repeat(part, many)
            row = np.arange(many.sum()) + np.repeat(low[part] - (np.cumsum(many) - many), many)
            at = index.locate(row)
            text = np.searchsorted(begin, at, side="right") - 1
            for w, a, t in zip(which.tolist(), at.tolist(), text.tolist(), strict=True):
                if all(spelled(x, t) for x in range(a, a + size)):
                    change[a] += 1
                    change[a + size] -= 1
                    items[t].update(dict.fromkeys(phrases.items_of(size, w)))
    inside = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    owner = np.searchsorted(begin, edges[0::2], side="right") - 1
    for t, a, b in zip(owner.tolist(), edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        hits[t].append((a - int(begin[t]), b - int(begin[t])))
    return hits, items


FOUND = "_fm_found"
FOUND_TYPE = "struct<n_words:long,hits:array<struct<word:long,words:long,start:long,end:long>>,items:array<string>>"
RANGES = pa.list_(pa.struct([(name, pa.int64()) for name in ("word", "words", "start", "end")]))


def union(a: list[dict], b: list[dict]) -> list[dict]:
    """Word ranges of two lists merged where they overlap or follow each other."""
    if not a or not b:
        return a or b
    out: list[dict] = []
    for x in sorted([*a, *b], key=lambda r: r["word"]):
        if out and x["word"] <= out[-1]["word"] + out[-1]["words"]:
            last = out[-1]
            last["words"] = max(last["word"] + last["words"], x["word"] + x["words"]) - last["word"]
            last["end"] = max(last["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def block_folder(folder: str, block: int) -> str:
    return f"{folder.rstrip('/')}/block={block}"


def read_phrases(folder: str, block: int, window: int) -> Phrases:
    """One block of the benchmark, read by a task from the shared folder. A block that no item fell into has no phrases."""
    system, path = file_system(block_folder(folder, block))
    files = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = [row for name in files for row in pq.ParquetFile(name, filesystem=system).read().to_pylist()]
    return Phrases(sorted(((r["item"], r["text"]) for r in rows), key=lambda r: (r[0] or "", r[1])), window)


def phrase_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[str | None, int]:
    """Distinct items of the benchmark, written by Spark as blocks of bounded text: their folder and number."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / block_bytes)
    if not n:
        return None, 0
    folder = work_folder(benchmark.sparkSession, "phrases")
    items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, n


def _search(folder: str | None, blocks: int, window: int, shard_words: int):
    """mapInArrow body: the rows of each shard with what all blocks of phrases find in it, one block at a time."""

    def run(batches):
        single = read_phrases(folder, 0, window) if blocks == 1 else None

        def flush(shard):
            texts = sum(batch.num_rows for batch, _ in shard)
            ranges: list[list[dict]] = [[] for _ in range(texts)]
            items: list[dict] = [{} for _ in range(texts)]
            for block in range(blocks):
                phrases = single or read_phrases(folder, block, window)
                hits, owners = occurrences(phrases, [(words, phrases.symbols(words)) for _, words in shard])
                row = 0
                for _, words in shard:
                    for first, origin in zip(words.first.tolist(), words.text_start.tolist(), strict=True):
                        new = [
                            {"word": a, "words": b - a, "start": int(words.start[first + a]) - origin, "end": int(words.end[first + b - 1]) - origin}
                            for a, b in hits[row]
                        ]
                        ranges[row] = union(ranges[row], new)
                        items[row].update(owners[row])
                        row += 1
            row = 0
            for batch, words in shard:
                stop = row + batch.num_rows
                columns = [pa.array(words.count, pa.int64()), pa.array(ranges[row:stop], RANGES), pa.array([list(x) for x in items[row:stop]], pa.list_(pa.string()))]
                found = pa.StructArray.from_arrays(columns, names=["n_words", "hits", "items"])
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, FOUND])
                row = stop

        shard, held = [], 0
        for batch in batches:
            for first, texts in chunks(batch.column("text"), CHUNK_BYTES):
                words = Words(texts, ALNUM, lower=True)
                if shard and held + len(words.start) > shard_words:
                    yield from flush(shard)
                    shard, held = [], 0
                shard.append((batch.slice(first, len(texts)), words))
                held += len(words.start)
        if shard:
            yield from flush(shard)

    return run


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, block_bytes: int) -> DataFrame:
    """`docs` plus the column FOUND."""
    rows = docs.drop(FOUND)
    folder, blocks = phrase_blocks(benchmark, block_bytes)
    return rows.mapInArrow(_search(folder, blocks, window, shard_words), rows.withColumn(FOUND, F.lit(None).cast(FOUND_TYPE)).schema)


def find(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = PHRASE_BYTES
) -> DataFrame:
    """`docs` (with `text`) plus `contamination`: n_words, hits (merged word ranges with their byte offsets), items.

    Words are runs of ASCII letters and digits and of all other non-ASCII signs, A-Z lower-cased. A phrase is
    `window` consecutive words of a benchmark item (item_id, text), or the whole item if it has fewer, but
    some. A null text has no words; a null item_id still marks words but is not listed; rows repeat as
    they came; an empty benchmark finds nothing; a column `contamination` of `docs` gives way to the new one.
    No shuffle of `docs`: each task indexes its own rows in shards. The benchmark lies in blocks in the shared
    folder; a task holds one block at a time, the driver none.
    """
    return _searched(docs.drop("contamination"), benchmark, window, shard_words, block_bytes).withColumnRenamed(FOUND, "contamination")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = PHRASE_BYTES
) -> DataFrame:
    """`docs` with every benchmark phrase cut out of `text` (and `n_chars` renewed where it is a column)."""
    found = _searched(docs, benchmark, window, shard_words, block_bytes)
    raw = F.col("text").cast("binary")
    hits = F.col(f"{FOUND}.hits")
    kept = F.transform(
        F.sequence(F.lit(0), F.size(hits)),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(hits, i - 1)["end"]).alias("begin"),
            F.when(i == F.size(hits), F.length(raw).cast("long")).otherwise(F.get(hits, i)["start"]).alias("stop"),
        ),
    )
    pieces = F.transform(kept, lambda p: F.decode(F.substring(raw, (p["begin"] + 1).cast("int"), (p["stop"] - p["begin"]).cast("int")), "UTF-8"))
    dirty = F.size(hits) > 0
    out = found.withColumn("_fm_cut", F.when(dirty, F.array_join(pieces, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dirty, F.length("_fm_cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("_fm_cut")).select(*docs.columns)

"""Fill-in-middle: texts cut at two unit ranks found in an indexable skip list, and put together in another order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 1
PLAIN_PERCENT = 10  # of texts that stay as they are
SPM_PERCENT = 20  # of the cut ones that have the suffix first
MARKS = ("<P>", "<S>", "<M>")  # no mark begins with a sign that another ends with, so they never overlap
LANE_BITS = 2  # a node of one lane is in the next with a chance of 1 in 2**LANE_BITS
CHUNK_CHARS = 4_000_000  # of texts and outputs that are held at once
ADDED = "n_units long, form string, prefix_chars long, middle_chars long, output string"


def unit_starts(text: str) -> tuple[np.ndarray, int]:
    """Code point where each unit begins, and the number of code points. A unit is a run of letters A-Z, a-z or one other sign."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((code | np.uint32(32)) - np.uint32(97)) < 26
    first = ~letter
    first[:1] = True
    first[1:] |= ~letter[:-1]
    return np.flatnonzero(first), len(code)


class SkipList:
    """Units of a text under express lanes. A link of a lane carries how many units and how many code points it passes.

    The height of a unit's tower comes from a hash of its rank, so equal texts have equal lists; each lane holds
    about a fourth of the nodes of the one below.
    """

    def __init__(self, starts: np.ndarray, n_chars: int):
        self.units = len(starts)
        mixed = (np.arange(self.units, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed[:1] = 0  # the head is in every lane
        nodes, places = np.arange(self.units), starts
        self.lanes = []  # lowest first: (units passed, code points passed, node below) by node of the lane
        below = np.arange(self.units)
        while True:
            self.lanes.append((np.diff(nodes, append=self.units), np.diff(places, append=n_chars), below))
            up = np.flatnonzero(mixed[nodes] & np.uint64((1 << LANE_BITS * len(self.lanes)) - 1) == 0)
            if len(up) < 2 or len(up) == len(nodes):
                break
            nodes, places, below = nodes[up], places[up], up

    def code_point(self, rank: int) -> int:
        """Code points before the unit of this rank (`units`: the end), by descending from the highest lane."""
        at = place = passed = 0
        for units, chars, below in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                place += int(chars[at])
                at += 1
            if passed == rank:
                break
            at = int(below[at])
        return place


def _digits(seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of seed and doc_id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arranged(text: str, h: list[int], plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """(units, form, code points of prefix and middle, output) of one text under its four hash numbers."""
    starts, n_chars = unit_starts(text)
    n = len(starts)
    prefix_mark, suffix_mark, middle_mark = MARKS
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    lanes = SkipList(starts, n_chars)
    a, b = (lanes.code_point(rank) for rank in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle))
    return n, "psm", a, b - a, "".join((prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))


def _arrange(plain_percent: int, spm_percent: int):
    def made(batch, first, rows, schema):
        part = batch.slice(first, len(rows)).select([i for i, name in enumerate(batch.schema.names) if name != "_h"])
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *schema])

    def run(batches):
        names = [c.split(" ")[0] for c in ADDED.split(", ")]
        for batch in batches:
            texts, hashes = batch.column("text"), batch.column("_h")
            rows, held, first = [], 0, 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                rows.append(arranged(text, hashes[i].as_py(), plain_percent, spm_percent))
                held += len(text)
                if held > CHUNK_CHARS:
                    yield made(batch, first, rows, names)
                    rows, held, first = [], 0, i + 1
            if rows:
                yield made(batch, first, rows, names)

    return run


def transform(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """`docs` (with doc_id, text) plus n_units, form, prefix_chars, middle_chars and output.

    Both cuts are drawn by hash of doc_id among the n_units + 1 places between units, so a rerun draws the same. A text that is
    empty or null or holds a mark is plain: its output is the text (null: empty), its part sizes are null. Texts are cut whole,
    one at a time; rows and other columns stay (columns of the added names are replaced). No shuffle.
    """
    names = [c.split(" ")[0] for c in ADDED.split(", ")]
    rows = docs.drop(*names, "_h")
    schema = rows.schema
    for column in ADDED.split(", "):
        schema = schema.add(*column.split(" "))
    return rows.withColumn("_h", F.array(*_digits(seed))).mapInArrow(_arrange(plain_percent, spm_percent), schema)


def restored(form: Column, output: Column) -> Column:
    """The text an output was made of. Each mark stands in a cut output once, so splitting at it is exact."""
    prefix_mark, suffix_mark, middle_mark = (F.lit(m) for m in MARKS)
    head, middle = F.split_part(output, middle_mark, F.lit(1)), F.split_part(output, middle_mark, F.lit(2))
    between = F.when(form == "psm", suffix_mark).otherwise(prefix_mark)
    one, two = F.split_part(head, between, F.lit(1)), F.split_part(head, between, F.lit(2))
    size = len(MARKS[0])
    one = F.substring(one, size + 1, 2147483647)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))

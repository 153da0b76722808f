"""Greedy longest-match token counts: a vocabulary trie with failure links and popped-token counts, in linear time."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import NONSPACE, Words, chunks

CHUNK_BYTES = 2_000_000
MARK = 0x20  # stands before every word


class Automaton:
    """A trie over token bytes. Where a node has no child for the next byte, its failure link pops as many
    tokens as greedy longest match would, and goes on at the node of what is left; so counting takes a step per byte
    and pop, and no piece is built. Every single byte must be a token."""

    def __init__(self, tokens: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in tokens:
            node = 0
            for byte in token:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][byte]
            final[node] = final[node] or node > 0
        if len(children[0]) < 256 or not all(final[x] for x in children[0].values()):
            raise ValueError("every single byte must be a token")
        fail, pops = [0] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in children[parent].items():
                    below.append(node)
                    if final[node]:
                        fail[node], pops[node] = 0, 1  # the whole of it is one token
                        continue
                    at, count = fail[parent], pops[parent]
                    while byte not in children[at]:
                        at, count = fail[at], count + pops[at]
                    fail[node], pops[node] = children[at][byte], count
            level = below
        self.keys = np.array(sorted(node << 8 | byte for node, c in enumerate(children) for byte in c), np.int64)
        self.targets = np.array([children[k >> 8][k & 255] for k in self.keys.tolist()], np.int64)
        self.fail, self.pops = np.array(fail), np.array(pops)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each byte range of `data` with MARK before it; all ranges advance together."""
        count = np.zeros(len(start), np.int64)
        node = np.zeros(len(start), np.int64)
        live = np.arange(len(start))
        step = -1
        while len(live):
            byte = np.full(len(live), MARK, np.int64) if step < 0 else data[start[live] + step].astype(np.int64)
            todo = np.arange(len(live))
            while len(todo):
                key = node[live[todo]] << 8 | byte[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                node[live[todo[hit]]] = self.targets[at[hit]]
                todo = todo[~hit]
                self._pop(live[todo], node, count)
            step += 1
            live = live[start[live] + step < end[live]]
        rest = np.flatnonzero(node)
        while len(rest):
            self._pop(rest, node, count)
            rest = rest[node[rest] > 0]
        return count

    def _pop(self, rows, node, count):
        count[rows] += self.pops[node[rows]]
        node[rows] = self.fail[node[rows]]


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Of a file with a base64 token and its rank a line; one per worker process."""
    if path not in _AUTOMATA:
        with open(path, "rb") as lines:
            _AUTOMATA[path] = Automaton([base64.b64decode(line.split()[0]) for line in lines if line.strip()])
    return _AUTOMATA[path]


def text_counts(texts: list[bytes], machine: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text. Equal words of the texts are counted once; their bytes are compared."""
    words = Words(texts, NONSPACE, lower=False)
    if not len(words.start):
        return words.count, np.zeros(len(texts), np.int64)
    size = words.end - words.start
    _, first, which = np.unique(words.hashes() ^ (size.astype(np.uint64) << np.uint64(40)), return_index=True, return_inverse=True)
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    same = size == size[first][which]
    other = np.repeat(words.start[first][which], size) + np.minimum(place, np.repeat(size[first][which], size) - 1)
    equal = np.logical_and.reduceat(words.data[words.inside] == words.data[other], begin) & same
    tokens = machine.counts(words.data, words.start[first], words.end[first])[which]
    odd = np.flatnonzero(~equal)
    tokens[odd] = machine.counts(words.data, words.start[odd], words.end[odd])
    total = np.concatenate([[0], np.cumsum(tokens)])
    return words.count, total[words.first + words.count] - total[words.first]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """`docs` (with `text`) plus n_words and n_tokens: words are runs of other than ASCII white space, each counted in
    greedy longest vocabulary pieces with a space before it.

    A null or empty text has none. Texts are counted whole; rows and other columns stay (columns of these names are replaced).
    """
    rows = docs.drop("n_words", "n_tokens")
    schema = rows.withColumns({"n_words": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema

    def run(batches):
        machine = automaton(path)
        for batch in batches:
            parts = [text_counts(some, machine) for _, some in chunks(batch.column("text"), CHUNK_BYTES)]
            made = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "n_words", "n_tokens"])

    return rows.mapInArrow(run, schema)

"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BREAK = b"\n"  # stands between texts; no word class may contain it
_ODD = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)


def byte_class(text: str) -> np.ndarray:
    """Which of the 256 bytes belong to words, from the characters of `text`; all bytes from 0x80 on do too."""
    known = np.zeros(256, bool)
    known[np.frombuffer(text.encode("ascii"), np.uint8)] = True
    known[0x80:] = True
    return known


ALNUM = byte_class("0123456789abcdefghijklmnopqrstuvwxyz")  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]
SPACES = " \t\n\x0b\x0c\r"
NONSPACE = ~np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))  # [^\x20\x09-\x0D]
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z only


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 256)
        _POWERS = np.full(size, _ODD, np.uint64)
        _POWERS[0] = 1
        _POWERS = np.cumprod(_POWERS)
    return _POWERS


class Words:
    """Words of a list of texts (bytes): byte ranges, the text each belongs to, and 64-bit hashes.

    Equal words have equal hashes; unequal ones may, rarely, share one, so callers compare the bytes.
    """

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray, lower: bool):
        joined = BREAK.join(texts) + BREAK
        self.raw = joined.translate(LOWER) if lower else joined
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.cumsum(sizes) - sizes
        self.inside = word_bytes[self.data]
        self.inside[(self.text_start + sizes - 1)] = False
        edges = np.flatnonzero(np.diff(self.inside.view(np.int8), prepend=0))
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.text_start)  # index of each text's first word
        self.count = np.diff(np.append(self.first, len(self.start)))

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sizes = self.end - self.start
        begin = np.cumsum(sizes) - sizes
        place = np.arange(begin[-1] + sizes[-1]) - np.repeat(begin, sizes)
        letters = self.data[self.inside].astype(np.uint64) + np.uint64(1)
        return np.add.reduceat(letters * powers(int(sizes.max()))[place], begin)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]


def chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first row, texts as bytes, null as empty) in runs of at most `limit` bytes; a longer text is alone."""
    held: list[bytes] = []
    size = first = 0
    for i, value in enumerate(column.cast(pa.large_binary()).to_pylist()):
        value = value or b""
        if held and size + len(value) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(value)
        size += len(value)
    if held:
        yield first, held

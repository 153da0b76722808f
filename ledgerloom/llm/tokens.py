"""Token ids of whole texts with a public tokenizer, as pieces of bounded length."""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 400_000  # words a worker keeps the ids of; then it starts anew

#: Letters and marks that the word pattern below treats as the tokenizer's own does.
_LETTERS = "a-zß-öø-ÿ"
_OTHER = re.compile("[^\\x00-\\x7fÀ-ÖØ-öø-ÿ¡-©«»¿–—‘’“”…€]|<\\|")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \\t\\n\\r\\x0b\\x0c{_LETTERS}0-9]+")


class WordIds:
    """Ids of texts as bytes (little-endian unsigned 32 bits), the same as the tokenizer's own.

    The tokenizer lower-cases, drops white space and merges inside words only, so the ids of a word are kept
    once it has been seen. A text with signs beyond Latin letters and common marks goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = {i for token, i in vocabulary.items() if token.endswith("</w>")}
        self.known: dict[str, bytes] = {}

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Ids of unseen words in one call: each word's last id, and no other, closes a word."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        ids = self._direct(" ".join(words))
        ends = [i for i, x in enumerate(ids) if x in self.closes]
        if len(ends) != len(words) or not ends or ends[-1] != len(ids) - 1:
            self.known.update((w, struct.pack(f"<{len(x)}I", *x)) for w in words for x in [self._direct(w)])
            return
        packed = struct.pack(f"<{len(ids)}I", *ids)
        begin = 0
        for word, end in zip(words, ends, strict=True):
            self.known[word] = packed[4 * begin : 4 * end + 4]
            begin = end + 1

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text):
            ids = self._direct(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        words = _WORDS.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            self._learn([w for w in dict.fromkeys(words) if w not in self.known])
            return b"".join(map(self.known.__getitem__, words))


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of `docs` (doc_id, text).

    A document is its ids and END_ID; null text is empty text. Only documents longer than `capacity` are
    cut, at every `capacity` ids. Repeated rows give repeated pieces; other columns are ignored.
    """

    def cut(batches):
        encode = encoder(path).encode
        end = struct.pack("<I", END_ID)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")

"""Licence scan: passages against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import ALNUM, Words, chunks

LIKENESS = 0.8  # least Dice coefficient
CHUNK_BYTES = 2_000_000
#: Fixed values: (licence, text) of notices and short licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Where passages of each kind end: sentences, lines, paragraphs.
BREAKS = [re.compile(rb"[.!?]\s+|\n"), re.compile(rb"\n"), re.compile(rb"\n[ \t\r]*\n")]
SCHEMA = "array<struct<license:string,score:double,start:long,end:long>>"


def bigrams(spelled: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(spelled, spelled[1:], strict=False))


class Templates:
    """Bigram sets of the templates, and which templates have a bigram."""

    def __init__(self, templates: list[tuple[str, str]], likeness: float):
        self.likeness = likeness
        words = Words([t.encode() for _, t in templates], ALNUM, lower=True)
        self.rows = []
        self.owners: dict[tuple, list[int]] = {}
        for (name, _), first, count in zip(templates, words.first.tolist(), words.count.tolist(), strict=True):
            mine = bigrams([words.word(i) for i in range(first, first + count)])
            if not mine:
                raise ValueError("a template needs two words")
            for pair in mine:
                self.owners.setdefault(pair, []).append(len(self.rows))
            self.rows.append((name, len(mine)))
        hashes = words.hashes()
        inner = np.setdiff1d(np.arange(len(hashes) - 1), words.first[1:] - 1)
        pairs = pair_hashes(hashes)
        self.known = np.unique(pairs[inner])
        self.by_hash: dict[int, list[int]] = {}
        for t, (first, count) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=True)):
            for h in set(pairs[first : first + count - 1].tolist()):
                self.by_hash.setdefault(h, []).append(t)
        sizes = np.array([n for _, n in self.rows])
        self.fewest = math.ceil(likeness / (2 - likeness) * sizes.min() - 1e-9)  # shared bigrams of any match

    def best(self, spelled: list[bytes]) -> dict[str, float]:
        """Licences of a passage with their scores; sizes alone rule out most templates."""
        mine = bigrams(spelled)
        shared = Counter(t for pair in mine for t in self.owners.get(pair, ()))
        found: dict[str, float] = {}
        for t, n in shared.items():
            name, size = self.rows[t]
            if 2 * min(size, len(mine)) < self.likeness * (size + len(mine)):
                continue
            score = 2 * n / (size + len(mine))
            if score >= self.likeness:
                found[name] = max(score, found.get(name, 0.0))
        return found


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of each word with the next."""
    return hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + (hashes[1:] ^ (hashes[1:] >> np.uint64(29)))


def runs(words: Words, pairs: np.ndarray, hits: np.ndarray, templates: Templates):
    """Word ranges (a, b) of consecutive sentences or lines of a text that, by hash, match a template.

    A run grows from a passage with template bigrams. It stops where its first passage adds none that the rest
    lacks (the run without it scores no less), or where bigrams of no template are too many for any match.
    """
    cuts = np.fromiter((m.end() for m in BREAKS[0].finditer(words.raw)), np.int64)
    first = np.unique(np.concatenate([words.first, np.searchsorted(words.start, cuts)]))
    first = first[first < len(words.start)]
    stop = np.append(words.first, len(words.start))[np.searchsorted(words.first, first, side="right")]
    after = np.append(first[1:], len(words.start))
    grows = (after < stop) & (hits[after] > hits[first]) & (hits[stop - 1] - hits[first] >= templates.fewest)
    likeness, owners, rows = templates.likeness, templates.by_hash, templates.rows
    for i in np.flatnonzero(grows).tolist():
        a, end = int(first[i]), int(stop[i])
        own = {h for h in pairs[a : after[i]].tolist() if h in owners}
        limit = (2 / likeness - 2) * max(rows[t][1] for h in own for t in owners[h])
        seen: set[int] = set()
        shared: Counter = Counter()
        unknown, at, j = 0, a, i
        while own and unknown <= limit and j < len(first) and first[j] < end:
            b = int(after[j])
            for h in pairs[at : b - 1].tolist():
                if h not in seen:
                    seen.add(h)
                    mine = owners.get(h)
                    if mine is None:
                        unknown += 1
                    else:
                        shared.update(mine)
            if j > i:
                if any(2 * n >= likeness * (rows[t][1] + len(seen)) - 1e-9 for t, n in shared.items()):
                    yield a, b
                own.difference_update(pairs[int(first[j]) : b - 1].tolist())
            at, j = b - 1, j + 1


def matches(texts: list[bytes], templates: Templates, joined: bool = False) -> list[list[dict]]:
    """Per text its licences, each with its best score and the first passage (byte range) that has it.

    Passages are sentences, lines, paragraphs and the whole text, and if `joined` also runs of consecutive sentences
    and lines. Only those with enough bigrams of templates, by hash, are compared, and then by their words.
    """
    words = Words(texts, ALNUM, lower=True)
    out: list[dict[str, tuple]] = [{} for _ in texts]
    if len(words.start) < 2:
        return [[] for _ in texts]
    pairs = pair_hashes(words.hashes())
    at = np.minimum(np.searchsorted(templates.known, pairs), len(templates.known) - 1)
    hits = np.concatenate([[0], np.cumsum(templates.known[at] == pairs), [0]])
    hits[-1] = hits[-2]
    raw = words.raw

    def compare(a: int, b: int) -> None:
        found = templates.best([words.word(i) for i in range(a, b)])
        if found:
            t = int(np.searchsorted(words.text_start, words.start[a], side="right")) - 1
            begin, end = int(words.start[a] - words.text_start[t]), int(words.end[b - 1] - words.text_start[t])
            for name, score in found.items():
                out[t][name] = max(out[t].get(name, (0.0, 0, 0)), (score, -begin, -end))

    for breaks in (*BREAKS, None):
        cuts = np.fromiter((m.end() for m in breaks.finditer(raw)), np.int64) if breaks else np.zeros(0, np.int64)
        first = np.unique(np.concatenate([words.first, np.searchsorted(words.start, cuts)]))
        first = first[first < len(words.start)]
        last = np.append(first[1:], len(words.start))
        enough = hits[last - 1] - hits[first] >= templates.fewest
        for a, b in zip(first[enough].tolist(), last[enough].tolist(), strict=True):
            compare(a, b)
    if joined:
        for a, b in runs(words, pairs, hits, templates):
            compare(a, b)
    return [[{"license": n, "score": s, "start": -b, "end": -e} for n, (s, b, e) in sorted(found.items())] for found in out]


def scan(docs: DataFrame, templates=TEMPLATES, likeness: float = LIKENESS, joined: bool = False) -> DataFrame:
    """`docs` (with `text`) plus `licenses`: the licences found, by name, with score and byte range of the passage.

    Words are runs of ASCII letters and digits and of non-ASCII signs, lower-cased. A null or empty text, and one with fewer
    than two words, has none. Of passages with equal scores the first wins, then the shortest. Rows and other columns
    stay (a column `licenses` is replaced). `joined` compares runs of passages too. The templates are a fixed list that travels with the tasks.
    """
    rows = docs.drop("licenses")
    schema = rows.withColumn("licenses", F.lit(None).cast(SCHEMA)).schema
    known = Templates(list(templates), likeness)
    kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            made = [m for _, some in chunks(batch.column("text"), CHUNK_BYTES) for m in matches(some, known, joined)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*batch.schema.names, "licenses"])

    return rows.mapInArrow(run, schema)

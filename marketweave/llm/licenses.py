"""License scan: MinHash bands over overlapping text windows, then exact containment.

Words are letters and digits, A-Z lower-cased; shingles are SHINGLE (five) words. A
template of n shingles (a template shorter than a shingle is one shingle of all its
words, sought with that many words) belongs to the class W, the least power of two not
below n. The text's shingles are covered by windows of 1.5 W with a stride of W / 2 (all
shingles one by one for W = 1), so any run of at most W shingles lies within a window.

Retrieval: BANDS MinHash values, one row a band, for each window and template; a window
retrieves the templates with which it agrees in a band. A window that contains at least
THRESHOLD of a template has a Jaccard similarity of at least j = 0.8 n / (1.5 W + 0.2 n),
0.25 or more, and is retrieved with probability 1 - (1 - j) ** BANDS, at least
1 - 1.1e-6 (for W = 1 always). Verification: the share of the template's distinct
shingles, as words, that the window holds must be THRESHOLD or more.

Overlapping matching windows of a template are one occurrence. Each template's
occurrences in each text are reported; templates are parameters of bounded number and
size (MAX_TEMPLATE_WORDS in all), broadcast within the function. No shuffle.

Defined cases: null and empty texts, and texts without a match, give no row; repeated
rows each give their rows; null ids are kept; templates without words are refused;
columns other than id and text are not read; long texts are run in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.common import table
from marketweave.llm.decontaminate import words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 48
BLOCK = 1 << 12
MAX_TEMPLATE_WORDS = 100_000
MAX_WORDS = 300_000

#: Fixed: notices of public licenses.
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

_ODD = np.array([xxhash.xxh32_intdigest(b"a%d" % k) | 1 for k in range(BANDS)], np.uint32)
_ADD = np.array([xxhash.xxh32_intdigest(b"b%d" % k) for k in range(BANDS)], np.uint32)
_MIX = np.array([xxhash.xxh64_intdigest(b"m%d" % k) | 1 for k in range(64)], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 32-bit hash of each run of ``size`` words."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _MIX[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(32)).astype(np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """[len(shingles), BANDS] permuted values; the minimum over a window is its MinHash."""
    return shingles[:, None] * _ODD + _ADD


class Template(NamedTuple):
    name: str
    size: int  # words in a shingle
    width: int  # class W
    shingles: frozenset
    signature: np.ndarray


def prepare(templates: Mapping[str, str]) -> list[Template]:
    out, total = [], 0
    for name, text in templates.items():
        words = words_of(text.encode())
        total += len(words)
        if not words or total > MAX_TEMPLATE_WORDS:
            raise ValueError(f"template {name} has no words, or all together have over {MAX_TEMPLATE_WORDS}")
        size = min(SHINGLE, len(words))
        runs = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        width = 1
        while width < len(runs):
            width *= 2
        out.append(Template(name, size, width, frozenset(runs), minhash(shingle_hashes(words, size)).min(axis=0)))
    return out


def windows(n: int, width: int) -> list[tuple[int, int]]:
    """[start, end) in shingles of the windows that cover n shingles in class ``width``."""
    if width == 1:
        return [(i, i + 1) for i in range(n)]
    stride = width // 2
    return [(a, min(n, a + 3 * stride)) for a in range(0, max(1, n - stride), stride)] if n else []


class Match(NamedTuple):
    license: str
    containment: float
    start: int
    end: int


def _minima(values: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """For each class, the MinHash of each of its windows; strides double, so blocks are halved step by step."""
    out, blocks, stride, n = {}, values, 1, len(values)
    for width in sorted(widths):
        while stride < width // 2:
            odd = blocks[len(blocks) & ~1 :]
            blocks = np.concatenate([np.minimum(blocks[: len(blocks) & ~1 : 2], blocks[1::2]), odd])
            stride *= 2
        count = -(-max(1, n - stride) // stride)
        low = blocks[:count].copy()
        for k in (1, 2):
            more = blocks[k : k + count]
            np.minimum(low[: len(more)], more, out=low[: len(more)])
        out[width] = low
    return out


def scan(text: bytes | None, prepared: list[Template], threshold: float = THRESHOLD) -> list[Match]:
    """Occurrences of the templates in one text, by template and place."""
    words = words_of(text)
    spots: dict[str, list[tuple[int, int, float]]] = {}
    for size in sorted({t.size for t in prepared}):
        group = [t for t in prepared if t.size == size]
        hashes = shingle_hashes(words, size)
        reach = 2 * max(t.width for t in group)
        for block in range(0, len(hashes), BLOCK):
            # blocks begin on every class's grid and reach far enough for their last windows
            part = hashes[block : block + BLOCK + reach]
            wide = {t.width for t in group if t.width > 1}
            minima = _minima(minhash(part), list(wide)) if wide else {}
            for t in group:
                if t.width == 1:
                    hit = np.flatnonzero(part * _ODD[0] + _ADD[0] == t.signature[0])
                else:
                    hit = np.flatnonzero((minima[t.width] == t.signature).any(axis=1))
                stride = max(1, t.width // 2)
                for w in hit.tolist():
                    a = block + w * stride
                    if w * stride >= BLOCK:
                        continue
                    b = min(len(hashes), a + (1 if t.width == 1 else 3 * stride))
                    held = {i for i in range(a, b) if tuple(words[i : i + size]) in t.shingles}
                    share = len({tuple(words[i : i + size]) for i in held}) / len(t.shingles)
                    if share >= threshold:
                        spots.setdefault(t.name, []).append((min(held), max(held) + size, share))
    out = []
    for name in sorted(spots):
        runs: list[list] = []
        for a, b, share in sorted(set(spots[name])):
            if runs and a < runs[-1][1]:
                runs[-1][1], runs[-1][2] = max(runs[-1][1], b), max(runs[-1][2], share)
            else:
                runs.append([a, b, share])
        out += [Match(name, share, a, b) for a, b, share in runs]
    return out


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, license_id, containment, start_word, end_word), one for each occurrence."""
    prepared = prepare(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for m in scan(t, prepared, threshold):
                    ids.append(i)
                    found.append(m)
            columns = [pa.array(ids, batch.column(0).type), *(pa.array([m[k] for m in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license_id", "containment", "start_word", "end_word"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, license_id string, containment double, start_word long, end_word long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))

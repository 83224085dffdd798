"""License texts in documents: MinHash bands retrieve templates, shingle containment verifies.

Templates of ``m`` word shingles are looked for in windows of ``m + step - 1``
shingles that start every ``step = max(1, m // 4)``, so that any ``m``
consecutive shingles lie within one window.  Each window has ``bands``
MinHash bands of ``ROWS`` values; a template is retrieved where a band agrees.
``bands`` is the least number at which a window that holds ``CONTAINMENT`` of a
template's shingles agrees in some band with probability ``CERTAINTY``.  What is
retrieved is verified by the exact share of the template's shingles in the
window.

A band can only agree where the window holds one of the template's shingles, so
windows without any are passed over.

Templates are few and of bounded size (``MOST_TEMPLATES``), and go to every
task; documents are read once and nothing is shuffled.

Defined results: null and empty texts, and rows with a null ``doc_id``, match
nothing; repeated rows match alike; a text is scanned whole, whatever its
length; a text of fewer words than a shingle has one shingle, of all its words.
Of several places the one of highest containment counts, then the first; of
several wordings of a license likewise.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import byte_sizes, mapped, row_slices
from ._text import mix, ngrams, words

SHINGLE = 3
ROWS = 1
CONTAINMENT = 0.8
CERTAINTY = 0.9999
MOST_TEMPLATES = 10_000
SLICE = 8 << 20

#: (license, wording): short notices, and passages that identify the full texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def bands_for(jaccard: float, rows: int = ROWS, certainty: float = CERTAINTY) -> int:
    """Least number of bands of ``rows`` values that agree somewhere with probability ``certainty``."""
    same = jaccard**rows
    return 1 if same >= 1 else max(1, math.ceil(math.log(1 - certainty) / math.log(1 - same)))


def _seeds(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _minhash(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return mix(shingles[None, :] ^ seeds[:, None]).min(axis=1)


def _banded(values: np.ndarray, rows: int) -> list[tuple]:
    return [(b, *values[b * rows : (b + 1) * rows].tolist()) for b in range(len(values) // rows)]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], containment: float = CONTAINMENT, rows: int = ROWS, certainty: float = CERTAINTY):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        self.containment, self.rows = containment, rows
        self.names = [name for name, _ in templates]
        g, splits = ngrams(*words(pc.utf8_lower(pa.array([t for _, t in templates], pa.string()))), SHINGLE)
        self.sets = [np.unique(g[a:b]) for a, b in zip(splits[:-1], splits[1:])]
        self.all = np.unique(g)
        self.holds = np.zeros(1 << 16, bool)
        self.holds[(self.all >> np.uint64(48)).astype(np.int64)] = True
        sizes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                sizes.setdefault(int(splits[i + 1] - splits[i]), []).append(i)
        self.classes = []
        for m, members in sorted(sizes.items()):
            step = max(1, m // 4)
            window = m + step - 1
            share = containment * m / (m + window - containment * m)
            seeds = _seeds(bands_for(share, rows, certainty) * rows)
            index: dict[tuple, set[int]] = {}
            for i in members:
                for key in _banded(_minhash(self.sets[i], seeds), rows):
                    index.setdefault(key, set()).add(i)
            self.classes.append((m, step, window, seeds, index))

    def scan(self, shingles: np.ndarray, hits: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(license, containment, first shingle, shingles of the window) of one text; ``hits``: where its shingles are some template's."""
        found: dict[str, tuple[float, int, int]] = {}
        for _, step, window, seeds, index in self.classes:
            starts = np.unique(np.concatenate([np.arange(max(0, -(-(h - window + 1) // step)), h // step + 1) for h in hits.tolist()])) * step
            for start in starts.tolist():
                part = shingles[start : start + window]
                retrieved: set[int] = set()
                for key in _banded(_minhash(part, seeds), self.rows):
                    retrieved |= index.get(key, set())
                for i in retrieved:
                    inside = np.isin(part, self.sets[i])
                    share = len(np.unique(part[inside])) / len(self.sets[i])
                    if share >= self.containment - 1e-12:
                        at = start + int(np.argmax(inside))
                        best = found.get(self.names[i])
                        if best is None or (-share, at) < (-best[0], best[1]):
                            found[self.names[i]] = (share, at, window)
        return [(name, *found[name]) for name in sorted(found)]


def _run(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for lo, hi in row_slices(byte_sizes(b.column("text")), SLICE):
                part = b.slice(lo, hi - lo)
                ids = part.column("doc_id")
                g, splits = ngrams(*words(pc.utf8_lower(part.column("text"))), SHINGLE)
                maybe = np.flatnonzero(scanner.holds[(g >> np.uint64(48)).astype(np.int64)])
                hits = maybe[np.isin(g[maybe], scanner.all)]
                rows = np.searchsorted(splits, hits, side="right") - 1
                for row in np.unique(rows).tolist():
                    own = hits[rows == row] - splits[row] if len(hits) < 64 else hits[np.searchsorted(rows, row) : np.searchsorted(rows, row, side="right")] - splits[row]
                    if ids[row].is_valid:
                        out += [(ids[row].as_py(), *x) for x in scanner.scan(g[splits[row] : splits[row + 1]], own)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["doc_id", "license", "containment", "first_word", "window"])

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word): each license that a document holds, and the word it begins at."""
    scanner = Scanner(TEMPLATES if templates is None else templates, containment)
    return mapped(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), _run(scanner), "doc_id bigint, license string, containment double, first_word bigint, window bigint").drop("window")

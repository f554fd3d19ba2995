"""Licence notices by MinHash bands over text windows, then containment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.hashing import IS_LETTER, U, buffers, chunks, ngram_hashes, slices, word_hashes

#: Words of a shingle, and the share of a notice's shingles that a window must hold.
SHINGLE, CONTAINED = 5, 0.8
#: A step has SPARE times a notice's shingles or more, so that words may be
#: put in between without the notice leaving its window.
SPARE = 1.5
#: Bands of one row each. A window holds under 6 times the shingles of a notice
#: (LEAST_STEP of it for the shortest), so a notice of which 0.8 are there has a
#: similarity of 0.129 or more with it, and shares a band with a probability of
#: 1 - 0.871**96 > 1 - 2e-6.
BANDS = 96
#: Two notices are in one place if they share this part of the shingles of the
#: lesser; the one that explains more shingles is reported.
SAME_PLACE = 0.5
#: Shingles of the shortest step of windows; the others double.
LEAST_STEP = 2

W = np.uint32
_rng = np.random.default_rng(31)
_XOR = _rng.integers(1, 1 << 31, BANDS, dtype=W)
_MUL = _rng.integers(1, 1 << 31, BANDS, dtype=W) * W(2) + W(1)

# Public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT licensed": "Licensed under the MIT License",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-2-Clause numbered text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "BSD-3-Clause numbered text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0-only notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as "
        "published by the Free Software Foundation."
    ),
    "GPL-2.0-or-later notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0-or-later notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-or-later notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-or-later notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSL-1.0 text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
        "notices in the Software and this entire statement must be included in all copies of the Software."
    ),
    "Zlib text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions."
    ),
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "All rights reserved": "Copyright. All rights reserved. No part of this publication may be reproduced",
}

#: SPDX identifiers whose tags are named; other tags are found without one.
_SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
    "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0",
    "EUPL-1.2", "GFDL-1.3-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "OFL-1.1",
    "Python-2.0", "Unicode-DFS-2016", "Unlicense", "WTFPL", "Zlib",
)
# Notices that are looked up word by word.
PHRASES = {"All rights reserved line": "All rights reserved", "SPDX tag": "SPDX-License-Identifier"} | {f"{x} tag": f"SPDX-License-Identifier: {x}" for x in _SPDX}


def _band(shingles: np.ndarray, k: int) -> np.ndarray:
    """Band k's hash of shingles that were cut to 32 bits."""
    z = (shingles ^ _XOR[k]) * _MUL[k]
    return (z ^ (z >> W(15))) * W(0x9E3779B1)


def step_of(shingles: int) -> int:
    """The step of windows for a notice: the next power of two from SPARE times
    its shingles on."""
    return max(LEAST_STEP, 1 << (math.ceil(SPARE * shingles) - 1).bit_length())


def best_places(found: list[tuple[int, int, float, np.ndarray]], sizes: list[int]) -> list[tuple[int, int, float, np.ndarray]]:
    """Of (text, notice, containment, positions of its shingles), those that are
    not in one place with a notice that explains more: most shingles found less
    those missing, then the larger share, then the first place and name."""
    worth = lambda f: (f[0], -sizes[f[1]] * (2 * f[2] - 1), -f[2], int(f[3][0]), f[1])
    kept: list[tuple[int, int, float, np.ndarray]] = []
    for f in sorted(found, key=worth):
        rivals = [g for g in kept if g[0] == f[0] and g[3][0] <= f[3][-1] and f[3][0] <= g[3][-1]]
        if not any(len(np.intersect1d(f[3], g[3], assume_unique=True)) > SAME_PLACE * min(len(f[3]), len(g[3])) for g in rivals):
            kept.append(f)
    return kept


class Templates:
    """Shingles of the notices and their band values, by step of windows; and
    the whole word sequences of phrases and of notices of under SHINGLE words."""

    def __init__(self, texts: dict[str, str], phrases: dict[str, str] | None = None):
        self.names, self.sets = [], []
        #: words of a phrase, most first -> their hash -> name
        self.phrases: dict[int, dict[int, str]] = {}
        phrases = phrases or {}
        for name, text in [*texts.items(), *phrases.items()]:
            data, offs = buffers(pa.array([text]))
            words, first = word_hashes(data, offs, IS_LETTER)
            if len(words) >= SHINGLE and name not in phrases:
                grams, _ = ngram_hashes(words, first, SHINGLE)
                self.names.append(name)
                self.sets.append(np.unique(grams))
            elif len(words):
                self.phrases.setdefault(len(words), {})[int(ngram_hashes(words, first, len(words))[0][0])] = name
        self.phrases = dict(sorted(self.phrases.items(), reverse=True))
        step = [step_of(len(s)) for s in self.sets]
        #: step -> notices, and for each band their values
        self.by_step = {}
        for one in sorted(set(step)):
            mine = np.array([t for t, x in enumerate(step) if x == one])
            low = np.array([[_band((self.sets[t] >> U(32)).astype(W), k).min() for k in range(BANDS)] for t in mine])
            self.by_step[one] = mine, low

    @staticmethod
    def _equal(low: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(windows, place of the value) of equal band values."""
        if len(values) <= 16:
            for t, v in enumerate(values):
                yield np.flatnonzero(low == v), t
            return
        by = np.argsort(values, kind="stable")
        lo, hi = np.searchsorted(values[by], low, "left"), np.searchsorted(values[by], low, "right")
        for t in np.unique(np.concatenate([np.arange(a, b) for a, b in {*zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True)}] or [np.empty(0, np.int64)])):
            yield np.flatnonzero((lo <= t) & (t < hi)), int(by[t])

    def find(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
        """(text, name, first, last+1 word) of each phrase; of those that start
        at one word the longest."""
        taken = np.zeros(len(words), bool)
        for n, names in self.phrases.items():
            grams, begin = ngram_hashes(words, first, n)
            at = np.flatnonzero(np.isin(grams, np.array(list(names), U)))
            text = np.searchsorted(begin, at, "right") - 1
            place = at - begin[text]
            for t, name, x, w in zip(text.tolist(), grams[at].tolist(), place.tolist(), (first[text] + place).tolist(), strict=True):
                if not taken[w]:
                    taken[w] = True
                    yield t, names[name], x, x + n

    def scan(self, grams: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, float, np.ndarray]]:
        """(text, notice, containment, positions of its shingles) of each window."""
        if not len(grams) or not self.by_step:
            return
        # blocks of one step within a text; the next step's are pairs of them. A
        # window is two neighbours, so a run of one step lies within a window
        levels, step, begins = [], LEAST_STEP, begin
        while step <= max(self.by_step):
            width = 2 if levels else LEAST_STEP
            per_text = -(-np.diff(begins) // width)
            block = np.zeros(len(begin), np.int64)
            np.cumsum(per_text, out=block[1:])
            text = np.repeat(np.arange(len(per_text)), per_text)
            within = np.arange(block[-1]) - block[:-1][text]
            levels.append((step, begins[:-1][text] + within * width, begin[:-1][text] + within * step, text, np.append(text[1:] != text[:-1], True)))
            begins, step = block, 2 * step
        short = (grams >> U(32)).astype(W)
        pairs: set[tuple[int, int, int]] = set()
        for k in range(BANDS):
            least = _band(short, k)
            for level, (step, cut, _, _, last) in enumerate(levels):
                least = np.minimum.reduceat(least, cut)
                if step in self.by_step:
                    window = least.copy()
                    window[:-1] = np.where(last[:-1], least[:-1], np.minimum(least[:-1], least[1:]))
                    mine, low = self.by_step[step]
                    for windows, t in self._equal(window, low[:, k]):
                        pairs.update((level, int(w), int(mine[t])) for w in windows)
        for level, w, t in sorted(pairs):
            step, _, at, text, _ = levels[level]
            a = int(at[w])
            b = int(min(a + 2 * step, begin[text[w] + 1]))
            share = np.isin(self.sets[t], grams[a:b]).mean()
            if share >= CONTAINED:
                yield int(text[w]), t, float(share), np.flatnonzero(np.isin(grams[a:b], self.sets[t])) + a - int(begin[text[w]])


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, start_word, end_word): each notice of which
    a window of a document holds CONTAINED of the five-word shingles or more.

    Words are runs of letters and digits with A-Z lowered. Windows of two steps
    overlap by one step; a notice's step is the next power of two from SPARE
    times its shingles on, so a run of words that could be the notice, with
    half as many words put in between, lies whole in a window. MinHash bands
    retrieve the notices of a window, exact containment confirms them. Of
    notices in one place only the best is reported, so versions of one licence
    are told apart (``best_places``); of places of one notice the best, the
    first of equals. start_word and end_word enclose its shingles. Whole texts
    are scanned, and not shuffled.

    Notices of under five words, and all ``phrases`` (by default none; op9 asks
    for PHRASES), are found where their words stand one after the other, in
    texts of any length; of phrases that start at one word the longest counts.
    Of an SPDX expression the first identifier is named. Null and empty texts
    hold no notice. Rows that repeat an id count as
    one; a null id is an id. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, phrases))
    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
    names = ["doc_id", "license", "containment", "start_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            data, offs = buffers(batch.column(1))
            rows = []
            for a, _, part, at in chunks(data, offs):
                words, first = word_hashes(part, at, IS_LETTER)
                grams, begin = ngram_hashes(words, first, SHINGLE)
                places = best_places(list(known.scan(grams, begin)), [len(s) for s in known.sets])
                found = [(text, known.names[t], share, int(at[0]), int(at[-1]) + SHINGLE) for text, t, share, at in places]
                found += [(text, name, 1.0, x, y) for text, name, x, y in known.find(words, first)]
                best: dict[tuple[int, str], tuple[float, int, int]] = {}
                for text, name, share, x, y in found:
                    old = best.get((text, name))
                    if old is None or (share, -x) > (old[0], -old[1]):
                        best[text, name] = share, x, y
                rows += [(ids[a + text], name, *one) for (text, name), one in best.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = read.mapInArrow(run, "doc_id long, license string, containment double, start_word int, end_word int")
    best = F.max_by(F.struct("containment", "start_word", "end_word"), F.struct("containment", -F.col("start_word"))).alias("m")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "m.containment", "m.start_word", "m.end_word")

"""License notices by winnowed fingerprints and banded alignment.

Hashes of k-word runs of each template are winnowed (the least of every window
is kept) into an inverted index.  A document's own winnowed fingerprints pick
templates and diagonals from it; a banded alignment of the template with that
stretch of the document reports how much of the template is matched and where.
A run of ``K + WINDOW - 1`` equal words always shares a fingerprint.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import U64, as_bytes, byte_slices, shingle_hashes, word_hashes

K, WINDOW, BAND = 3, 3, 8
#: Share of a template that must be matched, and of the matched stretch that must be template words.
LEAST_COVERAGE, LEAST_DENSITY = 0.6, 0.5
#: Words of the templates that travel to a task at once; more are scanned for in several passes over the texts.
MOST_TEMPLATE_WORDS = 2_000_000

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"

# Published license texts, file notices and short notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd": _BSD_GRANT,
    "bsd-2-clause-text": f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_DISCLAIMER}",
    "bsd-3-clause-text": f"{_BSD_GRANT} {_BSD_CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-short": "Released under the MIT License.",
    "mit-text": f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOUND = "doc_id long, template string, start long, end long, matched_words long, template_words long, coverage double"


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of every window (the last of equal ones); all of a shorter sequence's least."""
    if not len(hashes):
        return np.empty(0, np.int64)
    w = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(np.arange(len(views)) + (w - 1 - views[:, ::-1].argmin(1)))


class Index:
    """Template fingerprints, sorted, with the template and word place of each."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words, offsets = word_hashes(as_bytes([templates[n] for n in self.names]))
        self.words = [words[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        runs, bounds = shingle_hashes(words, offsets, K)
        own = [(runs[a:b], winnow(runs[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)]
        prints = np.concatenate([np.empty(0, U64), *(r[at] for r, at in own)])
        order = np.argsort(prints, kind="stable")
        self.prints = prints[order]
        self.template = np.repeat(np.arange(len(own)), [len(at) for _, at in own])[order]
        self.place = np.concatenate([np.empty(0, int), *(at for _, at in own)])[order].astype(int)

    def candidates(self, runs: np.ndarray) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each template the diagonals that the winnowed runs of a document pick, those of most hits first, with the hits' places."""
        at = winnow(runs)
        first = np.searchsorted(self.prints, runs[at], "left")
        n = np.searchsorted(self.prints, runs[at], "right") - first
        if not n.any():
            return {}
        hit = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places = np.repeat(at, n)
        template, diagonal = self.template[hit], places - self.place[hit]
        order = np.lexsort((places, diagonal, template))
        template, diagonal, places = template[order], diagonal[order], places[order]
        cuts = np.flatnonzero((np.diff(template) != 0) | (np.diff(diagonal) != 0)) + 1
        out: dict[int, list[tuple[int, np.ndarray]]] = {}
        for own, i in zip(np.split(places, cuts), [0, *cuts.tolist()], strict=True):
            out.setdefault(int(template[i]), []).append((int(diagonal[i]), own))
        return {t: sorted(found, key=lambda x: (-len(x[1]), x[0])) for t, found in out.items()}

    def stretches(self, words: np.ndarray, runs: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, matched words) of each stretch; those of one template don't overlap.

        A diagonal is aligned until its hits lie in stretches or no more is found there.
        """
        out = []
        for t, found in self.candidates(runs).items():
            template = self.words[t]
            n = len(template)
            known = np.append(0, np.cumsum(np.isin(words, template)))
            free = np.ones(len(words), bool)
            for diagonal, places in found:
                a, b = max(diagonal - BAND, 0), min(diagonal + n + BAND, len(words))
                if known[b] - known[a] < LEAST_COVERAGE * n:  # more words can't match
                    continue
                while free[places].any():
                    matched, first, last = align(template, words, diagonal, free)
                    if not matched or matched < LEAST_COVERAGE * n or matched < LEAST_DENSITY * (last - first + 1):
                        break
                    out.append((t, first, last, matched))
                    free[first : last + 1] = False
        return sorted(out)


def align(template: np.ndarray, words: np.ndarray, diagonal: int, free: np.ndarray | None = None) -> tuple[int, int, int]:
    """Most free words matched in order within BAND of the diagonal, and the first and last matched word of the document.

    Of several such stretches the one that ends first, and from there back the words that are nearest.
    """
    n, width = len(template), 2 * BAND + 1
    best = np.zeros((n + 1, width + 2), int)  # row i, document word diagonal + i + column - BAND - 1
    hits = np.zeros(best.shape, bool)
    for i in range(n):
        j = diagonal + i + np.arange(-BAND, BAND + 1)
        inside = (j >= 0) & (j < len(words))
        at = np.clip(j, 0, len(words) - 1)
        equal = inside & (words[at] == template[i])
        if free is not None:
            equal &= free[at]
        hits[i + 1, 1 : width + 1] = equal
        row = np.maximum(best[i, 1 : width + 1] + equal, best[i, 2 : width + 2])
        best[i + 1, 1 : width + 1] = np.maximum.accumulate(row)
        best[i + 1, width + 1] = best[i + 1, width]
    matched = int(best[n, width])
    first, last, i, c = -1, -1, n, width
    while c > 1 and best[n, c - 1] == matched:
        c -= 1
    while i > 0 and c > 0 and best[i, c]:
        if hits[i, c] and best[i, c] == best[i - 1, c] + 1:
            first = diagonal + i - 1 + c - 1 - BAND
            last = first if last < 0 else last
            i -= 1
        elif c < width + 1 and best[i, c] == best[i - 1, c + 1]:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return matched, first, last


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for at, to in byte_slices(batch.column(1)):
                texts = batch.column(1).slice(at, to - at).to_pylist()
                words, offsets = word_hashes(as_bytes(texts))
                runs, bounds = shingle_hashes(words, offsets, K)
                for i, text in enumerate(texts):
                    spans = None
                    for t, first, last, matched in index.stretches(words[offsets[i] : offsets[i + 1]], runs[bounds[i] : bounds[i + 1]]):
                        spans = spans or [m.span() for m in _WORD.finditer(text)]
                        n = len(index.words[t])
                        rows.append((ids[at + i], index.names[t], spans[first][0], spans[last][1], matched, n, matched / n))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Each stretch of ``docs(doc_id, text)`` that matches a license template.

    Returns doc_id, template, start and end (code points, end exclusive),
    matched_words, template_words and coverage.  Null, empty and clean texts have
    no row; repeated rows and null doc_ids report each on their own; an empty
    table gives no rows; other columns are ignored.  Templates without words
    match nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes = [docs.mapInArrow(_scan(Index(part)), _FOUND) for part in template_parts(TEMPLATES if templates is None else templates)]
    return functools.reduce(DataFrame.unionByName, passes)


def template_parts(templates: dict[str, str]) -> list[dict[str, str]]:
    """The templates in parts of MOST_TEMPLATE_WORDS words at most; a longer one is alone, and one part may be empty."""
    parts: list[dict[str, str]] = [{}]
    left = MOST_TEMPLATE_WORDS
    for name in sorted(templates):
        n = len(_WORD.findall(templates[name]))
        if n > left and parts[-1]:
            parts.append({})
            left = MOST_TEMPLATE_WORDS
        parts[-1][name] = templates[name]
        left -= n
    return parts

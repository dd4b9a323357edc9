"""License scans: winnowed fingerprints, an inverted index of templates, banded alignment.

Texts are reduced to lower-case words with one space between. All k-grams of bytes are hashed, and of each window of w
hashes the least is kept, in templates and texts alike, so a run of w + k - 1 = 19 equal bytes always shares a fingerprint. The
inverted index maps a fingerprint to its places in the templates; its size is that of the templates. A hit
fixes a diagonal; hits on near diagonals are one candidate. A candidate whose words, each as often as both sides hold it, are
too few for the coverage cannot match; any other is aligned word by word within a band round it.
The alignment gives the words matched, the coverage of the template and the span in the text.

Templates are single sentences, notices and the whole texts of short licences; the long ones (Apache, GPL, MPL) are found by
the notice that they tell users to put into their files.

Defined results
  null or empty text   no match
  null doc_id          carried as it is
  repeated rows        each row by itself
  ties                 of overlapping matches the one with more matched words, then more coverage, then the first template by name
  empty table          empty result
  extra columns        ignored
  very long texts      whole; documents are taken together up to 4 MB, a longer one alone
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.pieces import bounded
from corpuslab.llm.shared import arrow_stage

# Notices and licences in the words in which they are published.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "MIT/line": "Released under the MIT License.",
    "MIT/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT/warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD/conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense/line": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
}

# Whole texts of short licences, without names and years.
TEMPLATES |= {
    "MIT": TEMPLATES["MIT/grant"] + " " + TEMPLATES["MIT/warranty"],
    "BSD/disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
    "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC/warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
    "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
    "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this "
    "entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
    "derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
    'copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT '
    "SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
TEMPLATES |= {
    "BSD-2-Clause": TEMPLATES["BSD/conditions"] + " " + TEMPLATES["BSD/disclaimer"],
    "BSD-3-Clause": TEMPLATES["BSD/conditions"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + TEMPLATES["BSD/disclaimer"],
    "ISC": TEMPLATES["ISC/grant"] + " " + TEMPLATES["ISC/warranty"],
}

K, WINDOW = 12, 8
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b == 0 else 32 for b in range(256))


def normalise(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with one space between words, and the place of each in raw."""
    b = np.frombuffer(raw.translate(TABLE), dtype=np.uint8)
    space = b == 32
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return b[at], at


def hashes(b: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k bytes from each place on, made by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    done, factor, out, used = 1, np.uint64(0xD6E8FEB86659FD93), None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & done:
                if out is None:
                    out, used = h, done
                else:
                    power = np.uint64(pow(0xD6E8FEB86659FD93, used, 1 << 64))
                    n = len(h) - used
                    out = out[:n] + power * h[used : used + n] if n > 0 else out[:0]
                    used += done
            if 2 * done > k:
                break
            n = len(h) - done
            h = h[:n] + factor * h[done:] if n > 0 else h[:0]
            factor, done = factor * factor, done * 2
        out = out[: max(0, len(b) - k + 1)]
        out = out ^ (out >> np.uint64(31))
        return out * np.uint64(0xBF58476D1CE4E5B9)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose hash is the least of a window that holds them (window: a power of two)."""
    if len(h) < window:
        return np.arange(len(h))
    low, s = h, 1
    while s < window:
        low, s = np.minimum(low[:-s], low[s:]), s * 2
    high = np.concatenate((np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)))
    s = 1
    while s < window:
        high, s = np.maximum(high[:-s], high[s:]), s * 2
    return np.flatnonzero(high == h)


class Index:
    """Fingerprints of all templates, sorted, with their (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.texts = [bytes(normalise(templates[n].encode())[0]).strip() for n in self.names]
        self.words = [t.split() for t in self.texts]
        self.counts = [Counter(w) for w in self.words]
        found = []
        for i, t in enumerate(self.texts):
            h = hashes(np.frombuffer(t, np.uint8))
            found += [(int(h[p]), i, int(p)) for p in winnow(h)]
        found.sort()
        self.keys = np.array([f[0] for f in found], dtype=np.uint64)
        self.places = [(f[1], f[2]) for f in found]

    def hits(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(place in the text, template, place in the template)."""
        of = h[at]
        low = np.searchsorted(self.keys, of, "left")
        some = np.flatnonzero((low < len(self.keys)) & (self.keys[np.minimum(low, len(self.keys) - 1)] == of)) if len(self.keys) else []
        out = []
        for i in some:
            for j in range(int(low[i]), int(np.searchsorted(self.keys, of[i], "right"))):
                out.append((int(at[i]), *self.places[j]))
        return out


@cache
def index() -> Index:
    return Index(TEMPLATES)


def align(template: list[bytes], words: list[bytes], offset: int, band: int) -> tuple[int, int, int]:
    """Local alignment within `band` of the diagonal words[i + offset] ~ template[i]: (matched words, first, last
    word of the text); match 2, mismatch and gap -1."""
    width = 2 * band + 1
    prev = [(0, 0, 0)] * (width + 2)  # score, matched, first word; entry c stands for word i + offset + c - band
    best = (0, 0, 0, -1)
    for i, t in enumerate(template):
        now = [(0, 0, 0)] * (width + 2)
        for c in range(width):
            j = i + offset + c - band
            if not 0 <= j < len(words):
                continue
            s, m, f = prev[c]  # the diagonal before: the word before, the template word before
            same = words[j] == t
            cell = (s + 2, m + 1, f if m else j) if same else (s - 1, m, f)
            up, left = prev[c + 1], now[c - 1] if c else (0, 0, 0)
            for s, m, f in (up, left):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, f)
            if cell[0] <= 0:
                cell = (0, 0, 0)
            now[c] = cell
            if same and cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j)
        prev = now
    return best[1], best[2], best[3]


def _word_spans(b: bytes, at: int) -> list[tuple[int, int]]:
    out, start = [], None
    for i, c in enumerate(b):
        if c == 32:
            if start is not None:
                out.append((at + start, at + i))
            start = None
        elif start is None:
            start = i
    if start is not None:
        out.append((at + start, at + len(b)))
    return out


def scan(norm: np.ndarray, hits: list[tuple[int, int, int]], idx: Index, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, from, to) of one text, in normalised places, without overlaps."""
    groups: dict[int, list[tuple[int, int]]] = {}
    for place, t, tp in hits:
        groups.setdefault(t, []).append((place - tp, place))
    found = []
    for t, diagonals in groups.items():
        diagonals.sort()
        size = len(idx.texts[t])
        slack = 16 + size // 8
        at = 0
        while at < len(diagonals):
            upto = at
            while upto + 1 < len(diagonals) and diagonals[upto + 1][0] - diagonals[at][0] <= slack:
                upto += 1
            low, high = diagonals[at][0], diagonals[upto][0]
            a, b = max(0, low - slack), min(len(norm), high + size + slack)
            while a > 0 and norm[a - 1] != 32:
                a -= 1
            while b < len(norm) and norm[b] != 32:
                b += 1
            spans = _word_spans(norm[a:b].tobytes(), a)
            words = [norm[x:y].tobytes() for x, y in spans]
            starts = [x for x, _ in spans]
            middle = (low + high) // 2
            offset = int(np.searchsorted(starts, middle))
            band = 3 + len(idx.words[t]) // 8 + int(np.searchsorted(starts, high) - np.searchsorted(starts, low))
            at = upto + 1
            if (Counter(words) & idx.counts[t]).total() < coverage * len(idx.words[t]):
                continue
            matched, first, last = align(idx.words[t], words, offset, band)
            if last >= 0 and matched >= coverage * len(idx.words[t]):
                found.append((matched, matched / len(idx.words[t]), t, spans[first][0], spans[last][1]))
    out = []
    for matched, _, t, x, y in sorted(found, key=lambda f: (-f[0], -f[1], idx.names[f[2]], f[3])):
        if all(y <= p or x >= q for _, _, p, q in out):
            out.append((t, matched, x, y))
    return sorted(out, key=lambda f: f[2])


def scan_licenses(docs: DataFrame, coverage: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per match: doc_id, license, start, end (code points of the text), matched_words, template_words, coverage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = Index(templates) if templates is not None else index()
        for whole in batches:
            for batch in bounded(whole, 4 << 20):
                yield one(batch, idx)

    def one(batch: pa.RecordBatch, idx: Index) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        norm, at = normalise(b"\0".join(texts))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])  # in raw places
        h = hashes(norm)
        hits = idx.hits(h, winnow(h))
        by_doc: dict[int, list] = {}
        owner = np.searchsorted(starts, at[[x[0] for x in hits]], side="right") - 1 if hits else []
        for d, x in zip(owner, hits, strict=True):
            by_doc.setdefault(int(d), []).append(x)
        rows = []
        for d, found in by_doc.items():
            a, b = np.searchsorted(at, (starts[d], starts[d] + len(texts[d])))
            points = None
            for t, matched, x, y in scan(norm[a:b], [(p - a, t, tp) for p, t, tp in found], idx, coverage):
                if points is None:
                    points = np.cumsum((np.frombuffer(texts[d], np.uint8) & 0xC0) != 0x80)
                start, last = int(at[a + x] - starts[d]), int(at[a + y - 1] - starts[d])
                rows.append((d, idx.names[t], int(points[start]) - 1, int(points[last]), matched, len(idx.words[t])))
        col = lambda i, kind: pa.array([r[i] for r in rows], kind)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(col(0, pa.int64())), col(1, pa.string()), col(2, pa.int64()), col(3, pa.int64()), col(4, pa.int32()), col(5, pa.int32()), pa.array([r[4] / r[5] for r in rows], pa.float64())],
            names=["doc_id", "license", "start", "end", "matched_words", "template_words", "coverage"],
        )

    schema = "doc_id long, license string, start long, end long, matched_words int, template_words int, coverage double"
    return arrow_stage(docs.select("doc_id", F.col("text").cast("binary").alias("t")), run, schema)

"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a shingle is five words (all words of a
template that has fewer). Templates of like size form a class with its own window: long enough that a template which
starts anywhere lies whole in one window, and with as many bands as make the chance of missing a match at the
threshold at most MISS. A window that collides with a template is verified by the share of the template's distinct
shingles that it holds. Of matches in one place the fullest is told.

Defined cases: null and empty texts match nothing; texts shorter than a window are one window; repeated rows are
scanned each on its own; texts of any length are scanned whole, a block of shingles at a time; an empty table or no
templates give no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.text import bounded, text_bytes
from quern.plans.columns import pick

SHINGLE, THRESHOLD, MISS = 5, 0.8, 1e-5
#: Templates that may come from a table.
MAX_TEMPLATES = 5000
#: Shingles whose minima are taken at a time, and texts that are scanned together.
BLOCK, TEXTS = 1 << 15, 256

#: Fixed texts: common license statements, notices and short licenses. Whole texts of longer ones are in license_texts/.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-statement": "Released under the MIT License.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "boost-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
        "permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "epl-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "cc-by-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-long-statement": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0-statement": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-statement": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc0-statement": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit-license-statement": "Licensed under the MIT license.",
    "bsd-statement": "Licensed under the BSD license.",
    "gpl-3.0-short": "Licensed under the GNU General Public License v3.0.",
    "lgpl-3.0-statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0-statement": "Licensed under the Mozilla Public License, Version 2.0.",
}


def whole_texts() -> dict[str, str]:
    """Full texts of longer licenses by name."""
    folder = Path(__file__).parent / "license_texts"
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(folder.glob("*.txt"))}


def from_table(templates: DataFrame, most: int = MAX_TEMPLATES) -> dict[str, str]:
    """Templates of a table with name and text; raises ValueError for more than `most`, since they go along with the code."""
    rows = pick(templates, "name", "text").filter("name IS NOT NULL AND text IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    return {r["name"]: r["text"] for r in rows}


_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def license_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], size: int, table: _Hashes) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, in order."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


@dataclass(frozen=True)
class WindowClass:
    """Templates of like size: how their windows lie, and the band values to look for."""

    size: int
    names: list[str]
    sets: list[np.ndarray]
    window: int
    stride: int
    #: Shingles below which a text can't match any of them.
    least: int
    bands: int
    rows: int
    mult: np.ndarray
    add: np.ndarray
    #: Per band, the templates by value, and which low 16 bits any value has.
    tables: list[dict[int, list[int]]]
    low_bits: np.ndarray

    @staticmethod
    def build(size: int, names: list[str], sets: list[np.ndarray], lengths: list[int], threshold: float, seed: int) -> WindowClass:
        stride = max(1, max(lengths) // 4)
        window = max(lengths) + stride - 1
        reach = -(-window // stride) * stride
        need = [ceil(threshold * len(s) - 1e-9) for s in sets]
        # at the least overlap that matches, in a window of shingles that are all distinct
        jaccard = min(n / (reach + len(s) - n) for n, s in zip(need, sets))
        rows, bands = (1, 1) if jaccard == 1 else (2, ceil(log(MISS) / log(1 - jaccard**2)))
        random = np.random.default_rng(seed + max(lengths))
        mult = random.integers(0, 1 << 31, (bands, rows)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        add = random.integers(0, 1 << 32, (bands, rows)).astype(np.uint32)
        made = WindowClass(size, names, sets, window, stride, min(need), bands, rows, mult, add, [{} for _ in range(bands)], np.zeros((bands, 1 << 16), bool))
        for t, s in enumerate(sets):
            for b in range(bands):
                value = 0
                for r in range(rows):
                    least = (_folded(s) * mult[b, r] + add[b, r]).min()
                    value = int(_band(np.array([value], np.uint32), np.array([least], np.uint32))[0])
                made.tables[b].setdefault(value, []).append(t)
                made.low_bits[b, value & 0xFFFF] = True
        return made

    @property
    def blocks(self) -> int:
        """Strides in a window."""
        return -(-self.window // self.stride)

    def candidates(self, hashed: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text, window start, template) of all collisions in some band, for the shingle hashes of several texts."""
        found: set[tuple[int, int, int]] = set()
        group: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for i, hashes in enumerate(hashed):
            windows = max(1, -(-(len(hashes) - self.window) // self.stride) + 1) if len(hashes) >= self.least else 0
            step = max(1, BLOCK // self.stride)
            for first in range(0, windows, step):
                last = min(windows, first + step)
                part = _folded(hashes[first * self.stride : (last - 1 + self.blocks) * self.stride])
                short = (last - first - 1 + self.blocks) * self.stride - len(part)
                # the last shingle again: it lies in every window that reaches past the end, so no minimum changes
                group.append((i, first, np.concatenate([part, np.full(short, part[-1])]) if short else part))
                held += len(group[-1][2])
                if held >= BLOCK:
                    found |= self._collide(group)
                    group, held = [], 0
        if group:
            found |= self._collide(group)
        return sorted(found)

    def _collide(self, group: list[tuple[int, int, np.ndarray]]) -> set[tuple[int, int, int]]:
        x = np.ascontiguousarray(np.concatenate([g[2] for g in group]).reshape(-1, self.stride).T)
        y = np.empty_like(x)
        lengths = [len(g[2]) // self.stride for g in group]
        owner = np.repeat(np.arange(len(group)), lengths)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        windows = len(owner) - self.blocks + 1
        whole = (place <= np.repeat(lengths, lengths) - self.blocks)[:windows]
        found = set()
        for b in range(self.bands):
            value = np.zeros(windows, np.uint32)
            for r in range(self.rows):
                np.multiply(x, self.mult[b, r], out=y)
                y += self.add[b, r]
                least = y.min(axis=0) if self.stride > 1 else y[0]
                minima = least[:windows].copy()
                for k in range(1, self.blocks):
                    np.minimum(minima, least[k : k + windows], out=minima)
                value = _band(value, minima)
            for w in np.flatnonzero(self.low_bits[b][value & np.uint32(0xFFFF)] & whole).tolist():
                for t in self.tables[b].get(int(value[w]), ()):
                    i, first, _ = group[owner[w]]
                    found.add((i, int(first + place[w]) * self.stride, t))
        return found


def _folded(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)


def _band(value: np.ndarray, minima: np.ndarray) -> np.ndarray:
    mixed = (value * np.uint32(0x9E3779B1)) ^ minima
    return mixed ^ (mixed >> np.uint32(15))


def window_classes(templates: dict[str, str], threshold: float = THRESHOLD, size: int = SHINGLE, seed: int = 3) -> list[WindowClass]:
    """Templates grouped by shingle size and by length within a factor of 1.25."""
    table = _Hashes()
    made = []
    for name, text in templates.items():
        words = license_words(text.encode())
        if words:
            k = min(size, len(words))
            hashes = shingle_hashes(words, k, table)
            made.append((k, len(hashes), name, np.unique(hashes)))
    made.sort(key=lambda m: (m[0], m[1], m[2]))
    groups: list[list[tuple]] = []
    for m in made:
        if groups and groups[-1][0][0] == m[0] and m[1] <= 1.25 * groups[-1][0][1]:
            groups[-1].append(m)
        else:
            groups.append([m])
    return [WindowClass.build(g[0][0], [m[2] for m in g], [m[3] for m in g], [m[1] for m in g], threshold, seed) for g in groups]


def scan_texts(texts: list[bytes], classes: list[WindowClass], table: _Hashes, threshold: float = THRESHOLD) -> list[tuple[int, str, float, int, int, int]]:
    """(text, template, containment, first word, end word, windows) for each template found, with its best window."""
    words = [license_words(t) for t in texts]
    sizes = {c.size for c in classes}
    hashed = {k: [shingle_hashes(w, k, table) for w in words] for k in sizes}
    best: dict[tuple[int, str], list] = {}
    for c in classes:
        reach = c.blocks * c.stride
        for i, start, t in c.candidates(hashed[c.size]):
            inside = hashed[c.size][i][start : start + reach]
            share = len(np.intersect1d(inside, c.sets[t])) / len(c.sets[t])
            if share >= threshold - 1e-9:
                at = start + np.flatnonzero(np.isin(inside, c.sets[t]))
                row = (-share, int(at[0]), int(at[-1]) + c.size)
                known = best.setdefault((i, c.names[t]), [row, 0])
                known[0] = min(known[0], row)
                known[1] += 1
    return [(i, name, -row[0], row[1], row[2], n) for (i, name), (row, n) in sorted(best.items())]


def best_of_alike(found: list[tuple[int, str, float, int, int, int]]) -> list[tuple[int, str, float, int, int, int]]:
    """Matches less those most of whose words a fuller match of the same text covers: notices of one family are alike."""
    kept: list[tuple[int, str, float, int, int, int]] = []
    for m in sorted(found, key=lambda m: (m[0], -m[2], m[1])):
        covered = (min(m[4], k[4]) - max(m[3], k[3]) for k in reversed(kept) if k[0] == m[0] and k[2] > m[2])
        if all(5 * c < 4 * (m[4] - m[3]) for c in covered):
            kept.append(m)
    return sorted(kept)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and template that it holds: doc_id, license, containment, first_word, end_word, n_windows.

    One pass, no shuffle; the templates go along with the code and are bounded by their table.
    """
    source = pick(docs, "doc_id", "text").select("doc_id", text_bytes().alias("_bytes"))
    classes = window_classes({**TEMPLATES, **whole_texts()} if templates is None else templates, threshold)
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hashes()
        for batch in bounded(batches, "_bytes"):
            found = []
            texts = batch.column("_bytes").to_pylist()
            for at in range(0, len(texts), TEXTS):
                found += [(at + m[0], *m[1:]) for m in best_of_alike(scan_texts(texts[at : at + TEXTS], classes, table, threshold))]
            rows, name, share, first, end, n = list(zip(*found)) or [()] * 6
            arrays = [pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *arrays], names=["doc_id", "license", "containment", "first_word", "end_word", "n_windows"])

    return source.mapInArrow(run, f"doc_id {kind}, license string, containment double, first_word long, end_word long, n_windows long")

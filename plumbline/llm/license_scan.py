"""License notices in documents: MinHash bands over overlapping windows of text retrieve templates, exact containment confirms.

Templates are put into classes by their number of shingles, up to a power of two (hi). Windows of a class hold 2 * hi shingles and
begin every hi + 1, so any run of hi shingles lies within a window as a whole. A window in which a template of s shingles is
contained to LEAST has a Jaccard similarity to it of at least j = m / (2 * hi + s - m), m = ceil(LEAST * s); with bands of one row
the two share no band with probability (1 - j) ** bands, and as many bands are taken as keep that under MISS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import short_batches
from .textops import NORMAL, U, as_bytes, multipliers, shingle_hashes, slices, word_hashes

WORDS, LEAST, MISS = 5, 0.8, 1e-5

#: Notices by which works are licensed, as their licenses word them, and whole terms of short licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-2-Clause-terms": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-terms": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-terms": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-terms": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib-terms": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


@dataclass
class Class:
    """Templates of one class: names, their distinct shingles, window and step in shingles, and their least hash for each band."""

    names: list[str]
    sets: list[np.ndarray]
    window: int
    step: int
    bands: np.ndarray
    least: np.ndarray


def classes(templates: dict[str, str]) -> list[Class]:
    """Templates without words are left out; null ones too."""
    by: dict[int, list[tuple[str, np.ndarray]]] = {}
    for name, text in sorted(templates.items()):
        shingles = np.unique(shingle_hashes(*word_hashes([(text or "").encode().translate(NORMAL)]), WORDS)[0])
        if len(shingles):
            by.setdefault(1 << (len(shingles) - 1).bit_length(), []).append((name, shingles))
    out = []
    for hi, own in sorted(by.items()):
        s = min(len(x) for _, x in own)
        need = int(np.ceil(LEAST * s - 1e-9))
        j = need / (2 * hi + s - need)
        bands = multipliers(int(np.ceil(np.log(MISS) / np.log(1 - j))), 57)
        out.append(Class([n for n, _ in own], [x for _, x in own], 2 * hi, hi + 1, bands, np.array([[(x * m).min() for _, x in own] for m in bands])))
    return out


def grid(n: int, c: Class) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the windows over n shingles."""
    at = np.arange(0, max(1, n - c.window + c.step), c.step)
    return at, np.minimum(at + c.window, n)


def matches(shingles: np.ndarray, bounds: np.ndarray, c: Class) -> Iterator[tuple[int, str, float, int]]:
    """(text, template, containment, first shingle of the window) of confirmed windows."""
    begins, ends, text = [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a < b:
            x, y = grid(b - a, c)
            begins.append(x + a)
            ends.append(y + a)
            text.append(np.full(len(x), i))
    if not begins:
        return
    begin, end, of = map(np.concatenate, (begins, ends, text))
    # reduceat over begin, end, begin, ...: every other result is a window's; the shingle after the last is no text's
    edges = np.stack((begin, end), axis=1).ravel()
    found = np.zeros((len(begin), len(c.names)), bool)
    padded = np.concatenate((shingles, [U(0)]))
    for m, least in zip(c.bands, c.least, strict=True):
        own = np.minimum.reduceat(padded * m, edges)[::2]
        found |= own[:, None] == least[None, :]
    for w, k in zip(*np.nonzero(found), strict=True):
        inside = np.isin(c.sets[k], shingles[begin[w] : end[w]]).mean()
        if inside >= LEAST - 1e-9:
            yield int(of[w]), c.names[k], float(inside), int(begin[w] - bounds[of[w]])


def _scanned(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = classes(templates)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts):
                shingles, bounds = shingle_hashes(*word_hashes([t.translate(NORMAL) for t in texts[a:b]]), WORDS)
                best: list[dict[str, tuple[float, int]]] = [{} for _ in range(b - a)]
                for c in known:
                    for i, name, inside, at in matches(shingles, bounds, c):
                        if name not in best[i] or (inside, -at) > (best[i][name][0], -best[i][name][1]):
                            best[i][name] = (inside, at)
                rows = [sorted(x.items()) for x in best]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(r) for r in rows], pa.int32()),
                        pa.array([",".join(n for n, _ in r) for r in rows]),
                        pa.array([max((v[0] for _, v in r), default=0.0) for r in rows], pa.float64()),
                        pa.array([[{"template": n, "containment": v[0], "first_word": v[1]} for n, v in r] for r in rows], pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())]))),
                    ],
                    ["doc_id", "n_licenses", "licenses", "containment", "found"],
                )

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """License notices found in each row of docs (doc_id, text); templates: name to text, a list that the caller bounds.

    Words are of UTF-8 bytes, A-Z lower-cased, other ASCII than 0-9 and a-z parting them; shingles of WORDS words, a shorter
    template or text having all its words as one. A template is found where a window holds LEAST of its distinct shingles.

    Returns doc_id, n_licenses, licenses (names, sorted, comma-joined), containment (the largest, 0 without any), found (template,
    containment, number of the window's first word; of equal windows the first). Null and wordless texts have none. Repeated and
    null doc_ids each get their row; an empty table gives no row. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with short_batches(docs.sparkSession):
        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scanned(TEMPLATES if templates is None else templates), f"doc_id {kind}, n_licenses int, licenses string, containment double, found array<struct<template: string, containment: double, first_word: bigint>>")

"""Licence scan: Dice coefficient over word bigrams against licence templates."""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.hashing import IS_PUNCTUATION, LOWER, gram_hash, slices, text_bytes, tokenize

# Notices and licence texts that are compared with, by SPDX-like name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "BSD",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ),
    (
        "BSD",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but "
        "not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the "
        "copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages "
        "(including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business "
        "interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or "
        "otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "ISC",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential "
        "damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other "
        "tortious action, arising out of or in connection with the use or performance of this software.",
    ),
    (
        "MIT",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of "
        "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable "
        "for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection "
        "with the software or the use or other dealings in the software.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ),
    ("Proprietary", "All rights reserved."),
]

BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13]] = True


def bigram_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word bigrams of each unit of text, and the unit of each."""
    tokens = tokenize(data, offsets, IS_PUNCTUATION)
    if len(tokens.values) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    unit = np.repeat(np.arange(len(offsets) - 1), np.diff(tokens.first))
    inside = unit[1:] == unit[:-1]
    grams, unit = gram_hash(tokens.values, 2)[inside], unit[1:][inside]
    order = np.lexsort((grams, unit))
    grams, unit = grams[order], unit[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (unit[1:] != unit[:-1])
    return grams[new], unit[new]


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        raw = [LOWER[np.frombuffer(t.encode(), np.uint8)] for _, t in templates]
        grams, unit = bigram_sets(np.concatenate(raw), np.cumsum([0, *map(len, raw)]))
        self.names = np.array([n for n, _ in templates])
        self.size = np.bincount(unit, minlength=len(templates))
        self.grams = np.unique(grams)
        self.has = np.zeros((len(self.grams) + 1, len(templates)), np.int32)
        self.has[np.searchsorted(self.grams, grams), unit] = 1


def matches(data: np.ndarray, offsets: np.ndarray, known: Templates, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units with a template at Dice ``least`` or more: unit, nearest template, Dice.

    Dice can't reach ``least`` unless sizes are within a factor (2 - least) / least, so only units
    whose size is near some template's are compared, and only with those templates.
    """
    grams, unit = bigram_sets(data, offsets)
    size = np.bincount(unit, minlength=len(offsets) - 1)
    factor = (2 - least) / least
    near = (size[:, None] * factor >= known.size) & (size[:, None] <= known.size * factor) & (size[:, None] > 0)
    use = near.any(1)[unit]
    grams, unit = grams[use], unit[use]
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.searchsorted(known.grams, grams)
    at[(at == len(known.grams)) | (known.grams[np.minimum(at, len(known.grams) - 1)] != grams)] = len(known.grams)
    first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    common = np.add.reduceat(known.has[at], first, axis=0)
    units = unit[first]
    dice = 2 * common / (size[units][:, None] + known.size)
    dice[~near[units]] = 0
    template, row = dice.argmax(1), np.arange(len(units))
    row = row[dice[row, template] >= least]
    return units[row], template[row], dice[row, template[row]]


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lines end, where a line without any character does, and where one without terms does (a rule, or
    marks of a comment alone). A carriage return with its line feed is one end of line."""
    breaks = np.zeros(len(data) + 1, bool)
    breaks[:-1] = BREAK[data]
    breaks[:-2] &= ~((data[:-1] == 13) & (data[1:] == 10))
    ends = np.flatnonzero(breaks)
    blank, bare = np.zeros_like(breaks), np.zeros_like(breaks)
    if len(ends):
        size = np.diff(np.r_[ends, len(data)]) - 1
        follows = data[np.minimum(ends + 1, len(data) - 1)]
        empty = (size == 0) | ((size == 1) & (follows == 13))
        terms = np.concatenate(([0], np.cumsum(~IS_PUNCTUATION[data])))
        last = np.searchsorted(ends, offsets[1:]) - 1  # the last line of a text isn't closed by a break of its own
        closed = np.ones(len(ends), bool)
        closed[last[(last >= 0)]] = False
        blank[np.r_[ends[1:], len(data)][empty & closed]] = True
        bare[ends[(np.diff(terms[np.r_[ends, len(data)]]) == 0) & closed]] = True
    return breaks, blank, bare


def scan_batches(batches: Iterator[pa.RecordBatch], templates: list[tuple[str, str]], least: float) -> Iterator[pa.RecordBatch]:
    known = Templates(templates)
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"), lower=True)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            breaks, blank, bare = cuts(data, offsets)
            for kind, cut in (("line", breaks), ("paragraph", blank), ("paragraph", bare), ("text", np.zeros_like(breaks))):
                edges = cut.copy()
                edges[offsets] = True
                edges = np.flatnonzero(edges)
                if len(edges) < 2:
                    continue
                unit, template, dice = matches(data, edges, known, least)
                start = edges[unit]
                doc = np.searchsorted(offsets, start, "right") - 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids[doc],
                        "unit": pa.array([kind] * len(doc), pa.string()),
                        "start": (start - offsets[doc]).astype(np.int64),
                        "end": (edges[unit + 1] - offsets[doc]).astype(np.int64),
                        "license": pa.array(known.names[template].tolist(), pa.string()),
                        "dice": dice,
                    }
                )


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences found in documents: ``doc_id, license, dice, unit, start, end``, one row for each
    document and licence with its best unit (the widest of equal ones).

    Units are lines, paragraphs between empty lines or lines without a word (as ``#`` alone), whatever ends a
    line, and the whole text (byte offsets). Texts are
    normalised to lower-case terms without punctuation. Null, empty and one-word texts match
    nothing; repeated rows are scanned each and count once; further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id long, unit string, start long, end long, license string, dice double"
    found = texts.mapInArrow(partial(scan_batches, templates=templates, least=least), kind)
    best = F.max_by(F.struct("unit", "start", "end"), F.struct("dice", F.col("end") - F.col("start"), -F.col("start"), "unit"))
    out = found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), best.alias("b"))
    return out.select("doc_id", "license", "dice", "b.unit", "b.start", "b.end")

"""Licence notices by the Dice coefficient over word bigrams.

Units of a text are its lines, its paragraphs (parts between blank lines) of more than one line, and its windows: for each
template all runs of consecutive words, over lines and paragraphs or inside a line, of up to (2 - t) / t times the
template's bigrams. A unit and a licence template are normalised alike (A-Z lower-cased; words are runs of a-z and 0-9), and compared by their sets of word bigrams,

    dice = 2 * shared / (own + template's)

A dice of ``THRESHOLD`` bounds the sizes: own lies within t / (2 - t) and (2 - t) / t times the template's. Units outside
the bounds of all templates are passed over before their bigrams are compared, and an index from bigrams to templates
leads to those that share any. Windows are compared for those templates of which the text has, anywhere, the bigrams that a dice
of ``THRESHOLD`` takes at least, and only from words on where enough of them are within reach.

The result of a document is its best unit: highest dice, then lines and paragraphs before windows (of windows that of the
template with the most bigrams), then first template in the list, then first line, lines before paragraphs. The number of matching lines counts lines that match as a whole. ``oracle_sql`` has lines and
paragraphs alone, so it agrees where no window is better than them. Odd input: null and empty texts, and texts without a match, have a null licence and dice 0; repeated rows give
repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_map, bound_arrow_batches, texts_of

THRESHOLD = 0.7
#: Common licence notices and short licence texts, by identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT-licensed", "Licensed under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved. No part of this publication may be reproduced without written permission."),
    ("All-rights-reserved-line", "All rights reserved."),
)
WORD = re.compile(rb"[a-z0-9]+")
BLANK = re.compile(r"\n[ \t\r]*\n")
RESULT = "doc_id long, license string, dice double, line long, n_lines long"


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def bigrams(own: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(own, own[1:]))


class Matcher:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.names = [name for name, _ in templates]
        self.sets = [bigrams(words(text)) for _, text in templates]
        self.threshold, ratio = threshold, threshold / (2 - threshold)
        self.low, self.high = [ratio * len(s) for s in self.sets], [len(s) / ratio for s in self.sets]
        self.least, self.most = min(self.low), max(self.high)
        self.fewest = [threshold / (2 - threshold) * len(s) - 1e-9 for s in self.sets]  # shared bigrams
        self.reach = [int((len(words(text)) - 1) / ratio) for _, text in templates]
        self.index: dict[tuple[bytes, bytes], list[int]] = {}
        for i, s in enumerate(self.sets):
            for b in s:
                self.index.setdefault(b, []).append(i)

    def best(self, unit: str) -> tuple[float, int] | None:
        """(dice, -template) of the best template that reaches the threshold."""
        own = words(unit)
        if len(own) - 1 < self.least:
            return None
        mine = bigrams(own)
        if not self.least <= len(mine) <= self.most:
            return None
        shared: dict[int, int] = {}
        for b in self.index.keys() & mine:
            for i in self.index[b]:
                shared[i] = shared.get(i, 0) + 1
        found = [(2.0 * n / (len(mine) + len(self.sets[i])), -i) for i, n in shared.items() if self.low[i] <= len(mine) <= self.high[i]]
        found = [x for x in found if x[0] >= self.threshold]
        return max(found) if found else None

    def windows(self, text: str) -> list[tuple[float, int, int]]:
        """(dice, -template, -line) of the best window of each template that reaches the threshold."""
        own = words(text)
        grams = list(zip(own, own[1:]))
        shared: dict[int, int] = {}
        for b in self.index.keys() & set(grams):
            for i in self.index[b]:
                shared[i] = shared.get(i, 0) + 1
        close = [i for i, n in shared.items() if n >= self.fewest[i]]
        if not close:
            return []
        last: dict[tuple[bytes, bytes], int] = {}
        before = np.empty(len(grams), np.int64)  # where a bigram stood last
        for k, b in enumerate(grams):
            before[k] = last.get(b, -1)
            last[b] = k
        found = []
        for i in close:
            hit = np.fromiter((b in self.sets[i] for b in grams), bool, len(grams))
            if best := self._best_window(i, hit, before):
                dice, start = best
                at = next(islice(WORD.finditer(text.encode().lower()), start, None)).start()
                found.append((dice, -i, -text.encode().count(b"\n", 0, at)))
        return found

    def _best_window(self, i: int, hit: np.ndarray, before: np.ndarray) -> tuple[float, int] | None:
        """Dice and first word of the best, then first, window of template i. ``hit``: whether a bigram is the template's."""
        size, reach, starts = len(self.sets[i]), self.reach[i], np.flatnonzero(hit)
        ahead = np.searchsorted(starts, starts + reach) - np.arange(len(starts))  # hits within reach
        best, at = 0.0, -1
        for start, n in zip(starts[ahead >= self.fewest[i]].tolist(), ahead[ahead >= self.fewest[i]].tolist()):
            if 2.0 * min(n, size) / (min(n, size) + size) <= best:
                continue
            new = before[start : start + reach] < start
            dice = 2.0 * np.cumsum(new & hit[start : start + reach]) / (np.cumsum(new) + size)
            if (top := float(dice.max())) > best:
                best, at = top, start
        return (best, at) if best >= self.threshold else None

    def scan(self, text: str) -> tuple[str | None, float, int | None, int]:
        """Licence, dice and first line of the best unit, and the number of lines that match."""
        found, lines = [], text.split("\n")
        for at, line in enumerate(lines):
            if hit := self.best(line):
                found.append((hit[0], 1, 0, hit[1], -at, 1))
        matching, at = len(found), 0
        for part in BLANK.split(text) if len(lines) > 1 else ():
            start = text.find(part, at)
            at = start + len(part)
            if "\n" in part and (hit := self.best(part)):
                found.append((hit[0], 1, 0, hit[1], -text.count("\n", 0, start), 0))
        found += [(dice, 0, len(self.sets[-i]), i, line, 0) for dice, i, line in self.windows(text)]
        if not found:
            return None, 0.0, None, 0
        dice, _, _, template, line, _ = max(found)
        return self.names[-template], dice, -line, matching


@lru_cache(maxsize=4)
def matcher(templates: tuple[tuple[str, str], ...], threshold: float) -> Matcher:
    return Matcher(templates, threshold)


def scan(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: its best licence match, the match's dice and line (from 0), and the number of matching lines."""
    bound_arrow_batches(documents.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = matcher(templates, threshold)
        found = list(zip(*map(own.scan, texts_of(batch.column(1)))))
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(found, kinds))], names=["doc_id", "license", "dice", "line", "n_lines"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batch_map(run), RESULT)


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan`` over table documents."""
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    lower = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return f"""
WITH templates AS (SELECT i, name, {grams} AS g FROM (SELECT i, name, {lower.format("t")} AS w FROM (VALUES {rows}) v(i, name, t))),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, unnest(range(len(string_split(text, chr(10))))) AS line, 1 AS is_line FROM documents WHERE text IS NOT NULL
), paragraphs AS (
  SELECT doc_id, parts[k] AS unit, parts, k, marks FROM (
    SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS parts, regexp_extract_all(text, '\\n[ \\t\\r]*\\n') AS marks, text FROM documents WHERE text IS NOT NULL
  ), unnest(range(1, len(parts) + 1)) AS r(k)
), units AS (
  SELECT doc_id, unit, line, is_line FROM lines
  UNION ALL
  SELECT doc_id, unit, len(string_split(array_to_string(list_concat(parts[1:k - 1], marks[1:k - 1]), ''), chr(10))) - 1, 0 FROM paragraphs WHERE contains(unit, chr(10))
), sized AS (
  SELECT doc_id, line, is_line, {grams} AS g FROM (SELECT doc_id, line, is_line, {lower.format("unit")} AS w FROM units) WHERE len(w) > 1
), hits AS (
  SELECT doc_id, line, is_line, i, name, 2.0::DOUBLE * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice
  FROM sized s, templates t WHERE len(s.g) BETWEEN {threshold / (2 - threshold)!r}::DOUBLE * len(t.g) AND len(t.g) / {threshold / (2 - threshold)!r}::DOUBLE
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, i, line, is_line DESC) AS place, count(DISTINCT CASE WHEN is_line = 1 THEN line END) OVER (PARTITION BY doc_id) AS n_lines
  FROM hits WHERE dice >= {threshold!r}::DOUBLE
)
SELECT d.doc_id, b.name AS license, coalesce(b.dice, 0.0::DOUBLE) AS dice, b.line::BIGINT AS line, coalesce(b.n_lines, 0)::BIGINT AS n_lines
FROM documents d LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (doc_id)
"""

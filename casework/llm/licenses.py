"""License notices found by alignment.

A notice's coverage is the share of its words that are aligned with a text's, in order. A text can
hold a notice only if it has enough of its words at all, so those are counted first, by hash and
for a whole block of texts at once. In the texts that remain, the notice's words are followed as
long as no gap between two of them is longer than a quarter of the notice and two words; how many
words lie between in all does not matter. Along such a stretch the longest common subsequences
that are long enough are taken, each the shortest stretch of text it fits in, so a notice that a
text holds twice is found twice.

``align`` is the patience form: words that occur once on both sides are anchors, the longest chain
of anchors in the same order (a longest increasing subsequence) is kept, and the gaps between are
aligned the same way. Repeated words hide its anchors, so the scan does not rely on it.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm import arrays

MIN_COVERAGE = 0.8

# Public licenses' notices as their texts or their stewards give them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software.""",
}


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, that rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k:k + 1], at[k:k + 1] = [j], [n]
        back.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _once(words: list, low: int, high: int) -> dict:
    seen: dict = {}
    for i in range(low, high):
        seen[words[i]] = -1 if words[i] in seen else i
    return seen


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal words, rising in both, by patience."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        left, right = _once(a, i, n), _once(b, j, m)
        anchors = _chain([(x, right[w]) for w, x in left.items() if x >= 0 and right.get(w, -1) >= 0])
        if not anchors:
            continue
        for x, y in [*anchors, (n, m)]:
            todo.append((i, x, j, y))
            if x < n:
                out.append((x, y))
            i, j = x + 1, y + 1
    return sorted(out)


class Scanner:
    """All notices, ready for many texts."""

    def __init__(self, notices: dict[str, str], min_coverage: float):
        texts = pa.array(notices.values(), pa.string())
        hashes = []
        for block in arrays.blocks(texts):
            words = block.words(arrays.ALPHANUMERIC, arrays.LOWER)
            hashes += [words.hash[words.of[i] : words.of[i + 1]] for i in range(len(block))]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        self.names, self.notices, self.places = list(notices), [], []
        for part in hashes:
            notice = np.searchsorted(self.vocabulary, part)
            places: dict[int, list[int]] = {}
            for j in range(len(notice) - 1, -1, -1):
                places.setdefault(int(notice[j]), []).append(j)
            self.notices.append(notice)
            self.places.append(places)
        self.need = [max(1, math.ceil(min_coverage * len(n))) for n in self.notices]

    def scan(self, block: arrays.Block):
        """(text, name, coverage, first word, last word) of every notice found."""
        words = block.words(arrays.ALPHANUMERIC, arrays.LOWER)
        size = len(self.vocabulary)
        if not len(words.hash) or not size:
            return
        place = np.minimum(np.searchsorted(self.vocabulary, words.hash), size - 1)
        at = np.flatnonzero(self.vocabulary[place] == words.hash)
        word = place[at]
        text = np.searchsorted(words.of, at, side="right") - 1
        counts = np.bincount(text * size + word, minlength=len(block) * size).reshape(len(block), size)
        possible = np.zeros((len(block), len(self.notices)), bool)
        for k, (notice, need) in enumerate(zip(self.notices, self.need)):
            ids, times = np.unique(notice, return_counts=True)
            possible[:, k] = np.minimum(counts[:, ids], times).sum(axis=1) >= need
        edges = np.searchsorted(text, np.arange(len(block) + 1))
        for i in np.flatnonzero(possible.any(axis=1)).tolist():
            part = slice(edges[i], edges[i + 1])
            yield from ((i, *x) for x in self._text(at[part] - words.of[i], word[part], np.flatnonzero(possible[i]).tolist()))

    def _stretches(self, at, word, k):
        """(aligned, first word, last word) of one notice after the other."""
        notice, need = self.notices[k], self.need[k]
        reach = len(notice) // 4 + 2
        mine = np.isin(word, notice)
        at, word = at[mine], word[mine]
        ids, times = np.unique(notice, return_counts=True)
        cuts = [0, *(np.flatnonzero(np.diff(at) > reach + 1) + 1).tolist(), len(at)]
        for low, high in zip(cuts, cuts[1:]):
            if high - low < need:
                continue
            there = np.bincount(word[low:high], minlength=len(self.vocabulary))[ids]
            if np.minimum(there, times).sum() >= need:
                yield from self._follow(at[low:high].tolist(), word[low:high].tolist(), k, reach)

    def _follow(self, at, word, k, reach):
        places, need, m = self.places[k], self.need[k], len(self.notices[k])
        latest = np.full((m + 1, m + 1), -1)  # [c, j]: last place where c of the first j words, in order, can begin
        n, best = 0, None
        while n < len(at) or best:
            if best and (n == len(at) or best[0] == m or at[n] - best[2] > reach + 1):
                yield best[:3]
                n, best = best[3] + 1, None
                latest.fill(-1)
                continue
            for j in places[word[n]]:
                before = latest[:m, j].copy()
                before[0] = at[n]
                np.maximum(latest[1:, j + 1 :], before[:, None], out=latest[1:, j + 1 :])
            least = max(need, best[0] + 1 if best else 0)
            reached = np.flatnonzero(latest[least:, m] >= 0)
            if len(reached):
                c = least + int(reached[-1])
                best = (c, int(latest[c, m]), at[n], n)
            n += 1

    def _text(self, at, word, candidates):
        found = []
        for k in candidates:
            for aligned, first, last in self._stretches(at, word, k):
                found.append((-aligned, -aligned / len(self.notices[k]), self.names[k], first, last + 1))
        best: list[tuple[int, int]] = []
        for _, coverage, name, first, stop in sorted(found):
            k = bisect_left(best, (first,))
            if (k == 0 or best[k - 1][1] <= first) and (k == len(best) or stop <= best[k][0]):
                best.insert(k, (first, stop))
                yield (name, -coverage, int(first), int(stop) - 1)


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word): one row for each notice in each text.

    Words are runs of letters and digits, A-Z lower-cased, counted from 0 over the whole text; the
    last is included. Where notices overlap, the one with most aligned words is reported, then that
    with the higher coverage, then by name. Null and empty texts have none; repeated rows and null ids are rows like any other; other columns are
    ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()),
                        ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches):
        scanner = Scanner(notices, min_coverage)
        for batch in batches:
            for block in arrays.blocks(batch.column("text")):
                found = list(zip(*scanner.scan(block))) or [()] * 5
                ids = batch.column("doc_id").take(pa.array([block.first + i for i in found[0]], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, f.type) for c, f in zip(found[1:], list(schema)[1:]))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long")

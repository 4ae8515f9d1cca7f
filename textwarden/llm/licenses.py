"""License scans: rare words pick candidates, banded alignment measures them.

Of a template's words, a text that reaches the coverage lacks some number at most; one word more than that, the longest,
are its fingerprints, so that such a text holds at least one of them in its place. The inverted index of these is small
and broadcast. A text's words probe it; hits on neighbouring diagonals make a candidate, which goes on if enough of the
template's words stand near, and a local alignment within BAND of the candidate's diagonals gives the matched words, the
coverage of the template and the span.
Then the words before and after the span are aligned again, until no alignment reaches the coverage. Long runs of
diagonals are cut into overlapping windows; an alignment drifts by less than two templates' lengths, so one window holds it.

Templates are a parameter: name -> text; the built-in ones are short notices. Defined results: a null or empty text has
no matches; repeated rows are scanned one by one; of overlapping matches the one of higher coverage, then more words,
then the name that comes first, stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textwarden.llm.common import mapped, slices, words

BAND, COVERAGE = 8, 0.8
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")

# Short notices by which works state their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


class Index:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(n for n in templates if words(templates[n]))
        self.vocabulary: dict[bytes, int] = {}
        self.texts = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(templates[n])] for n in self.names]
        spelt = list(self.vocabulary)
        self.coverage = coverage
        self.postings: dict[int, list[tuple[int, int]]] = {}
        self.holds = np.zeros((len(self.texts), len(spelt) + 1), dtype=bool)
        for t, ids in enumerate(self.texts):
            self.holds[t, ids] = True
            lacking = sum(m >= coverage * len(ids) for m in range(len(ids)))
            for i in sorted(range(len(ids)), key=lambda j: (-len(spelt[ids[j]]), j))[: lacking + 1]:
                self.postings.setdefault(ids[i], []).append((t, i))
        self.marked = np.zeros(len(spelt) + 1, dtype=bool)
        self.marked[list(self.postings)] = True
        self.memo: dict = {}

    def candidates(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By template: (place in the text, place in the template) of the hits."""
        out: dict[int, list[tuple[int, int]]] = {}
        for at in np.flatnonzero(self.marked[ids]).tolist():
            for t, p in self.postings[int(ids[at])]:
                out.setdefault(t, []).append((at, p))
        for t in list(out):
            # an alignment of a score above 0 is shorter than three templates
            reach = 3 * len(self.texts[t])
            total = np.concatenate(([0], np.cumsum(self.holds[t][ids])))
            near = [(a, p) for a, p in out[t] if total[min(len(ids), a + reach)] - total[max(0, a - reach)] >= self.coverage * len(self.texts[t])]
            if near:
                out[t] = near
            else:
                del out[t]
        return out

    def align(self, t: int, ids: list[int], low: int, high: int, need: float = 0) -> tuple[int, int, int]:
        """Matched words and the span (start, end) of the best local alignment within diagonals low to high, one of need words if any."""
        key = (t, tuple(ids), low, high, need)
        if key not in self.memo:
            if len(self.memo) > 20_000:
                self.memo.clear()
            template, best = self.texts[t], (False, 0, 0, 0, 0)
            row: dict[int, tuple[int, int, int]] = {}
            for i, x in enumerate(template):
                new: dict[int, tuple[int, int, int]] = {}
                for j in range(max(0, i + low), min(len(ids), i + high + 1)):
                    score, matched, start = row.get(j - 1, (0, 0, j))
                    cell = (score + 2, matched + 1, start) if x == ids[j] else (score - 1, matched, start)
                    for old in (row.get(j), new.get(j - 1)):
                        if old and old[0] - 1 > cell[0]:
                            cell = (old[0] - 1, old[1], old[2])
                    if cell[0] > 0:
                        new[j] = cell
                        best = max(best, (cell[1] >= need, cell[0], cell[1], -cell[2], j + 1))
                row = new
            self.memo[key] = (best[2], -best[3], best[4])
        return self.memo[key]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(name, coverage, first word, end word), in order of place."""
        ws, coverage = words(text), self.coverage
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
        found = set()
        for t, hits in self.candidates(ids).items():
            size = len(self.texts[t])
            diagonals: list[list[int]] = []
            for d in sorted({a - p for a, p in hits}):
                if diagonals and d - diagonals[-1][1] <= BAND:
                    diagonals[-1][1] = d
                else:
                    diagonals.append([d, d])
            for first, last in diagonals:
                for low in range(first, max(first, last - 3 * size) + size, size):
                    high = min(last, low + 3 * size)
                    left = [(max(0, low - BAND), min(len(ids), high + size + BAND))]
                    while left:
                        begin, end = left.pop()
                        if end - begin < coverage * size:
                            continue
                        matched, a, b = self.align(t, ids[begin:end].tolist(), low - BAND - begin, high + BAND - begin, coverage * size)
                        if matched and matched >= coverage * size:
                            found.add((matched / size, matched, self.names[t], begin + a, begin + b))
                            left += [(begin, begin + a), (begin + b, end)]
        kept: list = []
        for c, m, name, a, b in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            i = bisect_left(kept, a, key=lambda x: x[2])
            if (i == 0 or kept[i - 1][3] <= a) and (i == len(kept) or b <= kept[i][2]):
                kept.insert(i, (name, c, a, b))
        return sorted(kept, key=lambda x: (x[2], x[3]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and licenses: (name, coverage, start, end) with spans in code points. A row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)
    kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        index = Index(sent.value, coverage)
        for part in slices(batches):
            out = []
            for t in part.column("text").to_pylist():
                found = index.scan(t)
                at = [m.span() for m in _WORD.finditer(t)] if found else []
                out.append([{"name": n, "coverage": c, "start": at[a][0], "end": at[b - 1][1]} for n, c, a, b in found])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], names=["doc_id", "licenses"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {id_kind}, licenses array<struct<name:string,coverage:double,start:int,end:int>>")

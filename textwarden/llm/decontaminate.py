"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The automaton accepts every run of words that some item holds. A document's words stream through it and the length of
the longest match that ends at each word is tracked; where it reaches a window's length, the window's words are hit.
Items are few and documents many, so the automaton is what travels: it is built on the driver from items whose words
are counted first, at most MAX_WORDS an automaton. More items make more automata, one after another, each matched in a
pass of its own over the documents whose hits are written; these are merged by row, so no bound on the benchmark is
assumed and the driver holds one automaton at a time.

Defined results: a null text has no words (0, 0, 0, sha256 of '', false); items without words have no windows; rows of
`benchmark` that share an item_id count as one item; an item whose id is null marks words but is not counted; repeated
documents are judged one by one; with an empty benchmark nothing is hit; an empty table gives no rows; very long texts are
matched whole; windows that overlap or touch are one span. Other columns are not looked at, and come back as they were but
for those named as the ones added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import fresh, mapped, slices, words, written

WINDOW = 10
#: Words that one automaton holds at most, unless a single item has more: some 100 MB of memory.
MAX_WORDS = 200_000
_FILTER_BITS = 24
_CHARS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        ids = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for k, ws in items if ws]
        self.size = max(1, len(self.vocabulary))
        self.edge: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        self._out: list[list[int]] = [[]]
        for _, ws in ids:
            last = 0
            for c in ws:
                last = self._add(last, c)
        self.shortest = min([window, *(len(ws) for _, ws in ids)])
        full: dict[int, set] = {}
        short: dict[int, list] = {}
        for k, ws in ids:
            v = 0
            for i, c in enumerate(ws):
                v = self.edge[v * self.size + c]
                if i + 1 >= window:
                    full.setdefault(self._at(v, window), set()).add(k)
            if len(ws) < window:
                short.setdefault(self._at(v, len(ws)), []).append((len(ws), k))
        self.full = {v: sorted(x, key=str) for v, x in full.items()}
        # of each state: the state of its suffix of a window's length, and the whole short items that end there
        self.tail, self.ends = [-1] * len(self.link), [()] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            p = self.link[v]
            if self.length[v] >= window:
                self.tail[v] = self.tail[p] if self.length[p] >= window else v
            self.ends[v] = self.ends[p] + tuple(short.get(v, ()))
        # pairs of neighbouring words that occur in items, hashed: no longer match can hold any other pair
        self.pairs = np.zeros(1 << _FILTER_BITS, dtype=bool)
        for _, ws in ids:
            a = np.array(ws, dtype=np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True
        del self._out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77) & ((1 << _FILTER_BITS) - 1)

    def _at(self, v: int, n: int) -> int:
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def _state(self, length: int, link: int, out: list[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append(out)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for its suffixes that end where p's do, extended by c."""
        n, edge = self.size, self.edge
        clone = self._state(self.length[p] + 1, self.link[q], list(self._out[q]))
        for d in self._out[clone]:
            edge[clone * n + d] = edge[q * n + d]
        while p >= 0 and edge.get(p * n + c) == q:
            edge[p * n + c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _add(self, last: int, c: int) -> int:
        n, edge = self.size, self.edge
        q = edge.get(last * n + c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, []), last
        while p >= 0 and p * n + c not in edge:
            edge[p * n + c] = new
            self._out[p].append(c)
            p = self.link[p]
        if p >= 0:
            q = edge[p * n + c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged intervals of hit words, and the ids of the items whose windows occur."""
        if len(ws) < self.shortest:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
        known = ids >= 0
        if self.shortest > 1:
            joined = known[:-1] & known[1:] & self.pairs[self._pair(ids[:-1], ids[1:])]
            flags, least = joined, self.shortest - 1
        else:
            flags, least = known, 1
        edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
        out: list[tuple[int, int]] = []
        items: set = set()
        for a, b in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= least] if len(edges) else ():
            self._walk(ids[a : b + 1 if self.shortest > 1 else b].tolist(), int(a), out, items)
        return out, items

    def _walk(self, ids: list[int], offset: int, out: list, items: set) -> None:
        edge, size, link, length, window = self.edge, self.size, self.link, self.length, self.window
        v = n = 0
        for i, c in enumerate(ids):
            u = edge.get(v * size + c)
            while u is None and v:
                v = link[v]
                n = length[v]
                u = edge.get(v * size + c)
            if u is None:
                continue
            v, n = u, n + 1
            reach = 0
            if n >= window:
                reach = window
                items.update(self.full.get(self.tail[v], ()))
            for m, k in self.ends[v]:
                if m <= n:
                    reach = max(reach, m)
                    items.add(k)
            if reach:
                start, end = offset + i + 1 - reach, offset + i + 1
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, end))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _groups(benchmark: DataFrame, max_words: int) -> tuple[DataFrame, int]:
    """Distinct items, and how many automata they need."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    # a word takes at least two characters, its separator included, so characters bound the words
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return items, int(chars // (max_words * 2)) + 1


def _automaton(items: DataFrame, group: int, groups: int, window: int) -> Automaton:
    part = items if groups == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group)
    return Automaton(sorted(((r["item_id"], words(r["text"])) for r in part.toLocalIterator()), key=lambda r: (str(r[0]), r[1])), window)


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, then: Callable | None = None) -> DataFrame:
    """Each row of docs with n_words, hits (array of word intervals, end exclusive) and items (sorted ids) added.

    The columns of docs stay, except for any of these three names. then: what is made of each record batch before it is given
    out, with the same columns.
    """
    spark = docs.sparkSession
    mine = ("n_words", "hits", "items")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in mine])
    items, groups = _groups(benchmark, max_words)
    added = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"
    schema = pa.schema([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def one(df: DataFrame, group: int, keep: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(_automaton(items, group, groups, window))

        def run(batches):
            found = sent.value
            for part in slices(batches):
                counts, spans, items = [], [], []
                for t in part.column("text").to_pylist():
                    ws = words(t)
                    s, k = found.hits(ws)
                    counts.append(len(ws))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    items.append(sorted(x for x in k if x is not None))
                new = [pa.array(v, type=f.type) for v, f in zip((counts, spans, items), schema, strict=True)]
                old = [part.column(i) for i in range(part.num_columns) if keep or part.schema.names[i] != "text"]
                names = [n for n in part.schema.names if keep or n != "text"]
                out = pa.RecordBatch.from_arrays([*old, *new], names=[*names, *schema.names])
                yield then(out) if then and keep else out

        base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if keep or f.name != "text")
        out = mapped(df, run, f"{base}, {added}")
        if keep:
            return out
        out = written(out)
        sent.destroy()
        return out

    if groups == 1:
        return one(docs, 0, True)
    # several automata: rows are numbered once, each automaton has a pass, and what the passes hit is merged by number
    row = fresh([*docs.columns, *mine], "_row")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    union = None
    for g in range(groups):
        one_pass = one(keyed.select(F.col(row).alias("_row"), "text"), g, False)
        union = one_pass if union is None else union.unionByName(one_pass)
    both = union.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    start = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    merged = F.aggregate(
        "hits", F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.coalesce(F.try_element_at(acc, F.lit(-1)), start)["end"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    rows = keyed.join(both.withColumn("hits", merged).withColumnRenamed("_row", row), row).drop(row)
    return mapped(rows, lambda batches: map(then, slices(batches)), rows.schema) if then else rows


def _n_hit():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of docs."""
    n_hit = _n_hit()
    return match(docs.select("doc_id", "text"), benchmark, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _cut(part: pa.RecordBatch, max_coverage: float) -> pa.RecordBatch:
    """The rows whose hit words are no more than a share of all, their texts without these."""
    found, words_ = part.column("hits").to_pylist(), part.column("n_words").to_pylist()
    keep = [sum(h["end"] - h["start"] for h in hits) <= max_coverage * max(n, 1) for hits, n in zip(found, words_, strict=True)]
    texts = part.column("text").to_pylist()
    for i, hits in enumerate(found):
        if hits and keep[i]:
            at = [m.span() for m in _CHARS.finditer(texts[i])]
            out, done = [], 0
            for h in hits:
                out.append(texts[i][done : at[h["start"]][0]])
                done = at[h["end"] - 1][1]
            texts[i] = "".join([*out, texts[i][done:]])
    cols = [pa.array(texts, type=pa.string()) if n == "text" else part.column(n) for n in part.schema.names]
    return pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(pa.array(keep, pa.bool_()))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without the hit spans: each is cut from its first word's start to its last word's end.

    A document with more than max_coverage of its words hit goes as a whole. n_chars, where docs have it, follows the new
    text. Clean documents come back as they are, and so do all columns but these two.
    """
    names = docs.columns
    own = {c: fresh([*names, "n_words", "hits", "items"], f"_in_{c}") for c in names if c.lower() in ("n_words", "hits", "items")}
    kept = match(docs.withColumnsRenamed(own), benchmark, window, max_words, partial(_cut, max_coverage=max_coverage))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(F.size("hits") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in names])


def brute_force(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """The definition, word by word, for tests: id -> (n_words, n_hit, sorted item ids)."""
    out = {}
    for d, t in texts.items():
        ws = words(t)
        hit, found = set(), set()
        for k, item in items.items():
            iw = words(item)
            n = min(window, len(iw))
            for j in range(len(iw) - n + 1 if n else 0):
                for i in range(len(ws) - n + 1):
                    if ws[i : i + n] == iw[j : j + n]:
                        hit.update(range(i, i + n))
                        found.add(str(k))
        out[d] = (len(ws), len(hit), sorted(found))
    return out


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

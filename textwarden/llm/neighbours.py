"""Nearest neighbours by collision counting over single projections.

Vectors are scaled to length 1 and projected on M random lines; each line keeps its projections as a sorted array. A
query looks at the window centred on its own projection on each line and counts on how many lines a vector collides
with it. Virtual rehashing widens all windows until they are SPAN times as wide as the K-th best distance known; vectors
that collide on THRESHOLD of the lines are verified by exact cosine in double precision on the original vectors. By the
normal distribution of the projections, a vector at that distance then has collided often enough with a probability of
about 0.93, a nearer one with more. If fewer than K are found, windows grow until they hold everything, so small sets are
searched whole. No bucket, window or candidate list is capped.

The K-th best distance starts from a bound: the K-th best among SAMPLE vectors, taken by hash, which only tells where
windows may end. Vectors are dealt once into shards of SHARD_ROWS by hash, each of which a task indexes and searches; while
shards are fewer than tasks can run, each goes to several tasks that share the queries. Queries travel by broadcast, in
passes of PASS_BYTES each. Equal vectors of a shard are one entry with its K + 1 smallest ids, which is all a search for
K can return of them, so large groups of copies cost one verification. The shards' best K are merged by query.

Defined results: vectors that are null, of length zero, or hold null or non-finite components take no part, nor do those
of another dimension than the most common one (the smaller of equals); ties go to the smaller vec_id; rows that share id
and vector count once; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import written

K = 5
#: Lines, the share of them that must collide, and how wide windows are for the distance they have to cover: a vector at
#: that distance collides on a line with probability 0.668, which is 1.5 deviations above the share.
M, THRESHOLD, SPAN = 120, 0.6, 0.971
#: The first window's half width where no distance is known, its share of the last one's where one is, and the factor by
#: which windows grow.
WIDTH, FIRST, GROWTH = 0.5, 0.78, 1.3
SHARD_ROWS, SAMPLE, PASS_BYTES = 65536, 8192, 32 << 20
SEED = 20240601


class Shard:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int = K, m: int = M, seed: int = SEED):
        rows = np.ascontiguousarray(vectors).view([("", vectors.dtype)] * vectors.shape[1]).ravel()
        _, first, entry = np.unique(rows, return_index=True, return_inverse=True)
        self.vectors, self.k = vectors[first], k
        pairs = np.unique(np.column_stack([entry.ravel(), ids]), axis=0)
        at = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.ids = [pairs[a : min(b, a + k + 1), 1].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        lone = pairs[at[:-1][np.diff(at) == 1]]
        self.alone = dict(zip(lone[:, 1].tolist(), lone[:, 0].tolist(), strict=True))
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], m))
        p = (self.vectors / self.norm[:, None]) @ self.lines
        order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, axis=0).T)
        # where each vector stands on each line: windows are ranges of places
        self.place = np.empty((m, len(first)), dtype=np.uint16 if len(first) <= 1 << 16 else np.uint32)
        for j in range(m):
            self.place[j, order[:, j]] = np.arange(len(first))
        self.m, self.verified = m, 0

    def collisions(self, at: np.ndarray, width: float) -> tuple[np.ndarray, bool]:
        """On how many lines each vector stands in the window; and whether all windows hold everything."""
        n = len(self.vectors)
        hits, whole = np.zeros(n, dtype=np.uint16 if self.m > 255 else np.uint8), True
        off, inside = np.empty_like(self.place[0]), np.empty(n, dtype=bool)
        for j in range(self.m):
            a, b = np.searchsorted(self.sorted[j], (at[j] - width, at[j] + width))
            if b - a == n:
                hits += 1
                continue
            whole = False
            # places before the window wrap around to large numbers
            np.subtract(self.place[j], self.place.dtype.type(min(a, n - 1)), out=off)
            np.less(off, self.place.dtype.type(b - a), out=inside)
            np.add(hits, inside.view(np.uint8), out=hits)
        return hits, whole

    def search(self, query: int, q: np.ndarray, bound: float = -1.0) -> list[tuple[float, int]]:
        """The k best (cosine, id), ties by id, besides the query's own id. bound: a cosine that the k-th best of all reaches."""
        n, k, length = len(self.vectors), self.k, np.sqrt((q * q).sum())
        at = (q / length) @ self.lines
        need, score, own = int(np.ceil(THRESHOLD * self.m)), np.full(n, -np.inf), self.alone.get(query, -1)
        # the widest that the K-th best distance asks for; without K found, all there is
        reach = lambda kth: SPAN * np.sqrt(max(0.0, 2 - 2 * kth)) if kth > -1 else np.inf
        kth, last = bound, reach(bound)
        width = min(FIRST * last, last) if last < np.inf else WIDTH
        while True:
            hits, whole = self.collisions(at, width)
            enough = hits >= need
            if own >= 0:
                enough[own] = False
            fresh = np.flatnonzero(enough & np.isneginf(score))
            if len(fresh):
                score[fresh] = (self.vectors[fresh] @ q) / (self.norm[fresh] * length)
                self.verified += len(fresh)
            if n > k:
                kth = max(kth, np.partition(score, -k)[-k])
            last = reach(kth)
            if width >= last or whole:
                break
            width = min(width * GROWTH, last)
        rows = np.flatnonzero(np.isfinite(score))
        if len(rows) > k:
            rows = rows[score[rows] >= np.partition(score[rows], -k)[-k]]
        return [(-s, v) for s, v in sorted((-float(score[r]), v) for r in rows.tolist() for v in self.ids[r] if v != query)[:k]]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(fine)
    top = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("embedding") == (top["d"] if top else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 1))


def bounds(queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Of each query, the k-th best cosine among a sample's other vectors; -1 where there are fewer."""
    out = np.full(len(queries), -1.0)
    if len(sample) <= k:
        return out
    unit = sample / np.sqrt((sample * sample).sum(axis=1))[:, None]
    for i in range(0, len(queries), 256):
        some = queries[i : i + 256]
        cosine = (some / np.sqrt((some * some).sum(axis=1))[:, None]) @ unit.T
        cosine[ids[i : i + 256, None] == own[None, :]] = -1.0
        # a little below, for the rounding of the verified cosines
        out[i : i + 256] = np.maximum(-1.0, np.partition(cosine, -k, axis=1)[:, -k] - 1e-9)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, pass_bytes: int = PASS_BYTES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest other vectors. Both tables: vec_id, embedding."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    asked = written(usable(queries).distinct())
    n = asked.count()
    out_schema = "query_id long, vec_id long, score double"
    if not total or not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = -(-total // shard_rows)
    # spare tasks share a shard's queries among them: no more copies of vectors than tasks run at once
    share = max(1, min(n, spark.sparkContext.defaultParallelism // shards))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
    few = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(total)) < sample).toArrow()
    some, own = _matrix(few.column("embedding")), few.column("vec_id").to_numpy()
    dimension = len(asked.first()["embedding"])
    passes = -(-n * dimension * 8 // pass_bytes)
    if some.shape[1] != dimension:
        some, own = np.empty((0, dimension)), own[:0]

    def one(i: int) -> DataFrame:
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toArrow()
        q, ids = _matrix(got.column("embedding")), got.column("vec_id").to_numpy()
        sent = spark.sparkContext.broadcast((q, ids, bounds(q, ids, some, own, k) if len(q) else np.empty(0)))

        def run(key: tuple, part: pa.Table) -> pa.Table:
            qs, names, known = sent.value
            shard = Shard(_matrix(part.column("embedding")), part.column("vec_id").to_numpy(), k)
            mine = range(key[1].as_py(), len(names), share) if qs.shape[1] == shard.vectors.shape[1] else ()
            found = [(int(names[j]), v, s) for j in mine for s, v in shard.search(int(names[j]), qs[j], known[j])]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

        return dealt.groupBy("shard", "part").applyInArrow(run, out_schema)

    near = one(0)
    if passes > 1:
        near = written(near)
        for i in range(1, passes):
            near = near.unionByName(written(one(i)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

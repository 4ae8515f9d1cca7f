"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning takes at most PER_CLASS labelled documents of each label (those with the smallest id hashes). Their words are
counted in Spark, and a word's weight is (1 + log tf) * idf * r, where r = max(0, 1 - CHI2 / x) shrinks it by how surely
the word tells the labels apart (x is chi-squared of its document frequencies). CHI2 is the same for every sample; a word
that says nothing passes it with a chance of 1 in 9,000, and then with a weight near 0. Words whose r is 0 add nothing to
any product or length, so the index holds the others (at most MAX_TERMS, the bound of the model's size), and the cosine
under these weights is exact. Without r, a text's ordinary words outweigh the few that matter, and toxic texts are missed
(see the README).

Examples stand in blocks of BLOCK; for each term and block the index keeps the largest weight, so that the sum over a
document's terms bounds any score in the block. Blocks are opened in the order of their bounds until no unopened block
can reach the K-th best score. Documents with different counts are searched BATCH at a time: frequent terms as a matrix,
rare ones by list.

The K nearest vote with their cosine squared as weight, each label's votes scaled back to its share of the labels; without
a neighbour the vote is that share. A logistic curve, fitted on all examples with each one's own row left out, turns the
vote into a probability. Its ridge keeps it finite where the words part the labels wholly.

The model is a few MB at most, whatever the corpus, and is broadcast; documents are read in one pass without a shuffle.

Defined results: a null or empty text has no terms; without usable labels every score is 0.5, with labels of one kind
only the smoothed share of label 1; repeated rows are scored one by one; ties between neighbours go to the smaller
doc_id; an empty table gives no rows; columns named score or evidence are replaced, all others stay; very long texts are
counted whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import fit_logistic, labelled_sample, logistic, mapped, slices, words, written

PER_CLASS = 3000
MAX_TERMS = 16384
CHI2 = 15.0
BLOCK = 64
BATCH = 256
#: Terms that one example of so many holds, or more, are columns of a matrix; the rest stay lists.
DENSE = 32
#: Documents' counts whose results a task remembers, half a kB each.
MEMORY = 20_000
K = 15


class BlockMaxIndex:
    """Examples' unit vectors by term and block, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, terms: int, block: int = BLOCK):
        # likeness within blocks tightens the bounds: order by the heaviest term, then id
        heaviest = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in vectors], dtype=np.int64)
        self.order = np.lexsort((ids, heaviest))
        self.ids, self.block = ids[self.order], block
        self.blocks = max(1, -(-len(ids) // block))
        at = [np.full(len(vectors[j][0]), i) for i, j in enumerate(self.order)]
        row = np.concatenate([*at, np.empty(0)]).astype(np.int32)
        term = np.concatenate([*(vectors[j][0] for j in self.order), np.empty(0)]).astype(np.int64)
        weight = np.concatenate([*(vectors[j][1] for j in self.order), np.empty(0)])
        cell = term * self.blocks + row // block
        by = np.lexsort((row, cell))
        self.row, self.weight = row[by], weight[by]
        self.start = np.searchsorted(cell[by], np.arange(terms * self.blocks + 1))
        self.most = np.zeros(terms * self.blocks)
        np.maximum.at(self.most, cell, weight)
        self.most = self.most.reshape(terms, self.blocks)
        self._columns = None

    def __getstate__(self):
        return self.__dict__ | {"_columns": None}

    def _matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """The frequent terms, and the examples' weights of these by block, row and term."""
        if self._columns is None:
            n = np.diff(self.start).reshape(-1, self.blocks).sum(axis=1)
            frequent = np.flatnonzero(n * DENSE >= max(1, len(self.ids)))
            dense = np.zeros((self.blocks * self.block, len(frequent)))
            for i, t in enumerate(frequent):
                at = slice(self.start[t * self.blocks], self.start[(t + 1) * self.blocks])
                dense[self.row[at], i] = self.weight[at]
            self._columns = frequent, dense.reshape(self.blocks, self.block, len(frequent))
        return self._columns

    def _scores(self, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray, out: np.ndarray) -> None:
        cells = (terms[:, None] * self.blocks + blocks[None, :]).ravel()
        begin, n = self.start[cells], self.start[cells + 1] - self.start[cells]
        total = int(n.sum())
        if not total:
            return
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        w = np.repeat(np.repeat(q, len(blocks)), n)
        out += np.bincount(self.row[at], weights=w * self.weight[at], minlength=len(out))

    def search(self, terms: np.ndarray, q: np.ndarray, k: int = K, without: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and cosines of the k nearest with a cosine above 0, best first; and how many blocks were opened."""
        bound = q @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        score = np.zeros(len(self.ids))
        opened, step = 0, 4
        while opened < len(order) and bound[order[opened]] > 0:
            self._scores(terms, q, order[opened : opened + step], score)
            opened += step
            if without is not None:
                score[without] = 0
            if len(score) > k and opened < len(order):
                kth = np.partition(score, -k)[-k]
                # a bound that equals the k-th score may hold a tie; rounding is given a margin
                if kth > 0 and bound[order[opened]] < kth - 1e-9:
                    break
            step *= 2
        some = np.flatnonzero(score > 0)
        # scores equal up to rounding are ties, and go to the smaller id
        best = some[np.lexsort((self.ids[some], -np.round(score[some], 9)))][:k]
        return best, score[best], min(opened, len(order))

    def search_many(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and cosines as search() gives them, for each of the vectors; without: a row to leave out for each."""
        frequent, dense = self._matrix()
        n, m = len(self.ids), len(vectors)
        q = np.zeros((m, len(self.most)))
        for i, (t, w) in enumerate(vectors):
            q[i, t] = w
        bound, own = q @ self.most, q[:, frequent]
        q[:, frequent] = 0
        doc, term = np.nonzero(q)
        begin, size = self.start[term * self.blocks], self.start[(term + 1) * self.blocks] - self.start[term * self.blocks]
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(doc) else np.empty(0, dtype=np.int64)
        width = self.blocks * self.block
        score = np.bincount(np.repeat(doc * width, size) + self.row[at], weights=np.repeat(q[doc, term], size) * self.weight[at], minlength=m * width).astype(np.float64, copy=False).reshape(m, width)
        # a block not opened for a document leaves its rare terms' sums there: below the bound, so never among the best
        order = np.argsort(-bound.sum(axis=0), kind="stable")
        kth, opened, step = np.zeros(m), 0, max(4, self.blocks // 8)
        while opened < self.blocks:
            group = order[opened : opened + step]
            highest = bound[:, group].max(axis=1)
            need = np.flatnonzero((highest > 0) & (highest >= kth - 1e-9))
            if len(need):
                part = own[need] @ dense[group].reshape(len(group) * self.block, len(frequent)).T
                score.reshape(m, self.blocks, self.block)[need[:, None], group[None, :]] += part.reshape(len(need), len(group), self.block)
            opened += step
            if without is not None:
                score[np.arange(m), without] = 0
            if n > k and len(need) and opened < self.blocks:
                kth[need] = np.partition(score[need, :n], -k, axis=1)[:, -k]
        out = []
        least = np.partition(score[:, :n], -k, axis=1)[:, -k] if n > k else np.zeros(m)
        for i in range(m):
            some = np.flatnonzero((score[i, :n] > 0) & (score[i, :n] >= least[i] - 1e-8))
            best = some[np.lexsort((self.ids[some], -np.round(score[i, some], 9)))][:k]
            out.append((best, score[i, best]))
        return out


class Model:
    """A fitted classifier: vocabulary, index, labels and the calibration."""

    def __init__(self, rows: list[tuple[int, int, dict[bytes, int]]], factors: dict[bytes, float], sizes: dict[int, int], k: int = K, block: int = BLOCK):
        vocabulary = sorted(factors)
        self.vocabulary = {t: i for i, t in enumerate(vocabulary)}
        self.k = k
        n = len(rows)
        self.empty = 0.5
        self.curve = None
        if not n:
            return
        df = np.zeros(max(1, len(vocabulary)))
        for _, _, counts in rows:
            for t in counts:
                df[self.vocabulary[t]] += 1
        self.idf = (np.log((1 + n) / (1 + df)) + 1) * np.array([factors[t] for t in vocabulary] or [1.0])
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        y = np.array([r[1] for r in rows])
        vectors = [self.vector(counts) for _, _, counts in rows]
        share = {c: sizes.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
        self.index = BlockMaxIndex(vectors, ids, max(1, len(vocabulary)), block)
        self.label = y[self.index.order]
        self.weight = np.array([share[int(c)] for c in self.label])
        w = self.weight
        self.prior = self.empty = float(((w * self.label).sum() + 0.5) / (w.sum() + 1))
        if 0 < y.sum() < n:
            x = np.full(n, self.prior)
            own = [j for j in range(n) if len(vectors[self.index.order[j]][0])]
            for i in range(0, len(own), BATCH):
                some = own[i : i + BATCH]
                found = self.index.search_many([vectors[self.index.order[j]] for j in some], self.k, np.array(some))
                x[some] = [self.vote(*f) for f in found]
            self.curve = fit_logistic(self.feature(x), self.label, w / w.mean())
            self.empty = float(logistic(self.feature(np.array([self.prior])), self.curve)[0])

    def vector(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter((self.vocabulary[t] for t in counts), dtype=np.int64, count=len(counts))
        order = np.argsort(terms)
        tf = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))[order]
        terms = terms[order]
        w = (1 + np.log(tf)) * self.idf[terms] if len(terms) else tf
        return terms, w / np.sqrt((w * w).sum()) if len(terms) else w

    def feature(self, share: np.ndarray) -> np.ndarray:
        p = np.clip(share, 1e-3, 1 - 1e-3)
        return np.log(p / (1 - p))[:, None]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        weight = cosines**2 * self.weight[rows]
        # half a vote of the prior: few or far neighbours say little
        a, b = (weight * self.label[rows]).sum(), weight.sum()
        unit = 0.05 * self.weight.mean()
        return float((a + unit * self.prior) / (b + unit))

    def score(self, counts: dict[bytes, int]) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability of label 1, and as evidence the three nearest examples: (doc_id, label, cosine)."""
        return self.score_many([counts])[0]

    def score_many(self, counts: list[dict[bytes, int]]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """As score(), for each of the counts."""
        out = [(self.empty, [])] * len(counts)
        if self.curve is None:
            return out
        some = [i for i, c in enumerate(counts) if c]
        for at in range(0, len(some), BATCH):
            part = some[at : at + BATCH]
            found = self.index.search_many([self.vector(counts[i]) for i in part], self.k)
            p = logistic(self.feature(np.array([self.vote(*f) for f in found])), self.curve)
            for i, x, (rows, cosines) in zip(part, p, found, strict=True):
                out[i] = float(x), [(int(self.index.ids[r]), int(self.label[r]), float(c)) for r, c in zip(rows[:3], cosines[:3], strict=True)]
        return out

    def counts(self, text: str | None) -> dict[bytes, int]:
        known = self.vocabulary
        return Counter([w for w in words(text) if w in known])


def chi_squared(a, b, n1: int, n0: int):
    """Of the fourfold table of a (of n1) and b (of n0), as a Spark column."""
    a, b = a.cast("double"), b.cast("double")
    c, d = F.lit(float(n1)) - a, F.lit(float(n0)) - b
    return F.coalesce(F.try_divide((a * d - b * c) ** 2 * (n1 + n0), (a + b) * (c + d) * n1 * n0), F.lit(0.0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, remainder: int = 1, per_class: int = PER_CLASS, max_terms: int = MAX_TERMS, chi2: float = CHI2, k: int = K) -> Model:
    sample, sizes = labelled_sample(docs, labels, label, modulus, remainder, per_class)

    def count(batches):
        for part in slices(batches, chars=500_000):
            at, ys = part.column("doc_id").to_pylist(), part.column("y").to_pylist()
            found = [Counter(words(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(ys, pa.int32()), pa.array([list(c.items()) for c in found], pa.map_(pa.binary(), pa.int32()))], names=["doc_id", "y", "counts"]
            )

    counted = written(mapped(sample, count, "doc_id long, y int, counts map<binary,int>"))
    n = {int(r["y"]): int(r["n"]) for r in counted.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    # at most max_terms words come to the driver, and then the examples' counts of these words only
    found = (
        counted.select("y", F.explode(F.map_keys("counts")).alias("term")).groupBy("term")
        .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a + b >= 3")
        .withColumn("x", chi_squared(F.col("a"), F.col("b"), n1, n0)).where(F.col("x") > chi2)
        .orderBy(F.desc("x"), "term").limit(max_terms)
    )
    factors = {bytes(r["term"]): 1 - chi2 / r["x"] for r in found.select("term", "x").collect()}
    known = F.broadcast(docs.sparkSession.createDataFrame([(bytearray(t),) for t in factors], "term binary"))
    rows = (
        counted.select("doc_id", "y", F.explode_outer("counts").alias("term", "n")).join(known.withColumn("ours", F.lit(True)), "term", "left")
        .groupBy("doc_id", "y").agg(F.map_from_entries(F.collect_list(F.when(F.col("ours"), F.struct("term", "n")))).alias("counts"))
    )
    got = sorted((int(r["doc_id"]), int(r["y"]), {bytes(t): c for t, c in r["counts"].items()}) for r in rows.collect())
    return Model(got, factors, sizes, k)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (double) and evidence (array of neighbours) added; the other columns stay."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "evidence")])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        m, memo = sent.value, {}
        for part in slices(batches, chars=500_000):
            counts = [m.counts(t) for t in part.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(b"".join(b"%b %d " % x for x in sorted(c.items()))) for c in counts]
            if len(memo) > MEMORY:
                memo.clear()
            new = {key: c for key, c in zip(keys, counts, strict=True) if key not in memo}
            memo |= zip(new, m.score_many(list(new.values())), strict=True)
            scores = [memo[key][0] for key in keys]
            found = [[{"doc_id": d, "label": y, "cosine": s} for d, y, s in memo[key][1]] for key in keys]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(found, evidence)], names=[*part.schema.names, "score", "evidence"])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return mapped(docs, run, f"{base}, score double, evidence array<struct<doc_id:long,label:int,cosine:double>>")

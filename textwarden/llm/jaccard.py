"""N-gram Jaccard join by parity sketches: XOR-hashed shingles, a pigeonhole join per size band, exact verification.

A document's set is its distinct 5-word shingles. The sketch of a set has one bit for each shingle hash it may hold, and
every shingle flips its bit; the Hamming distance of two sketches never exceeds the symmetric difference of the sets.
A Jaccard similarity of at least t bounds that difference by d = (1-t)/(1+t) * (a + b). Sizes fall into bands; in a
band a sketch is cut into d + 1 + d/5 parts, of which at least 1 + d/5 must then be equal. The sketch is
far wider than the set is large, so it is held sparsely: a part is known by the XOR of the hashes of its set bits. Empty
parts say nothing and make no key; a set with so many empty parts that no other need be equal also gets the hashes of
its prefix (the 20 % that come first) as keys, so no link is lost. Each set joins in its own band and, as the smaller one, in those that larger partners may have.

Sets that are equal are one node from the start, so exact copies never meet in a join. Of two sets that link, so many
parts are equal that each must share a certain number of keys of the band with the other (NEED: the equal parts less the
set's own empty ones); nodes that share fewer keys with anyone drop out before any sketch is read.

Keys of two or more nodes give edges from the key's least node to each other (never all pairs); those that sizes and
sketches (folded to about four bits a shingle) do not rule out are verified on the whole sets and contracted to
components. Where a key's nodes still lie in different components, each meets the nearest sketch across, which contracts
most of what links; only then are all pairs across the components left compared, as arrays of sketches. So a large group
of copies costs its size, and no link between different texts is lost.

A key that still holds more than HOT nodes of different components (pages of one template, say) is not compared. Its
nodes meet again by shingles: in any order of shingles, two sets that link share one of the 20 % (and one) of either that
come first, and the order puts first what is rare, by counts in a table of BUCKETS. Tokens of more than HOT nodes that are
left even then are dealt in cells of two blocks of nodes each.

Defined results: a null text or one without words has an empty set and is linked with nothing; repeated rows are equal
sets; rows that share a doc_id but not a text are judged by their texts; null ids take part, and a component of null ids
only has a null component_id; an empty table gives no rows; of equal rows the one that comes first in the files stays as
representative; other columns are not looked at and come back from representatives() as they were. Hashes have 64 bits
(two sets in 10^9 collide with probability 0.03).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import ROW, forget, fresh, mapped, numbered, slices, written

WORDS = 5
PERCENT = 80
#: Bands' upper sizes grow by this factor.
RATIO = 1.4
#: Rounds in which nodes meet only the nearest across components, before all pairs across what is left.
NEAREST_ROUNDS = 1
#: Rows whose texts are looked up go to every executor up to this count (about 50 MB there); beyond it texts are shuffled.
SENT_ROWS = 1 << 20
#: Nodes of a key that are compared within one task; counts by which shingles are put in order.
HOT, BUCKETS = 2048, 1 << 18
#: Sets that a task remembers, so that their copies give no keys again.
SEEN = 200_000
#: Into how many parts a key is dealt that many rows may share.
SALT = 16
_M = np.uint64(0x9E3779B97F4A7C15)
_EVEN = np.uint64((1 << 64) - 2)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


#: Each byte's part in the hash of a word: A-Z count as a-z, and the bytes that part words as nothing.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _M)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BYTE[_SPACE] = 0
#: Bytes hashed at once.
BLOCK = 1 << 19


class Shingler:
    """Sets of shingle hashes. Words are hashed block by block: a word is the sum of its bytes' values times powers of _M."""

    def __init__(self, n: int = WORDS):
        self.n = n
        self._grow(BLOCK)

    def _grow(self, size: int) -> None:
        """Powers of _M and of its inverse modulo 2^64."""
        self.power, self.inverse = np.full(size, _M), np.full(size, np.uint64(pow(int(_M), -1, 1 << 64)))
        for x in (self.power, self.inverse):
            x[0] = 1
            np.multiply.accumulate(x, out=x)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words [^\\x20\\x09-\\x0D]+ of bytes, A-Z lower-cased."""
        at, starts, hashes = 0, [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
        while at < len(raw):
            size = BLOCK
            while True:
                a = np.frombuffer(raw, dtype=np.uint8, count=min(size, len(raw) - at), offset=at)
                space = _SPACE[a]
                if at + len(a) == len(raw):
                    break
                # a block ends with its last space; one that holds none grows to the end of its word
                if last := len(a) - int(space[::-1].argmax()) if space.any() else 0:
                    a, space = a[:last], space[:last]
                    break
                size *= 2
            if len(a) > len(self.power):
                self._grow(len(a))
            edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
            start, end = edge[::2], edge[1::2]
            upto = np.zeros(len(a) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[a] * self.power[: len(a)], out=upto[1:])
            starts.append(start + at)
            hashes.append((upto[end] - upto[start]) * self.inverse[start])
            at += len(a)
        return np.concatenate(starts), mixed(np.concatenate(hashes))

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of the shingles of each text."""
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        starts, h = self.words(b" ".join(raw))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
        # all texts' words in one array; shingles that would cross texts are passed over below
        full = np.full(max(0, len(h) - self.n + 1), self.n, dtype=np.uint64)
        for i in range(self.n):
            full = full * _M + h[i : len(h) - self.n + 1 + i] if len(full) else full
        full = mixed(full)
        out = []
        for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = end - at
            if n >= self.n:
                x = np.sort(full[at : end - self.n + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            elif n:
                one = np.full(1, n, dtype=np.uint64)
                for x in h[at:end]:
                    one = one * _M + x
                out.append(mixed(one))
            else:
                out.append(np.empty(0, dtype=np.uint64))
        return out


def sketch(s: np.ndarray) -> bytes:
    """Parity sketch: each hash flips one of four times as many bits as the next power of two of the set's size, 64 at least."""
    bits = max(64, 4 << int(len(s) - 1).bit_length()) if len(s) else 64
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded by XOR onto the shorter: no more than the sets differ by."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def bands(percent: int = PERCENT, largest: int = 1 << 40) -> list[int]:
    """Upper sizes of the bands, exclusive."""
    out, at = [], 4
    while at <= largest:
        out.append(at)
        at = max(at + 1, int(at * RATIO))
    return out


class Sketcher:
    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.tops = np.array(bands(percent), dtype=np.int64)

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of a band's sketches, and how many of these must be equal at least."""
        most = int(self.tops[band]) - 1
        d = (100 - self.percent) * 2 * most // (100 + self.percent)
        slack = d // 5
        return d + 1 + slack, 1 + slack

    def span(self, n: int) -> range:
        """The bands that sets of n join in: their own and, as the smaller ones, those of larger partners."""
        return range(int(np.searchsorted(self.tops, n, side="right")), int(np.searchsorted(self.tops, n * 100 // self.percent, side="right")) + 1)

    def need(self, s: np.ndarray) -> list[int]:
        """Of keys with an even and of keys with an odd last bit: how many two sets that link share at least, 1 or more."""
        out = [1, 1]
        for band in self.span(len(s)):
            p, equal = self.parts(band)
            held = np.zeros(p, dtype=bool)
            held[((s >> np.uint64(32)) % np.uint64(p)).astype(np.int64)] = True
            out[band & 1] = max(1, equal - p + int(held.sum()))
        return out

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Join keys of a set: at least one is shared by any two sets that link. The last bit is the band's."""
        n = len(s)
        out = []
        for band in self.span(n):
            p, equal = self.parts(band)
            seed = np.uint64((band + 1) * int(_M) & (1 << 64) - 1)
            if p == 1:
                # only equal sets link here, and these are one node already
                continue
            part = ((s >> np.uint64(32)) % np.uint64(p)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = part[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            xor = np.bitwise_xor.reduceat(mixed(s[order] + seed), first)
            bit = np.uint64(band & 1)
            out.append(mixed((xor ^ seed) + at[first].astype(np.uint64) * _A) & _EVEN | bit)
            if p - len(first) >= equal:
                # so many empty parts that the equal ones may all be empty in both sets: such sets meet by the
                # hashes that come first, of which any two that link share one
                out.append(mixed(s[: n - -(-n * self.percent // 100) + 1] + (seed ^ _B)) & _EVEN | bit)
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def nodes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """_row, doc_id, n_shingles, node (the hash of the set, null where it is empty), its sketch and needs, of each row."""

    def run(batches):
        shingle, sketcher = Shingler(n), Sketcher(percent)
        for part in slices(batches):
            sets = shingle.many(part.column("text").to_pylist())
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
            needs = np.array([sketcher.need(s) for s in sets], dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("doc_id"), *cols, pa.array(needs[:, 0]), pa.array(needs[:, 1])], names=["_row", "doc_id", "n_shingles", "node", "sketch", "even", "odd"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("_row", "doc_id", "text"), run, f"_row {ROW}, doc_id {kind}, n_shingles long, node long, sketch binary, even int, odd int")


def keyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, node) of each set. Sets that a task repeats are left out there (of the last SEEN); others fall together by node."""

    def run(batches):
        shingle, sketch = Shingler(n), Sketcher(percent)
        seen: set[int] = set()
        for part in slices(batches):
            keys, ids = [], []
            if len(seen) > SEEN:
                seen.clear()
            for s in shingle.many(part.column("text").to_pylist()):
                if len(s) and (k := _node(s)) not in seen:
                    seen.add(k)
                    keys.append(x := sketch.keys(s))
                    ids.append(np.full(len(x), k, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(ids))], names=["key", "node"])

    return mapped(docs.select("text"), run, "key long, node long")


def _shared(df: DataFrame) -> DataFrame:
    """(key, node, least, many) of the keys that two or more nodes share. Needs each partition sorted by key and node.

    A row for each node but the key's least; keys of more than two nodes are many, and have a row for the least as well.
    """

    def run(batches):
        held = None  # the last key, its least node, its last node, how many nodes it has
        waiting = None  # its second node's row, until a third is seen or the key ends
        for b in batches:
            key, node = b.column("key").to_numpy(), b.column("node").to_numpy()
            if not len(key):
                continue
            new = np.concatenate(([held is None or key[0] != held[0]], key[1:] != key[:-1]))
            fresh = np.concatenate(([bool(new[0]) or node[0] != held[2]], new[1:] | (node[1:] != node[:-1])))
            # groups of a key; the first is the one that the last batch ended with
            starts, group = np.flatnonzero(new), np.cumsum(new)
            carried = held or (0, 0, 0, 0)
            keys, least = np.concatenate(([carried[0]], key[starts])), np.concatenate(([carried[1]], node[starts]))
            before = np.zeros(len(keys), dtype=np.int64)
            before[0] = carried[3]
            size = before + np.bincount(group[fresh], minlength=len(keys))
            many = size > 2
            x, g = node[fresh], group[fresh]
            other = x != least[g]
            hold = other & (g == len(keys) - 1) & ~many[g]
            give, grown = other & ~hold, np.flatnonzero(many & (before <= 2))
            g, x = np.concatenate((g[give], grown)), np.concatenate((x[give], least[grown]))
            if waiting is not None and (many[0] or len(starts)):
                g, x, waiting = np.append(g, 0), np.append(x, waiting), None
            if hold.any():
                waiting = node[fresh][hold][0]
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(keys[g]), pa.array(x), pa.array(least[g]), pa.array(many[g])], names=["key", "node", "least", "many"])
            held = (keys[-1], least[-1], node[-1], int(size[-1]))
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (held[0], waiting, held[1], False)], names=["key", "node", "least", "many"])

    return df.mapInArrow(run, "key long, node long, least long, many boolean")


def _across(df: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """The pairs (a, b) of a key's nodes in different components that sizes and sketches do not rule out.

    With nearest, only the pair of each node and the one of these whose sketch is nearest: no more pairs than rows.
    df: key, node, comp, size, sketch, block, each partition sorted by key; nodes of one block are not compared, but where
    all are of block -1. A key's rows are compared as arrays, row against rows, so memory is one key's sketches (HOT nodes,
    or a cell of two blocks) and only what passes is given out.
    """

    def compared(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, comp, size, block = (rows.column(c).to_numpy() for c in ("node", "comp", "size", "block"))
        order = np.argsort(node, kind="stable")
        node, comp, size, block = node[order], comp[order], size[order], block[order]
        sketches = rows.column("sketch").to_pylist()
        least = min(map(len, sketches))
        bits = np.empty((len(node), least // 8), dtype=np.uint64)
        for at, i in enumerate(order.tolist()):
            x = np.frombuffer(sketches[i], dtype=np.uint64)
            # folded by XOR down to the shortest
            bits[at] = np.bitwise_xor.reduce(x.reshape(-1, least // 8), axis=0)
        left, right = [], []
        best, to = np.full(len(node), np.iinfo(np.int64).max), np.full(len(node), -1)
        for i in range(len(node) - 1):
            rest = slice(i + 1, None)
            fits = (comp[rest] != comp[i]) & (size[rest] * 100 >= size[i] * percent) & (size[i] * 100 >= size[rest] * percent)
            if block[i] >= 0:
                fits &= block[rest] != block[i]
            j = np.flatnonzero(fits) + i + 1
            if len(j):
                far = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                fits = far <= (100 - percent) * (size[j] + size[i]) // (100 + percent)
                j, far = j[fits], far[fits]
                if not nearest:
                    left.append(np.full(len(j), node[i])), right.append(node[j])
                elif len(j):
                    closer = far < best[j]
                    best[j[closer]], to[j[closer]] = far[closer], i
                    if far.min() < best[i]:
                        best[i], to[i] = far.min(), j[far.argmin()]
        if nearest:
            met = np.flatnonzero(to >= 0)
            left, right = [node[met]], [node[to[met]]]
        none = np.empty(0, dtype=np.int64)
        a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            a, b = compared(pa.Table.from_batches(held).combine_chunks())
            held.clear()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        last = None
        for batch in batches:
            key = batch.column("key").to_numpy()
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                if held and key[a] != last:
                    yield from done()
                last = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return mapped(df.select("key", "node", "comp", "size", "sketch", "block"), run, "a long, b long")


def _few(rows: DataFrame) -> DataFrame:
    """The rows, of a written table of some numbers each, marked to be sent to every executor if their count is small."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def _sets(docs: DataFrame, wanted: DataFrame, located: DataFrame, n: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, from the texts of one row each."""
    rows = written(located.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("_row").alias("_row")))
    texts = docs.join(_few(rows), "_row").select("node", "text")

    def run(batches):
        shingle = Shingler(n)
        for part in slices(batches):
            sets = [_signed(s).tolist() for s in shingle.many(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return mapped(texts, run, "node long, hashes array<long>")


def near(pairs: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches do not rule the similarity out. known: node, size, sketch."""
    x, y = (known.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    both = pairs.join(x, "a").where(F.col("size_a") > 0).join(y, "b").where(f"size_a * 100 >= size_b * {percent} and size_b * 100 >= size_a * {percent}")

    def run(batches):
        for b in batches:
            sizes = b.column("size_a").to_numpy() + b.column("size_b").to_numpy()
            limit = (100 - percent) * sizes // (100 + percent)
            far = [distance(p, q) for p, q in zip(b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist(), strict=True)]
            keep = np.array(far, dtype=np.int64) <= limit
            yield pa.RecordBatch.from_arrays([pa.array(b.column(k).to_numpy()[keep]) for k in "ab"], names=["a", "b"])

    return mapped(both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b"), run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, compared whole."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    fits = (F.size("x") * 100 >= F.size("y") * percent) & (F.size("y") * 100 >= F.size("x") * percent)
    return both.where(fits & (common * 100 >= union * percent)).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): the least node of each node's component. Alternating large and small stars until nothing changes."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    for i in range(rounds + 1):
        if i == rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        step = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = step.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        settled = now == e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        forget(step if settled else e)
        if settled:
            break
        e = step
    top = e.select(F.col("v").alias("node")).distinct()
    out = written(e.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node").unionByName(top.join(e.select(F.col("u").alias("node")), "node", "left_anti").withColumn("comp", F.col("node"))))
    forget(e)
    return out


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def _thinned(members: DataFrame, known: DataFrame) -> DataFrame:
    """The rows that comparing needs. members: key, node, n (nodes of the key), times (for how many keys a row stands); all
    rows of the mixed keys, as rows thinned before do not hold the numbers that are needed any more.

    Two nodes that link share some number of keys of a band at least (even, odd), so nodes that share fewer with anyone drop
    out; and where each leaves out one key less than that number, the largest ones in one order for all, one is still shared.
    """
    odd = F.col("key").bitwiseAND(F.lit(1)).cast("int")
    w = Window.partitionBy("node", "odd")
    ranked = members.withColumn("odd", odd).withColumn("all", F.sum("times").over(w)).withColumn("before", F.coalesce(F.sum("times").over(w.orderBy("n", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    needs = known.select("node", "even", F.col("odd").alias("uneven"))
    need = F.when(F.col("odd") == 1, F.col("uneven")).otherwise(F.col("even"))
    return ranked.join(needs, "node").where((F.col("all") >= need) & (F.col("before") <= F.col("all") - need)).select(*members.columns)


def _starred(members: DataFrame) -> DataFrame:
    least = members.groupBy("key").agg(F.min("node").alias("a"))
    return members.join(least, "key").where("a != node").select("a", F.col("node").alias("b")).distinct()


class _Links:
    """What is known so far: the pairs verified, the pairs looked at, and the components."""

    def __init__(self, source: DataFrame, located: DataFrame, known: DataFrame, n: int, percent: int):
        self.source, self.located, self.known, self.n, self.percent = source, located, known, n, percent
        self.spark = source.sparkSession
        self.width = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.links = self.seen = None
        self.comp = self.spark.createDataFrame([], "node long, comp long")

    def dealt(self, keys: DataFrame) -> DataFrame:
        return keys.repartition(self.width, "key").sortWithinPartitions("key", "node")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        return _sets(self.source, wanted, self.located, self.n)

    def verify(self, pairs: DataFrame, sets: DataFrame | None) -> None:
        """Looks at pairs (a, b) not seen before, and contracts those that link."""
        pairs = written(pairs if self.seen is None else pairs.join(self.seen, ["a", "b"], "left_anti"))
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        if _empty(pairs):
            return
        if sets is None:
            sets = self.lookup(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        new = written(verified(pairs, sets, self.percent))
        if not _empty(new):
            self.links = new if self.links is None else self.links.unionByName(new)
            old, self.comp = self.comp, components(self.links)
            forget(old)

    def mixed(self, members: DataFrame) -> DataFrame:
        """key, node, comp, times and n (how many nodes the key holds) of the keys whose nodes lie in different components."""
        at = members.select("key", "node", "times").join(self.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mark = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in (0, 1)]
        keys = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.max("times").alias("times"), *mark).where("lo != hi")
        # keys that hold the same nodes would be compared alike: one of them is enough, and stands for the others
        keys = keys.groupBy(F.col("key").bitwiseAND(F.lit(1)), "n", "mark0", "mark1").agg(F.min("key").alias("key"), F.sum("times").alias("times")).select("key", "times", "n")
        return at.drop("times").join(keys, "key")

    def thinned(self, at: DataFrame) -> DataFrame:
        """The rows of mixed() that comparing needs, of the keys that are still mixed by these."""
        left = _thinned(at, self.known).drop("n")
        keys = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("key", "n")
        return left.join(keys, "key")

    def contract(self, members: DataFrame, sets: DataFrame | None, cells: bool) -> DataFrame | None:
        """Stars, then the nearest across components, then all pairs across what is left. Keys of more than HOT nodes that
        are still mixed are compared in cells, or else left alone and their nodes returned."""
        self.verify(near(_few(written(_starred(members))), self.known, self.percent), sets)
        sketches = self.known.select("node", "size", "sketch")
        for nearest in [True] * NEAREST_ROUNDS + [False]:
            # each round thins anew, from all rows
            old, members = members, written(self.mixed(members))
            forget(old)
            rest = members if cells else written(self.thinned(members))
            groups = rest.where(F.col("n") <= HOT).withColumn("block", F.lit(-1))
            if cells:
                groups = groups.unionByName(_cells(rest.where(F.col("n") > HOT)))
            if not _empty(groups):
                self.verify(_across(self.dealt(groups.join(sketches, "node")), self.percent, nearest).distinct(), sets)
        hot = rest.where(F.col("n") > HOT)
        left = None if cells or _empty(hot) else written(hot.select("node").distinct())
        forget(members)
        return left


def _cells(hot: DataFrame) -> DataFrame:
    """Nodes of large keys in cells of two blocks: a row for each cell that a node's block is in. In a cell of a block with
    itself, all pairs are compared; in the others those across."""
    blocks = F.ceil(F.col("n") / (HOT // 2)).cast("int")
    mine = hot.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.withColumn("key", key).withColumn("block", F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block"))).drop("other")


def _order(sets: DataFrame) -> np.ndarray:
    """How often hashes of each bucket occur: a table of bounded size, by which shingles are put in order."""
    bucket = F.col("hash").bitwiseAND(F.lit(BUCKETS - 1))
    rows = sets.select(F.explode("hashes").alias("hash")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node): of each set the hashes that come first by count, so many that any two sets that link share one."""
    sent = sets.sparkSession.sparkContext.broadcast(_order(sets))

    def run(batches):
        for b in batches:
            lists, node = b.column("hashes"), b.column("node").to_numpy()
            flat, at = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            keys, ids = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for i, x in enumerate(node.tolist()):
                s = flat[at[i] : at[i + 1]]
                first = len(s) - -(-len(s) * percent // 100) + 1
                keys.append(s[np.lexsort((s, sent.value[s & (BUCKETS - 1)]))][:first])
                ids.append(np.full(len(keys[-1]), x))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["key", "node"])

    return mapped(sets.select("node", "hashes"), run, "key long, node long")


def _members(shared: DataFrame) -> DataFrame:
    """(key, node, times) of all nodes of the keys that _shared() gives."""
    return shared.select("key", "node").unionByName(shared.where("not many").select("key", F.col("least").alias("node"))).withColumn("times", F.lit(1).cast("long"))


def _joined(source: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id and _row. source: _row, doc_id, text."""
    located = written(nodes(source, n, percent))
    known = located.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("size"), F.max("sketch").alias("sketch"), F.max("even").alias("even"), F.max("odd").alias("odd"))
    state = _Links(source, located, known, n, percent)
    shared = written(_shared(state.dealt(keyed(source, n, percent))))
    if not _empty(shared):
        members = _members(shared)
        hot = state.contract(members, None, False)
        if hot is not None:
            sets = written(state.lookup(hot))
            state.contract(_members(written(_shared(state.dealt(_rarest(sets, percent))))), sets, True)
    # each node's least id, then each component's, then back by node: tables of unique nodes, but many of either may share a key
    named = written(located.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("d")).join(state.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    least = written(named.groupBy("comp").agg(F.min("d").alias("component_id")))
    named = written(_unskewed(named.select("node", "comp"), least, "comp", "node").select("node", "component_id"))
    forget(least)
    rows = _unskewed(located.select("_row", "doc_id", "n_shingles", "node"), named, "node", "_row")
    return rows.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "_row")


def _unskewed(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """left joined with a written table whose keys are unique, where one key may stand in a large part of left's rows: by
    sending the table up to SENT_ROWS rows, and beyond that with SALT copies of it, dealt by another column of left."""
    if right.count() <= SENT_ROWS:
        return left.join(F.broadcast(right), key, "left")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)))
    return salted.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), [key, "_salt"], "left").drop("_salt")


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs."""
    return _joined(numbered(docs.select("doc_id", "text")), n, percent).drop("_row")


def representatives(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, and of rows that share it the first read."""
    name = fresh(docs.columns, "_row")
    source = numbered(docs, name)
    rows = _joined(source.select(F.col(name).alias("_row"), "doc_id", "text"), n, percent).where(F.col("n_shingles") > 0)
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("_row"))
    gone = rows.join(first, "_row", "left_anti").select(F.col("_row").alias(name))
    return source.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_force(texts: dict, n: int = WORDS, percent: int = PERCENT) -> dict:
    """The definition for tests: id -> (size, least id of its component)."""
    sets = {}
    for d, t in texts.items():
        ws = (t or "").encode().lower().split()
        m = min(n, len(ws))
        sets[d] = {tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)} if ws else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}

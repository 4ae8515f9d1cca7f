"""SentencePiece encoding and decoding: batched numpy Viterbi over a piece vocabulary.

A text becomes the pieces whose scores sum highest; the model's file gives pieces and scores. A character that no piece
holds costs the least score less 10 and is spelled in byte pieces, so decoding returns every text exactly. Equal sums
go to the longer last piece. That is the unigram rule. A model trained by merging pairs encodes by merge order in its
own library, and the ids can differ from these; decoded texts cannot.

Blanks become U+2581 and one is put in front. No piece has U+2581 after another character, and none holds a newline
(both are checked), so no piece crosses a run of U+2581 or a newline, and a text's best segmentation is that of its
units joined. A task remembers the units it has encoded, their ids packed, up to MEMORY bytes. Units of one length
advance together: at each end position, the hashes of the substrings that end there (from prefix hashes) probe the
sorted hashes of the pieces, the best sum is the vectorised maximum, and its length is the backpointer. The ids given
out are decoded, by a gather of the pieces' bytes for many texts at once, and compared with the texts; a text that
differs (a hash collision) is encoded from the piece strings instead, and decoded and compared again.

Memory: texts are worked on in slices of CHARS characters, a longer text STEP units at a time.

Defined results: a null or empty text has no ids and decodes to ''; repeated rows are encoded one by one; equal sums go
to the longer last piece; an empty table gives no rows; columns named ids or round_trip are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from textwarden.llm.common import mapped, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
PENALTY = 10
#: Bytes of units and their ids that a task remembers; characters of a slice; units of a long text that are encoded at once.
MEMORY, CHARS, STEP = 32 << 20, 500_000, 50_000
#: About what a remembered unit takes besides its characters and ids.
_ENTRY = 190
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITS = 20
_ID = np.dtype("<i4")


class Vocabulary:
    def __init__(self, model: bytes):
        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = np.full(256, -1, dtype=np.int32)
        self.byte_of = {}
        normal = []
        for i, t in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
                self.byte_of[i] = int(t[3:5], 16)
            elif not special[i]:
                normal.append(i)
        if (self.byte < 0).any():
            raise ValueError("the model must have a piece for each byte")
        if any(BLANK in self.text[i].lstrip(BLANK) or "\n" in self.text[i] for i in normal):
            raise ValueError("a piece crosses a blank or a newline")
        self.spell = pa.array([bytes((self.byte_of[i],)) if i in self.byte_of else t.encode() for i, t in enumerate(self.text)], pa.large_binary())
        self.longest = max(len(self.text[i]) for i in normal)
        scores = np.array([sp.get_score(i) for i in normal])
        self.unknown = float(scores.min()) - PENALTY
        powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                powers.append(powers[-1] * _BASE)
            self.powers = np.array(powers, dtype=np.uint64)
            hashes = np.array([self._hash(self.text[i]) for i in normal], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.scores = hashes[order], np.array(normal, dtype=np.int32)[order], scores[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        # of each value of the first bits: whether a key has it, and where such keys begin among the sorted ones
        bits = (self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        size = np.bincount(bits, minlength=1 << _BITS)
        self.maybe, self.first, self.deepest = size > 0, np.cumsum(size) - size, int(size.max())
        self.exact = {self.text[i]: (i, s) for i, s in zip(self.ids.tolist(), self.scores.tolist(), strict=True)}

    def _hash(self, s: str) -> np.uint64:
        h = np.uint64(0)
        for c in s:
            h = h * _BASE + np.uint64(ord(c) + 1) * _SPREAD
        return h

    def viterbi(self, units: list[str]) -> list[bytes]:
        """Ids, as 32-bit words, of units of one length, which advance together."""
        n, size = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).T.astype(np.uint64)
        prefix = np.zeros((size + 1, n), dtype=np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * _BASE + (codes[j] + np.uint64(1)) * _SPREAD
        best = np.zeros((size + 1, n))
        back = np.zeros((size + 1, n), dtype=np.int32)
        piece = np.full((size + 1, n), -1, dtype=np.int32)
        for j in range(1, size + 1):
            most = min(self.longest, j)
            lengths = np.arange(most, 0, -1)  # the longest first: maxima keep the first of equal sums
            h = prefix[j] - prefix[j - lengths] * self.powers[lengths][:, None]
            total = np.full(h.shape, -np.inf)
            which = np.full(h.shape, -1, dtype=np.int32)
            at = np.nonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            value = h[at]
            k = self.first[(value >> np.uint64(64 - _BITS)).astype(np.int64)]
            hit = self.hashes[k] == value
            for _ in range(self.deepest - 1):
                miss = np.flatnonzero(~hit)
                k[miss] = np.minimum(k[miss] + 1, len(self.hashes) - 1)
                hit[miss] = self.hashes[k[miss]] == value[miss]
            at, k = (at[0][hit], at[1][hit]), k[hit]
            total[at] = best[j - lengths[at[0]], at[1]] + self.scores[k]
            which[at] = self.ids[k]
            alone = which[-1] < 0
            total[-1, alone] = best[j - 1, alone] + self.unknown
            choice = total.argmax(axis=0)
            column = np.arange(n)
            best[j], back[j], piece[j] = total[choice, column], lengths[choice], which[choice, column]
        # all units walk back together; a character without a piece leaves -1 - code point
        at, column, walked = np.full(n, size), np.arange(n), []
        while at.any():
            taken = np.where(at > 0, piece[at, column], -2)
            bare = (taken == -1) & (at > 0)
            walked.append(np.where(bare, -3 - codes[at - 1, column].astype(np.int64), taken))
            at = at - np.where(at > 0, back[at, column], 0)
        rows = np.array(walked[::-1]).T
        if (rows < -2).any():
            return [np.array(self._filled(r), dtype=_ID).tobytes() for r in rows.tolist()]
        held = rows >= 0
        flat, ends = rows[held].astype(_ID).tobytes(), (4 * np.cumsum(held.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _filled(self, row: list[int]) -> list[int]:
        """A unit's ids, with bare characters as their bytes."""
        ids = []
        for x in row:
            if x >= 0:
                ids.append(x)
            elif x < -2:
                ids += [int(self.byte[b]) for b in chr(-3 - x).encode("utf-8", "surrogatepass")]
        return ids

    def spelled(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The pieces' bytes joined, and where each piece starts (and the end)."""
        got = self.spell.take(pa.array(ids))
        at = np.frombuffer(got.buffers()[1], dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
        return (got.buffers()[2].to_pybytes()[: at[-1]] if len(ids) else b""), at

    def scalar(self, unit: str) -> list[int]:
        """The same rule, one unit at a time, from the pieces' strings."""
        best, back = [0.0] + [-np.inf] * len(unit), [(0, -1)] * (len(unit) + 1)
        for j in range(1, len(unit) + 1):
            for i in range(max(0, j - self.longest), j):
                k, s = self.exact.get(unit[i:j], (-1, self.unknown if j - i == 1 else -np.inf))
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        ids, j = [], len(unit)
        while j:
            i, k = back[j]
            ids += [k] if k >= 0 else [int(self.byte[b]) for b in reversed(unit[i:j].encode("utf-8", "surrogatepass"))]
            j = i
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        return self.spelled(np.array(ids, dtype=_ID))[0].decode("utf-8", "replace").replace(BLANK, " ")[1:]


def marked(text: str | None) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


class Encoder:
    """Encodes texts, remembering units."""

    #: Units longer than this are advanced alone or nearly so: they are cut no further, memory stays in proportion.
    unit = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY):
        self.v, self.memory, self.memo, self.held = vocabulary, memory, {}, 0

    def _learn(self, units: set[str]) -> None:
        if self.held > self.memory:
            self.memo, self.held = {}, 0
        new = units - self.memo.keys()
        if "\n" in new:
            # alone, so that its byte piece does not slow the others down
            new.remove("\n")
            self._keep(["\n"])
        for size, group in groupby(sorted(new, key=len), len):
            some, step = list(group), max(1, 400_000 // (size * min(size, self.v.longest) + 1))
            for i in range(0, len(some), step):
                self._keep(some[i : i + step])

    def _keep(self, units: list[str]) -> None:
        ids = self.v.viterbi(units)
        self.memo.update(zip(units, ids, strict=True))
        self.held += sum(map(len, ids)) + len(units) * (_ENTRY + 2 * len(units[0]))

    def _packed(self, texts: list[str]) -> list[bytes]:
        """Ids of marked texts."""
        if sum(map(len, texts)) <= 2 * CHARS:
            split = [self.unit.findall(t) for t in texts]
            self._learn(set().union(*split))
            return [b"".join(map(self.memo.__getitem__, us)) for us in split]
        out = []
        for t in texts:
            parts, units = [], (m.group() for m in self.unit.finditer(t))
            while step := list(islice(units, STEP)):
                self._learn(set(step))
                parts.append(b"".join(map(self.memo.__getitem__, step)))
            out.append(b"".join(parts))
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """All texts' ids, where each text's begin (and the end), and whether they decode to the text."""
        given = [marked(t) for t in texts]
        packed = self._packed(given)
        want = [t.encode("utf-8", "surrogatepass") for t in given]
        ids, at = self._joined(packed)
        got, starts = self.v.spelled(ids)
        if got != b"".join(want) or (starts[at] != np.cumsum([0, *map(len, want)])).any():
            for i, t in enumerate(given):
                if got[starts[at[i]] : starts[at[i + 1]]] != want[i]:
                    packed[i] = np.array(self.exact(t), dtype=_ID).tobytes()
            ids, at = self._joined(packed)
            got, starts = self.v.spelled(ids)
        # a blank is what U+2581 decodes to, so a text that holds one itself comes back changed
        plain = [got[starts[a] : starts[b]] == w for a, b, w in zip(at[:-1], at[1:], want, strict=True)]
        return ids, at, [ok and BLANK not in (t or "") for ok, t in zip(plain, texts, strict=True)]

    @staticmethod
    def _joined(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(packed), dtype=_ID), np.cumsum([0, *(len(p) // 4 for p in packed)])

    def exact(self, text: str) -> list[int]:
        """Ids of a marked text without hashes."""
        return [x for u in self.unit.findall(text) for x in self.v.scalar(u)]


def _encoded(docs: DataFrame, model: str | bytes, schema: str, give: Callable) -> DataFrame:
    """give(part, ids, starts, same): the record batch for a slice of rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, bytes) else Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(sent.value))
        for part in slices(batches, chars=CHARS):
            yield give(part, *encoder(part.column("text").to_pylist()))

    return mapped(docs, run, schema)


def encode(docs: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """docs with ids (array of ints) and round_trip (whether they decode to the text) added; other columns stay.

    model: the model file's path on the driver, or its bytes; half a MB, which is broadcast. A text that holds U+2581
    itself decodes with a blank in its place, and round_trip says so.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "round_trip")])

    def give(part, ids, starts, same):
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(same, pa.bool_())], names=[*part.schema.names, "ids", "round_trip"])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _encoded(docs, model, f"{base}, ids array<int>, round_trip boolean", give)


def digest(docs: DataFrame, model: str | bytes = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit words) and round_trip."""

    def give(part, ids, starts, same):
        hashes = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        cols = [part.column("doc_id"), pa.array(np.diff(starts), pa.int64()), pa.array(hashes, pa.string()), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _encoded(docs.select("doc_id", "text"), model, f"doc_id {kind}, n_tokens long, ids_sha256 string, round_trip boolean", give)

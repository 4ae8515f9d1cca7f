"""Quality by compression: a zstandard dictionary of good text and one of bad text, and which makes a document smaller.

Learning takes at most PER_CLASS labelled documents of each label (those with the smallest id hashes), and all of them
take part. Where a label's are larger than SAMPLE_BYTES together, those longer than the length at which they fit give
blocks of so many bytes in all, from anywhere in the text by hash; the others stay whole. Half of the documents, by id
hash, train the two dictionaries, the other half calibrate.
A text is cut into blocks of BLOCK bytes, each compressed alone with either dictionary, so that likeness to the
dictionaries counts and not how a text repeats itself. The feature is the normalised difference of sizes,
(bad - good) / (bad + good), over the whole text; a logistic curve turns it into a probability.

The model is two dictionaries of DICTIONARY bytes; documents are read in one pass without a shuffle.

Defined results: a null or empty text gets the share of label 1; without labels of both kinds every score is the share
of label 1, or 0.5 without any; repeated rows are scored one by one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import fit_logistic, labelled_sample, logistic, mapped, slices, written

PER_CLASS = 1500
SAMPLE_BYTES = 6_000_000
DICTIONARY = 64 * 1024
BLOCK = 1024
LEVEL = 3


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """Trained from the samples; where they are too few to train from, the samples themselves."""
    blocks = [s[i : i + BLOCK] for s in samples for i in range(0, len(s), BLOCK)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, blocks)) // 4)), blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:] or b"\n"


def longest(lengths: list[int], total: int) -> int:
    """The length at which texts have to be cut so that they are no larger than total together."""
    left = total
    for i, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - i) > left:
            return left // (len(lengths) - i)
        left -= n
    return max(lengths, default=0)


def excerpt(raw: bytes, size: int, seed: int) -> bytes:
    """Blocks of about size bytes in all, by hash, in order of place; a text that is no longer comes whole."""
    if len(raw) <= size:
        return raw
    order = sorted(range(-(-len(raw) // BLOCK)), key=lambda i: (zlib.crc32(b"%d:%d" % (seed, i)), i))
    return b"".join(raw[i * BLOCK : (i + 1) * BLOCK] for i in sorted(order[: max(1, size // BLOCK)]))


class Model:
    def __init__(self, good: bytes, bad: bytes, share: float):
        self.good, self.bad, self.share, self.curve = good, bad, share, None
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            made = []
            for d in (self.good, self.bad):
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
            self._ready = made
        return self._ready

    def feature(self, text: str | bytes | None) -> float | None:
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return None
        good, bad = self._compressors()
        g = b = 0
        for i in range(0, len(raw), BLOCK):
            block = raw[i : i + BLOCK]
            g += len(good(block))
            b += len(bad(block))
        return (b - g) / (b + g)

    def calibrate(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> None:
        x = [self.feature(t) for t in texts]
        ok = np.array([v is not None for v in x], dtype=bool)
        if 0 < y[ok].sum() < ok.sum():
            a = np.array([v for v in x if v is not None])[:, None] * 10
            self.curve = fit_logistic(a, y[ok], weight[ok] / weight[ok].mean())

    def score(self, text: str | None) -> float:
        x = self.feature(text) if self.curve is not None else None
        return self.share if x is None else float(logistic(np.array([[x * 10]]), self.curve)[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    sample, sizes = labelled_sample(docs, labels, label, modulus, remainder, per_class)
    kept = written(sample.select("doc_id", "y", "text", F.xxhash64(F.col("doc_id"), F.lit(29)).alias("h")))
    lengths = kept.select("y", F.octet_length("text").alias("n")).collect()
    most = {c: longest([r["n"] for r in lengths if r["y"] == c], sample_bytes) for c in (0, 1)}

    def cut(batches):
        for part in slices(batches):
            cols = [part.column(c).to_pylist() for c in ("h", "y", "doc_id", "text")]
            raw = [excerpt(t.encode("utf-8", "surrogatepass"), most[y], h) for h, y, _, t in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("h", "y", "doc_id")), pa.array(raw, pa.binary())], names=["h", "y", "doc_id", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    sent = mapped(kept, cut, f"h long, y {kinds['y']}, doc_id {kinds['doc_id']}, text binary")
    rows = sorted((r["h"], r["y"], r["doc_id"], bytes(r["text"])) for r in sent.collect())
    total = sizes[0] + sizes[1]
    share = sizes[1] / total if total else 0.5
    teach = [r for i, r in enumerate(rows) if r[0] % 2 == 0]
    check = [r for i, r in enumerate(rows) if r[0] % 2]
    by = {c: [r[3] for r in teach if r[1] == c] for c in (0, 1)}
    model = Model(dictionary(by[1]), dictionary(by[0]), share)
    if by[0] and by[1] and check:
        y = np.array([r[1] for r in check])
        weight = np.array([sizes[int(c)] / max(1, int((y == c).sum())) for c in y])
        model.calibrate([r[3] for r in check], y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (double) added; the other columns stay."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "score"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for part in slices(batches):
            scores = [m.score(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "score"])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return mapped(docs, run, f"{base}, score double")

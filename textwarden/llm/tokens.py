"""Token counts by offset-mapped attribution.

A whole document is encoded once. Token ids give byte lengths, these give each token's span, and the spans are joined
to the sections' by binary search of their bounds: sections are a text's lines (each with its newline) or the fields
that a row's columns make when joined. A token that crosses a boundary goes by an explicit rule: 'start' to the section
of its first byte, 'largest' to the one that holds most of its bytes (the earlier of equals), 'shared' to each in
proportion. The sections' counts of a document therefore sum to its number of tokens under every rule.

Documents are read in one pass without a shuffle; the vocabulary (under a MB) is broadcast. Defined results: a null or
empty text is one section without tokens; repeated rows are counted one by one; null fields are empty sections.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import mapped, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "largest", "shared")


class Counter:
    def __init__(self, file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """End of each token, in bytes."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), dtype=np.int64)])

    def sections(self, text: str, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each section, and how many of them cross into or out of it. bounds: byte offsets from 0 to the end."""
        n = len(bounds) - 1
        if not text:
            return np.zeros(n), np.zeros(n, dtype=np.int64)
        end = self.ends(text)
        start = np.concatenate(([0], end[:-1]))
        first = np.searchsorted(bounds, start, side="right") - 1
        last = np.searchsorted(bounds, end, side="left") - 1
        crossing = np.flatnonzero(first != last)
        crossed = np.zeros(n, dtype=np.int64)
        count = np.bincount(first, minlength=n).astype(np.float64)
        for t in crossing:
            within = [(s, min(end[t], bounds[s + 1]) - max(start[t], bounds[s])) for s in range(first[t], last[t] + 1)]
            within = [(s, b) for s, b in within if b > 0]
            for s, _ in within:
                crossed[s] += 1
            if rule == "largest":
                count[first[t]] -= 1
                count[max(within, key=lambda x: (x[1], -x[0]))[0]] += 1
            elif rule == "shared":
                count[first[t]] -= 1
                for s, b in within:
                    count[s] += b / (end[t] - start[t])
        return count, crossed


def line_bounds(raw: bytes) -> np.ndarray:
    at = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    return np.unique(np.concatenate(([0], at, [len(raw)]))) if raw else np.array([0, 0])


def count(docs: DataFrame, fields: list[str] | None = None, rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens, n_crossing: a row for each section of each row.

    fields: columns that, joined by newlines, make the text, each a section; by default the sections are the lines of text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = fields or ["text"]
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    # text holds all fields' characters only so that batches are cut by size
    source = docs.select("doc_id", F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("parts"))
    source = source.select("doc_id", "parts", F.concat_ws("\n", "parts").alias("text"))

    def run(batches):
        counter = Counter(sent.value)
        for part in slices(batches):
            ids, section, a, b, n, crossing = [], [], [], [], [], []
            for d, text, parts in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("parts").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if fields:
                    sizes = [len(p.encode("utf-8", "surrogatepass")) + (i + 1 < len(parts)) for i, p in enumerate(parts)]
                    bounds = np.concatenate(([0], np.cumsum(sizes)))
                else:
                    bounds = line_bounds(raw)
                tokens, crossed = counter.sections(text, bounds, rule)
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))[bounds] if raw else bounds
                k = len(bounds) - 1
                ids += [d] * k
                section.append(np.arange(k)), a.append(chars[:-1]), b.append(chars[1:]), n.append(tokens), crossing.append(crossed)
            cols = [pa.array(np.concatenate(x), t) for x, t in ((section, pa.int32()), (a, pa.int64()), (b, pa.int64()), (n, pa.float64()), (crossing, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field("doc_id").type), *cols], names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(source, run, f"doc_id {kind}, section int, start_char long, end_char long, n_tokens double, n_crossing long")

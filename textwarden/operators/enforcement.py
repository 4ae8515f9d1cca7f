"""Responses: redaction, buffered verdicts, leak curves, and exact bounded-lookback enforcement."""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from textwarden.functions import detectors as D
from textwarden.functions.spans import let, replaced
from textwarden.operators.policy import DEFAULT, Policy, Rule, action_for

#: A window must show the longest least match whole.
LONGEST = 64


def redact(text: Column, found: Column) -> Column:
    """Text with each finding's span replaced by its detector; overlapping spans are spliced in from the right, one by one."""
    marker = lambda s: F.concat(F.lit("[redacted:"), s["detector"], F.lit("]"))
    order = F.array_sort(F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end_pos"].alias("end_pos"), f["detector"].alias("detector"))))

    def cut(spans):
        disjoint = F.forall(F.zip_with(spans, F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), lambda a, b: b.isNull() | (a["end_pos"] <= b["start"])), lambda ok: ok)
        spliced = F.aggregate(F.reverse(spans), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), marker(s), F.substring(t, s["end_pos"] + 1, F.length(t))))
        return F.when(disjoint, replaced(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end_pos"].alias("end_pos"), marker(s).alias("value"))))).otherwise(spliced)

    return F.when(F.size(found) > 0, let(order, cut)).otherwise(text)


def chunked(df: DataFrame, size: int = 6, text: str = "text") -> DataFrame:
    """The other columns with seq, chunk and chunk_end of fixed-size chunks; an empty text has none. The text itself goes."""
    others = [c for c in df.columns if c != text]
    parts = F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % size), F.lit(0))
    return df.select(*others, F.posexplode(parts).alias("seq", "chunk")).withColumn("chunk_end", F.col("seq") * size + F.length("chunk"))


def leak_curve(spans: DataFrame, chunks: DataFrame, lookbacks: list[int] | DataFrame, key: str) -> DataFrame:
    """leaked and first_emit for each response and lookback, in closed form: one grouping by response.

    spans: key, start, fires_at (the end of the shortest prefix in which the detector fires); chunks: key, chunk_end;
    lookbacks: some numbers, or a table of them. Holds for one blocking finding a response and no warm-up.
    """
    looks = sorted({r["lookback"] for r in lookbacks.collect()} if isinstance(lookbacks, DataFrame) else set(lookbacks))
    end, fires = F.col("chunk_end"), F.col("fires_at")
    # spans are as many as responses: broadcast, all of them would meet on the driver
    cut = chunks.select(key, "chunk_end").join(spans.select(key, "start", "fires_at").hint("merge"), key).groupBy(key, "start", "fires_at").agg(
        F.min(F.when(end >= fires, end)).alias("_cut"), F.coalesce(F.max(F.when(end < fires, end)), F.lit(0)).alias("_before"),
        F.array(*[F.struct(F.lit(x).alias("lookback"), F.min(F.when(end > x, end)).alias("first")) for x in looks]).alias("_grid"),
    ).where(F.col("_cut").isNotNull())
    grid = cut.select(key, "start", "fires_at", "_cut", "_before", F.explode("_grid").alias("g"))
    leaked = F.greatest(F.lit(0), F.least(F.col("_before") - F.col("g.lookback") - F.col("start"), F.col("fires_at") - F.col("start")))
    return grid.select(key, F.col("g.lookback").alias("lookback"), leaked.alias("leaked"), F.when(F.col("g.first") < F.col("_cut"), F.col("g.first")).alias("first_emit"))


# ---- exact replay: the same detectors in Python, as a window's findings depend on what was released before

_SHAPES = [(D.STARTS[k][0], re.compile(p)) for k, p in D.SHAPES.items()]
_RUN, _EMAIL, _CARD = re.compile(D.RUN), re.compile(D.EMAIL), re.compile(D.CARD)
_DIGITS = re.compile(r"\d(?:[ -]?\d){12,}")
_FAMILIES = {"injection_override": ([re.compile(p, re.I) for p in D.OVERRIDE], "medium"), "injection_exfiltration": ([re.compile(p, re.I) for p in D.EXFILTRATION], "high")}


def _luhn(run: str) -> bool:
    ds = [int(c) for c in run if c.isdigit()]
    return len(ds) >= 12 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(ds))) % 10 == 0


def _bits(run: str) -> float:
    return -sum(run.count(c) / len(run) * math.log2(run.count(c) / len(run)) for c in set(run))


def find(name: str, text: str, prompt: str = "") -> list[tuple[str, int, int, str]]:
    """(detector, start, end, confidence) of one detector on one text."""
    if name == "secret_pattern":
        claimed = [m.span() for starts, p in _SHAPES if any(s in text for s in starts) for m in p.finditer(text)]
        loose = [m.span() for m in _RUN.finditer(text) if not any(a <= m.start() < b for a, b in claimed) and _bits(m.group()) >= D.BITS]
        return [(name, a, b, "high") for a, b in claimed] + [(name, a, b, "low") for a, b in loose]
    if name == "pii_email":
        return [(name, *m.span(), "high") for m in _EMAIL.finditer(text)]
    if name == "pii_card":
        return [(name, *m.span(), "high") for m in _CARD.finditer(text) if _luhn(m.group())]
    if name in _FAMILIES:
        patterns, confidence = _FAMILIES[name]
        return [(name, *m.span(), confidence) for p in patterns if (m := p.search(text))]
    if name == "system_prompt_echo":
        for at in range(0, len(prompt) - D.ECHO_SPAN + 1, D.ECHO_STRIDE):
            if m := re.search(re.escape(prompt[at : at + D.ECHO_SPAN]), text, re.I):
                return [(name, *m.span(), "high")]
    return []


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


class Marks:
    """Where a text holds what each detector can't do without: in a window that holds none of it nothing is found."""

    def __init__(self, text: str, rules: list[Rule], prompt: str = ""):
        #: [detector, least, spans, the first span that counts]: a window must share so many characters with one of the spans.
        self.marks: list[list] = []
        #: Detectors that look at every window.
        self.always: set[str] = set()
        for name in {r.name for r in rules}:
            if name == "secret_pattern":
                for starts, least in D.STARTS.values():
                    for s in starts:
                        if s in text:
                            self.marks.append([name, least, [(a, a + least) for a in _places(text, s)], 0])
                self._add(name, 24, [m.span() for m in _RUN.finditer(text)])
            elif name == "pii_email":
                self._add(name, 6, [(a - 1, a + 5) for a in _places(text, "@")])
            elif name == "pii_card":
                self._add(name, 13, [m.span() for m in _DIGITS.finditer(text)])
            elif name in _FAMILIES or name == "system_prompt_echo" and len(prompt) >= D.ECHO_SPAN:
                self.always.add(name)
        self.all = self.always | {m[0] for m in self.marks}

    def _add(self, name: str, least: int, spans: list[tuple[int, int]]) -> None:
        if spans:
            self.marks.append([name, least, spans, 0])

    def again(self) -> None:
        for m in self.marks:
            m[3] = 0

    def near(self, base: int, upto: int) -> set[str]:
        """Detectors that may find something from base to upto. Of one call to the next neither falls, until again()."""
        if not self.marks:
            return self.always
        names = set(self.always)
        for m in self.marks:
            name, least, spans, i = m
            while i < len(spans) and spans[i][1] - least < base:
                i += 1
            m[3] = i
            if i < len(spans) and max(spans[i][0], base) + least <= upto:
                names.add(name)
        return names


@dataclass
class Replay:
    """State of one response as its chunks come in. Offsets count characters of the source text; of seen, n have come."""

    policy: Policy = DEFAULT
    prompt: str = ""
    seen: str = ""
    n: int = 0
    out: str = ""
    sent: int = 0
    cut: str | None = None
    leaked: int = 0
    past: int = 0
    first_emit: int | None = None
    redactions: int = 0
    missed: list = field(default_factory=list)
    settled: list = field(default_factory=list)
    chunks_in: int = 0
    chunks_out: int = 0
    detector_ms: float = 0.0
    findings: list = field(default_factory=list)

    def __post_init__(self):
        self.rules = self.policy.for_side("response")

    def _scan(self, start: int, names: set[str] | None = None) -> list:
        """What is found from start on; names: the detectors that may find something, all where that isn't known."""
        found = []
        for r in self.rules:
            if names is None or r.name in names:
                base = start if r.stream_safe else 0
                found += [(n, a + base, b + base, r.action_for(c), c) for n, a, b, c in find(r.name, self.seen[base : self.n], self.prompt)]
            # accounted, not measured
            self.detector_ms += r.budget_ms * SHARE
        return found

    def _blocked(self, found: list) -> bool:
        blocks = [f for f in found if f[3] == "block"]
        if blocks:
            name, a, b = min(blocks, key=lambda f: f[1])[:3]
            self.cut, self.past, self.findings = name, max(0, self.sent - a), found
            self.leaked = min(b - a, self.past)
            self.out += self.policy.cut_message
            self.chunks_out += 1
        return bool(blocks)

    def _release(self, upto: int, found: list, final: bool) -> None:
        wanted = [f for f in found if f[3] == "redact"]
        now = [f for f in wanted if f[1] >= self.sent and (final or f[2] <= upto)]
        for n, a, b, *_ in wanted:
            if a < self.sent and not any(n == m and a < y and x < b for m, x, y in (*self.missed, *self.settled)):
                self.missed.append((n, a, b))
                self.leaked, self.past = max(self.leaked, min(b - a, self.sent - a)), max(self.past, self.sent - a)
        text = self.seen[self.sent : upto]
        for n, a, b, *_ in sorted(now, key=lambda f: -f[1]):
            a, b = a - self.sent, b - self.sent
            if 0 <= a <= b <= len(text):
                text = f"{text[:a]}[redacted:{n}]{text[b:]}"
                self.redactions += 1
        self.settled += [f[:3] for f in now] if not final else []
        if self.first_emit is None:
            self.first_emit = self.n
        self.out += text
        self.sent = upto
        self.chunks_out += 1
        self.findings = found

    def push(self, chunk: str | None) -> None:
        """The next chunk; a null one counts as empty."""
        if self.cut is not None:
            return
        chunk = chunk or ""
        self.chunks_in += 1
        self.seen += chunk
        self.n = len(self.seen)
        self._judge(self._scan(max(0, self.n - max(2 * self.policy.lookback, LONGEST) - len(chunk))))

    def _judge(self, found: list) -> None:
        look = self.policy.lookback
        if self._blocked(found) or self.n - self.sent <= look + self.policy.warmup:
            return
        upto = self.n - look
        for _, a, b, action, _ in found:
            if action == "redact" and a >= self.sent and b > upto:
                upto = min(upto, a)
        if upto > self.sent:
            self._release(upto, found, False)

    def end(self, names: set[str] | None = None) -> None:
        if self.cut is None:
            found = self._scan(0, names)
            if not self._blocked(found):
                if self.sent < self.n:
                    self._release(self.n, found, True)
                self.findings = found

    def whole(self, text: str, ends: list[int], marks: Marks | None = None) -> Replay:
        """The same as to push the chunks that end there, one by one, and to end; windows that hold no mark aren't scanned."""
        marks = marks or Marks(text, self.rules, self.prompt)
        marks.again()
        look, span, costs = self.policy.lookback, max(2 * self.policy.lookback, LONGEST), [r.budget_ms * SHARE for r in self.rules]
        wait, near, at, sent, ms = look + self.policy.warmup, marks.near, 0, 0, 0.0
        self.seen = text
        for n in ends:
            base = at - span
            names = near(base if base > 0 else 0, n)
            at = n
            self.chunks_in += 1
            if not names:
                for c in costs:
                    ms += c
                if n - self.sent > wait:
                    if self.first_emit is None:
                        self.first_emit = n
                    self.sent = n - look
                    self.chunks_out += 1
                    self.findings = []
                continue
            # what has been sent without findings since sent
            self.out, self.n, self.detector_ms = self.out + text[sent : self.sent], n, ms
            self._judge(self._scan(base if base > 0 else 0, names))
            sent, ms = self.sent, self.detector_ms
            if self.cut is not None:
                return self
        self.out, self.n, self.detector_ms = self.out + text[sent : self.sent], len(text), ms
        self.end(marks.all)
        return self

    def row(self) -> tuple:
        late, found = self.policy.stream_unsafe("response"), [{"detector": n, "start": a, "end_pos": b, "confidence": c} for n, a, b, _, c in self.findings]
        return (self.cut is not None, self.cut, self.leaked, self.past, self.first_emit, self.redactions, len(self.missed), self.out,
                self.chunks_in, self.chunks_out, late, round(self.detector_ms, 3), found)


#: Share of a detector's budget that a scan of a window is accounted with.
SHARE = 0.25
FOUND = "array<struct<detector:string,start:int,end_pos:int,confidence:string>>"
OUTCOME = (
    "cut boolean, cut_reason string, leaked int, past int, first_emit int, redactions int, missed int, emitted string, "
    f"chunks_in int, chunks_out int, late_detectors array<string>, detector_ms double, findings {FOUND}"
)
COLUMNS = ["cut", "cut_reason", "leaked", "past", "first_emit", "redactions", "missed", "emitted", "chunks_in", "chunks_out", "late_detectors", "detector_ms", "findings"]


def frame(rows: list[tuple], *first: str) -> pd.DataFrame:
    """Rows of the first columns and a replay's, as OUTCOME has them."""
    df = pd.DataFrame(rows, columns=[*first, *COLUMNS])
    return df.astype({"first_emit": "Int32"} | {c: "int32" for c in ("leaked", "past", "redactions", "missed", "chunks_in", "chunks_out")})


def outcomes(rows: list[tuple | None], kind: pa.DataType) -> pa.Array:
    """Replays' rows as an array of structs with OUTCOME's fields. kind: outcome_type(), which only the driver can tell."""
    return pa.array([None if r is None else dict(zip(COLUMNS, r, strict=True)) for r in rows], kind)


def outcome_type() -> pa.DataType:
    return to_arrow_type(StructType.fromDDL(OUTCOME))


def gathered(chunks: DataFrame, key: str) -> DataFrame:
    """key, text and the sizes of its chunks, in order of seq: one row a response. chunks: key, seq, chunk (null: empty)."""
    one = F.struct(F.col("seq").isNull().alias("last"), F.col("seq").alias("seq"), F.coalesce("chunk", F.lit("")).alias("chunk"))
    both = let(F.array_sort("_chunks"), lambda cs: F.struct(F.array_join(F.transform(cs, lambda c: c["chunk"]), "").alias("text"), F.transform(cs, lambda c: F.length(c["chunk"])).alias("sizes")))
    return chunks.groupBy(key).agg(F.collect_list(one).alias("_chunks")).select(key, both.alias("_both")).select(key, "_both.text", "_both.sizes")


def enforce(chunks: DataFrame, key: str, policy: Policy = DEFAULT, prompt: str = "", lookbacks: tuple[int, ...] | None = None) -> DataFrame:
    """One row a response: what was sent, cut and leaked. chunks: key, seq, chunk. A response's chunks meet in one row.

    lookbacks: one row for each of these instead of the policy's, and a column for it after the key.
    """
    looks = (policy.lookback,) if lookbacks is None else tuple(lookbacks)
    policies = [replace(policy, lookback=x) for x in looks]
    rules, struct = policy.for_side("response"), outcome_type()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes_, texts = part.column("sizes"), part.column("text").to_pylist()
            bounds, flat = sizes_.offsets.to_pylist(), sizes_.values.to_numpy().tolist()
            for first in range(0, len(texts), ROWS):
                rows, of = [], []
                for i in range(first, min(len(texts), first + ROWS)):
                    ends, marks = list(accumulate(flat[bounds[i] : bounds[i + 1]])), Marks(texts[i], rules, prompt)
                    rows += [Replay(p, prompt).whole(texts[i], ends, marks).row() for p in policies]
                    of += [i] * len(policies)
                keys = part.column(key).take(pa.array(of, pa.int32()))
                look = [] if lookbacks is None else [pa.array(looks * (len(of) // len(looks)), pa.int32())]
                yield pa.RecordBatch.from_arrays([keys, *look, *outcomes(rows, struct).flatten()], names=[key, *["lookback"] * len(look), *COLUMNS])

    kind = chunks.schema[key].dataType.simpleString()
    return gathered(chunks, key).mapInArrow(run, f"`{key}` {kind}, {'' if lookbacks is None else 'lookback int, '}{OUTCOME}")


#: Responses that are replayed between two batches of rows.
ROWS = 2000


@lru_cache(maxsize=64)
def _drawn(size: int, jitter: int, seed: int, call: int) -> tuple[random.Random, list[int]]:
    """The generator of a call's chunk sizes, and the ends drawn so far."""
    return random.Random(f"{seed}:{call}"), [0]


def chunk_ends(n: int, size: int = 6, jitter: int = 3, seed: int = 20260818, call: int = 1) -> list[int]:
    """Where the chunks of n characters end, the same for the same seed and call."""
    if n <= 0:
        return []
    rng, ends = _drawn(size, jitter, seed, call)
    while ends[-1] < n:
        ends.append(ends[-1] + max(1, size + (rng.randint(-jitter, jitter) if jitter else 0)))
    return [*ends[1 : bisect_left(ends, n)], n]


def sizes(n: int, size: int = 6, jitter: int = 3, seed: int = 20260818, call: int = 1) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of n characters, the same for the same seed and call."""
    ends = chunk_ends(n, size, jitter, seed, call)
    return zip([0, *ends], ends, strict=False)


def replayed(text: str | None, policy: Policy = DEFAULT, prompt: str = "", **chunks) -> Replay:
    """A whole response, cut into chunks as sizes() has them."""
    text = text or ""
    return Replay(policy, prompt).whole(text, chunk_ends(len(text), **chunks))


def buffered(text: Column, policy: Policy = DEFAULT, system_prompt: str = "") -> Column:
    """What a client gets if the whole response is scanned first, as a struct of OUTCOME's fields. Nothing leaks."""
    rules = policy.for_side("response")

    def judged(rule: Rule) -> Column:
        return F.transform(D.detect(rule.name, text, system_prompt=system_prompt), lambda f: F.struct(f.alias("f"), action_for(rule, f["confidence"]).alias("action")))

    found = F.flatten(F.array(*map(judged, rules)))

    def outcome(all_: Column) -> Column:
        blocks = F.filter(all_, lambda x: x["action"] == "block")
        wanted = F.transform(F.filter(all_, lambda x: x["action"] == "redact"), lambda x: x["f"])
        # the first in place, and of these the first in the rules' order
        reason = F.element_at(F.array_sort(F.transform(blocks, lambda x, i: F.struct(x["f"]["start"].alias("start"), i.alias("i"), x["f"]["detector"].alias("detector")))), 1)["detector"]
        cut = F.size(blocks) > 0
        return F.struct(
            cut.alias("cut"), F.when(cut, reason).alias("cut_reason"), F.lit(0).alias("leaked"), F.lit(0).alias("past"), F.length(text).alias("first_emit"),
            F.when(cut, 0).otherwise(F.size(wanted)).alias("redactions"), F.lit(0).alias("missed"), F.when(cut, F.lit(policy.cut_message)).otherwise(redact(text, wanted)).alias("emitted"),
            F.lit(1).alias("chunks_in"), F.when(cut, 0).otherwise(1).alias("chunks_out"), F.array().cast("array<string>").alias("late_detectors"), F.lit(round(sum(r.budget_ms for r in rules) * SHARE, 3)).alias("detector_ms"),
            F.transform(all_, lambda x: F.struct(x["f"]["detector"].alias("detector"), x["f"]["start"].alias("start"), x["f"]["end_pos"].alias("end_pos"), x["f"]["confidence"].alias("confidence"))).alias("findings"))

    return let(found, outcome)


def verdict(refused: Column, leaked: Column, redactions: Column, unchecked: Column) -> Column:
    return F.when(leaked > 0, "leaked").when(refused, "refused").when(redactions > 0, "redacted").when(unchecked, "allowed_unchecked").otherwise("allowed")


def fail_modes(runs: DataFrame, key: str, mode: Column) -> DataFrame:
    """Which detectors of a side answer in time: closed stops after the first that fails, open goes on.

    runs: key, name, budget_ms, elapsed_ms, and error if detectors can fail otherwise. Adds failed, adversarial (over five
    budgets) and counted.
    """
    w = Window.partitionBy(key).orderBy("budget_ms", "name").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("elapsed_ms") > F.col("budget_ms")
    if "error" in runs.columns:
        failed = failed | F.col("error").isNotNull()
    r = runs.withColumn("failed", failed).withColumn("adversarial", F.col("elapsed_ms") > 5 * F.col("budget_ms"))
    return r.withColumn("counted", (mode == "open") | ~F.coalesce(F.max("failed").over(w), F.lit(False)))


def spend(runs: DataFrame, key: str, policy: Policy = DEFAULT, side: str = "prompt") -> DataFrame:
    """What a side's detectors cost each text, and how it ended: total_ms, detectors_run, answered, unavailable, adversarial
    (names in the order they ran), failed_open, failed_closed and unchecked. runs: key, name, elapsed_ms and maybe error."""
    budgets = runs.sparkSession.createDataFrame([(r.name, float(r.budget_ms)) for r in policy.for_side(side)], "name string, budget_ms double")
    counted = fail_modes(runs.join(F.broadcast(budgets), "name"), key, F.lit(policy.mode_for(side))).where("counted")
    ran = F.array_sort(F.collect_list(F.struct("budget_ms", "name", "failed", "adversarial")))
    of = lambda x, keep: F.transform(F.filter(x, keep), lambda r: r["name"])
    out = counted.groupBy(key).agg(F.round(F.sum("elapsed_ms"), 3).alias("total_ms"), F.count("*").alias("detectors_run"), ran.alias("_ran"))
    out = out.withColumns({"answered": of("_ran", lambda r: ~r["failed"]), "unavailable": of("_ran", lambda r: r["failed"]), "adversarial": of("_ran", lambda r: r["adversarial"])}).drop("_ran")
    lost, open_ = F.size("unavailable") > 0, policy.mode_for(side) == "open"
    return out.withColumns({"failed_open": lost & F.lit(open_), "failed_closed": lost & F.lit(not open_), "unchecked": lost & F.lit(open_)})

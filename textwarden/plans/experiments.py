"""The composed measurements: stream against buffer, base rates, bypasses, what a lookback costs, and a slow pattern."""

from __future__ import annotations

import re
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.canonical import canonical
from textwarden.functions.detectors import EXFILTRATION
from textwarden.operators import enforcement as E
from textwarden.operators import evaluation as V
from textwarden.operators.policy import DEFAULT, Policy
from textwarden.operators.requests import as_declared, detector_findings, enforced, handle
from textwarden.sources import labelled as L

LOOKBACKS = (0, 4, 8, 12, 16, 20, 24, 48, 96)
LATENCY_LOOKBACKS = (0, 8, 16, 24, 48, 96)
SWITCHES = {"all on": (), "no invisible": ("invisible",), "no nfkc": ("nfkc",), "no homoglyph": ("homoglyphs",), "no base64": ("base64",), "no case fold": ("case",), "no whitespace": ("whitespace",)}
# Fixed value: a pattern whose ways to match a run of letters double with each letter; never used to detect.
AMBIGUOUS = r"(\w+\s?)+\bsystem prompt\b"
REDOS_LENGTHS = (12, 16, 20, 24)


def run_all(spark: SparkSession, policy: Policy = DEFAULT, *, kind: str | None = None, slug: str | None = None, streamed: bool = True) -> DataFrame:
    """The labelled cases through the request path, with what was declared."""
    rows = L.cases(spark, kind, slug).join(F.broadcast(L.completions(spark).select("name", "completion")), "name")
    return as_declared(handle(rows, policy, system_prompt=L.SYSTEM_PROMPT, streamed=streamed, key="slug"))


def samples(spark: SparkSession) -> DataFrame:
    """Both labelled populations: the cases' prompts and the completions."""
    prompts = L.cases(spark).select(F.lit("prompt").alias("side"), F.col("prompt").alias("text"), "expect_detectors")
    return prompts.unionByName(L.completions(spark).select(F.lit("response").alias("side"), F.col("completion").alias("text"), "expect_detectors"))


def exact_curve(texts: DataFrame, key: str, lookbacks: tuple[int, ...] = LOOKBACKS, policy: Policy = DEFAULT, system_prompt: str = "", buffered: bool = True, text: str = "completion") -> DataFrame:
    """Each response replayed at each lookback with the same chunks, and scanned whole (lookback null)."""
    parts = [enforced(texts.select(key, F.lit(x).alias("lookback"), text), text, replace(policy, lookback=x), system_prompt, name="r").drop(text) for x in lookbacks]
    if buffered:
        parts.append(texts.select(key, F.lit(None).cast("int").alias("lookback"), E.buffered(F.col(text), policy, system_prompt).alias("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        key, "lookback", F.col("r.leaked").alias("leaked_chars"), F.col("r.past").alias("emitted_after_match"), F.col("r.first_emit").alias("first_emit_at_char"), F.col("r.cut").alias("cut"),
        F.length("r.emitted").alias("emitted_chars"), F.array_sort(F.array_distinct(F.transform("r.findings", lambda f: f["detector"]))).alias("detectors"))


def stream_vs_buffer(spark: SparkSession, policy: Policy = DEFAULT) -> DataFrame:
    """The curves of the completions that leak."""
    return exact_curve(L.completions(spark).where("kind != 'clean'"), "name", policy=policy, system_prompt=L.SYSTEM_PROMPT)


def zero_leak(curve: DataFrame, key: str = "name") -> DataFrame:
    """For each response the smallest lookback without a leak, the worst leak, and when a buffered answer begins."""
    streamed = F.col("lookback").isNotNull()
    return curve.groupBy(key).agg(
        F.min(F.when(streamed & (F.col("leaked_chars") == 0), F.col("lookback"))).alias("zero_leak_at"), F.max("leaked_chars").alias("worst_leak"),
        F.max(F.when(~streamed, F.col("first_emit_at_char"))).alias("buffered_first_emit"))


def smallest_safe(curve: DataFrame, key: str = "name") -> DataFrame:
    """The smallest lookback at which no response leaks."""
    return zero_leak(curve, key).agg(F.max("zero_leak_at").alias("smallest_safe"), F.max("worst_leak").alias("worst_leak"))


def latency_exchange(curve: DataFrame, key: str = "name") -> DataFrame:
    """Of a curve: characters that are waited for, per character that does not leak for it. Null where nothing is saved."""
    base = curve.where("lookback = 0").select(key, F.col("leaked_chars").alias("_base"))
    saved = F.col("_base") - F.col("leaked_chars")
    rate = F.when((F.col("lookback") > 0) & (saved > 0), F.bround(F.col("first_emit_at_char") / saved, 2))
    return curve.join(base, key).select(key, "lookback", "first_emit_at_char", "leaked_chars", rate.alias("latency_per_char_saved"))


def base_rate(spark: SparkSession, policy: Policy = DEFAULT) -> DataFrame:
    """Each rule as a gate and as a signal: counts, rates, an interval, and how many clean samples a block would need."""
    of = lambda gate, name: V.derived(V.measure(samples(spark), policy, L.SYSTEM_PROMPT, gate)).select("detector", F.struct("tp", "fn", "fp", "tn", "tpr", "fpr", "resolved_fpr").alias(name))
    rules = policy.rules_df(spark).select(F.col("name").alias("detector"), "action", "min_confidence")
    both = rules.join(of(True, "gate"), "detector").join(of(False, "signal"), "detector")
    low, high = V.wilson(F.col("gate.fp"), F.col("gate.fp") + F.col("gate.tn"))
    p = F.lit(float(policy.prevalence))
    return both.withColumns({"low": F.bround(low, 4), "high": F.bround(high, 4), "needed": V.benign_needed(p, F.col("gate.tpr")), "resolved_precision": V.precision_at(p, F.col("gate.tpr"), F.col("gate.resolved_fpr"))}).withColumn(
        "unsupported", (F.col("action") == "block") & (F.col("resolved_precision") < V.FLOOR))


def outcomes(rows: DataFrame, key: str, policy: Policy = DEFAULT, system_prompt: str = "", switches: dict[str, tuple[str, ...]] | None = None, text: str = "prompt") -> DataFrame:
    """key, switch and outcome (blocked, flagged or MISSED) of each text under each setting of the canonical form."""
    out = None
    for name, off in (SWITCHES if switches is None else switches).items():
        df = canonical(rows.select(key, text), text, off=off)
        actions = F.flatten(F.array(*[F.transform(detector_findings(r, text, system_prompt), lambda f: f["action"]) for r in policy.for_side("prompt")]))
        part = df.select(key, F.lit(name).alias("switch"), F.when(F.array_contains(actions, "block"), "blocked").when(F.size(actions) > 0, "flagged").otherwise("MISSED").alias("outcome"))
        out = part if out is None else out.unionByName(part)
    return out


def bypass_matrix(spark: SparkSession, policy: Policy = DEFAULT) -> DataFrame:
    """The evasions by switch, a column each, and the switches without which one passes otherwise than with all on."""
    long = outcomes(L.cases(spark, "evasion"), "slug", policy, L.SYSTEM_PROMPT)
    wide = long.groupBy("slug").pivot("switch", list(SWITCHES)).agg(F.first("outcome"))
    changed = F.filter(F.array(*[F.when(F.col(f"`{s}`") != F.col("`all on`"), F.lit(s)) for s in list(SWITCHES)[1:]]), lambda s: s.isNotNull())
    return wide.withColumn("defeated_by", changed)


def refusals(spark: SparkSession, policy: Policy = DEFAULT) -> DataFrame:
    """How many refusals the probes can tell apart, with and without an explanation."""
    probes = L.probes(spark).join(F.broadcast(L.completions(spark).select("name", "completion")), "name")
    out = None
    for explain in (False, True):
        seen = handle(probes, replace(policy, explain=explain), system_prompt=L.SYSTEM_PROMPT, key="detector").agg(F.count("*").alias("probes"), F.count_distinct(F.when(~F.col("allowed"), F.col("client_sees"))).alias("refusals"))
        part = seen.withColumn("explain", F.lit(explain))
        out = part if out is None else out.unionByName(part)
    return out


def time_pattern(pattern: re.Pattern, text: str, repeats: int = 3) -> float:
    """The best of some runs, in milliseconds."""
    best = float("inf")
    for _ in range(repeats):
        start = time.perf_counter()
        pattern.search(text)
        best = min(best, (time.perf_counter() - start) * 1000)
    return best


def redos_curve(lengths: tuple[int, ...] = REDOS_LENGTHS, repeats: int = 1) -> list[tuple[int, float, float]]:
    """(characters, ms of the ambiguous pattern, ms of the slowest pattern in use) on a run of one letter, in Python's engine."""
    ambiguous, used = re.compile(AMBIGUOUS, re.I), [re.compile(p, re.I) for p in EXFILTRATION]
    return [(n, time_pattern(ambiguous, "a" * n, repeats), max(time_pattern(p, "a" * n, repeats) for p in used)) for n in lengths]


def redos_outcomes(spark: SparkSession, elapsed_ms: float, policy: Policy = DEFAULT) -> DataFrame:
    """What becomes of a short harmless request when one detector takes elapsed_ms, by fail mode."""
    out = None
    for mode in ("open", "closed"):
        p = replace(policy, modes={"prompt": mode, "response": mode})
        row = spark.createDataFrame([("a" * REDOS_LENGTHS[-1],)], "prompt string").withColumn("key", F.lit(mode)).withColumn("completion", F.lit(dict((r[0], r[1]) for r in L.COMPLETIONS)["clean_answer"]))
        runs = spark.createDataFrame([(mode, r.name, float(elapsed_ms) if r.name == "injection_exfiltration" else 0.01) for r in policy.for_side("prompt")], "key string, name string, elapsed_ms double")
        part = handle(row, p, system_prompt=L.SYSTEM_PROMPT, runs=runs).select(F.col("key").alias("mode"), "verdict", "allowed", "exit_code", "unavailable", "adversarial", "unchecked_sides")
        out = part if out is None else out.unionByName(part)
    return out

"""The request path: canonical form, the prompt's scan, the response's enforcement, verdict and what the client sees."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from textwarden.functions import detectors as D
from textwarden.functions.canonical import canonical, scannable
from textwarden.functions.spans import let
from textwarden.operators import enforcement as E
from textwarden.operators.policy import DEFAULT, Policy, Rule, action_for

FINDING = "struct<detector:string,start:int,end_pos:int,excerpt:string,confidence:string,note:string,form:string,form_ix:int,action:string>"
UNAVAILABLE = "the guard did not answer and this route fails closed"
NOT_A_MODEL = "responses come from fixed texts, not from a model"


def detector_findings(rule: Rule, column: str, system_prompt: str = "") -> Column:
    """A rule's findings in each form that it reads, and in what was decoded, with form, form_ix and the action of each.

    For tables that canonical() has been applied to; column: the text as it was sent.
    """
    def of(form: Column) -> Column:
        found = D.detect(rule.name, form["value"], system_prompt=system_prompt, decoded=F.col("decoded"))
        return F.transform(found, lambda f: F.struct(
            *[f[c].alias(c) for c in ("detector", "start", "end_pos", "excerpt", "confidence", "note")], form["form"].alias("form"), form["form_ix"].alias("form_ix"), action_for(rule, f["confidence"]).alias("action")))

    return F.flatten(F.transform(scannable(rule.reads, column), of)).cast(f"array<{FINDING}>")


def scanned(df: DataFrame, policy: Policy = DEFAULT, side: str = "prompt", column: str = "text", system_prompt: str = "") -> DataFrame:
    """df with the canonical form's columns and found: what all of a side's detectors find, in their order."""
    return canonical(df, column).withColumn("found", found_by(policy, side, column, system_prompt))


def found_by(policy: Policy = DEFAULT, side: str = "prompt", column: str = "text", system_prompt: str = "") -> Column:
    """What all of a side's detectors find, in their order. For tables that canonical() has been applied to."""
    return F.concat(F.array().cast(f"array<{FINDING}>"), *[detector_findings(r, column, system_prompt) for r in policy.for_side(side)])


def timed_runs(df: DataFrame, key: str, policy: Policy = DEFAULT, side: str = "prompt", column: str = "text", system_prompt: str = "") -> DataFrame:
    """key, name, elapsed_ms, findings, error: the same detectors run in Python and timed one by one, as expressions can't be."""
    ready, rules = canonical(df.select(key, column), column).select(key, column, "canonical", "decoded"), policy.for_side(side)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, raw, plain, decoded in zip(pdf[key], pdf[column], pdf["canonical"], pdf["decoded"], strict=True):
                for r in rules:
                    forms = [f or "" for f in {"raw": [raw], "canonical": [plain], "both": [plain, raw]}[r.reads]] + list(decoded if decoded is not None else [])
                    start, n, error = time.perf_counter(), 0, None
                    try:
                        n = len(forms) * (len(forms) > 1 and len(decoded) > 0) if r.name == "encoded_payload" else sum(len(E.find(r.name, f, system_prompt)) for f in forms)
                    except Exception as e:  # noqa: BLE001 - a detector that fails is one that did not answer
                        error = f"{type(e).__name__}: {e}"
                    out.append((k, r.name, (time.perf_counter() - start) * 1000, n, error))
            yield pd.DataFrame(out, columns=[key, "name", "elapsed_ms", "findings", "error"]).astype({"findings": "int32"})

    return ready.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, name string, elapsed_ms double, findings int, error string")


def enforced(df: DataFrame, column: str, policy: Policy = DEFAULT, system_prompt: str = "", call: str | None = None, name: str = "response", **chunks) -> DataFrame:
    """df with whole responses sent through the exact replay, as a struct of OUTCOME's fields; null for a null text. A
    response is one row, so nothing is shuffled."""
    kind = to_arrow_type(StructType.fromDDL(E.OUTCOME))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(column).to_pylist()
            calls = part.column(call).to_pylist() if call else [1] * len(texts)
            rows = [None if t is None else dict(zip(E.COLUMNS, E.replayed(t, policy, system_prompt, call=int(c), **chunks).row(), strict=True)) for t, c in zip(texts, calls, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], names=[*part.schema.names, name])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{base}, `{name}` struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in StructType.fromDDL(E.OUTCOME).fields)}>")


def handle(requests: DataFrame, policy: Policy = DEFAULT, *, system_prompt: str = "", streamed: bool = True, runs: DataFrame | None = None, key: str = "key", call: str | None = None, **chunks) -> DataFrame:
    """Each request from end to end. requests: key, prompt and completion (what the model would say); other columns stay.

    runs: key, name, elapsed_ms (and error) of the prompt side's detectors, where their time is to count; without it all
    answer at once. call: a column that seeds the chunk sizes. Adds prompt_findings, refused_at, refusal_reason, response
    (OUTCOME's fields; null where the prompt was refused, so that no response is scanned), unchecked_sides, findings,
    verdict, exit_code, caveats and client_sees. Null prompts count as empty.
    """
    df = scanned(requests.withColumn("prompt", F.coalesce("prompt", F.lit(""))), policy, "prompt", "prompt", system_prompt)
    if runs is None:
        df = df.withColumns({"failed_closed": F.lit(False), "unchecked": F.lit(False), "unavailable": F.array().cast("array<string>"), "adversarial": F.array().cast("array<string>")}).withColumnRenamed("found", "prompt_findings")
    else:
        df = df.join(E.spend(runs, key, policy, "prompt"), key, "left")
        df = df.withColumns({"failed_closed": F.coalesce("failed_closed", F.lit(False)), "unchecked": F.coalesce("unchecked", F.lit(False))})
        df = df.withColumn("prompt_findings", F.filter("found", lambda f: F.coalesce(F.array_contains("answered", f["detector"]), F.lit(True)))).drop("found")
    blocks = F.filter("prompt_findings", lambda f: f["action"] == "block")
    first = let(F.array_sort(F.transform(blocks, lambda f, i: F.struct(f["start"].alias("start"), i.alias("i"), f["detector"].alias("detector")))), lambda x: F.try_element_at(x, F.lit(1))["detector"])
    df = df.withColumn("_refused", F.when(F.col("failed_closed"), F.lit(UNAVAILABLE)).otherwise(first))
    text = F.when(F.col("_refused").isNull(), F.coalesce("completion", F.lit("")))
    df = df.withColumn("_text", text)
    if streamed:
        df = enforced(df, "_text", policy, system_prompt, call, **chunks)
    else:
        df = df.withColumn("response", F.when(F.col("_text").isNotNull(), E.buffered(F.col("_text"), policy, system_prompt)))
    cut, leaked = F.coalesce(F.col("response.cut"), F.lit(False)), F.coalesce(F.col("response.leaked"), F.lit(0))
    refused = F.col("_refused").isNotNull() | cut
    df = df.withColumns({
        "allowed": ~refused, "refused_at": F.when(F.col("_refused").isNotNull(), "prompt").when(cut, "response"), "refusal_reason": F.coalesce("_refused", "response.cut_reason"),
        "leaked_chars": leaked, "unchecked_sides": F.when(F.col("unchecked"), F.array(F.lit("prompt"))).otherwise(F.array()).cast("array<string>"),
        "verdict": E.verdict(refused, leaked, F.coalesce(F.col("response.redactions"), F.lit(0)), F.col("unchecked")),
    })
    short = lambda c: F.transform(c, lambda f: F.struct(f["detector"].alias("detector"), f["start"].alias("start"), f["end_pos"].alias("end_pos"), f["confidence"].alias("confidence")))
    late = F.coalesce(F.col("response.late_detectors"), F.array().cast("array<string>"))
    notes = F.array(
        F.lit(NOT_A_MODEL), F.when(F.col("unchecked"), F.concat(F.array_join("unchecked_sides", ", "), F.lit(": went through unchecked, as a detector did not answer and this side fails open"))),
        F.when(F.size(late) > 0, F.concat(F.array_join(late, ", "), F.lit(": reads all that came so far, so it fires late on a stream"))),
        F.when(leaked > 0, F.format_string("%d character(s) of what was found had been sent before the cut and cannot be taken back", leaked)))
    return df.withColumns({
        "exit_code": F.when(F.col("verdict").isin("leaked", "allowed_unchecked"), 1).otherwise(0), "caveats": F.filter(notes, lambda n: n.isNotNull()),
        "findings": F.concat(short(F.col("prompt_findings")), F.coalesce(F.col("response.findings"), F.array().cast(E.FOUND))), "client_sees": client_sees(policy),
    }).drop("_refused", "_text", "failed_closed", "unchecked", "canonical", "decoded")


def client_sees(policy: Policy = DEFAULT) -> Column:
    """The same words for every refusal, unless the policy explains."""
    refusal = F.concat(F.lit(policy.refusal + " ["), F.col("refusal_reason"), F.lit("]")) if policy.explain else F.lit(policy.refusal)
    return F.when(F.col("allowed"), F.col("response.emitted")).otherwise(refusal)


def as_declared(handled: DataFrame) -> DataFrame:
    """Cases with blocked, redacted and as_declared: whether the policy did what the case declares."""
    blocked, redacted = ~F.col("allowed"), F.coalesce(F.col("response.redactions"), F.lit(0)) > 0
    return handled.withColumns({"blocked": blocked, "redacted": redacted, "as_declared": (blocked == F.col("expect_blocked")) & (redacted | ~F.col("expect_redacted"))})

"""The command line. Exit code 0: all well; 1: the guard let something through, or a check failed; 2: it could not run."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators import evaluation as V
from textwarden.operators.policy import DEFAULT, PolicyError, load
from textwarden.operators.requests import handle
from textwarden.plans import experiments as X
from textwarden.sources import labelled as L
from textwarden.sources import report


def _show(df: DataFrame, as_json: bool) -> None:
    rows = [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]
    print(json.dumps(rows, indent=1) if as_json else "\n".join("  ".join(f"{k}={v}" for k, v in r.items()) for r in rows))


def check(spark, policy, a) -> int:
    row = spark.createDataFrame([("one", a.prompt, dict((r[0], r[1]) for r in L.COMPLETIONS)[L.completions(spark, a.completion).first()["name"]])], "key string, prompt string, completion string")
    out = handle(row, policy, system_prompt=L.SYSTEM_PROMPT, streamed=not a.buffered).select("verdict", "refused_at", "refusal_reason", "leaked_chars", "unchecked_sides", "caveats", "client_sees", "exit_code")
    _show(out, a.json)
    return out.first()["exit_code"]


def corpus(spark, policy, a) -> int:
    out = X.run_all(spark, policy, streamed=not a.buffered).orderBy("ix").select("slug", "kind", "verdict", "as_declared", "leaked_chars")
    _show(out, a.json)
    return int(bool(out.where("not as_declared").take(1)))


def posture(spark, policy, a) -> int:
    out = V.posture(V.measure(X.samples(spark), policy, L.SYSTEM_PROMPT), policy).orderBy("detector").select("detector", "action", "resolved_precision", "needed", "justified", "reason")
    _show(out, a.json)
    _show(V.fail_costs(spark, policy), a.json)
    return int(a.strict and bool(out.where("not justified").take(1)))


def sweep(spark, policy, a) -> int:
    _show(V.sweep(V.measure(X.samples(spark), policy, L.SYSTEM_PROMPT)).orderBy("detector", F.desc("prevalence")).select("detector", "prevalence", "precision", "resolved_precision", "needed"), a.json)
    return 0


def lookback(spark, policy, a) -> int:
    curve = X.exact_curve(L.completions(spark, a.completion), "name", policy=policy, system_prompt=L.SYSTEM_PROMPT)
    _show(curve.orderBy(F.col("lookback").isNull(), "lookback"), a.json)
    return 0


def redos(spark, policy, a) -> int:
    rows = X.redos_curve(tuple(a.lengths))
    _show(spark.createDataFrame(rows, "characters int, ambiguous_ms double, used_ms double"), a.json)
    _show(X.redos_outcomes(spark, rows[-1][1], policy), a.json)
    return 0


def write_report(spark, policy, a) -> int:
    p = report.build(spark, policy, redos=[(n, ms) for n, ms, _ in X.redos_curve((12, 16))])
    print(*report.write(p, a.folder).values(), sep="\n")
    return int(p["corpus"]["as_declared"] < p["corpus"]["cases"])


def completions(spark, policy, a) -> int:
    _show(L.completions(spark).select("name", "kind", F.length("completion").alias("chars"), "expect_detectors", "note"), a.json)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textwarden", description=__doc__)
    p.add_argument("--policy", help="a YAML file; without it the default route")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for f, name in ((check, "check"), (corpus, "corpus"), (posture, "posture"), (sweep, "sweep"), (lookback, "lookback"), (redos, "redos"), (write_report, "report"), (completions, "completions")):
        q = sub.add_parser(name)
        q.set_defaults(run=f)
        if f is check:
            q.add_argument("prompt")
        if f in (check, lookback):
            q.add_argument("--completion", default="clean_answer" if f is check else "leaks_aws_key")
        if f in (check, corpus):
            q.add_argument("--buffered", action="store_true")
        if f is posture:
            q.add_argument("--strict", action="store_true")
        if f is redos:
            q.add_argument("--lengths", type=int, nargs="+", default=[12, 16, 20])
        if f is write_report:
            q.add_argument("folder")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        policy = load(a.policy) if a.policy else DEFAULT
        spark = spark or SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[2]")).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
        return a.run(spark, policy, a)
    except (PolicyError, KeyError, OSError) as e:
        print(f"textwarden: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

"""Sources and sinks: tables, chunk streams with seeded jitter, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators.enforcement import sizes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, tasks: int = 4) -> DataFrame:
    """Rows of a table dealt out, so many parts a core, where its files are fewer: for steps that cost more than reading it."""
    n = tasks * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def jittered(df: DataFrame, key: str, text: str = "text", size: int = 6, jitter: int = 3, seed: int = 20260818, call: int = 1) -> DataFrame:
    """key, seq, chunk, is_last: chunks whose sizes vary by at most jitter, the same for the same seed and call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(k, i, t[a:b], b == len(t)) for k, t in zip(pdf[key], pdf[text], strict=True) if t for i, (a, b) in enumerate(sizes(len(t), size, jitter, seed, call))]
            yield pd.DataFrame(out, columns=[key, "seq", "chunk", "is_last"]).astype({"seq": "int32"})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, seq int, chunk string, is_last boolean")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def as_markdown(rows: DataFrame) -> str:
    """A table of a small result."""
    cells = [[str(x).replace("|", "\\|") for x in r] for r in rows.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows.columns, ["---"] * len(rows.columns), *cells]) + "\n"


def write_report(parts: dict[str, DataFrame], folder: str) -> None:
    """report.json and report.md of small results."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "report.json").write_text(json.dumps({k: [json.loads(r["json"]) for r in as_json(v).collect()] for k, v in parts.items()}, indent=1))
    (out / "report.md").write_text("\n".join(f"## {k}\n\n{as_markdown(v)}" for k, v in parts.items()))

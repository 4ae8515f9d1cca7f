"""Canonical forms of texts, and what was done to reach them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters without width, look-alikes and what they are folded to.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u00ad"
GLYPHS_FROM = "аеорсухіјһΑΒΕΗΙΚΜΝΟΡΤΥΧοα‐‑‒–—‘’“”"
GLYPHS_TO = "aeopcyxijhabehikmnoptyxoa-----''\"\""
RUN = r"[A-Za-z0-9+/]{24,}={0,2}"
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Characters that neither print nor are blank.
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\s\x1c-\x1f\x85]]"
STEPS = ("invisible", "nfkc", "homoglyphs", "base64", "case", "whitespace")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def fold_case(text: Column) -> Column:
    """Lower case with sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def _decode_once(text: Column) -> Column:
    runs = F.when(text.rlike(RUN), F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    padded = F.transform(runs, lambda r: F.concat(r, F.repeat(F.lit("="), (4 - F.length(r) % 4) % 4)))
    raw = F.filter(F.transform(padded, lambda r: F.try_to_binary(r, F.lit("base64"))), lambda b: b.isNotNull())
    texts = F.transform(F.filter(raw, lambda b: F.is_valid_utf8(b.cast("string"))), lambda b: b.cast("string"))
    return F.filter(texts, lambda t: (F.length(t) > 0) & (F.length(F.regexp_replace(t, UNPRINTABLE, "")) >= F.length(t) * F.lit(0.9)))


def decode(text: Column, depth: int = 2) -> Column:
    """Texts of base64 runs, each followed by the texts of its own, to a depth."""
    if depth <= 0:
        return F.array().cast("array<string>")
    here = _decode_once(text)
    if depth == 1:
        return here
    return F.flatten(F.transform(here, lambda t: F.concat(F.array(t), decode(t, depth - 1))))


def canonical(df: DataFrame, column: str = "text", *, off: tuple[str, ...] = (), depth: int = 2) -> DataFrame:
    """df with canonical, decoded, applied, changed and suspicious added. off: steps that are left out."""
    if set(off) - set(STEPS):
        raise ValueError(f"no such step: {sorted(set(off) - set(STEPS))}")
    at, steps = F.col(column), [F.col(column)]
    if "invisible" not in off:
        at = F.translate(at, INVISIBLE, "")
    df = df.withColumn("_invisible", at)
    df = df.withColumn("_nfkc", F.col("_invisible") if "nfkc" in off else nfkc("_invisible"))
    df = df.withColumn("_homoglyphs", F.col("_nfkc") if "homoglyphs" in off else F.translate("_nfkc", GLYPHS_FROM, GLYPHS_TO))
    df = df.withColumn("decoded", F.array().cast("array<string>") if "base64" in off else decode(F.col("_homoglyphs"), depth))
    df = df.withColumn("_case", F.col("_homoglyphs") if "case" in off else fold_case(F.col("_homoglyphs")))
    df = df.withColumn("canonical", F.col("_case") if "whitespace" in off else collapse(F.col("_case")))
    before = {"invisible": (column, "_invisible"), "nfkc": ("_invisible", "_nfkc"), "homoglyphs": ("_nfkc", "_homoglyphs"), "case": ("_homoglyphs", "_case"), "whitespace": ("_case", "canonical")}
    tags = [F.when(F.size("decoded") > 0, F.lit(s)) if s == "base64" else F.when(F.col(before[s][0]) != F.col(before[s][1]), F.lit(s)) for s in STEPS]
    df = df.withColumn("applied", F.filter(F.array(*tags), lambda t: t.isNotNull()))
    df = df.withColumn("changed", F.col("canonical") != steps[0]).withColumn("suspicious", F.arrays_overlap("applied", F.array(F.lit("invisible"), F.lit("homoglyphs"), F.lit("base64"))))
    return df.drop("_invisible", "_nfkc", "_homoglyphs", "_case")


def scannable(reads: str = "canonical", column: str = "text") -> Column:
    """Array of (form, form_ix, value): what a detector reads, always with the decoded texts."""
    forms = {"canonical": ["canonical"], "raw": [column], "both": ["canonical", column]}[reads]
    own = [F.struct(F.lit("raw" if f == column else f).alias("form"), F.lit(0).alias("form_ix"), F.col(f).alias("value")) for f in forms]
    return F.concat(F.array(*own), F.transform("decoded", lambda v, i: F.struct(F.lit("decoded").alias("form"), i.alias("form_ix"), v.alias("value"))))


def content_free(df: DataFrame, column: str = "text") -> DataFrame:
    """Of a table that canonical() has been applied to: what was done and how much, without any of the text."""
    others = [c for c in df.columns if c not in (column, "canonical", "decoded")]
    return df.select(*others, F.length(column).alias("original_chars"), F.length("canonical").alias("canonical_chars"), F.size("decoded").alias("decoded_segments"))

"""Where a pattern matches, in code points, within Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = "struct<detector:string,start:int,end_pos:int,excerpt:string,confidence:string,note:string>"
NONE = f"array<{FINDING}>"


SPANS = "array<struct<start:int,end_pos:int,value:string>>"
#: Matches that are added up at once, and characters that are cut at once: long texts cost their length, not its square.
STEP, BLOCK = 512, 4096


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(items: Column, size: int = STEP) -> Column:
    """The array cut into arrays of so many elements; one empty array for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, size))


def starts(gaps: Column, found: Column) -> Column:
    """Offsets of the matches from the texts between and of them."""
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("v")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        return F.struct((acc["at"] + x["g"] + x["v"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["g"])).alias("out"))

    def bases(parts):
        return F.aggregate(parts, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    sums = let(lengths, lambda x: F.transform(blocks(x), lambda b: F.aggregate(b, zero, step)))
    return let(sums, lambda parts: F.flatten(F.zip_with(parts, bases(parts), lambda x, base: F.transform(x["out"], lambda s: s + base))))


def spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Array of (start, end_pos, value) of all matches, leftmost and non-overlapping. The pattern must not match ''.

    guard: a condition that every text with a match meets and that is cheaper to test than the pattern.
    """
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    located = let(both, lambda p: F.zip_with(starts(p["gaps"], p["found"]), p["found"], lambda s, v: F.struct(s.alias("start"), (s + F.length(v)).alias("end_pos"), v.alias("value"))))
    return F.when(text.rlike(pattern) if guard is None else guard, located).otherwise(F.array()).cast(SPANS)


def replaced(text: Column, marks: Column) -> Column:
    """The text with each mark's span replaced by its value. marks: (start, end_pos, value), in order and disjoint."""

    def block(part, b, all_):
        base = b * BLOCK

        def cut(near):
            upto = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.least(F.try_element_at(near, i)["end_pos"] - base, F.lit(BLOCK)))
            kept = F.transform(near, lambda m, i: F.concat(
                F.substring(part, upto(i) + 1, F.greatest(m["start"] - base - upto(i), F.lit(0))), F.when(m["start"] >= base, m["value"]).otherwise(F.lit(""))))
            return F.concat(F.array_join(kept, ""), F.substring(part, upto(F.size(near)) + 1, F.lit(BLOCK)))

        return let(F.filter(all_, lambda m: (m["end_pos"] > base) & (m["start"] < base + BLOCK)), cut)

    parts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    # bound by let, as an expression within a lambda is evaluated for each element
    return let(marks, lambda all_: F.when(F.size(all_) > 0, F.array_join(F.transform(parts, lambda part, b: block(part, b, all_)), "")).otherwise(text))


def mask(value: Column, keep: int = 4) -> Column:
    """The first characters, at most twelve stars and the length; a short value is all stars."""
    n = F.length(value)
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(value, 1, keep), F.repeat(F.lit("*"), F.least(n - keep, F.lit(12))), F.lit(" ("), n.cast("string"), F.lit(" chars)")))


def shannon(value: Column) -> Column:
    """Bits a character; 0 for ''."""
    n = F.length(value).cast("double")
    shares = F.transform(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


#: Decimal digits of every script, and the ASCII digit of each.
DIGITS = [(c, str(unicodedata.decimal(c))) for c in map(chr, range(128, 0x10000)) if unicodedata.category(c) == "Nd"]


def luhn(value: Column) -> Column:
    """Whether the digits, of which there must be twelve, pass the check."""
    plain = F.when(value.rlike(r"[^\x00-\x7F]"), F.translate(value, *("".join(x) for x in zip(*DIGITS, strict=True)))).otherwise(value)
    return let(F.regexp_replace(plain, "[^0-9]", ""), lambda digits: (F.length(digits) >= 12) & F.call_function("luhn_check", digits))


def finding(detector: str, s: Column, excerpt: Column, confidence: str, note: Column | str) -> Column:
    note = F.lit(note) if isinstance(note, str) else note
    return F.struct(F.lit(detector).alias("detector"), s["start"].alias("start"), s["end_pos"].alias("end_pos"), excerpt.alias("excerpt"), F.lit(confidence).alias("confidence"), note.alias("note"))

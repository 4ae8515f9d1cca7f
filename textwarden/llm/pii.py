"""Personal data in texts: four pattern kinds, and bootstrapped contextual extraction of identifiers they miss.

The base kinds are located by JVM regular expressions, with offsets in code points. Expressions for the runs start where
a run starts (or where the last match ended), so a long run is read once and not from each of its characters.

Bootstrapping: identifier-like tokens (at least MIN_TOKEN characters with a digit or an @ among them) stand in lexical
contexts: a name they are assigned to ('in password=', whether within the token or before it, with blanks and a quote),
the word before and the word after, a blank apart (either may be a token itself), and the form of long ones (first four
letters, length, kinds of characters). Seed entities have belief 1: the base kinds, and as 'secret' values assigned to a
name of SECRET_NAMES and values of a published key format. Each round scores the pattern-instance graph: a context's
confidence is its instances' summed belief over their number plus SMOOTH, if it has SUPPORT different instances or more
that are believed; an instance's belief is the largest confidence of its contexts. Beliefs only grow; rounds end when no
confidence has changed by more than SETTLED, or after ROUNDS. Contexts of confidence ACCEPT or more give their unseen
instances as new spans, of the kind that most of the context's seeds have. Secret seeds are new spans in any case.
Identifiers whose contexts no seed shares stay unfound, as do tokens without a digit or an @.

Only DataFrame expressions run. The corpus is read once; what goes through the rounds is one row for each distinct pair
of context and instance, summed before it is shuffled. Rows are numbered once, in the table that is written first, and
joins by that number read this table, so they do not depend on how the input is split when it is read again.

Defined results: a null text counts as empty, and comes back null from redact(); repeated rows are judged one by one; a
null doc_id stays null; an empty table gives no rows; a token that two kinds claim goes to the context of the higher
confidence, then to the kind that comes last in the alphabet; very long texts are read whole; input columns of any name
come back from redact() as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.spans import blocks, let, replaced, spans
from textwarden.llm.common import written

KINDS = ("email", "ip", "card", "phone")
# After a match or where no character of the run precedes; possessive, as no shorter run could match either.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ROUNDS, SETTLED, SUPPORT, SMOOTH, ACCEPT, MIN_TOKEN = 20, 0.01, 3, 2.0, 0.5, 6
# Names whose values are secrets, and published formats of keys.
SECRET_NAMES = r"(?i)^(?:.*[._-])?(?:password|passwd|passphrase|pwd|secret|token|api[._-]?key|access[._-]?key|private[._-]?key|client[._-]?secret)$"
KEY_FORMATS = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})$"
# Runs with a digit or an @; from where a run starts, possessive.
TOKEN = r"(?<![^\s\"'<>,;|])[^\s\"'<>,;|0-9@]*+[0-9@][^\s\"'<>,;|]*+"
SPAN = "struct<kind:string,start:int,end:int,value:string>"
MARK = "struct<start:int,end:int,value:string,contexts:array<string>,seed:string>"
#: Accepted contexts that are sent to every task at most (some 50 bytes each); more are joined by a shuffle, salted.
SENT_CONTEXTS, SALT = 1 << 18, 16


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end_pos"].alias("end"), x["value"].alias("value")))


def base_spans(text: Column) -> dict[str, Column]:
    """By kind: arrays of (kind, start, end, value) of the valid matches."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    small = lambda v: F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) < 4) & F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    rules = {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), small),
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda v: let(digits(v), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))),
        "phone": (PHONE, text.rlike(r"\+[0-9]"), lambda v: F.length(digits(v)).between(8, 15)),
    }
    return {kind: _of_kind(F.filter(spans(text, pattern, maybe), lambda x: fine(x["value"])), kind).cast(f"array<{SPAN}>") for kind, (pattern, maybe, fine) in rules.items()}


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _tokens(text: Column) -> Column:
    """(start, end, value, left, right) of the tokens of MIN_TOKEN characters or more; left and right are the text from
    the token before and up to the one after."""
    none = F.array(F.lit(""))

    def around(p):
        n, found = F.size(p["found"]), p["found"]
        at = F.arrays_zip(
            found.alias("token"), F.slice(p["gaps"], 1, n).alias("gap"), F.slice(p["gaps"], 2, n).alias("next_gap"),
            F.slice(F.concat(none, F.transform(found, lambda x: x["value"])), 1, n).alias("last"),
            F.slice(F.concat(F.transform(found, lambda x: x["value"]), none), 2, n).alias("next"),
        )
        long = F.filter(at, lambda x: F.length(x["token"]["value"]) >= MIN_TOKEN)
        return F.transform(long, lambda x: F.struct(
            x["token"]["start"].alias("start"), x["token"]["end_pos"].alias("end"), x["token"]["value"].alias("value"),
            F.concat(x["last"], x["gap"]).alias("left"), F.concat(x["next_gap"], x["next"]).alias("right")))

    return let(F.struct(F.split(text, TOKEN, -1).alias("gaps"), spans(text, TOKEN, F.lit(True)).alias("found")), around)


def _mark(x: Column) -> Column:
    """The token without its lead-in and what closes a sentence, its contexts, and 'secret' where it is such a seed."""
    lead = F.regexp_extract(x["value"], r"^([A-Za-z_.-]{2,32}[=:])[^=:]", 1)
    tail = F.length(F.regexp_extract(x["value"], r"[.:!?)\]}]+$", 0))

    def named(y):
        before, after = F.lower(F.regexp_extract(x["left"], r"(?<!\S)(\S++)[ ]$", 1)), F.lower(F.regexp_extract(x["right"], r"^[ ](\S++)", 1))
        value = y["value"]
        form = F.concat_ws(" ", F.lit("form"), F.substring(value, 1, 4), F.length(value).cast("string"), *[F.when(value.rlike(f"[{c}]"), c).otherwise("") for c in ("a-z", "A-Z", "0-9", "_=+/.-")])
        contexts = F.array(
            F.when(y["name"] != "", F.concat(F.lit("in "), F.lower(y["name"]), F.lit("="))), F.when(before != "", F.concat(F.lit("after "), before)),
            F.when(after != "", F.concat(F.lit("before "), after)), F.when(value.rlike("^[A-Za-z]{4}") & (F.length(value) >= 12), form))
        secret = y["name"].rlike(SECRET_NAMES) | value.rlike(KEY_FORMATS)
        start = x["start"] + F.length(lead)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.filter(contexts, lambda c: c.isNotNull()).alias("contexts"), F.when(secret, F.lit("secret")).alias("seed"))

    assigned = F.regexp_extract(F.substring(x["left"], -48, 48), r"([A-Za-z_.-]{2,32})[ ]?[=:][ ]?[\"']?$", 1)
    name = F.when(lead != "", F.regexp_replace(lead, "[=:]$", "")).otherwise(assigned)
    value = F.substring(x["value"], F.length(lead) + 1, F.greatest(F.length(x["value"]) - F.length(lead) - tail, F.lit(1)))
    return let(F.struct(name.alias("name"), value.alias("value")), named).cast(MARK)


def _seeded(marks: Column, base: Column) -> Column:
    """The marks with the kind of the first base span that each overlaps as their seed."""

    def part(some):
        low, high = F.element_at(some, 1)["start"], F.element_at(some, -1)["end"]
        near = F.filter(base, lambda s: (s["end"] > low) & (s["start"] < high))
        kind = lambda m, held: F.try_element_at(F.filter(held, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"])), F.lit(1))["kind"]
        return let(near, lambda held: F.transform(some, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["contexts"].alias("contexts"), F.coalesce(kind(m, held), m["seed"]).alias("seed"))))

    return F.when(F.size(marks) > 0, F.flatten(F.transform(blocks(marks), part))).otherwise(marks)


def located(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """_row, _in (the columns of docs, or those to keep), base (spans in order of kind and start) and marks: identifier-like tokens with
    their contexts, and the kind of those that are seeds."""
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*columns).alias("_in"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.select("*", F.concat(*base_spans(F.col("_text")).values()).alias("base"))
    marks = F.when(F.col("_text").rlike("[0-9@]"), F.transform(_tokens(F.col("_text")), _mark)).otherwise(F.array()).cast(f"array<{MARK}>")
    return rows.withColumn("marks", marks).select("_row", "_in", "base", _seeded(F.col("marks"), F.col("base")).alias("marks"))


def patterns(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(context, kind, confidence) of the contexts accepted, from the rows that located() gives."""
    kinds = (*KINDS, "secret")
    m = found.where(F.size("marks") > 0).select(F.explode("marks").alias("m"))
    pairs = m.select(F.explode("m.contexts").alias("context"), F.col("m.value").alias("value"), F.col("m.seed").alias("kind"))
    edges = written(pairs.groupBy("context", "value").agg(F.max("kind").alias("kind")))
    belief = edges.withColumn("belief", F.col("kind").isNotNull().cast("double"))
    scores = None
    for i in range(rounds):
        last = scores
        scores = written(belief.groupBy("context").agg(
            F.sum("belief").alias("sum"), F.count("*").alias("n"), F.sum((F.col("belief") > 0.25).cast("int")).alias("support"),
            *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
        ).where(F.col("support") >= support).withColumn("confidence", F.col("sum") / (F.col("n") + SMOOTH)))
        if last is not None:
            moved = scores.join(last.select("context", F.col("confidence").alias("before")), "context", "left").where(F.col("confidence") - F.coalesce("before", F.lit(0.0)) > SETTLED)
            if not moved.take(1):
                break
        best = edges.join(scores.select("context", "confidence"), "context").groupBy("value").agg(F.max("confidence").alias("b"))
        belief = edges.join(best, "value", "left").select("context", "value", "kind", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("b", F.lit(0.0))).alias("belief"))
    most = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)]))
    return scores.where(F.col("confidence") >= accept).select("context", F.when(most["n"] > 0, most["kind"]).otherwise(F.lit("other")).alias("kind"), "confidence")


def _matched(hits: DataFrame, accepted: DataFrame) -> DataFrame:
    """hits joined with the accepted contexts: by a broadcast up to a checked count, beyond it dealt with a salt, as one context may hold many of the rows."""
    if accepted.limit(SENT_CONTEXTS + 1).count() <= SENT_CONTEXTS:
        return hits.join(F.broadcast(accepted), "context")
    salted = hits.withColumn("_salt", F.pmod(F.xxhash64("_row", "start"), F.lit(SALT)))
    return salted.join(accepted.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["context", "_salt"]).drop("_salt")


def extract(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """_row, _in, base and more: the spans that seeds of secrets and accepted contexts add. A row for each row of docs."""
    found = written(located(docs, keep))
    accepted = written(patterns(found))
    m = found.where(F.size("marks") > 0).select("_row", F.explode("marks").alias("m")).where(F.col("m.seed").isNull())
    hits = _matched(m.select("_row", "m.start", "m.end", "m.value", F.explode("m.contexts").alias("context")), accepted)
    one = hits.groupBy("_row", "start", "end").agg(F.max_by(F.struct("kind", "value"), F.struct("confidence", "kind")).alias("x"))
    new = one.groupBy("_row").agg(F.collect_list(F.struct(F.col("x.kind").alias("kind"), "start", "end", F.col("x.value").alias("value"))).alias("_new"))
    # only rows with marks that no seed explains take part in the join; the others' texts are not shuffled
    secrets = F.transform(F.filter("marks", lambda s: s["seed"] == "secret"), lambda s: F.struct(s["seed"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).cast(f"array<{SPAN}>")
    open_ = F.exists("marks", lambda s: s["seed"].isNull())
    rows = found.select("_row", "_in", "base", secrets.alias("more"), open_.alias("_open"))
    joined = rows.where("_open").join(new, "_row", "left").withColumn("more", F.concat("more", F.coalesce("_new", F.array().cast(f"array<{SPAN}>"))))
    both = joined.select("_row", "_in", "base", "more").unionByName(rows.where("not _open").select("_row", "_in", "base", "more"))
    return both.withColumn("more", F.array_sort(F.transform("more", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))).withColumn(
        "more", F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))


def _ordered(found: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.transform(found, lambda s: F.struct(F.when(rank(s) > 0, rank(s)).otherwise(9).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, spans, n_found (added spans), n_spans (all)."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return extract(docs, ["doc_id"]).select(
        F.col("_in.doc_id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(_ordered(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_found"),
        (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, marker: str = "[{}]") -> DataFrame:
    """docs with each span replaced by its kind in brackets; of overlapping spans the union is replaced once, by the kind
    of the first. n_chars follows the text. Rows without spans come back as they are."""
    left, right = marker.split("{}")
    order = F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merged(some):
        """Disjoint spans: each that overlaps the one before it lengthens that one."""

        def add(acc, s):
            last = F.element_at(acc, -1)
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end_pos"], s["end"]).alias("end_pos"), last["value"].alias("value"))
            new = F.struct(s["start"].alias("start"), s["end"].alias("end_pos"), F.concat(F.lit(left), s["kind"], F.lit(right)).alias("value"))
            return F.when((F.size(acc) > 0) & (s["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end_pos"], F.lit(-1))), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(new)))

        return F.aggregate(some, F.array().cast("array<struct<start:int,end_pos:int,value:string>>"), add)

    rows = extract(docs).withColumn("_cut", F.when(F.size(F.concat("base", "more")) > 0, let(order, lambda some: replaced(F.col("_in.text"), merged(some)))))
    out = []
    for f in docs.schema.fields:
        old = F.col("_in").getField(f.name)
        new = {"text": F.col("_cut"), "n_chars": F.length("_cut").cast(f.dataType)}.get(f.name)
        out.append((old if new is None else F.when(F.col("_cut").isNotNull(), new).otherwise(old)).alias(f.name))
    return rows.select(*out)

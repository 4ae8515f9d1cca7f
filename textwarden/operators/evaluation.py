"""Measuring detectors: confusion counts, precision at a prevalence, intervals, and whether an action is supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.canonical import canonical
from textwarden.operators.policy import Policy
from textwarden.operators.requests import detector_findings

PREVALENCES = (0.5, 0.1, 0.01, 0.001, 0.0001)
FLOOR = 0.5


def rates(fired: DataFrame) -> DataFrame:
    """tp, fn, fp, tn by detector. fired: detector, is_attack, fired."""
    c = lambda a, f: F.count_if((F.col("is_attack") == a) & (F.col("fired") == f))
    return fired.groupBy("detector").agg(c(True, True).alias("tp"), c(True, False).alias("fn"), c(False, True).alias("fp"), c(False, False).alias("tn"))


def derived(r: DataFrame) -> DataFrame:
    """tpr, fpr, smallest_fpr (what the benign sample can resolve) and resolved_fpr added."""
    share = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    r = r.withColumn("tpr", share(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("fpr", share(F.col("fp"), F.col("fp") + F.col("tn")))
    r = r.withColumn("smallest_fpr", F.when(F.col("fp") + F.col("tn") > 0, 1.0 / (F.col("fp") + F.col("tn"))).otherwise(F.lit(1.0)))
    return r.withColumn("resolved_fpr", F.greatest("fpr", "smallest_fpr"))


def precision_at(prevalence: Column, tpr: Column, fpr: Column) -> Column:
    hit, alarm = tpr * prevalence, fpr * (F.lit(1.0) - prevalence)
    return F.when(hit + alarm > 0, hit / (hit + alarm)).otherwise(F.lit(0.0))


def benign_needed(prevalence: Column, tpr: Column, floor: float = FLOOR) -> Column:
    limit = tpr * prevalence * F.lit(1.0 - floor) / (F.lit(floor) * (F.lit(1.0) - prevalence))
    return F.when((tpr <= 0) | (prevalence <= 0) | (prevalence >= 1), F.lit(0)).otherwise(F.ceil(F.lit(1.0) / limit)).cast("long")


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    n, zz = trials.cast("double"), z * z
    p = successes / n
    middle, spread, scale = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    return (F.when(trials > 0, F.greatest(F.lit(0.0), (middle - spread) / scale)).otherwise(F.lit(0.0)),
            F.when(trials > 0, F.least(F.lit(1.0), (middle + spread) / scale)).otherwise(F.lit(1.0)))


def sweep(r: DataFrame, prevalences: tuple[float, ...] = PREVALENCES) -> DataFrame:
    """A row for each detector and prevalence, with measured and resolved precision."""
    p = derived(r).withColumn("prevalence", F.explode(F.array(*[F.lit(float(x)) for x in prevalences])))
    return p.withColumn("precision", precision_at(F.col("prevalence"), F.col("tpr"), F.col("fpr"))).withColumn("resolved_precision", precision_at(F.col("prevalence"), F.col("tpr"), F.col("resolved_fpr"))).withColumn("needed", benign_needed(F.col("prevalence"), F.col("tpr")))


def justify(r: DataFrame, action: Column, prevalence: float) -> DataFrame:
    """justified and reason added: a block needs a resolved precision of FLOOR or more."""
    p = F.lit(float(prevalence))
    d = derived(r).withColumn("action", action).withColumn("precision", precision_at(p, F.col("tpr"), F.col("fpr"))).withColumn("resolved_precision", precision_at(p, F.col("tpr"), F.col("resolved_fpr")))
    d = d.withColumn("alarms_per_tp", F.try_divide(F.lit(1.0), "resolved_precision")).withColumn("needed", benign_needed(p, F.col("tpr")))
    none = F.col("tp") + F.col("fn") == 0
    ok = F.when(F.col("action") != "block", True).when(none, False).otherwise(F.col("resolved_precision") >= FLOOR)
    why = F.when(F.col("action") != "block", "does not block").when(none, "no attacks were measured").when(ok, "supported").otherwise("the benign sample is too small or fires too often")
    return d.withColumn("justified", ok).withColumn("reason", why)


def availability(df: DataFrame) -> DataFrame:
    """combined, downtime_min of a 30-day month, coverage and uncovered_min from model, guard and fail_open."""
    open_ = F.col("fail_open")
    both = F.col("model") * F.col("guard")
    combined, coverage, month = F.when(open_, F.col("model")).otherwise(both), F.when(open_, F.col("guard")).otherwise(F.lit(1.0)), 30 * 24 * 60.0
    return df.withColumns({"combined": F.bround(combined, 6), "downtime_min": F.bround((1 - combined) * month, 2), "coverage": F.bround(coverage, 6), "uncovered_min": F.bround((1 - coverage) * month, 2)})


def measure(samples: DataFrame, policy: Policy, system_prompt: str = "", gate: bool = True) -> DataFrame:
    """tp, fn, fp, tn of each rule. samples: side, text and expect_detectors; a rule is measured on the sides it applies to.

    As a gate, only findings sure enough for the rule's own action count; as a signal, any finding does. The findings are
    those of the request path. Every rule of the policy has a row, also without samples.
    """
    df = canonical(samples.select("side", "text", "expect_detectors"))

    def one(r):
        found = detector_findings(r, "text", system_prompt)
        fired = F.exists(found, lambda f: f["action"] == r.action) if gate else F.size(found) > 0
        return F.when(F.col("side").isin(*r.where), F.struct(F.lit(r.name).alias("detector"), F.array_contains("expect_detectors", r.name).alias("is_attack"), fired.alias("fired")))

    each = df.select(F.explode(F.array(*[one(r) for r in policy.rules])).alias("x")).where("x is not null").select("x.*")
    names = samples.sparkSession.createDataFrame([(r.name,) for r in policy.rules], "detector string")
    return F.broadcast(names).join(rates(each), "detector", "left").na.fill(0, ["tp", "fn", "fp", "tn"])


def posture(measured: DataFrame, policy: Policy) -> DataFrame:
    """A policy's report card: for each rule whether its action is justified at the policy's prevalence, and why."""
    rules = measured.sparkSession.createDataFrame([(r.name, r.action) for r in policy.rules], "detector string, action string")
    both = F.broadcast(rules).join(measured, "detector", "left").na.fill(0, ["tp", "fn", "fp", "tn"])
    known = F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn") > 0
    judged = justify(both, F.col("action"), policy.prevalence)
    return judged.withColumns({"justified": F.col("justified") & known, "reason": F.when(known, F.col("reason")).otherwise("nothing was measured")})


def fail_costs(spark: SparkSession, policy: Policy, model: float = 0.999, guard: float = 0.999) -> DataFrame:
    """The availability of each side under the policy's fail modes; the two nines are assumptions."""
    rows = [(s, float(model), float(guard), policy.mode_for(s) == "open") for s in ("prompt", "response")]
    return availability(spark.createDataFrame(rows, "side string, model double, guard double, fail_open boolean"))

"""Policies: which detector acts where, and how; loaded from YAML and checked as a whole."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions.detectors import REGISTRY

ACTIONS, SIDES, READS, MODES = ("block", "redact", "flag"), ("prompt", "response"), ("canonical", "raw", "both"), ("open", "closed")
CONFIDENCE = ("low", "medium", "high")


class PolicyError(ValueError):
    """A policy that can't be used."""


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    where: tuple[str, ...]
    budget_ms: float
    stream_safe: bool = True
    min_confidence: str = "low"
    reads: str = "canonical"

    def action_for(self, confidence: str) -> str:
        return self.action if CONFIDENCE.index(confidence) >= CONFIDENCE.index(self.min_confidence) else "flag"


@dataclass(frozen=True)
class Policy:
    route: str
    rules: tuple[Rule, ...]
    prevalence: float = 0.0
    lookback: int = 96
    warmup: int = 0
    cut_message: str = "\n\n[response withheld]"
    total_ms: float = 45.0
    modes: dict = field(default_factory=lambda: {"prompt": "closed", "response": "open"})
    refusal: str = "This request cannot be answered."
    explain: bool = False

    def for_side(self, side: str) -> list[Rule]:
        return sorted((r for r in self.rules if side in r.where), key=lambda r: (r.budget_ms, r.name))

    def mode_for(self, side: str) -> str:
        return self.modes.get(side, "closed")

    def stream_unsafe(self, side: str) -> list[str]:
        return [r.name for r in self.for_side(side) if not r.stream_safe]

    @property
    def declared_budget_ms(self) -> float:
        return round(sum(r.budget_ms for r in self.rules), 3)

    def rules_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.route, r.name, r.action, list(r.where), float(r.budget_ms), r.stream_safe, r.min_confidence, r.reads) for r in self.rules]
        return spark.createDataFrame(rows, "route string, name string, action string, `where` array<string>, budget_ms double, stream_safe boolean, min_confidence string, reads string")


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise PolicyError(why)


def from_dict(doc: dict) -> Policy:
    _need(isinstance(doc, dict), "a policy is a mapping")
    _need(bool(doc.get("route")), "a policy needs a route")
    _need(isinstance(doc.get("detectors"), dict) and bool(doc["detectors"]), "a policy needs detectors")
    rules = []
    for name, d in doc["detectors"].items():
        _need(name in REGISTRY, f"unknown detector {name!r}")
        _need(isinstance(d, dict) and all(k in d for k in ("action", "where", "budget_ms")), f"{name}: action, where and budget_ms are needed")
        where = tuple([d["where"]] if isinstance(d["where"], str) else d["where"])
        least = d.get("min_confidence", "high" if d["action"] == "block" else "low")
        _need(d["action"] in ACTIONS, f"{name}: unknown action {d['action']!r}")
        _need(bool(where) and set(where) <= set(SIDES), f"{name}: where must name {' or '.join(SIDES)}")
        _need(least in CONFIDENCE, f"{name}: unknown confidence {least!r}")
        _need(d.get("reads", "canonical") in READS, f"{name}: unknown form {d.get('reads')!r}")
        _need(not (d["action"] == "redact" and "prompt" in where), f"{name}: prompts are not redacted")
        _need(float(d["budget_ms"]) > 0, f"{name}: budget_ms must be above 0")
        rules.append(Rule(name, d["action"], where, float(d["budget_ms"]), bool(d.get("stream_safe", True)), least, d.get("reads", "canonical")))
    stream, budget, response = (doc.get(k) or {} for k in ("stream", "budget", "response"))
    modes = budget.get("on_unavailable") or {"prompt": "closed", "response": "open"}
    p = Policy(
        str(doc["route"]), tuple(rules), float(doc.get("prevalence", 0.0)), int(stream.get("lookback_chars", 96)), int(stream.get("warmup_chars", 0)),
        stream.get("cut_message", Policy.cut_message), float(budget.get("total_ms", 45.0)), dict(modes), response.get("refusal", Policy.refusal), bool(response.get("explain", False)),
    )
    _need(p.lookback >= 0 and p.warmup >= 0, "lookback_chars and warmup_chars must be at least 0")
    _need(set(p.modes) <= set(SIDES) and set(p.modes.values()) <= set(MODES), "on_unavailable maps sides to open or closed")
    _need(0 <= p.prevalence <= 1, "prevalence must be from 0 to 1")
    _need(p.declared_budget_ms <= p.total_ms, "detectors' budgets exceed total_ms")
    _need(not (p.explain and p.prevalence > 0), "explain tells attackers which detector fired")
    return p


def load(path: str) -> Policy:
    import yaml

    _need(Path(path).is_file(), f"no policy at {path}")
    try:
        return from_dict(yaml.safe_load(Path(path).read_text()))
    except yaml.YAMLError as e:
        raise PolicyError(f"not YAML: {e}") from e


def rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 2).when(confidence == "medium", 1).otherwise(0)


def action_for(rule: Rule, confidence: Column) -> Column:
    """The rule's action, or flag for findings below its confidence."""
    return F.when(rank(confidence) < CONFIDENCE.index(rule.min_confidence), "flag").otherwise(rule.action)


#: The route used where none is given.
DEFAULT = from_dict({
    "route": "default", "prevalence": 0.0004,
    "detectors": {
        "secret_pattern": {"action": "block", "where": ["prompt", "response"], "budget_ms": 6, "reads": "raw"},
        "pii_email": {"action": "redact", "where": ["response"], "budget_ms": 4},
        "pii_card": {"action": "redact", "where": ["response"], "budget_ms": 5, "reads": "raw"},
        "injection_override": {"action": "flag", "where": ["prompt"], "budget_ms": 8},
        "injection_exfiltration": {"action": "block", "where": ["prompt"], "budget_ms": 7},
        "system_prompt_echo": {"action": "block", "where": ["response"], "budget_ms": 9, "stream_safe": False},
        "encoded_payload": {"action": "flag", "where": ["prompt"], "budget_ms": 3},
    },
})

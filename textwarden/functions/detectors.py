"""Detectors as column builders: text -> array of findings, each located and masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden.functions.spans import NONE, finding, let, luhn, mask, shannon, spans

# Published key formats and the phrasings the engine looks for.
SHAPES = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}\b",
    "stripe_key": r"\b(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "openai_key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b",
    "private_key_header": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
}
#: What a key of each shape begins with, and its least length.
STARTS = {
    "aws_access_key": (("AKIA", "ASIA"), 20),
    "github_token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), 40),
    "slack_token": (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), 15),
    "stripe_key": (("sk_live_", "sk_test_", "pk_live_", "pk_test_", "rk_live_", "rk_test_"), 24),
    "google_api_key": (("AIza",), 39),
    "openai_key": (("sk-",), 23),
    "private_key_header": (("-----BEGIN ",), 27),
    "jwt": (("eyJ",), 29),
}
RUN = r"[A-Za-z0-9+/=_\-]{24,}"
EMAIL = r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
OVERRIDE = (
    r"\bignore\s{1,4}(?:all\s{1,4}|any\s{1,4}|the\s{1,4})?(?:previous|prior|above|earlier)\s{1,4}(?:instruction|instructions|prompt|prompts|rule|rules|direction|directions)\b",
    r"\bdisregard\s{1,4}(?:all\s{1,4}|any\s{1,4}|the\s{1,4})?(?:previous|prior|above|earlier)\b",
    r"\bforget\s{1,4}(?:everything|all)\s{1,4}(?:you|that|above)\b",
    r"\byou\s{1,4}are\s{1,4}(?:now|actually)\s{1,4}(?:a|an|in)\b",
    r"\bnew\s{1,4}(?:instructions|system\s{1,4}prompt|rules)\s{0,4}:",
    r"\b(?:developer|debug|god|admin)\s{1,4}mode\s{1,4}(?:on|enabled|activated)\b",
)
EXFILTRATION = (
    r"\b(?:repeat|print|show|reveal|output|display|echo)\s{1,4}(?:me\s{1,4})?(?:your|the)\s{1,4}(?:system\s{1,4})?(?:prompt|instructions|rules|directive)\b",
    r"\bwhat\s{1,4}(?:were|are)\s{1,4}your\s{1,4}(?:original\s{1,4})?instructions\b",
    r"\brepeat\s{1,4}(?:everything|the\s{1,4}text)\s{1,4}above\b",
    r"\b(?:base64|rot13|hex)\s{0,4}(?:encode|encoded)?\s{0,4}(?:your|the)\s{1,4}(?:system\s{1,4})?(?:prompt|instructions)\b",
    r"\bbegin\s{1,4}your\s{1,4}(?:reply|response|answer)\s{1,4}with\s{1,4}(?:your|the)\s{1,4}(?:system\s{1,4})?(?:prompt|instructions)\b",
)
BITS, ECHO_SPAN, ECHO_STRIDE = 3.6, 40, 8


def secret_pattern(text: Column) -> Column:
    """Key shapes at high confidence; other runs of high entropy, at low, unless they begin within a key."""
    shaped = F.when(text.rlike("|".join(SHAPES.values())), F.flatten(F.array(*[_shape(text, label, p) for label, p in SHAPES.items()]))).otherwise(F.array()).cast(NONE)

    def both(keys):
        free = F.filter(spans(text, RUN), lambda s: ~F.exists(keys, lambda c: (c["start"] <= s["start"]) & (s["start"] < c["end_pos"])))
        bits = F.transform(free, lambda s: F.struct(s.alias("s"), shannon(s["value"]).alias("bits")))
        loose = F.transform(F.filter(bits, lambda x: x["bits"] >= BITS), lambda x: finding("secret_pattern", x["s"], mask(x["s"]["value"]), "low", F.format_string("%.2f bits a character over %d characters", x["bits"], F.length(x["s"]["value"]))))
        return F.concat(keys, loose.cast(NONE))

    return let(shaped, both)


def _shape(text: Column, label: str, pattern: str) -> Column:
    return F.transform(spans(text, pattern), lambda s: finding("secret_pattern", s, mask(s["value"]), "high", f"has the published shape of a {label}")).cast(NONE)


def pii_email(text: Column) -> Column:
    return F.transform(spans(text, EMAIL, F.contains(text, F.lit("@"))), lambda s: finding("pii_email", s, mask(s["value"], 2), "high", "an address")).cast(NONE)


def pii_card(text: Column) -> Column:
    # without word bounds the engine is faster, and nearly all texts end there
    kept = F.filter(spans(text, "(?U)" + CARD, text.rlike(r"\p{Nd}(?:[ -]?\p{Nd}){12}")), lambda s: luhn(s["value"]))
    return F.transform(kept, lambda s: finding("pii_card", s, mask(F.regexp_replace(s["value"], "[ -]", ""), 6), "high", "digits that pass the Luhn check")).cast(NONE)


def _first_of_each(text: Column, patterns: tuple[str, ...], detector: str, confidence: str, note: str) -> Column:
    def one(p: str) -> Column:
        p = "(?iuU)" + p
        value = F.regexp_extract(text, p, 0)
        start = F.length(F.element_at(F.split(text, p, 2), 1))
        s = F.struct(start.alias("start"), (start + F.length(value)).alias("end_pos"))
        return F.when(text.rlike(p), finding(detector, s, mask(value, 24), confidence, note))

    found = F.filter(F.array(*[one(p) for p in patterns]), lambda x: x.isNotNull())
    return F.when(text.rlike("(?iuU)" + "|".join(patterns)), found).otherwise(F.array()).cast(NONE)


def injection_override(text: Column) -> Column:
    return _first_of_each(text, OVERRIDE, "injection_override", "medium", "asks to disregard instructions")


def injection_exfiltration(text: Column) -> Column:
    return _first_of_each(text, EXFILTRATION, "injection_exfiltration", "high", "asks for the instructions")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or not c.isascii() else f"\\x{ord(c):02x}" for c in text)


def system_prompt_echo(text: Column, prompt: str) -> Column:
    """The first window of the prompt that the text holds in any case, at its first place."""
    windows = [prompt[at : at + ECHO_SPAN] for at in range(0, len(prompt) - ECHO_SPAN + 1, ECHO_STRIDE)]
    if not windows:
        return F.array().cast(NONE)

    def one(i: int, window: str) -> Column:
        p = "(?iu)" + _quoted(window)
        start, value = F.length(F.element_at(F.split(text, p, 2), 1)), F.regexp_extract(text, p, 0)
        s = F.struct(start.alias("start"), (start + F.length(value)).alias("end_pos"))
        return F.when(text.rlike(p), finding("system_prompt_echo", s, mask(value, 16), "high", f"{ECHO_SPAN} characters of the prompt from offset {i * ECHO_STRIDE}"))

    found = F.array(F.coalesce(*[one(i, w) for i, w in enumerate(windows)]))
    return F.when(text.rlike("(?iu)" + "|".join(map(_quoted, windows))), found).otherwise(F.array()).cast(NONE)


def encoded_payload(text: Column, decoded: Column) -> Column:
    s = F.struct(F.lit(0).alias("start"), F.length(text).alias("end_pos"))
    one = finding("encoded_payload", s, mask(F.try_element_at(decoded, F.lit(1)), 24), "medium", F.format_string("%d segment(s) decoded to text", F.size(decoded)))
    return F.when(F.size(decoded) > 0, F.array(one)).otherwise(F.array()).cast(NONE)


REGISTRY = {
    "secret_pattern": secret_pattern, "pii_email": pii_email, "pii_card": pii_card, "injection_override": injection_override,
    "injection_exfiltration": injection_exfiltration, "system_prompt_echo": system_prompt_echo, "encoded_payload": encoded_payload,
}


def detect(name: str, text: Column, *, system_prompt: str = "", decoded: Column | None = None) -> Column:
    if name not in REGISTRY:
        raise KeyError(f"no detector {name!r}; there are {', '.join(sorted(REGISTRY))}")
    if name == "system_prompt_echo":
        return system_prompt_echo(text, system_prompt)
    if name == "encoded_payload":
        return encoded_payload(text, F.array().cast("array<string>") if decoded is None else decoded)
    return REGISTRY[name](text)

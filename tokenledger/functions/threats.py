"""Injection phrases and secrets in text, as arrays of findings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pii import contains_any
from .text import entropy


class Rule(NamedTuple):
    """``needles`` are searched in the lower-cased text before the pattern is tried."""

    name: str
    regex: str
    severity: str
    needles: tuple[str, ...]


# Injection rules.
INJECTION_RULES = (
    Rule("Ignore Instructions", r"(?i)ignore (all )?(previous|prior) instructions", "high", ("ignore ",)),
    Rule("System Override", r"(?i)you are now (a|an) (admin|system|root|developer)", "critical", ("you are now a",)),
    Rule("DAN Mode", r"(?i)do anything now|dan mode", "high", ("do anything now", "dan mode")),
    Rule("Output Redirection", r"(?i)stop (all )?filtering|disable safety", "critical", ("filtering", "disable safety")),
    Rule("XML Escape Attempt", r"</?[a-zA-Z0-9_]+>", "medium", ("<",)),
    Rule(
        "Roleplay Jailbreak",
        r"(?i)let's play a game|hypothetically speaking",
        "medium",
        ("let's play a game", "hypothetically speaking"),
    ),
)

# Secret rules.
SECRET_RULES = (
    Rule("Generic API Key", r"(?i)key-[a-zA-Z0-9]{32,}", "high", ("key-",)),
    Rule("AWS Access Key", r"AKIA[0-9A-Z]{16}", "critical", ("akia",)),
    Rule("AWS Secret Key", r"(?i)aws_secret_access_key", "critical", ("aws_secret_access_key",)),
    Rule("Stripe API Key", r"sk_test_[0-9a-zA-Z]{24}|sk_live_[0-9a-zA-Z]{24}", "critical", ("sk_test_", "sk_live_")),
    Rule("GitHub Token", r"ghp_[a-zA-Z0-9]{36}", "high", ("ghp_",)),
    Rule("Google API Key", r"AIza[0-9A-Za-z\-_]{35}", "high", ("aiza",)),
    Rule(
        "Slack Webhook",
        r"https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+",
        "medium",
        ("https://hooks.slack.com/",),
    ),
)

# The rule for unknown keys.
TOKEN_RUN = r"[a-zA-Z0-9/+]{32,}+"
_RUN_LENGTH = 32
ENTROPY_LIMIT = 4.0
ENTROPY_NAME = "High Entropy Token"
ENTROPY_TEXT = "High-entropy string detected (likely a key or token)."
# Sums of logarithms are exact only up to rounding; 4.0 itself must not count as above the limit.
_ENTROPY_SLACK = 1e-9

FINDING = "struct<type:string,name:string,severity:string,description:string,match:string>"
_NONE = f"cast(array() as array<{FINDING}>)"


def _finding(kind: str, name: str, severity: str, description: str, match: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(name).alias("name"),
        F.lit(severity).alias("severity"),
        F.lit(description).alias("description"),
        match.cast("string").alias("match"),
    )


def _fires(rule: Rule, content: Column, lowered: Column) -> Column:
    return contains_any(lowered, rule.needles) & F.rlike(content, F.lit(rule.regex))


def injection_findings(content: Column, lowered: Column) -> Column:
    """One finding per injection rule that fires."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    _fires(r, content, lowered),
                    _finding(
                        "injection",
                        r.name,
                        r.severity,
                        f"Potential injection pattern detected: {r.name}",
                        F.lit(None),
                    ),
                )
                for r in INJECTION_RULES
            ]
        )
    )


def entropy_tokens(content: Column) -> Column:
    """Runs of 32 or more key characters whose entropy is above the limit.

    Only a text with a long word between spaces can hold one, which is far cheaper to see than to search for.
    """
    runs = F.regexp_extract_all(content, F.lit(TOKEN_RUN), F.lit(0))
    long_word = F.exists(F.split(content, " "), lambda word: F.length(word) >= _RUN_LENGTH)
    return F.filter(
        F.when(long_word, runs).otherwise(F.expr("cast(array() as array<string>)")),
        lambda t: entropy(t) > ENTROPY_LIMIT + _ENTROPY_SLACK,
    )


def secret_findings(content: Column, lowered: Column) -> Column:
    """First match per secret rule (only its first 4 characters are kept), then one finding per random-looking run."""
    rules = F.array_compact(
        F.array(
            *[
                F.when(
                    _fires(r, content, lowered),
                    _finding(
                        "secret",
                        r.name,
                        r.severity,
                        f"Potential secret detected: {r.name}",
                        F.concat(
                            F.substring(F.regexp_extract(content, r.regex, 0), 1, 4),
                            F.lit("..."),
                        ),
                    ),
                )
                for r in SECRET_RULES
            ]
        )
    )
    runs = F.transform(
        entropy_tokens(content),
        lambda _: _finding("secret", ENTROPY_NAME, "medium", ENTROPY_TEXT, F.lit(None)),
    )
    return F.when(content.isNull(), F.expr(_NONE)).otherwise(F.concat(rules, runs))


def is_threat(findings: Column) -> Column:
    """True for an injection of high or critical severity, or a critical secret."""
    return F.exists(
        findings,
        lambda f: (f["severity"] == "critical") | ((f["type"] == "injection") & (f["severity"] == "high")),
    )


REDACTED = "[SECRET_REDACTED]"
_KEY = "[a-zA-Z0-9/+_-]"


def mask_secrets(content: Column, lowered: Column) -> Column:
    """Replace every secret by ``[SECRET_REDACTED]``, with the whole run of key characters it stands in.

    A rule of fixed length thus leaves no tail of a longer key. Runs are entered at their start only, so that a long one
    is read once. Random-looking runs of the original text follow, the longest first, as one may begin another.
    """
    masked = content
    for r in SECRET_RULES:
        whole = f"(?<!{_KEY}){_KEY}*?(?:{r.regex}){_KEY}*"
        masked = F.when(contains_any(lowered, r.needles), F.regexp_replace(masked, whole, REDACTED)).otherwise(masked)
    longest_first = F.array_sort(F.transform(F.array_distinct(entropy_tokens(content)), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.aggregate(longest_first, masked, lambda text, x: F.replace(text, x["t"], F.lit(REDACTED)))

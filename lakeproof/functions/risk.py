"""Risk score, bands and priorities of findings (F-18, P-03 to P-10, P-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round_half_up

# Weights, tables and word lists that scores depend on.
WEIGHTS = (("severity", 0.30), ("exposure", 0.20), ("criticality", 0.15), ("missing", 0.15), ("signal", 0.10), ("flow", 0.05), ("volatility", 0.05))
SEVERITY = {"CRITICAL": 100, "HIGH": 75, "MEDIUM": 50, "LOW": 25}
GUARDED = ("missing-auth-test", "security-finding-unprotected")
MONEY_CORE = ("payment", "wallet", "transfer", "refund", "debit", "charge")
MONEY = (*MONEY_CORE, "fund", "payout")
AUTH_CORE = ("auth", "login", "token")
AUTH = (*AUTH_CORE, "oauth", "session", "password")
CRITICALITY = {
    "uncovered-endpoint": 70,
    "missing-business-rule-test": 75,
    "missing-flow-step-test": 65,
    "error-scenario-gap": 55,
    "missing-negative-test": 60,
    "missing-boundary-test": 45,
    "compatibility-risk": 70,
    "performance-risk": 60,
    "high-risk-parameter-gap": 55,
}
FLOW_IMPACT = {"uncovered-endpoint": 30, "missing-business-rule-test": 50, "security-finding-unprotected": 60, "compatibility-risk": 60}
FRAMEWORKS = {
    "typescript": ("jest", "supertest"),
    "javascript": ("jest", "supertest"),
    "java": ("junit", "testng", "rest-assured", "spring-mockmvc"),
    "kotlin": ("kotest", "junit", "ktor-test"),
    "python": ("pytest", "httpx", "requests"),
    "ruby": ("rspec", "minitest", "rails-request-specs"),
    "cucumber": ("cucumber", "gherkin"),
}


def has_any(path: Column, words: tuple[str, ...]) -> Column:
    """True if the lower-cased path contains one of the words; null paths have none."""
    return F.coalesce(F.lower(path).rlike("|".join(words)), F.lit(False))


def _lookup(key: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def is_money(path: Column) -> Column:
    """F-18."""
    return has_any(path, MONEY)


def is_auth(path: Column) -> Column:
    """F-18."""
    return has_any(path, AUTH)


def severity_weight(severity: Column) -> Column:
    """P-03: unknown severities weigh as low."""
    return _lookup(F.upper(severity), SEVERITY, 25)


def exposure_weight(category: Column, path: Column) -> Column:
    """P-04: internal paths are tested before authentication ones."""
    return (
        F.when(category.isin(*GUARDED), 80)
        .when(has_any(path, ("admin", "internal")), 30)
        .when(has_any(path, AUTH_CORE) | has_any(path, ("payment", "wallet", "transfer")), 90)
        .otherwise(50)
    )


def criticality_weight(category: Column, path: Column) -> Column:
    """P-05."""
    return (
        F.when(category.isin(*GUARDED), 90)
        .when(has_any(path, MONEY_CORE), 95)
        .when(has_any(path, AUTH_CORE), 90)
        .when(has_any(path, ("profile", "account", "user")), 50)
        .otherwise(_lookup(category, CRITICALITY, 40))
    )


def flow_weight(category: Column, path: Column) -> Column:
    """P-06."""
    return F.when((category == "missing-flow-step-test") | has_any(path, ("payment", "checkout", "signup")), 80).otherwise(_lookup(category, FLOW_IMPACT, 20))


def score(severity: Column, category: Column, path: Column, zero_coverage: Column, signal: Column, overrides: dict[str, Column] | None = None) -> Column:
    """P-07: 0 to 100. The terms are added in the order of WEIGHTS, so doubles agree; overrides replace single components."""
    parts = {
        "severity": severity_weight(severity),
        "exposure": exposure_weight(category, path),
        "criticality": criticality_weight(category, path),
        "missing": F.when(zero_coverage, 100).otherwise(75),
        "signal": F.when(signal, 100).otherwise(0),
        "flow": flow_weight(category, path),
        "volatility": F.lit(40),
    }
    total = None
    for name, weight in WEIGHTS:
        part = F.coalesce((overrides or {}).get(name, F.lit(None)), parts[name]).cast("double") * F.lit(weight)
        total = part if total is None else total + part
    return F.least(F.lit(100), F.greatest(F.lit(0), round_half_up(total))).cast("int")


def band(score_: Column) -> Column:
    """P-08: cut-offs 75, 50, 25, unlike those of the priority."""
    return F.when(score_ >= 75, "Critical").when(score_ >= 50, "High").when(score_ >= 25, "Moderate").otherwise("Low")


def priority(score_: Column, must_lift: Column | None = None) -> Column:
    """P-09: cut-offs 85, 70, 50; whatever must be lifted is P1 at least."""
    plain = F.when(score_ >= 85, "P0").when(score_ >= 70, "P1").when(score_ >= 50, "P2").otherwise("P3")
    return plain if must_lift is None else F.when(F.coalesce(must_lift, F.lit(False)) & plain.isin("P2", "P3"), "P1").otherwise(plain)


def priority_band(priority_: Column) -> Column:
    """Band of a priority in metrics, a scale of its own."""
    return _lookup(priority_, {"P0": "Critical", "P1": "High", "P2": "Moderate"}, "Low")


def normal_severity(severity: Column) -> Column:
    """P-16."""
    upper = F.upper(severity)
    return F.when(upper.isin("CRITICAL", "HIGH", "MEDIUM"), upper).otherwise("LOW")


def framework_hints(languages: Column) -> Column:
    """P-10: test frameworks of an array of languages, each once, in order."""
    table = F.create_map(*[x for k, v in FRAMEWORKS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    found = F.flatten(F.transform(languages, lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), F.array().cast("array<string>"))))
    return F.array_distinct(found)

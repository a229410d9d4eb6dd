"""Findings and recommendations from coverage details (D-07, D-08, U-01, U-05, A-14, A-15, T-01, J-25, P-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.numeric import round_half_up
from .keys import first_by, running_best, union_all

# The test type that each category asks for.
TEST_TYPES = {
    "uncovered-endpoint": "positive-api-test",
    "missing-negative-test": "negative-api-test",
    "missing-auth-test": "auth-test",
    "missing-boundary-test": "boundary-test",
    "missing-business-rule-test": "business-rule-test",
    "missing-flow-step-test": "integration-flow-test",
    "security-finding-unprotected": "security-test",
    "high-risk-parameter-gap": "negative-api-test",
    "compatibility-risk": "compatibility-test",
    "performance-risk": "performance-test",
    "error-scenario-gap": "negative-api-test",
}
FIELDS = ("source", "category", "severity", "title", "description", "method", "path", "zero_coverage", "ord")


def _findings(rows: DataFrame, source: str, category: str, severity: Column, title: Column, description: Column, zero: bool = False) -> DataFrame:
    """Rows (…, method, path, ord) as findings; missing method and path columns are null."""
    have = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.lit(source).alias("source"), F.lit(category).alias("category"), severity.alias("severity"), title.alias("title"), description.alias("description"), have("method").alias("method"), have("path").alias("path"), F.lit(zero).alias("zero_coverage"), "ord"
    )


def _open(items: DataFrame) -> DataFrame:
    return items.filter(~F.coalesce("covered", F.lit(False)))


def _named(*first: str) -> Column:
    return F.coalesce(*first, F.lit("unknown"))


def endpoint_findings(items: DataFrame) -> DataFrame:
    """Uncovered endpoints (method, path, covered, ord); those that move money are graver."""
    severity = F.when(risk.is_money(F.col("path")), "HIGH").otherwise("MEDIUM")
    title = F.concat(F.lit("Uncovered endpoint: "), F.coalesce("method", F.lit("UNKNOWN")), F.lit(" "), F.coalesce("path", F.lit("/")))
    return _findings(_open(items), "coverage-gap-analysis", "uncovered-endpoint", severity, title, F.concat_ws(" ", F.lit("Endpoint"), "method", "path", F.lit("has no test coverage.")), True)


def error_findings(items: DataFrame) -> DataFrame:
    """Items (method, path, covered, codes, ord) with documented codes and no test."""
    bare = _open(items).filter(F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0)
    title = F.concat(F.lit("Missing error scenario tests for "), F.coalesce("path", F.lit("endpoint")))
    text = F.concat(F.lit("Error codes "), F.array_join("codes", ", "), F.lit(" are documented but have no matching test."))
    return _findings(bare, "error-coverage", "error-scenario-gap", F.lit("MEDIUM"), title, text)


def business_findings(items: DataFrame) -> DataFrame:
    """Rules (name, covered, ord) without a test."""
    text = F.concat(F.lit('Business rule "'), _named("name"), F.lit('" has no test coverage.'))
    return _findings(_open(items), "business-coverage", "missing-business-rule-test", F.lit("MEDIUM"), F.concat(F.lit("Uncovered business rule: "), _named("name")), text)


def flow_findings(steps: DataFrame) -> DataFrame:
    """Steps (flow, name, covered, ord) without a test."""
    title = F.concat(F.lit("Uncovered flow step: "), _named("name"), F.lit(" in "), F.coalesce("flow", F.lit("flow")))
    text = F.concat(F.lit('Integration flow step "'), _named("name"), F.lit('" has no test coverage.'))
    return _findings(_open(steps), "integration-flow", "missing-flow-step-test", F.lit("MEDIUM"), title, text)


def security_findings(items: DataFrame) -> DataFrame:
    """Controls (name, method, path, covered, ord) without a test."""
    where = _named("path", "name")
    return _findings(_open(items), "security-coverage", "missing-auth-test", F.lit("HIGH"), F.concat(F.lit("Missing auth/security test: "), where), F.concat(F.lit("Security scenario for "), where, F.lit(" has no test coverage.")))


def scan_findings(found: DataFrame) -> DataFrame:
    """Scanner findings (severity, title, description, method, path, ord)."""
    return _findings(found, "security-scan", "security-finding-unprotected", risk.normal_severity(F.col("severity")), F.concat(F.lit("Scanner finding: "), "title"), F.coalesce("description", "title"))


def parameter_findings(items: DataFrame) -> DataFrame:
    """Parameters (name, method, path, covered, missing, ord): one finding for missing boundary tests, one for missing invalid input."""
    parts = []
    for kind, category, what, title in (
        ("boundary", "missing-boundary-test", "boundary value", "Missing boundary tests for parameter: "),
        ("invalid", "high-risk-parameter-gap", "invalid input", "Missing invalid-input tests for parameter: "),
    ):
        rows = _open(items).filter(F.array_contains("missing", kind))
        text = F.concat(F.lit('Parameter "'), _named("name"), F.lit(f'" is missing {what} test coverage.'))
        parts.append(_findings(rows, "parameter-coverage", category, F.lit("MEDIUM"), F.concat(F.lit(title), _named("name")), text))
    return union_all(*parts)


def compatibility_findings(changes: DataFrame) -> DataFrame:
    """Breaking changes (description, method, path, breaking, ord)."""
    title = F.concat(F.lit("Breaking change risk: "), F.coalesce("description", F.lit("API contract change")))
    text = F.coalesce("description", F.lit("A breaking API change was detected with no contract test."))
    return _findings(changes.filter("breaking"), "compatibility", "compatibility-risk", F.lit("HIGH"), title, text)


def performance_findings(items: DataFrame) -> DataFrame:
    """Items (name, method, path, covered, has_threshold, resilience, ord): up to two findings each."""
    where = _named("path", "name")
    slow = _findings(_open(items).filter("has_threshold"), "performance-resilience", "performance-risk", F.lit("MEDIUM"), F.concat(F.lit("Missing performance test: "), where), F.lit("Endpoint has performance thresholds defined but no performance test exists."))
    weak = _findings(_open(items).filter("resilience"), "performance-resilience", "performance-risk", F.lit("MEDIUM"), F.concat(F.lit("Missing resilience test: "), where), F.lit("Resilience scenario has no test coverage."))
    return slow.unionByName(weak)


def distinct_findings(*parts: DataFrame) -> DataFrame:
    """U-01, U-05: all findings, of equal category, method, path and title the first; a missing method equals a missing method."""
    ranked = union_all(*[p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
    blank = lambda c: F.coalesce(c, F.lit(""))
    keyed = ranked.withColumns({"_m": blank("method"), "_p": blank("path")})
    first = first_by(keyed, ["category", "_m", "_p", "title"], ["part", "ord"]).drop("_m", "_p")
    return first.withColumn("id", F.concat_ws("-", F.lit("ff"), F.col("part").cast("string"), F.col("ord").cast("string"), F.hex(F.xxhash64("category", "title"))))


def recommendations(found: DataFrame) -> DataFrame:
    """D-08, A-14, T-01: (test_type, method, path, title, score, band, priority, confidence, linked), of equal test type and
    endpoint the best score, with the ids of the findings that raised it. Order by score descending, then first_ord."""
    category, path = F.col("category"), F.col("path")
    signal = (F.col("source") == "security-scan") | category.isin(*risk.GUARDED)
    score = risk.score(F.col("severity"), category, path, F.col("zero_coverage"), signal)
    lifted = ((F.col("severity") == "CRITICAL") & signal) | risk.is_money(path) | category.isin(*risk.GUARDED) | (F.col("zero_coverage") & (risk.criticality_weight(category, path) >= 75))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TEST_TYPES.items() for x in kv]), category), F.lit("positive-api-test"))
    rows = found.select(
        "id", (F.col("part").cast("long") * 1_000_000_000 + F.col("ord")).alias("_ord"), kind.alias("test_type"), F.coalesce("method", F.lit("")).alias("method"), F.coalesce("path", F.lit("")).alias("path"),
        F.concat(F.lit("Add "), F.regexp_replace(kind, "-", " "), F.lit(" for: "), "title").alias("title"), score.alias("score"), risk.band(score).alias("band"), risk.priority(score, lifted).alias("priority"),
        F.when(signal | F.col("zero_coverage"), "high").otherwise("medium").alias("confidence"),
    )
    best = running_best(rows, ["test_type", "method", "path"], "score", "_ord", "id")
    return best.select("test_type", "method", "path", "title", "score", "band", "priority", "confidence", "linked", "first_ord")


def summary(found: DataFrame, recs: DataFrame) -> DataFrame:
    """A-15: one row of counts, the highest and the mean score, and the five gravest titles."""
    n = F.count("*")
    a = found.agg(n.alias("findings"), *[F.count_if(F.upper("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])
    b = recs.agg(n.alias("recommendations"), *[F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P0", "P1", "P2", "P3")], F.coalesce(F.max("score"), F.lit(0)).alias("max_score"), F.coalesce(round_half_up(F.avg("score")), F.lit(0)).alias("avg_score"))
    top = recs.orderBy(F.desc("score"), "first_ord").limit(5)  # five rows
    c = top.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "first_ord", "title"))), lambda x: x["title"]).alias("top"))
    one = lambda d: d.withColumn("_one", F.lit(1))  # noqa: E731  each side is a single row
    return one(a).join(one(b), "_one").join(one(c), "_one").drop("_one")


def with_findings(recs: DataFrame, found: DataFrame) -> DataFrame:
    """J-25: (title, finding): each recommendation with the findings it links to, by equi join."""
    return recs.select("title", F.explode("linked").alias("id")).join(found.select("id", F.col("title").alias("finding")), "id").drop("id")

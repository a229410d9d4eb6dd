"""Summaries, lists and filters of reports (A-13, A-20, A-21, A-25, D-06, D-11, F-20, P-18, R-03, T-04, T-07, T-09, T-11, U-08, K-09)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.risk import band
from .keys import last_by

# Test layers and severities, in their order.
LAYERS = ("unit", "component", "integration", "api", "e2e", "performance", "security")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def pipeline_summary(mappings: DataFrame, classifications: DataFrame) -> DataFrame:
    """A-13: one row of counts over endpoint mappings (item_type, coverage_class, confidence, assertion_source, linked_tests,
    conflicts) and a map of tests (layer) by layer, zero-filled. Null arrays are empty; a null class is not uncovered."""
    each = lambda c: F.coalesce(F.size(c), F.lit(0))
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    counts = mappings.filter("item_type = 'endpoint'").agg(
        F.count("*").alias("total"),
        F.count_if(~is_("coverage_class", "uncovered")).alias("covered"),
        F.count_if(is_("confidence", "verified")).alias("verified"),
        F.count_if(is_("coverage_class", "uncovered")).alias("uncovered"),
        F.count_if(is_("coverage_class", "mock-covered")).alias("mock_limited"),
        F.count_if(is_("assertion_source", "unresolved") & (F.greatest(each("linked_tests"), F.lit(0)) > 0)).alias("unresolved"),
        F.coalesce(F.sum(F.greatest(each("conflicts"), F.lit(0))), F.lit(0)).cast("long").alias("n_conflicts"),
    )
    layers = classifications.groupBy("layer").agg(F.count("*").alias("n")).filter("layer is not null")
    domain = mappings.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    filled = domain.join(layers, "layer", "full_outer").agg(F.map_from_entries(F.collect_list(F.struct("layer", F.coalesce("n", F.lit(0))))).alias("by_layer"))
    return counts.withColumn("_one", F.lit(1)).join(filled.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def grouped(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """A-20, A-21: rows with their `group` and `group_ord`, the least `order` in it: sorted by group_ord and order they are the
    lists of a report, groups in order of first appearance. Rows without a group are left out. No list is gathered in one task."""
    named = rows.withColumn("group", key).filter(F.col("group").isNotNull())
    first = named.groupBy("group").agg(F.min(order).alias("group_ord"))
    return named.join(first, "group")


def risks_by_category(recommendations: DataFrame, findings: DataFrame) -> DataFrame:
    """A-20: recommendations (id, ord, linked) by the category of the first finding (id, ord, category) they link, else `unknown`."""
    links = recommendations.select(F.col("id").alias("_rec"), F.explode("linked").alias("_finding")).distinct()
    known = findings.select(F.col("id").alias("_finding"), "category", F.col("ord").alias("_ord"))
    first = links.join(known, "_finding").groupBy("_rec").agg(F.min_by("category", "_ord").alias("_category"))
    joined = recommendations.join(first, F.col("id") == F.col("_rec"), "left").drop("_rec")
    return grouped(joined, F.coalesce("_category", F.lit("unknown")), "ord").drop("_category")


def endpoint_key(method: Column, path: Column) -> Column:
    """A-20: `GET /path`, with GET for a null method; null without a path."""
    return F.when(path != "", F.concat_ws(" ", F.coalesce(method, F.lit("GET")), path))


def details_by_id(rules: DataFrame, order: str) -> DataFrame:
    """A-25: rules (id, any others) by id, the last in order of each."""
    return last_by(rules, ["id"], [order])


def lowest_coverage(results: DataFrame, n: int = 5) -> DataFrame:
    """T-04: the n results (type, total, covered, percent, ord) of least percentage below 100, the first in order on ties, with
    the number of items they miss."""
    return results.filter("percent < 100").withColumn("missing", F.col("total") - F.col("covered")).orderBy("percent", "ord").limit(n)


def gaps(total: Column, covered: Column, endpoints: Column, uncovered: Column, flows: Column, n: int = 10) -> Column:
    """T-07: up to n gaps of a result: its uncovered endpoints (structs of method and path), else its uncovered items, else its
    flows, else one sentence; none if nothing is uncovered. Of endpoints the first n are looked at, those without a path skipped."""
    tick = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    named = F.filter(F.slice(endpoints, 1, n), lambda e: F.coalesce(e["path"], F.lit("")) != "")
    method = lambda e: F.upper(F.coalesce(e["method"], F.lit("")))
    paths = F.transform(named, lambda e: tick(F.when(method(e) == "", e["path"]).otherwise(F.concat_ws(" ", method(e), e["path"]))))
    some = lambda a: F.when(F.size(a) > 0, a)
    listed = lambda c: some(F.transform(F.slice(c, 1, n), tick))
    rest = F.concat((total - covered).cast("string"), F.lit(" item(s) not covered"))
    return F.when(total <= covered, F.array().cast("array<string>")).otherwise(F.coalesce(some(paths), listed(uncovered), listed(flows), F.array(rest)))


def matching(rows: DataFrame, chosen: Mapping[str, str], endpoint: str = "", score: str = "score") -> DataFrame:
    """F-20: rows whose columns have the chosen values; `all` leaves a column open, `band` is the band of the score, an array
    column must contain the value, and endpoint is looked for in the lower-cased path."""
    out = rows
    for name, value in chosen.items():
        if value == "all":
            continue
        if name == "band":
            out = out.filter(band(F.col(score)) == value)
        elif dict(rows.dtypes)[name].startswith("array"):
            out = out.filter(F.array_contains(name, value))
        else:
            out = out.filter(F.col(name) == value)
    return out.filter(F.contains(F.lower(F.coalesce("path", F.lit(""))), F.lit(endpoint.lower()))) if endpoint else out


def sorted_by(rows: DataFrame, column: str, direction: str, order: str) -> DataFrame:
    """T-09: rows by a numeric column, ties in order."""
    return rows.orderBy(F.desc(column) if direction == "desc" else F.asc(column), order)


def first_files(files: DataFrame, n: int, by: Sequence[str], order: str) -> DataFrame:
    """T-11: the first n files of each group."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(order))
    return files.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def snippet(text: Column, n: int = 200) -> Column:
    """T-11."""
    return F.substring(text, 1, n)


def security_analysis(counts: DataFrame, gate_passed: bool | None, categories: Sequence[str], scanners: Sequence[str]) -> DataFrame:
    """D-11: rows (part, ord, sentence) of the analysis that stands in for a model, from zero-filled counts (dimension, value, n)
    of severities and categories. Categories without findings are not named; a gate that was not evaluated counts as passed."""
    of = lambda d, v: F.coalesce(F.sum(F.when((F.col("dimension") == d) & (F.col("value") == v), F.col("n"))), F.lit(0))
    row = counts.agg(*[of("severity", s).alias(s) for s in SEVERITIES], *[of("category", c).alias("category_" + c) for c in categories], F.coalesce(F.sum(F.when(F.col("dimension") == "severity", F.col("n"))), F.lit(0)).alias("_total"))
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    passed = gate_passed is not False
    if passed:
        summary = text("Security scan completed with ", F.col("_total"), " finding(s). No critical or high findings exceed gate thresholds.")
        actions = ("Review all remaining findings and assign remediation owners.", "Consider tightening gate thresholds to catch more issues.")
    else:
        summary = text("Security gate FAILED. ", F.col("CRITICAL") + F.col("HIGH"), " critical/high severity finding(s) require immediate remediation before this change can be merged.")
        actions = ("Fix all CRITICAL and HIGH findings before merging.", "Re-run security scan to confirm fixes.", "Review scanner configurations to reduce false positives.")
    sentences = [("summary", summary), ("finding", text("Total findings: ", F.col("_total")))]
    sentences += [("finding", text(s.capitalize() + ": ", F.col(s))) for s in SEVERITIES] + [("finding", F.lit("Scanners run: " + ", ".join(scanners)))]
    tails = {"CRITICAL": " CRITICAL finding(s) must be fixed immediately", "HIGH": " HIGH finding(s) pose significant risk", "MEDIUM": " MEDIUM finding(s) should be addressed soon"}
    sentences += [("risk", F.when(F.col(s) > 0, text(F.col(s), tail))) for s, tail in tails.items()]
    named = F.concat_ws(", ", *[F.when(F.col(f"`category_{c}`") > 0, F.lit(c)) for c in categories])
    sentences += [("cause", F.when(named != "", text("Findings span categories: ", named)))] + [("action", F.lit(a)) for a in actions]
    every = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(k).alias("ord"), s.alias("sentence")) for k, (part, s) in enumerate(sentences)])
    return row.select(F.inline(every)).filter("sentence is not null")


# Alert, metric, label and value (or none), labels that are summed up by service, test, bound, severity.
ALERTS = (
    ("ApiCoverageRatioLow", "api_coverage_ratio", None, False, "<", 0.8, "warning"),
    ("ApiCoverageThresholdBreached", "api_coverage_threshold_failure", None, False, "=", 1.0, "critical"),
    ("ApiErrorCoverageZero", "api_coverage_ratio", ("coverage_type", "error"), False, "=", 0.0, "critical"),
    ("ApiSecurityCoverageZero", "api_coverage_ratio", ("coverage_type", "security"), False, "=", 0.0, "critical"),
    ("SecurityGateFailed", "api_security_gate_passed", None, False, "=", 0.0, "critical"),
    ("SecurityCriticalFindingsDetected", "api_security_findings_total", ("severity", "CRITICAL"), True, ">", 0.0, "critical"),
    ("SecurityHighFindingsDetected", "api_security_findings_total", ("severity", "HIGH"), True, ">", 0.0, "warning"),
    ("SecuritySecretsDetected", "api_security_findings_total", ("category", "secret"), True, ">", 0.0, "critical"),
)


def firing(gauges: DataFrame, now: Column | None = None) -> DataFrame:
    """R-03: alerts (alert, severity, service, labels, value) that latest gauges (metric, labels map, value) set off.

    Summed alerts are one for each service. With now, in seconds, scans over a day old are told of too. Drops and rises over an
    hour are load.change_over of the samples, compared with their bound.
    """
    service = F.try_element_at("labels", F.lit("service"))
    wanted = F.array(*[F.when((F.col("metric") == metric) & (F.lit(True) if not label else F.coalesce(F.try_element_at("labels", F.lit(label[0])) == label[1], F.lit(False))), F.struct(F.lit(name).alias("alert"), F.lit(summed).alias("summed"))) for name, metric, label, summed, *_ in ALERTS])
    each = gauges.select(F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("_a"), service.alias("service"), "labels", "value").select("_a.*", "service", "labels", "value")
    sums = each.filter("summed").groupBy("alert", "service").agg(F.sum("value").alias("value"))
    sums = sums.select("alert", "service", F.create_map().cast("map<string,string>").alias("labels"), "value")
    rows = each.filter("not summed").select("alert", "service", "labels", "value").unionByName(sums)
    test, severity = F.lit(False), F.lit(None).cast("string")
    for name, _, _, _, op, bound, level in ALERTS:
        v = F.col("value")
        test = F.when(F.col("alert") == name, v < bound if op == "<" else v > bound if op == ">" else v == bound).otherwise(test)
        severity = F.when(F.col("alert") == name, level).otherwise(severity)
    out = rows.filter(test).select("alert", severity.alias("severity"), "service", "labels", "value")
    if now is None:
        return out
    age = now - F.col("value")
    stale = gauges.filter((F.col("metric") == "api_security_scan_timestamp_seconds") & (age > 86400))
    return out.unionByName(stale.select(F.lit("SecurityScanStale").alias("alert"), F.lit("warning").alias("severity"), service.alias("service"), "labels", age.alias("value")))


def scan_manifest(files: DataFrame, order: str) -> DataFrame:
    """K-09: (kind, value, ord) rows of a scan manifest from files (path, kind, language): paths by kind and the languages, in
    order of first appearance, to be written as JSON."""
    paths = files.groupBy("kind", F.col("path").alias("value")).agg(F.min(order).alias("ord"))
    languages = files.filter("language is not null").groupBy(F.col("language").alias("value")).agg(F.min(order).alias("ord"))
    return paths.unionByName(languages.select(F.lit("language").alias("kind"), "value", "ord"))


def exit_code(passed: bool, fail_build: bool | None = None) -> int:
    """D-06: 1 if the gate failed and failing the build is not switched off."""
    return int(not passed and fail_build is not False)


def build_id(pattern: str | None, now: str, environment: Mapping[str, str]) -> str:
    """P-18: a build's name; now is an ISO time. What the environment lacks is the time; an unknown pattern names itself."""
    stamp = re.sub("[:.]", "-", now)
    if pattern in (None, "timestamp"):
        return stamp
    if pattern == "branch-timestamp":
        return re.sub("[^a-zA-Z0-9_-]", "-", environment.get("GITHUB_REF_NAME", "local")) + "-" + stamp
    variable = {"commit-sha": "GITHUB_SHA", "run-number": "GITHUB_RUN_NUMBER"}.get(pattern)
    return environment.get(variable, stamp) if variable else pattern


def merge_config(file: Mapping, overrides: Mapping) -> dict:
    """U-08: thresholds merge key by key, exclusions and test patterns are replaced (patterns by non-empty ones only), plugins
    follow one another."""
    skipped = [x.get("exclude") or {} for x in (overrides, file)]
    pick = lambda k: next((x[k] for x in skipped if x.get(k) is not None), [])
    return {
        "thresholds": {**(file.get("thresholds") or {}), **(overrides.get("thresholds") or {})},
        "exclude": {k: pick(k) for k in ("paths", "methods")},
        "testPatterns": overrides.get("testPatterns") or file.get("testPatterns") or [],
        "plugins": [*(file.get("plugins") or []), *(overrides.get("plugins") or [])],
    }

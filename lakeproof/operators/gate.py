"""Quality gates and metric evaluation (A-11, D-01 to D-04, J-29, T-05, T-06)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_regex


def branch_thresholds(branch: str, patterns: Sequence[tuple[str, Mapping[str, float]]]) -> Mapping[str, float]:
    """D-01, F-05: overrides of the first pattern that the branch fits."""
    import re

    return next((dict(v) for p, v in patterns if p == branch or re.match(glob_regex(p), branch)), {})


def threshold_of(category: Column, overrides: Mapping[str, float], by_category: Mapping[str, float], all_of_them: float | None) -> Column:
    """J-29: branch before category before global threshold. Where none applies, 100 if there are no thresholds at all, else null."""
    none_at_all = not overrides and not by_category and all_of_them is None
    if none_at_all:
        return F.lit(100.0)
    out = F.lit(all_of_them).cast("double")
    for table in (by_category, overrides):
        for k, v in table.items():
            out = F.when(category == k, F.lit(float(v))).otherwise(out)
    return out


def failures(results: DataFrame, threshold: Column) -> DataFrame:
    """D-02, D-03: results (type, percent) strictly below their threshold, with the gap to two places; null thresholds are skipped."""
    return results.withColumn("threshold", threshold).filter("percent < threshold").withColumn("gap", F.round(F.col("threshold") - F.col("percent"), 2))


def verdict(found: DataFrame, mode: str = "fail", enabled: bool = True, order: str = "type") -> DataFrame:
    """D-02: one row (passed, n_failures, worst, worst_gap). A disabled gate has no failures; mode `warn` always passes."""
    rows = found if enabled else found.limit(0)
    n = F.count("*")
    # T-05: the largest gap, the first by `order` on ties
    worst = F.min_by("type", F.struct((-F.col("gap")).alias("_gap"), F.col(order).alias("_order")))
    return rows.agg(((n == 0) | F.lit(mode == "warn")).alias("passed"), n.alias("n_failures"), worst.alias("worst"), F.max("gap").alias("worst_gap"))


def evaluate(known: DataFrame, results: DataFrame, failed: DataFrame, threshold: Column) -> DataFrame:
    """D-04: every known type and every other type with results: SKIPPED without results, N/A without items or threshold (over
    `type`), FAIL if in failed, else PASS."""
    bad = failed.select("type", F.lit(True).alias("_failed")).distinct()
    joined = known.select("type").distinct().join(results, "type", "full_outer").join(bad, "type", "left")
    status = (
        F.when(F.col("total").isNull(), "SKIPPED").when((F.col("total") == 0) | threshold.isNull(), "N/A").when(F.col("_failed"), "FAIL").otherwise("PASS")
    )
    return joined.select("type", "total", "percent", status.alias("status"))


def security_gate(findings: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """A-11: one row (passed, reasons) from counts by severity (`CRITICAL`, …) or category (`secret`, …) against their limits."""
    counts = [F.count_if((F.upper("severity") == k.upper()) | (F.lower("category") == k.lower())).alias(k) for k in limits]
    row = findings.agg(*counts)
    reasons = F.filter(F.array(*[F.when(F.col(k) > n, F.concat(F.lit(f"{k}: "), F.col(k).cast("string"), F.lit(f" > {n}"))) for k, n in limits.items()]), lambda x: x.isNotNull())
    return row.select((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))

"""Report writers (K-01 to K-06): rows of coverage results are few; they are collected once and rendered on the driver."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.keys import upsert

COLUMNS = ("type", "total", "covered", "percent")


def rows_of(results: DataFrame) -> list[dict]:
    """Coverage results, one per type, in order of type."""
    return [r.asDict() for r in results.select(*COLUMNS).orderBy("type").collect()]


def write_summary(results: DataFrame, path: str, old: DataFrame | None = None) -> DataFrame:
    """K-01, U-04: JSON summary; results of types that are not new stay."""
    merged = upsert(old, results, "type") if old is not None else results
    merged.select(*COLUMNS).coalesce(1).write.mode("overwrite").json(path)
    return merged


def write_csv(results: DataFrame, path: str) -> None:
    """K-03."""
    results.select(*COLUMNS).orderBy("type").coalesce(1).write.mode("overwrite").csv(path, header=True)


def to_html(rows: Iterable[dict]) -> str:
    """K-02."""
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in COLUMNS) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{c}</th>" for c in COLUMNS) + f"</tr>{body}</table>"


def to_junit(rows: Iterable[dict], thresholds: dict[str, float] | None = None) -> str:
    """K-04: a case per type; a percentage under its threshold, 0 by default, is a failure."""
    cases, failed = [], 0
    for r in rows:
        least = (thresholds or {}).get(r["type"], 0.0)
        bad = r["percent"] < least
        failed += bad
        inner = f'<failure message="{r["percent"]} &lt; {least}"/>' if bad else ""
        cases.append(f'<testcase name="{html.escape(r["type"], quote=True)}">{inner}</testcase>')
    return f'<testsuite name="coverage" tests="{len(cases)}" failures="{failed}">{"".join(cases)}</testsuite>'


def to_markdown(rows: Iterable[dict]) -> str:
    """K-06, D-13."""
    lines = ["| " + " | ".join(COLUMNS) + " |", "|" + " --- |" * len(COLUMNS)]
    return "\n".join(lines + ["| " + " | ".join(str(r[c]) for c in COLUMNS) + " |" for r in rows]) + "\n"


FORMATS: dict[str, Callable[[Iterable[dict]], str]] = {"html": to_html, "junit": to_junit, "markdown": to_markdown}


def render(results: DataFrame, formats: Iterable[str]) -> dict[str, str]:
    """K-05: texts by format; unknown formats are left out."""
    rows = rows_of(results)
    return {f: FORMATS[f](rows) for f in formats if f in FORMATS}


def gauges(results: DataFrame) -> DataFrame:
    """K-08: (metric, labels, value) of coverage results."""
    return results.select(F.lit("coverage_percent").alias("metric"), F.create_map(F.lit("type"), "type").alias("labels"), F.col("percent").cast("double").alias("value"))

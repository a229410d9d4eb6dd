"""Load-test metrics and service levels (A-09, D-05, J-11, W-06, A-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import round_places
from .keys import best_match


def metrics(samples: DataFrame) -> DataFrame:
    """A-09: per label of samples (label, elapsed, success): n, avg, nearest-rank p50, p95, p99, error rate, and throughput.

    Throughput is samples per busy second, not per second of the clock. Sums are decimal, so they don't depend on their order.
    """
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY elapsed)")
    total = F.sum(F.col("elapsed").cast("decimal(18,4)"))
    grouped = samples.groupBy("label").agg(
        F.count("*").alias("n"), total.cast("double").alias("busy"), disc(0.5).alias("median"), disc(0.95).alias("p95"), disc(0.99).alias("p99"), F.count_if(~F.col("success")).alias("errors")
    )
    return grouped.select(
        "label", "n", round_places(F.col("busy") / F.col("n"), 2).alias("avg"), round_places(F.col("median"), 2).alias("median"), round_places(F.col("p95"), 2).alias("p95"),
        round_places(F.col("p99"), 2).alias("p99"), round_places(F.col("errors") / F.col("n"), 4).alias("error_rate"),
        F.when(F.col("busy") == 0, 0.0).otherwise(round_places(F.col("n") / (F.nullif(F.col("busy"), F.lit(0.0)) / 1000.0), 2)).alias("throughput"),
    )


def service_level(rows: DataFrame, response_ms: float = 500.0, error_rate: float = 0.05) -> DataFrame:
    """D-05: good, needs-improvement, or missing-data where there is no median."""
    good = (F.col("median") <= response_ms) & (F.col("error_rate") <= error_rate)
    return rows.withColumn("status", F.when(F.col("median").isNull(), "missing-data").when(good, "good").otherwise("needs-improvement"))


#: Letters of a path's end by which labels are looked up.
TAIL = 8


def endpoint_metrics(endpoints: DataFrame, labels: DataFrame) -> DataFrame:
    """J-11: metrics of the label that fits an endpoint (id, method, path) best: equal to its id, else with path and method, else
    with the path; the first label in order (ord) among equals. Endpoints without a label keep nulls. labels is one row a label.

    A label that contains a path contains its last letters: labels are spelled out in pieces of up to TAIL letters and meet the
    paths' ends by an equi join before the whole path is looked for.
    """
    ends = endpoints.select("id", F.lower("method").alias("_method"), F.lower("path").alias("_path"))
    low = F.lower("label")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(0), F.lit(TAIL)), lambda n: F.substring(low, i, n))))
    spelled = labels.select("label", F.explode(F.array_distinct(pieces)).alias("_piece"))
    met = ends.join(spelled, F.right("_path", F.lit(TAIL)) == F.col("_piece")).filter(F.contains(low, F.col("_path")))
    met = met.select("id", "label", F.when(F.contains(low, F.col("_method")), 1).otherwise(2).alias("_tier"))
    named = ends.join(labels.select("label"), F.col("id") == F.col("label")).select("id", "label", F.lit(0).alias("_tier"))
    pairs = named.unionByName(met).join(labels.select("label", "ord"), "label")
    best = best_match(pairs, ["id"], "_tier", ["ord"]).select("id", "label").join(labels.drop("ord"), "label")
    return endpoints.select("id", "method", "path").join(best, "id", "left")


def change_over(series: DataFrame, by: list[str], ts: str, value: str, seconds: int = 3600, stale: int = 300) -> DataFrame:
    """W-06: `delta` of a value against the last sample that is `seconds` old, and not more than `stale` older; else null."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    w = W.partitionBy(*by).orderBy("_at").rangeBetween(-seconds - stale + 1, -seconds)
    return series.withColumn("_at", at).withColumn("delta", F.col(value) - F.last(value).over(w)).drop("_at")


def last_values(samples: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """A-24: the latest value of each gauge, the greater on ties."""
    return samples.groupBy(*by).agg(F.max_by(value, F.struct(ts, value)).alias("value"))

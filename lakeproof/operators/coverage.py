"""Coverage joins and reports (F-11 to F-15, J-01 to J-03, J-05 to J-10, A-01 to A-07, A-10, A-22, A-23)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.numeric import percent, percent_scaled, share_of_flags
from .keys import SLOT, literal_join


def match_calls(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """J-01 (R-1): (method, path, n_calls) of the calls (method, path) that fit each endpoint (method, path); uncovered ones have 0.

    Calls are counted by method and path first and then meet templates by an equi join on all literal segments; only what is left
    is tested by pattern. Neither side is assumed to be small.
    """
    counted = calls.filter(~paths.has_placeholder(F.col("path"))).groupBy(F.col("method").alias("c_method"), F.col("path").alias("c_path")).agg(F.count("*").alias("n"))
    ends = endpoints.select("method", "path").distinct().withColumn("_shape", F.regexp_replace("path", r"\{[^}]+\}", SLOT))
    joined = literal_join(counted, ends, "c_method", "c_path", "method", "_shape").filter(F.call_function("rlike", F.col("c_path"), paths.path_to_regex(F.col("path"))))
    found = joined.groupBy("method", "path").agg(F.sum("n").alias("n_calls"))
    return endpoints.select("method", "path").distinct().join(found, ["method", "path"], "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))


def coverage_summary(items: DataFrame, covered: Column, *by: str) -> DataFrame:
    """A-01, A-04: (total, covered, percent) of all items, or of each group; no items are 0 percent."""
    grouped = items.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(covered).alias("covered"))
    return grouped.withColumn("percent", percent(F.col("covered"), F.col("total")))


def template_matches(interactions: DataFrame, endpoints: DataFrame) -> DataFrame:
    """J-02, F-02: interactions (method, path) and endpoints whose templates agree but for placeholder names, by equi join."""
    left = interactions.withColumn("_key", paths.skeleton(paths.normalize(F.col("path"))))
    right = endpoints.select(F.col("method").alias("_m"), F.col("path").alias("template"), paths.skeleton(F.col("path")).alias("_k"))
    return left.join(right, (F.col("method") == F.col("_m")) & (F.col("_key") == F.col("_k"))).drop("_m", "_key", "_k")


def keyword_hit(description: Column, content: Column, keywords: Column, in_content: Column | None = None) -> Column:
    """F-11, F-12, F-14: a keyword in the lower-cased description; where in_content holds, keywords of 8 letters or more in the content too."""
    d, c = F.lower(description), F.lower(content)
    plain = F.exists(keywords, lambda k: F.contains(d, F.lower(k)))
    if in_content is None:
        return F.coalesce(plain, F.lit(False))
    return F.coalesce(plain | (in_content & F.exists(keywords, lambda k: (F.length(k) >= 8) & F.contains(c, F.lower(k)))), F.lit(False))


def requirement_coverage(requirements: DataFrame, entries: DataFrame, words: Sequence[str]) -> DataFrame:
    """J-05 to J-10: requirement ids (id, keywords) with the number of entries (description) that contain one of the keywords.

    Every text is tested once against the list `words`, the distinct keywords of all requirements, which callers bound; what it
    contains then meets the requirements by an equi join. A text counts once for a requirement. Uncovered ones have 0.
    """
    low = F.lower(F.coalesce("description", F.lit("")))
    found = entries.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.explode(F.filter(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w.lower())) for w in words]), lambda x: x.isNotNull())).alias("word"))
    wanted = requirements.select("id", F.explode("keywords").alias("k")).select("id", F.lower("k").alias("word")).distinct()
    counts = found.join(wanted, "word").select("id", "_row").distinct().groupBy("id").agg(F.count("*").alias("n_entries"))
    return requirements.select("id").join(counts, "id", "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))


def by_category(items: DataFrame, categories: str, covered: Column, domain: DataFrame) -> DataFrame:
    """A-06, A-07: totals of each category of items with an array of them; categories of the domain without items have 0."""
    each = items.select(covered.alias("_covered"), F.explode(categories).alias("category"))
    grouped = each.groupBy("category").agg(F.count("*").alias("total"), F.count_if("_covered").alias("covered"))
    joined = domain.select("category").distinct().join(grouped, "category", "left").na.fill(0, ["total", "covered"])
    return joined.withColumn("percent", percent_scaled(F.col("covered"), F.col("total")))


def flow_status(steps: DataFrame, domain: DataFrame) -> DataFrame:
    """J-09, A-05: complete, partial or missing for each flow by its steps (flow, covered); a flow of no steps is missing."""
    grouped = steps.groupBy("flow").agg(F.count("*").alias("steps"), F.count_if("covered").alias("covered"))
    joined = domain.select("flow").distinct().join(grouped, "flow", "left").na.fill(0, ["steps", "covered"])
    status = F.when(F.col("covered") == 0, "missing").when(F.col("covered") == F.col("steps"), "complete").otherwise("partial")
    return joined.withColumn("status", status)


def parameter_flags(pairs: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """J-03, A-02, A-03: flags of each parameter, true if any segment sets them, and their share."""
    grouped = pairs.groupBy(*keys).agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])
    return grouped.withColumn("ratio", share_of_flags(*[F.col(f) for f in flags]))


def zero_filled_counts(rows: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """A-10, A-22: (dimension, value, n) of each value of each dimension in one pass over the rows; values of a dimension's domain
    that no row has are 0. Nulls are left out."""
    name = lambda c: "`" + c.replace("`", "``") + "`"
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(name(d)).cast("string").alias("value")) for d in domains])
    counted = rows.select(F.inline(each)).filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    wanted = rows.sparkSession.createDataFrame([(d, v) for d, vs in domains.items() for v in vs], "dimension string, value string").distinct()
    return wanted.join(counted, ["dimension", "value"], "full_outer").na.fill(0, ["n"])


def overall(results: DataFrame) -> DataFrame:
    """A-23: the mean of the percentages of coverage results."""
    return results.agg(F.avg("percent").alias("overall"))


def with_route(lines: DataFrame, route: str, by: str, order: str, back: int = 40) -> DataFrame:
    """X-13, X-15, W-03: the nearest non-null value of `route` in the `back` lines before each line, else null."""
    before = W.partitionBy(by).orderBy(order).rowsBetween(-back, -1)
    return lines.withColumn("nearest", F.last(route, ignorenulls=True).over(before))

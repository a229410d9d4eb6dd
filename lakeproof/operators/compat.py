"""Specification diffs and consumer contracts (J-12 to J-16, A-12, U-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percent_fixed
from ..functions.paths import contract_regex
from .keys import SLOT, SLOT_PATTERN, best_match, literal_join


def endpoint_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """J-12: removed (breaking), added or common for every key of two versions; keys are unique in a version."""
    a, b = (x.select(*keys).distinct().withColumn(n, F.lit(True)) for x, n in ((old, "_old"), (new, "_new")))
    change = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("common")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"), (change == "removed").alias("breaking"))


def removed_codes(old: DataFrame, new: DataFrame, keys: list[str], codes: str) -> DataFrame:
    """J-13, U-03: response codes (arrays) that common endpoints have lost, a sorted array; only rows with a loss."""
    joined = old.select(*keys, F.col(codes).alias("_a")).join(new.select(*keys, F.col(codes).alias("_b")), keys)
    return joined.select(*keys, F.sort_array(F.array_except("_a", "_b")).alias("removed")).filter(F.size("removed") > 0)


def parameter_changes(old: DataFrame, new: DataFrame, endpoint: list[str], identity: list[str]) -> DataFrame:
    """J-14: changes of parameters (…, type, format, required) of endpoints in both versions, a row for each change.

    A removal is breaking if the parameter was required. Another type or format, a parameter that became required and a new
    required one are breaking; a new optional one is no change. A null flag is not required; null formats are equal.
    """
    keys = endpoint + identity
    both = old.select(*endpoint).distinct().join(new.select(*endpoint).distinct(), endpoint)
    kind = lambda s: F.struct("type", "format", F.coalesce("required", F.lit(False)).alias("required")).alias(s)
    cut = lambda d, s: d.join(both, endpoint, "left_semi").select(*keys, kind(s))
    joined = cut(old, "_a").join(cut(new, "_b"), keys, "full_outer")
    a, b = F.col("_a"), F.col("_b")
    change = lambda test, name, breaking: F.when(test, F.struct(F.lit(name).alias("change"), breaking.alias("breaking")))
    retyped = ~(a["type"].eqNullSafe(b["type"]) & a["format"].eqNullSafe(b["format"]))
    common = a.isNotNull() & b.isNotNull()
    found = F.array(
        change(b.isNull(), "parameter-removed", a["required"]),
        change(common & retyped, "type-changed", F.lit(True)),
        change(common & ~a["required"] & b["required"], "became-required", F.lit(True)),
        change(a.isNull() & b["required"], "required-parameter-added", F.lit(True)),
    )
    return joined.select(*keys, F.inline(F.filter(found, lambda x: x.isNotNull())))


def contract_matches(interactions: DataFrame, operations: DataFrame) -> DataFrame:
    """J-15: each contract interaction (id, method, path, status) with the first operation (method, path, codes, ord) it fits.

    Status compatible, incompatible, or missing without an operation. Distinct methods and paths meet templates by the literal
    segments of both; only templates with other characters that mean something in patterns meet all paths of their method.
    """
    named = F.regexp_replace("path", r":([A-Za-z0-9_]+)", "{$1}")
    shape = F.regexp_replace(named, r"\{[^}]+\}", SLOT)
    ops = operations.select(F.lower("method").alias("_m"), F.col("path").alias("template"), "codes", "ord", contract_regex(F.col("path")).alias("_re"), shape.alias("_shape"))
    plain = ~F.regexp_replace("_shape", SLOT_PATTERN, "").rlike(r"[\\^$.|?*+()\[\]{}]")
    asked = interactions.select(F.lower("method").alias("method"), "path").distinct()
    kept = ["method", "path", "template", "codes", "ord"]
    fits = F.call_function("rlike", F.col("path"), F.col("_re"))
    by_key = literal_join(asked, ops.filter(plain), "method", "path", "_m", "_shape").filter(fits).select(*kept)
    loose = asked.join(ops.filter(~plain), (F.col("method") == F.col("_m")) & fits).select(*kept)
    first = best_match(by_key.unionByName(loose), ["method", "path"], "ord", ["template"])
    first = first.select(F.col("method").alias("_m"), F.col("path").alias("_p"), "template", "codes")
    ok = F.array_contains("codes", F.col("status").cast("string")) | F.array_contains("codes", "default")
    status = F.when(F.col("template").isNull(), "missing").when(ok, "compatible").otherwise("incompatible")
    joined = interactions.join(first, (F.lower("method") == F.col("_m")) & (F.col("path") == F.col("_p")), "left")
    return joined.select("id", "method", "path", "status", "template", status.alias("result"))


def compatibility(total: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A-12, J-16: share of old endpoints that no change but an addition affects; without endpoints 100."""
    n = total.select(F.count_distinct(F.struct(*keys)).alias("total"))
    bad = changes.filter("change not in ('added', 'common')").select(F.count_distinct(F.struct(*keys)).alias("affected"))
    both = n.withColumn("_one", F.lit(1)).join(bad.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each
    return both.withColumn("percent", percent_fixed(F.col("total") - F.col("affected"), F.col("total")))

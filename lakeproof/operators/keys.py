"""Order-sensitive helpers: first and last wins, ranked lookups, top-k, union by key (U-01, U-02, U-04, U-05, R-3, T-01 to T-03, T-08, A-14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """U-05: of rows with equal keys the first in order. Null keys are equal. A window group limit cuts groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """S-05, S-12: of rows with equal keys the last in order."""
    return first_by(rows, keys, [F.desc(c) for c in order])


def best_match(pairs: DataFrame, keys: Sequence[str], tier: str, order: Sequence[str]) -> DataFrame:
    """J-11, J-15, A-17, A-18: the match of the lowest tier for each key, the first in order among equals."""
    return first_by(pairs, keys, [tier, *order])


#: Stands for a placeholder of a template, alone or within a segment; no path holds it.
SLOT = "{}"
SLOT_PATTERN = r"\{\}"


def literal_join(paths: DataFrame, templates: DataFrame, method: str, path: str, t_method: str, shape: str) -> DataFrame:
    """J-01, J-15: pairs of paths and templates of equal method whose literal segments agree, by equi joins only.

    shape is the template with SLOT for placeholders. The distinct positions of placeholders among templates of a method and a
    number of segments are few; a path is blanked at each of them and then meets templates by its whole text.
    """
    cut = lambda c: F.split(c, "/", -1)
    open_ = F.transform(cut(F.col(shape)), lambda x: F.contains(x, F.lit(SLOT)))
    blank = F.array_join(F.transform(cut(F.col(shape)), lambda x: F.when(F.contains(x, F.lit(SLOT)), SLOT).otherwise(x)), "/")
    keyed = templates.withColumns({"_open": open_, "_key": blank})
    masks = keyed.select(F.col(t_method).alias("_mask_method"), F.size("_open").alias("_size"), F.col("_open").alias("_mask")).distinct()
    met = paths.withColumn("_parts", cut(F.col(path))).join(masks, (F.col(method) == F.col("_mask_method")) & (F.size("_parts") == F.col("_size")))
    blanked = F.array_join(F.transform("_parts", lambda x, i: F.when(F.get("_mask", i), SLOT).otherwise(x)), "/")
    met = met.withColumn("_blanked", blanked).drop("_parts", "_mask", "_size")
    return met.join(keyed.drop("_open"), (F.col("_mask_method") == F.col(t_method)) & (F.col("_blanked") == F.col("_key"))).drop("_mask_method", "_blanked", "_key")


def union_all(*parts: DataFrame) -> DataFrame:
    """U-01: rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def union_lists(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """U-02: the arrays of rows with equal keys joined: first the old values, then the new, each once. Null arrays are empty."""
    both = old.select(*keys, F.col(column).alias("_a")).join(new.select(*keys, F.col(column).alias("_b")), list(keys), "full_outer")
    empty = lambda c, other: F.coalesce(c, F.slice(other, 1, 0), F.array())
    return both.select(*keys, F.array_union(empty("_a", "_b"), empty("_b", "_a")).alias(column))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """U-04: the new rows and those old rows whose key is not among them."""
    keys = new.select(F.col(key).alias("_new_key")).distinct()
    return old.join(keys, old[key] == F.col("_new_key"), "left_anti").unionByName(new, allowMissingColumns=True)


def top(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """T-01 to T-08: the first n rows in a total order."""
    return rows.orderBy(*order).limit(n)


def running_best(rows: DataFrame, keys: Sequence[str], score: str, order: str, id_: str) -> DataFrame:
    """A-14: for each key the row of the highest score, the first on ties, with `linked`: the ids of the rows that were each a
    strict maximum when seen, in order. A later equal or lower row loses its id."""
    before = F.max(score).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    rises = rows.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(score) > F.col("_before")))
    linked = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(id_).alias("i")))), lambda x: x["i"])
    rest = [c for c in rows.columns if c not in (*keys,)]
    # the last strict rise is the winner; the order of the group's first row keeps ties of the result stable
    winner = F.max_by(F.struct(*rest), F.col(order)).alias("w")
    grouped = rises.groupBy(*keys).agg(linked.alias("linked"), winner, F.min(order).alias("first_ord"))
    return grouped.select(*keys, "linked", "first_ord", *[F.col(f"w.{c}").alias(c) for c in rest])

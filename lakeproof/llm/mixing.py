"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every copy of a document gets the virtual finish time (cumulative source tokens) / (target of the source); copies are served in
that order until the total budget is used up. Both orders are range-sorted in two levels: buckets of a known count, about the
square root of the rows, have their totals summed; rows are then ordered inside their own bucket. For the global order only
the one bucket in which the budget ends is sorted at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANK_RE, BLANKS, columns, materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null and blank texts."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, BLANK_RE))).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) with weight and target: shares of all sizes by weight, none above max_copies times its source.

    Water level: with sources ordered by cap / weight, a source is capped exactly when the level left by those before it is
    above its own; then all others share what the capped ones leave. One row per source is ordered, not one per document.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    every = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = every.rowsBetween(W.unboundedPreceding, -1)
    after = every.rowsBetween(0, W.unboundedFollowing)
    ranked = sources.select("source", "source_size", pick.alias("weight")).withColumn("cap", F.col("source_size").cast("double") * max_copies)
    total = F.sum(F.col("source_size").cast("double")).over(W.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first source that is not capped holds for all after it
    last = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(W.partitionBy())
    share = F.when(F.col("capped"), F.col("cap")).otherwise(last["level"] * F.col("weight"))
    return leveled.select("source", "source_size", share.alias("target"))


def row_hash(docs: DataFrame) -> Column:
    """What tells the rows of docs apart: doc_id, source and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.struct(docs["source"].isNull(), docs["source"].cast("string")), docs["text"])


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, row) for each row of docs (doc_id, source, text).

    Null texts have size 0 and are never taken; null sources form one source, the last. Equal rows take their places in
    turn. The order is a hash of the row (doc_id, source and text) and seed, so reruns agree, and rows without an id or with equal
    ids are spread as others are. copies is the number of times the mix repeats the row; row is the row's hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), row_hash(docs).alias("row"))
    rows = materialize(rows.withColumn("key", F.xxhash64("row", F.lit(seed))), "mix-rows")
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sized = materialize(sized.withColumn("buckets", F.ceil(F.sqrt("n")).cast("long")), "mix-sources")
    aims = materialize(targets(sized, weights, max_copies), "mix-targets")
    aims = materialize(
        sized.withColumnRenamed("source", "s").join(aims.withColumnRenamed("source_size", "z"), F.col("s").eqNullSafe(F.col("source"))).select("s", "source_size", "buckets", "target"),
        "mix-aims",
    )
    placed = rows.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the top 31 bits of the key, scaled: buckets are ranges of the shuffled order
    place = F.shiftright(F.shiftrightunsigned("key", 33) * F.col("buckets"), 31)
    placed = materialize(placed.withColumn("bucket", place).drop("buckets"), "mix-placed")

    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("b_size"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = materialize(sums.withColumn("b_start", F.coalesce(F.sum("b_size").over(upto), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "b_start"), "mix-sums")
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = placed.withColumn("within", F.sum("size").over(inside))
    queued = queued.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    queued = materialize(queued.select("doc_id", "source", "key", "row", "size", "source_size", "target", (F.col("b_start") + F.col("within")).alias("upto")), "mix-queued")

    finish = lambda k: (F.col("source_size") * k + F.col("upto")) / F.nullif(F.col("target"), F.lit(0.0))
    budget, count = rows.agg(F.sum("size"), F.count("*")).first()
    cut = _cut(queued, finish, max_copies, budget or 0, count)
    if cut is None:
        served = F.lit(max_copies)
    else:
        mine = F.struct(F.col("key").alias("key"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))
        edge = F.struct(*[F.lit(cut[c]).cast("long").alias(c) for c in ("key", "doc_id", "size")])
        before = [(finish(k) < cut["finish"]) | ((finish(k) == cut["finish"]) & (mine < edge)) for k in range(max_copies)]
        served = sum((F.coalesce(x, F.lit(False)).cast("int") for x in before), F.lit(0))
    served = F.when(F.col("size") > 0, served).otherwise(F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", served.alias("copies"), (F.col("size") * served).alias("taken"), "row")


def _cut(queued: DataFrame, finish, max_copies: int, budget: int, count: int):
    """The first copy that no longer fits the budget, as a row of (finish, key, doc_id, size); None if all fit.

    Totals of about sqrt(count) ranges of the finish time find the range in which the budget ends; only its rows are sorted.
    """
    copies = queued.filter(F.col("size") > 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))).alias("copy"))
    copies = copies.withColumn("finish", finish(F.col("copy"))).withColumn("slot", F.floor(F.col("finish") * float(max(1, round(count**0.5)))))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("s_size"))
    ends = slots.withColumn("s_end", F.sum("s_size").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = ends.filter(F.col("s_end") > budget).orderBy("slot").first()
    if last is None:
        return None
    order = ["finish", "key", "doc_id", "size"]
    running = F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) + (last["s_end"] - last["s_size"])
    edge = copies.filter(F.col("slot") == last["slot"]).withColumn("running", running)
    return edge.filter(F.col("running") > budget).orderBy(*order).select(*order).first()


def repeat_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """Docs as the mix takes them: each row as often as it is served. Rows equal in doc_id, source and text share what they are
    served together as evenly as it goes."""
    found = mix(docs, weights, max_copies, seed)
    counts = found.groupBy(F.col("row").alias("_mix_row")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n_rows"))
    counts = materialize(counts.filter("_copies > 0"), "mix-copies")
    # the counts grow with the corpus: they are merged at every size, never broadcast
    rows = docs.select(F.struct(*columns(docs)).alias("_doc"), row_hash(docs).alias("_row"))
    joined = rows.join(counts.hint("merge"), F.col("_row") == F.col("_mix_row"))
    served = joined.filter("_n_rows = 1").select("_doc", "_copies")
    if not counts.filter("_n_rows > 1").isEmpty():
        turn = F.row_number().over(W.partitionBy("_mix_row").orderBy("_n_rows"))
        share = F.floor(F.col("_copies") / F.col("_n_rows")) + (turn <= F.col("_copies") % F.col("_n_rows")).cast("long")
        served = served.unionByName(joined.filter("_n_rows > 1").select("_doc", share.alias("_copies")).filter("_copies > 0"))
    copies = served.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copies.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])

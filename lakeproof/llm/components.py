"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


class Forest:
    """Gathers links within one task and reduces them to stars around the smallest signed value of each component."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.pending = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """a and b: uint64 bit patterns."""
        if a.size:
            pairs = np.stack((a, b), axis=1).view(np.int64)
            self.parts.append(pairs)
            self.pending += len(pairs)

    def links(self) -> tuple[list[int], list[int]]:
        if not self.parts:
            return [], []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        for a, b in np.unique(np.concatenate(self.parts), axis=0).tolist():
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        found = [(root(x), x) for x in list(parent)]
        found = [(a, x) for a, x in found if a != x]
        return [a for a, _ in found], [x for _, x in found]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge and the smallest node it can reach, itself included; a root is listed too.

    Null ends and loops are ignored; an empty edge table gives an empty result. Each step is one aggregation and one join
    on a written table of minima, so Spark can split a hub's rows; nothing but counts reaches the driver.
    """
    pairs = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "cc")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-min")
        large = materialize(now.join(least, now.lo == least.u).select("hi", F.col("m").alias("lo")).distinct(), "cc")
        discard(now), discard(least)
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "cc-min")
        moved = large.join(least.withColumnRenamed("hi", "u"), F.col("hi") == F.col("u")).filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "cc")
        discard(large), discard(least)
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)

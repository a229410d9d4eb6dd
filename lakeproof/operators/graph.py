"""Graph operators over node and edge tables (G-02 to G-04, G-09, G-14, J-17, J-18, J-20 to J-22, J-24, J-28, J-30, U-06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keys import first_by


def reachable(edges: DataFrame, starts: DataFrame, edge_types: Sequence[str] = (), nodes: DataFrame | None = None, order: str = "") -> DataFrame:
    """G-02: (root, node, depth): nodes reached from each start (root), at their least depth, starts left out. Cycle-safe.

    One join per level from the frontier only, until the frontier is empty; nodes that were reached before leave it. Ids that
    are not in nodes (id), where given, are passed through but not returned. With order, a column of edges, `position` tells
    the place of a node in a breadth-first visit that takes a node's edges in that order. checkpoint() cuts the lineage
    where the cluster names a folder for it.
    """
    steps = edges.filter(F.col("type").isin(*edge_types)) if edge_types else edges
    steps = steps.groupBy(F.col("source").alias("_from"), F.col("target").alias("_to")).agg((F.min(order) if order else F.lit(0)).alias("_ord"))
    lasting = starts.sparkSession.sparkContext.getCheckpointDir()
    saved = (lambda d: d.checkpoint()) if lasting else (lambda d: d.cache())
    frontier = starts.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("position")).distinct()
    found, level = frontier, 0
    while True:
        level += 1
        step = frontier.join(steps, F.col("node") == F.col("_from")).groupBy("root", F.col("_to").alias("node")).agg(F.min(F.struct("position", "_ord", "_to")).alias("_via"))
        fresh = step.join(found.select("root", "node"), ["root", "node"], "left_anti")
        place = F.row_number().over(W.partitionBy("root").orderBy("_via")).cast("long") if order else F.lit(0).cast("long")
        frontier = saved(fresh.select("root", "node", F.lit(level).alias("depth"), place.alias("position")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    out = found.filter("depth > 0")
    if nodes is not None:
        out = out.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("root", "node", "depth", "position")
    if order:
        return out.withColumn("position", F.row_number().over(W.partitionBy("root").orderBy("depth", "position")))
    return out.drop("position")


def type_on_path(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, node_type: str, order: str = "id") -> DataFrame:
    """G-03: pairs (start, end) with a flag whether the first shortest path between them, by breadth-first visits that take edges
    by `order`, passes a node (id, type) of the type between its ends. No path, no flag."""
    steps = edges.groupBy(F.col("source").alias("_from"), F.col("target").alias("_to")).agg(F.min(order).alias("_ord"))
    typed = nodes.filter(F.col("type") == node_type).select(F.col("id").alias("_id")).distinct().withColumn("_is", F.lit(True))
    lasting = edges.sparkSession.sparkContext.getCheckpointDir()
    saved = (lambda d: d.checkpoint()) if lasting else (lambda d: d.cache())
    # `behind` tells of the nodes between start and node, `typed` of the node itself; a start counts for neither
    frontier = found = pairs.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("position"), F.lit(False).alias("behind"), F.lit(False).alias("typed"))
    while True:
        step = frontier.join(steps, F.col("node") == F.col("_from")).withColumn("behind", F.col("behind") | F.col("typed")).groupBy("start", F.col("_to").alias("node"))
        step = step.agg(F.min(F.struct("position", "_ord", "behind")).alias("_via")).join(found.select("start", "node"), ["start", "node"], "left_anti")
        place = F.row_number().over(W.partitionBy("start").orderBy("_via", "node")).cast("long")
        step = step.withColumn("position", place).join(typed, F.col("node") == F.col("_id"), "left")
        frontier = saved(step.select("start", "node", "position", F.col("_via.behind").alias("behind"), F.coalesce("_is", F.lit(False)).alias("typed")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    ends = found.select(F.col("start").alias("_s"), F.col("node").alias("_e"), "behind")
    joined = pairs.join(ends, (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left")
    return joined.select("start", "end", F.coalesce("behind", F.lit(False)).alias("on_path"))


def merge(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """U-06, G-04: nodes (id, type, metadata map) by id: the old type stays, metadata of the incoming wins key by key, and
    `conflict` tells of two different types."""
    b = incoming.select("id", F.col("type").alias("_t"), F.col("metadata").alias("_m"))
    joined = nodes.join(b, "id", "full_outer")
    empty = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce("metadata", empty), F.coalesce("_m", empty)
    merged = F.map_concat(F.map_filter(mine, lambda k, v: ~F.map_contains_key(theirs, k)), theirs)
    conflict = F.col("type").isNotNull() & F.col("_t").isNotNull() & (F.col("type") != F.col("_t"))
    return joined.select("id", F.coalesce("type", "_t").alias("type"), merged.alias("metadata"), conflict.alias("conflict"))


def merge_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """U-06: incoming edges whose id is new join the old ones."""
    return edges.unionByName(incoming.join(edges.select("id"), "id", "left_anti"))


def confirmed(endpoints: DataFrame, events: DataFrame) -> DataFrame:
    """J-17: endpoints (id) with a flag whether an event (method, path, normalized_path) names them."""
    named = events.select(F.concat(F.lit("endpoint:"), F.upper("method"), F.lit(":"), F.coalesce("normalized_path", "path")).alias("id")).distinct()
    return endpoints.join(named.withColumn("confirmed", F.lit(True)), "id", "left").na.fill(False, ["confirmed"])


def runtime_conflicts(results: DataFrame, endpoints: DataFrame) -> DataFrame:
    """J-18: up to four conflict rows for each probe result against the endpoints (id, auth_required) of the code."""
    known = endpoints.select(F.col("id").alias("_id"), F.col("auth_required").alias("_auth"), F.lit(True).alias("_known"))
    joined = results.join(known, F.col("id") == F.col("_id"), "left")
    when = lambda test, kind: F.when(F.coalesce(test, F.lit(False)), F.lit(kind))
    kinds = F.array(
        when(F.col("_known").isNull() & F.col("reachable"), "undocumented-endpoint"),
        when(F.col("_known") & ~F.col("reachable"), "unreachable-endpoint"),
        when(F.col("auth_bypass"), "auth-bypass"),
        when(F.col("server_error"), "server-error"),
    )
    return joined.select("id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("conflict"))


def unconfirmed(endpoints: DataFrame, *confirmed_by: DataFrame) -> DataFrame:
    """J-21: endpoints (id) that no runtime source (id) confirms; none if no source has any row."""
    every = confirmed_by[0].select("id")
    for d in confirmed_by[1:]:
        every = every.unionByName(d.select("id"))
    gate = every.select(F.lit(True).alias("_any")).limit(1)  # a single row, or none
    return endpoints.join(every.distinct(), "id", "left_anti").join(F.broadcast(gate), F.lit(True), "left_semi")


def test_mapping(*evidence: DataFrame) -> DataFrame:
    """J-22: the first evidence of each (test, endpoint); sources are given in order of precedence, each with (test, endpoint, via, ord)."""
    parts = [d.withColumn("priority", F.lit(k)) for k, d in enumerate(evidence)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_by(out, ["test", "endpoint"], ["priority", "ord"])


def coverage_star(endpoints: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """J-20, Q7: endpoints (id) with their number of tests and the layer and mock flag of the last edge (test, endpoint, ord) by tests (test, layer, mocked)."""
    joined = edges.join(tests, "test")
    last = F.max_by(F.struct("layer"), F.col("ord"))
    grouped = joined.groupBy(F.col("endpoint").alias("id")).agg(F.count_distinct("test").alias("n_tests"), last["layer"].alias("layer"), F.bool_or("mocked").alias("mocked"))
    return endpoints.select("id").join(grouped, "id", "left").na.fill(0, ["n_tests"]).na.fill(False, ["mocked"])


def chains(links: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """G-09, X-25: (start, last, length, cycle) of the chain child -> parent from each start, cut at depth; a parent seen before is a cycle."""
    now = starts.select(F.col("start"), F.col("start").alias("last"), F.array("start").alias("way"), F.lit(False).alias("cycle"), F.lit(True).alias("open"))
    up = links.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
    for _ in range(depth):
        step = now.join(up, F.col("open") & (F.col("last") == F.col("_c")), "left")
        again = F.coalesce(F.array_contains("way", F.col("_p")), F.lit(False))
        go = F.col("open") & F.col("_p").isNotNull() & ~again
        now = step.select("start", F.when(go, F.col("_p")).otherwise(F.col("last")).alias("last"), F.when(go, F.array_append("way", F.col("_p"))).otherwise(F.col("way")).alias("way"), (F.col("cycle") | again).alias("cycle"), go.alias("open"))
    return now.select("start", "last", (F.size("way") - 1).alias("length"), "cycle")


def function_files(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """J-24: calls (file, name) with the file that defines the function (file, name, ord): the caller's own, else the first of its
    imports (file, imported, ord) that does, else the first file at all; null if none does. ord of functions orders the files."""
    defined = functions.groupBy(F.col("name").alias("_name"), F.col("file").alias("_file")).agg(F.min("ord").alias("_ord"))
    asked = calls.select("file", "name").distinct()
    own = asked.join(defined, (F.col("name") == F.col("_name")) & (F.col("file") == F.col("_file"))).select("file", "name", F.lit(0).alias("tier"), "_ord", "_file")
    reach = imports.groupBy(F.col("file").alias("_from"), "imported").agg(F.min("ord").alias("_place"))
    via = asked.join(reach, F.col("file") == F.col("_from")).join(defined, (F.col("name") == F.col("_name")) & (F.col("imported") == F.col("_file")))
    via = via.select("file", "name", F.lit(1).alias("tier"), F.col("_place").alias("_ord"), "_file")
    # one file a name, found before it meets the calls
    anywhere = defined.groupBy("_name").agg(F.min(F.struct("_ord", "_file")).alias("_first"))
    anywhere = asked.join(anywhere, F.col("name") == F.col("_name")).select("file", "name", F.lit(2).alias("tier"), "_first._ord", "_first._file")
    best = own.unionByName(via).unionByName(anywhere).groupBy("file", "name").agg(F.min(F.struct("tier", "_ord", "_file"))["_file"].alias("defined_in"))
    return calls.join(best, ["file", "name"], "left")


def auth_gaps(endpoints: DataFrame, asserted: DataFrame) -> DataFrame:
    """J-28: gaps (path, gap) of endpoints (path, required, optional) whose path no assertion (path) names: a missing 401 test of
    required authentication, a missing second path of optional one. Null flags are unset."""
    bare = endpoints.join(asserted.select("path").distinct(), "path", "left_anti")
    kinds = F.array(F.when(F.col("required"), "missing-401-test"), F.when(F.col("optional"), "missing-optional-dual-path"))
    return bare.select("path", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("gap"))


def field_usage(fields: DataFrame, queried: DataFrame) -> DataFrame:
    """J-30: schema fields (type, name) with a flag whether a query names them (name)."""
    names = queried.select("name").distinct().withColumn("_used", F.lit(True))
    return fields.join(names, "name", "left").select("type", "name", F.coalesce("_used", F.lit(False)).alias("covered"))


#: Rules whose detection is part of the readers, so they always hold; SA02 and SA04 are checked.
RULES = ("SA01", "SA02", "SA03", "SA04", "SA05", "SA06", "SA07", "SA08", "SA09", "SA10")


def rule_violations(mounts: DataFrame, routes: DataFrame) -> DataFrame:
    """G-14: (rule, severity, file, line, subject): router mounts (file, line, prefix, target) with a target but an empty or root
    prefix, and routes (file, line, path, required, optional) that are both."""
    bare = mounts.filter(F.coalesce("prefix", F.lit("")).isin("", "/") & (F.coalesce("target", F.lit("")) != ""))
    both = routes.filter("required and optional")
    row = lambda d, rule, severity, subject: d.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "file", "line", F.col(subject).alias("subject"))
    return row(bare, "SA02", "warning", "target").unionByName(row(both, "SA04", "error", "path"))


def rules_passed(violations: DataFrame) -> DataFrame:
    """G-14: one row (checked, passed)."""
    return violations.agg(F.lit(len(RULES)).cast("long").alias("checked"), (F.lit(len(RULES)) - F.count_distinct("rule")).alias("passed"))

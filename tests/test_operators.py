import random

import pytest
from pyspark.sql import functions as F

from lakeproof.operators import compat, coverage, gate, graph, keys, load, sequence


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_match_calls(spark):
    ends = spark.createDataFrame([("GET", "/users/{id}"), ("GET", "/users"), ("GET", "/{x}/me"), ("POST", "/users")], "method string, path string")
    calls = spark.createDataFrame([("GET", "/users/7"), ("GET", "/users/7"), ("GET", "/users/me"), ("GET", "/users/{id}"), ("PUT", "/users")], "method string, path string")
    got = {(r.method, r.path): r.n_calls for r in coverage.match_calls(ends, calls).collect()}
    assert got == {("GET", "/users/{id}"): 3, ("GET", "/users"): 0, ("GET", "/{x}/me"): 1, ("POST", "/users"): 0}
    assert rows(coverage.coverage_summary(ends.limit(0), F.lit(True))) == [(0, 0, 0.0)]


def test_load_metrics(spark):
    samples = spark.createDataFrame([("GET /users", 100.0, True), ("GET /users", 200.0, False), ("GET /users", 300.0, True), ("POST /users", 5.0, True)], "label string, elapsed double, success boolean")
    got = {r.label: r for r in load.metrics(samples).collect()}
    assert (got["GET /users"].n, got["GET /users"].median, got["GET /users"].error_rate, got["GET /users"].avg, got["GET /users"].throughput) == (3, 200.0, 0.3333, 200.0, 5.0)
    assert got["POST /users"].error_rate == 0.0
    # throughput is per busy second: 5 samples of 1030 ms in all
    put = spark.createDataFrame([("POST /users", x, True) for x in (195.0, 200.0, 205.0, 210.0, 220.0)], "label string, elapsed double, success boolean")
    assert load.metrics(put).first().throughput == 4.85


def test_endpoint_metrics_tiers(spark):
    ends = spark.createDataFrame([("GET /users", "GET", "/users"), ("GET /x", "GET", "/x")], "id string, method string, path string")
    labels = spark.createDataFrame([("list /users", 0), ("get /users all", 1), ("GET /users", 2)], "label string, ord int").withColumn("median", F.lit(10.0)).withColumn("error_rate", F.lit(0.0))
    got = load.service_level(load.endpoint_metrics(ends, labels)).orderBy("id").collect()
    assert [(r.label, r.status) for r in got] == [("GET /users", "good"), (None, "missing-data")]


def _python_running_best(items):
    best = {}
    for key, ord_, score, id_ in items:
        if key not in best:
            best[key] = [score, [id_], id_]
        elif score > best[key][0]:
            best[key] = [score, best[key][1] + [id_], id_]
    return {k: (v[1], v[2]) for k, v in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_running_best_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    items = [(rng.randrange(4), k, rng.randrange(5), f"f{k}") for k in range(60)]
    df = spark.createDataFrame(items, "key int, ord int, score int, id string")
    got = {r.key: (r.linked, r.id) for r in keys.running_best(df, ["key"], "score", "ord", "id").collect()}
    assert got == _python_running_best(items)


def test_tied_duplicates_lose_their_link(spark):
    df = spark.createDataFrame([("k", 1, 50, "f1"), ("k", 2, 40, "f2"), ("k", 3, 60, "f3"), ("k", 4, 60, "f4")], "key string, ord int, score int, id string")
    assert [(r.linked, r.id) for r in keys.running_best(df, ["key"], "score", "ord", "id").collect()] == [(["f1", "f3"], "f3")]


def test_spec_changes(spark):
    op = "method string, path string, codes array<string>"
    old = spark.createDataFrame([("get", "/products", ["200"]), ("get", "/users", ["200", "404"])], op)
    new = spark.createDataFrame([("get", "/users", ["200"]), ("get", "/users/{id}/profile", ["200"])], op)
    got = compat.endpoint_changes(old, new, ["method", "path"])
    assert rows(got, "path") == [("get", "/products", "removed", True), ("get", "/users", "common", False), ("get", "/users/{id}/profile", "added", False)]
    assert rows(compat.removed_codes(old, new, ["method", "path"], "codes")) == [("get", "/users", ["404"])]
    assert compat.compatibility(old, got, ["method", "path"]).first().percent == 50.0
    assert compat.compatibility(old.limit(0), got.limit(0), ["method", "path"]).first().percent == 100.0
    p = "method string, path string, loc string, name string, type string, format string, required boolean"
    at = ("get", "/users", "query")
    a = spark.createDataFrame([(*at, "q", "string", None, False), (*at, "gone", "string", None, False), (*at, "needed", "string", None, True), (*at, "f", "integer", "int32", None), (*at, "same", "string", None, True)], p)
    b = spark.createDataFrame([(*at, "q", "integer", None, True), (*at, "must", "string", None, True), (*at, "may", "string", None, False), (*at, "f", "integer", "int64", False), (*at, "same", "string", None, True)], p)
    got = compat.parameter_changes(a, b, ["method", "path"], ["loc", "name"])
    assert sorted((r.name, r.change, r.breaking) for r in got.collect()) == [
        ("f", "type-changed", True), ("gone", "parameter-removed", False), ("must", "required-parameter-added", True),
        ("needed", "parameter-removed", True), ("q", "became-required", True), ("q", "type-changed", True),
    ]


def test_gate(spark):
    results = spark.createDataFrame([("a", 10, 50.0), ("b", 10, 90.0), ("c", 0, 0.0)], "type string, total int, percent double")
    assert gate.branch_thresholds("release/2", [("main", {"a": 1}), ("release/*", {"a": 60.0}), ("release/2", {"a": 0})]) == {"a": 60.0}
    failed = gate.failures(results, gate.threshold_of(F.col("type"), {"a": 60.0}, {"b": 80.0}, None))
    assert [(r.type, r.gap) for r in failed.collect()] == [("a", 10.0)]  # c has no threshold and is skipped
    assert gate.verdict(failed).first().asDict() == {"passed": False, "n_failures": 1, "worst": "a", "worst_gap": 10.0}
    assert gate.verdict(failed, mode="warn").first().passed and gate.verdict(failed, enabled=False).first().passed
    assert {r.type for r in gate.failures(results, gate.threshold_of(F.col("type"), {}, {}, None)).collect()} == {"a", "b", "c"}  # 100 without any threshold
    known = spark.createDataFrame([("a",), ("x",)], "type string")
    limits = gate.threshold_of(F.col("type"), {"a": 60.0}, {"b": 80.0}, None)
    assert {r.type: r.status for r in gate.evaluate(known, results, failed, limits).collect()} == {"a": "FAIL", "b": "PASS", "c": "N/A", "x": "SKIPPED"}
    empty = spark.createDataFrame([("a", 0, 0.0), ("z", 5, 0.0)], results.schema)
    assert {r.type: r.status for r in gate.evaluate(known, empty, gate.failures(empty, limits), limits).collect()} == {"a": "N/A", "x": "SKIPPED", "z": "N/A"}
    tie = spark.createDataFrame([("ab", 5.0, 1), ("aa", 5.0, 2), ("b", 1.0, 0)], "type string, gap double, ord int")
    assert gate.verdict(tie, order="ord").first().worst == "ab"


def test_category_domain_is_zero_filled(spark):
    items = spark.createDataFrame([(["missing-parameter"], True), (["missing-parameter", "unauthorized"], False), (["unauthorized"], True)], "categories array<string>, covered boolean")
    domain = spark.createDataFrame([("missing-parameter",), ("not-found",)], "category string")
    assert rows(coverage.by_category(items, "categories", F.col("covered"), domain), "category") == [("missing-parameter", 2, 1, 50.0), ("not-found", 0, 0, 0.0)]
    flows = spark.createDataFrame([("f", True), ("f", False), ("g", True)], "flow string, covered boolean")
    status = coverage.flow_status(flows, spark.createDataFrame([("f",), ("g",), ("h",)], "flow string"))
    assert {r.flow: r.status for r in status.collect()} == {"f": "partial", "g": "complete", "h": "missing"}


def _python_flows(calls, gap):
    out, name, group = [], None, []
    for line, test in sorted(calls):
        if group and ((test is not None and test != name) or (test is None and line - group[-1] > gap)):
            out.append((name, group))
            group, name = [], test
        elif not group:
            name = test
        group.append(line)
    out.append((name, group))
    return [(n, len(g), g[0], g[-1]) for n, g in out if len(g) >= 2]


@pytest.mark.parametrize("seed", range(3))
def test_flow_groups_match_a_loop(spark, seed):
    rng = random.Random(seed)
    lines = rng.sample(range(600), 40)
    calls = [(x, rng.choice([None, None, "a", "b"])) for x in lines]
    df = spark.createDataFrame([("f", x, t) for x, t in calls], "file string, line int, test_name string")
    assert [(r.name, r.n, r.first_line, r.last_line) for r in sequence.flow_groups(df).orderBy("flow").collect()] == _python_flows(calls, 50)


def _reach(edges, start):
    seen, level, depth = {start}, [start], {}
    while level:
        after = []
        for x in level:
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    depth[b] = depth.get(x, 0) + 1
                    after.append(b)
        level = after
    return depth


@pytest.mark.parametrize("seed", range(2))
def test_reachable_matches_a_search(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)]
    edges = spark.createDataFrame([("t", str(a), str(b)) for a, b in pairs], "type string, source string, target string")
    got = {(r.root, r.node): r.depth for r in graph.reachable(edges, spark.createDataFrame([("0",), ("5",)], "root string")).collect()}
    assert got == {(str(s), str(n)): d for s in (0, 5) for n, d in _reach(pairs, s).items()}


def test_graph_tables(spark):
    nodes = "id string, type string, metadata map<string,string>"
    a = spark.createDataFrame([("1", "x", {"a": "1", "b": "1"})], nodes)
    b = spark.createDataFrame([("1", "y", {"b": "2"}), ("2", "z", None)], nodes)
    assert rows(graph.merge(a, b), "id") == [("1", "x", {"a": "1", "b": "2"}, True), ("2", "z", {}, False)]
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "child string, parent string")
    got = {r.start: (r["last"], r.length, r.cycle) for r in graph.chains(links, spark.createDataFrame([("a",), ("c",)], "start string")).collect()}
    assert got == {"a": ("b", 1, True), "c": ("d", 1, False)}
    ends = spark.createDataFrame([("e1",), ("e2",)], "id string")
    assert rows(graph.unconfirmed(ends, ends.filter("id = 'e1'"))) == [("e2",)]
    assert rows(graph.unconfirmed(ends, ends.limit(0))) == []


def test_reach_has_no_depth_limit_and_visits_in_order(spark):
    rows = [(k, "e", str(k), str(k + 1)) for k in range(45)] + [(100, "e", "45", "dangling"), (101, "e", "dangling", "behind"), (102, "e", "3", "side"), (1, "e", "3", "first"), (103, "e", "45", "0")]
    edges = spark.createDataFrame(rows, "id int, type string, source string, target string")
    nodes = spark.createDataFrame([(str(k),) for k in range(46)] + [("behind",), ("side",), ("first",)], "id string")
    got = graph.reachable(edges, spark.createDataFrame([("0",)], "root string"), nodes=nodes, order="id").orderBy("position").collect()
    assert [r.node for r in got[:6]] == ["1", "2", "3", "first", "4", "side"]
    assert {r.node: r.depth for r in got} == {**{str(k): k for k in range(1, 46)}, "behind": 47, "first": 4, "side": 4}


def test_type_on_the_first_shortest_path(spark):
    edges = spark.createDataFrame([(1, "a", "m"), (2, "a", "h"), (3, "m", "z"), (4, "h", "z"), (5, "z", "q")], "id int, source string, target string")
    nodes = spark.createDataFrame([("a", "x"), ("m", "mock"), ("h", "helper"), ("z", "x"), ("q", "mock")], "id string, type string")
    pairs = spark.createDataFrame([("a", "z"), ("a", "h"), ("a", "q"), ("q", "a"), ("m", "m")], "start string, end string")
    of = lambda kind: {(r.start, r.end): r.on_path for r in graph.type_on_path(edges, nodes, pairs, kind).collect()}
    assert of("mock") == {("a", "z"): True, ("a", "h"): False, ("a", "q"): True, ("q", "a"): False, ("m", "m"): False}
    assert not of("x")["a", "z"]  # its ends do not count
    assert not of("helper")["a", "z"]  # the second shortest path has it, the first has not


def test_counts_by_dimension_have_their_domain(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("c", "x")], "`odd name` string, kind string")
    got = coverage.zero_filled_counts(rows, {"odd name": ["a", "b"], "kind": ["y"]})
    assert {(r.dimension, r.value): r.n for r in got.collect()} == {("odd name", "a"): 2, ("odd name", "b"): 0, ("odd name", "c"): 1, ("kind", "x"): 2, ("kind", "y"): 0}


def test_contracts_and_calls_meet_templates_of_any_shape(spark):
    """Against plain patterns over all pairs: placeholders within segments, metacharacters and deep literals."""
    import re

    templates = ["/api/users/{id}", "/api/users/me", "/api/{kind}/me", "/api/files/{name}.json", "/api/v1.0/x", "/api/any/.*", "/api/users/:id/orders", "/", ""]
    asked = ["/api/users/7", "/api/users/me", "/api/files/a.json", "/api/files/a.txt", "/api/v1.0/x", "/api/v1z0/x", "/api/any/a/b", "/api/users/7/orders", "/api/users/7/", "/", "", None]
    ops = spark.createDataFrame([("GET", t, ["200"], k) for k, t in enumerate(templates)], "method string, path string, codes array<string>, ord int")
    calls = spark.createDataFrame([(k, "get", p, 200) for k, p in enumerate(asked)], "id int, method string, path string, status int")
    got = {r.id: r.template for r in compat.contract_matches(calls, ops).collect()}
    pattern = lambda t: re.sub(r"\{[^}]+\}", "[^/]+", re.sub(r":([A-Za-z0-9_]+)", r"{\1}", t))
    assert got == {k: next((t for t in templates if p is not None and re.fullmatch(pattern(t), p)), None) for k, p in enumerate(asked)}
    ends = ops.select("method", "path")
    counts = {r.path: r.n_calls for r in coverage.match_calls(ends, calls.select(F.upper("method").alias("method"), "path")).collect()}
    escaped = lambda t: "[^/]+".join(re.escape(x) for x in re.split(r"\{[^}]+\}", t))
    assert counts == {t: sum(p is not None and re.fullmatch(escaped(t), p) is not None for p in asked) for t in templates}


def test_labels_of_endpoints(spark):
    ends = spark.createDataFrame([("a", "GET", "/users/{id}"), ("b", "POST", "/orders"), ("c", "PUT", "/x"), ("d", "GET", ""), ("lab", "GET", "/none"), ("n", "GET", None)], "id string, method string, path string")
    labels = spark.createDataFrame([("GET /users/{id} list", 1), ("a thing /orders", 2), ("Post /ORDERS", 3), ("lab", 4), ("", 5)], "label string, ord int").withColumn("median", F.col("ord") * 1.0)
    got = {r.id: r.label for r in load.endpoint_metrics(ends, labels).collect()}
    assert got == {"a": "GET /users/{id} list", "b": "Post /ORDERS", "c": None, "d": "GET /users/{id} list", "lab": "lab", "n": None}


def test_function_files_gaps_fields_and_rules(spark):
    functions = spark.createDataFrame([("f1", "go", 1), ("f2", "go", 2), ("f2", "run", 3), ("f3", "run", 4)], "file string, name string, ord int")
    imports = spark.createDataFrame([("f1", "f3", 1), ("f1", "f2", 2)], "file string, imported string, ord int")
    calls = spark.createDataFrame([("f1", "go"), ("f1", "run"), ("f3", "go"), ("f1", "none")], "file string, name string")
    got = {(r.file, r.name): r.defined_in for r in graph.function_files(calls, functions, imports).collect()}
    assert got == {("f1", "go"): "f1", ("f1", "run"): "f3", ("f3", "go"): "f1", ("f1", "none"): None}
    ends = spark.createDataFrame([("/a", True, False), ("/b", True, True), ("/c", None, True), ("/d", True, False)], "path string, required boolean, optional boolean")
    gaps = graph.auth_gaps(ends, ends.filter("path = '/d'").select("path"))
    assert rows(gaps, "path", "gap") == [("/a", "missing-401-test"), ("/b", "missing-401-test"), ("/b", "missing-optional-dual-path"), ("/c", "missing-optional-dual-path")]
    mounts = spark.createDataFrame([("m", 1, "/", "t"), ("m", 2, None, "u"), ("m", 3, "", ""), ("m", 4, "/v", "w")], "file string, line int, prefix string, target string")
    routes = spark.createDataFrame([("r", 9, "/b", True, True), ("r", 8, "/a", True, False)], "file string, line int, path string, required boolean, optional boolean")
    bad = graph.rule_violations(mounts, routes)
    assert rows(bad, "line") == [("SA02", "warning", "m", 1, "t"), ("SA02", "warning", "m", 2, "u"), ("SA04", "error", "r", 9, "/b")]
    assert rows(graph.rules_passed(bad)) == [(10, 8)] and rows(graph.rules_passed(bad.limit(0))) == [(10, 10)]
    fields = spark.createDataFrame([("Query", "users"), ("Query", "orders")], "type string, name string")
    assert {r.name: r.covered for r in graph.field_usage(fields, fields.filter("name = 'users'").select("name")).collect()} == {"users": True, "orders": False}

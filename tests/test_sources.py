import json

from lakeproof import plugins, sinks
from lakeproof.sources import files, results, spec
from pyspark.sql import functions as F

SPEC = {
    "servers": [{"url": "https://x"}],
    "security": [{"key": []}],
    "components": {"securitySchemes": {"key": {"type": "apiKey", "in": "header"}, "c": {"type": "apiKey", "in": "cookie"}}, "schemas": {"N": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "maxLength": 9}, "self": {"$ref": "#/components/schemas/N"}}}}},
    "paths": {
        "/users/{id}": {
            "parameters": [{"in": "path", "name": "id", "schema": {"type": "integer"}}, {"in": "query", "name": "q", "schema": {"type": "string"}}],
            "get": {"parameters": [{"in": "query", "name": "q", "required": True, "schema": {"type": "integer", "minimum": 1}}], "responses": {"200": {}, "404": {"description": "no"}}},
            "post": {"security": [], "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/N"}}}}, "responses": {"400": {"description": "missing name"}, "5XX": {}}},
        }
    },
}


def test_spec(spark):
    text = json.dumps(SPEC)
    assert [(r.id, r.path_regex) for r in spec.endpoints(spark, text).orderBy("ord").collect()] == [("GET /users/{id}", r"^/users/[^/]+\z"), ("POST /users/{id}", r"^/users/[^/]+\z")]
    p = {(r.method, r.location, r.name): r for r in spec.parameters(spark, text).collect()}
    assert set(p) == {("GET", "path", "id"), ("GET", "query", "q"), ("POST", "path", "id"), ("POST", "query", "q"), ("POST", "body", "name"), ("POST", "body", "self")}
    assert (p["GET", "query", "q"].type, p["GET", "query", "q"].minimum, p["POST", "query", "q"].type, p["POST", "body", "name"].required, p["GET", "path", "id"].required) == ("integer", 1.0, "string", True, True)
    assert sorted((r.status_code, tuple(r.categories)) for r in spec.error_scenarios(spark, text).collect()) == [(400, ("missing-parameter",)), (404, ("not-found",))]
    ids = {r.id: r.detail for r in spec.security_controls(spark, text).collect()}
    assert ids == {"authentication:key": "apiKey/header", "session-management:c": "apiKey/cookie", "cryptography:https": "https", "authorization:get:/users/{id}": "key", "input-validation:get:/users/{id}": "parameters", "input-validation:post:/users/{id}": "body"}


def test_rules_and_config(spark):
    r = spec.business_rules(spark, json.dumps({"rules": [{"id": "r", "scenarios": [{"id": "s"}]}]})).first()
    assert (r.keywords, r.scenarios[0].keywords) == ([], [])
    try:
        spec.business_rules(spark, "{}")
        raise AssertionError
    except ValueError:
        pass
    assert spec.merge_config({"a": {"b": 1, "c": [1, 2]}}, {"a": {"c": [3], "b": None}}) == {"a": {"b": 1, "c": [3]}}
    assert spec.integration_flows(spark, json.dumps({"flows": [{"id": "f", "steps": [{"id": "s", "keywords": ["k"]}]}]})).first().steps[0].keywords == ["k"]


def test_load_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timeStamp,Elapsed,label,success\n1,100,GET /u,true\n2,x,GET /u,true\n3,300,GET /u,false\n4,5,,true\n")
    durations = {"avg": 250, "med": 230, "p(95)": 450, "p(99)": 900}
    k6 = {"metrics": {"http_req_duration": {"values": durations}, "http_req_failed": {"values": {"rate": 0.03}}, "http_reqs": {"values": {"count": 100, "rate": 10}}}, "scenarios": {"s": {"metrics": {"http_req_duration": {"avg": 7}}}}}
    (tmp_path / "b.json").write_text(json.dumps(k6))
    got = {r.label: r for r in results.load_results(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.json")]).collect()}
    assert (got["GET /u"].n, got["GET /u"].error_rate, got["GET /u"].avg) == (2.0, 0.5, 200.0)
    o = got["overall"]
    assert (o.avg, o.median, o.p95, o.p99, o.error_rate, o.n, o.throughput) == (250.0, 230.0, 450.0, 900.0, 0.03, 100.0, 10.0)
    assert (got["s"].avg, got["s"].median) == (7.0, 0.0)  # a scenario without a median has 0, and so meets any limit


def texts(spark, *docs):
    return spark.createDataFrame([(f"f{k}", d if isinstance(d, str) else json.dumps(d)) for k, d in enumerate(docs)], "file string, text string")


def test_reports(spark):
    s = results.semgrep(texts(spark, {"results": [{"checkId": "x.sqli", "path": "a", "start": {"line": 3}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"category": "security", "cwe": ["CWE-1"]}}}, {"checkId": "y", "path": "b", "extra": {"metadata": {"category": "misconfig", "cwe": "CWE-2"}}}]}))
    assert [(r.category, r.severity, r.cwe, r.line_start) for r in s.orderBy("file_path").collect()] == [("injection", "HIGH", ["CWE-1"], 3), ("misconfig", "MEDIUM", ["CWE-2"], None)]
    t = results.trivy(texts(spark, {"Results": [{"Target": "t", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "Severity": "UNKNOWN"}], "Secrets": [{"RuleID": "r", "Title": "k", "Severity": "HIGH", "Category": "aws"}]}, {"Target": "u", "Misconfigurations": [{"ID": "m", "Title": "q", "Severity": "LOW"}]}]}))
    assert sorted((r.category, r.severity, r.title) for r in t.collect()) == [("misconfig", "LOW", "q"), ("sca", "LOW", "CVE-1"), ("secret", "HIGH", "k")]
    z = results.zap(texts(spark, {"site": {"alerts": [{"alert": "SQL Injection", "riskdesc": "High (x)", "instances": [{"uri": "https://h/p?q", "method": "get"}], "cweid": "89"}]}}, {"alerts": [{"name": "Other", "riskcode": 4}]}))
    assert sorted((r.title, r.category, r.severity, r.path, r.method, r.cwe) for r in z.collect()) == [("Other", "dast", "CRITICAL", None, None, None), ("SQL Injection", "injection", "HIGH", "/p", "GET", ["CWE-89"])]
    scan = results.scan_report(texts(spark, {"site": [{"alerts": [{"alert": "CSRF token"}]}]}, {"findings": [{"title": "weak cipher"}, {"name": "nothing"}]}, [{"name": "cookie"}], "<r><alert> XSS </alert></r>"))
    assert sorted((r.name, r.category) for r in scan.collect()) == [("CSRF token", "authentication"), ("XSS", "input-validation"), ("cookie", "session-management"), ("weak cipher", "cryptography")]
    c = results.contracts(texts(spark, {"consumer": {"name": "c"}, "provider": {"name": "p"}, "interactions": [{"description": "d", "request": {"method": "GET", "path": "/x"}, "response": {}}]}, "broken"))
    assert [(r.consumer, r.method, r.status) for r in c.collect()] == [("c", "get", 200)]
    events, problems = results.runtime_evidence(texts(spark, {"events": [{"eventId": "1", "method": "GET", "path": "/x"}]}, "no json"), "events", results.IAST)
    assert (events.count(), [r.file for r in problems.collect()]) == (1, ["f1"])


def test_files(spark, tmp_path):
    for name in ("src/a.ts", "tests/a.test.ts", ".git/x", "node_modules/y.js", ".env", "d/openapi.yaml", "d/x.feature"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = files.listing(spark, str(tmp_path)).withColumn("category", files.file_category(F.col("relative")))
    assert {r.relative: r.category for r in found.collect()} == {"src/a.ts": "service_code", "tests/a.test.ts": "test_code", "d/openapi.yaml": "specification", "d/x.feature": "bdd_scenarios"}
    assert files.coverage_evidence(found).count() == 2
    assert [r.language for r in files.texts(spark, str(tmp_path / "src")).collect()] == ["typescript"]


def test_sinks_and_plugins(spark, tmp_path):
    r = spark.createDataFrame([("a", 2, 1, 50.0)], "type string, total int, covered int, percent double")
    old = spark.createDataFrame([("a", 9, 9, 100.0), ("b", 1, 1, 100.0)], r.schema)
    merged = sinks.write_summary(r, str(tmp_path / "s"), old)
    assert {x.type: x.total for x in merged.collect()} == {"a": 2, "b": 1} and spark.read.json(str(tmp_path / "s")).count() == 2
    out = sinks.render(r, ["html", "junit", "markdown", "nonsense"])
    assert set(out) == {"html", "junit", "markdown"} and 'failures="0"' in out["junit"]
    assert "<failure" in sinks.to_junit(sinks.rows_of(r), {"a": 60.0})
    sinks.write_csv(r, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().percent == "50.0"

    def broken(s, c):
        raise RuntimeError("x")

    assert plugins.run(spark, {"good": lambda s, c: r, "bad": broken}, {}).count() == 1
    assert plugins.run(spark, {"bad": broken}, {}) is None
    tables, errors = plugins.run_stages([("one", lambda t: {"x": r}, False), ("two", broken, True)], {})
    assert set(tables) == {"x"} and "two" in errors

from pyspark.sql import functions as F

from lakeproof.functions import signals
from lakeproof.operators import intelligence as it


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def plain_dedup(recs):
    """recs: (key, id, score) in order."""
    best = {}
    for key, i, score in recs:
        if key not in best or score > best[key][1]:
            best[key] = ([*(best[key][0] if key in best else []), i], score)
    return best


def test_findings_to_recommendations(spark):
    item = "method string, path string, covered boolean, ord long"
    ends = spark.createDataFrame([("GET", "/payments", False, 0), ("GET", "/payments", False, 1), ("GET", "/x", True, 2), (None, None, False, 3)], item)
    errors = spark.createDataFrame([("GET", "/x", False, ["404"], 0), ("GET", "/y", False, [], 1)], "method string, path string, covered boolean, codes array<string>, ord long")
    scans = spark.createDataFrame([("critical", "SQL", None, "GET", "/x", 0), ("weird", "Other", "d", None, None, 1)], "severity string, title string, description string, method string, path string, ord long")
    params = spark.createDataFrame([("p", "GET", "/x", False, ["boundary", "invalid"], 0)], "name string, method string, path string, covered boolean, missing array<string>, ord long")
    named = spark.createDataFrame([("r", False, 0), (None, True, 1)], "name string, covered boolean, ord long")
    steps = named.withColumn("flow", F.lit("f"))
    perf = spark.createDataFrame([("n", None, None, False, True, True, 0)], "name string, method string, path string, covered boolean, has_threshold boolean, resilience boolean, ord long")
    changes = spark.createDataFrame([("gone", "GET", "/x", True, 0), ("added", "GET", "/z", False, 1)], "description string, method string, path string, breaking boolean, ord long")
    controls = spark.createDataFrame([("c", "GET", "/login", False, 0)], "name string, method string, path string, covered boolean, ord long")
    found = it.distinct_findings(
        it.endpoint_findings(ends), it.error_findings(errors), it.business_findings(named), it.flow_findings(steps), it.security_findings(controls), it.parameter_findings(params), it.compatibility_findings(changes), it.performance_findings(perf), it.scan_findings(scans)
    )
    rows = {r.title: r for r in found.collect()}
    assert len(rows) == found.count() == 13
    assert rows["Uncovered endpoint: GET /payments"].severity == "HIGH" and rows["Uncovered endpoint: UNKNOWN /"].severity == "MEDIUM"
    assert rows["Scanner finding: Other"].severity == "LOW"
    recs = it.recommendations(found)
    by = {(r.test_type, r.method, r.path): r for r in recs.collect()}
    # an uncovered money path: 0.3*75 + 0.2*90 + 0.15*95 + 0.15*100 + 0.05*80 + 0.05*40 = 75.75
    money = by["positive-api-test", "GET", "/payments"]
    assert (money.score, money.priority, money.band, money.confidence, len(money.linked)) == (76, "P1", "Critical", "high", 1)
    # error gap and invalid-parameter gap ask for the same test of the same endpoint and tie: the later one loses its link
    assert len(by["negative-api-test", "GET", "/x"].linked) == 1
    s = it.summary(found, recs).first()
    assert (s.findings, s.recommendations, s.max_score, s.top[0]) == (13, len(by), max(r.score for r in by.values()), max(by.values(), key=lambda r: r.score).title)
    assert it.with_findings(recs, found).count() == sum(len(r.linked) for r in by.values())


def test_lines(spark):
    text = "describe('users', () => {\n  it('lists', async () => {\n    await request.get('/users');\n    fetch('/z', { method: 'POST' })\n  })\n jest.mock('./db')\n if (amount > limit) throw new LimitError(x)\n axios.get('https://h.org/other')"
    files = spark.createDataFrame([("a.ts", text)], "file string, content string")
    assert [(r.line, r.method, r.path, r.test_name) for r in signals.named_calls(files).orderBy("line").collect()] == [(2, "GET", "/users", "lists"), (3, "POST", "/z", "lists")]
    mocks = signals.lines_of(files).select("line", signals.mock_of(F.col("text"), "javascript").alias("m")).filter("m is not null").collect()
    assert [(r.line, r.m.library, r.m.kind, r.m.target) for r in mocks] == [(5, "jest", "return-value", "./db")]
    assert {(r.line, r.kind) for r in signals.inferred_rules(files).collect()} == {(6, "business_logic")}


def test_signals(spark):
    t = F.lit
    got = one(
        spark, signals.asserted(t("res"), t("expect(res.status)")), signals.asserted(t("res"), t("expect(result)")), signals.asserted(t("r"), t("assert r.status_code")), signals.asserted(t(""), t("expect()")),
        signals.dependency_category(t("Spring-Security-core")), signals.dependency_category(t("jest"), {"jest": "testFramework"}), signals.dependency_category(t("zzz")),
    )
    assert got == [True, False, True, False, "securityLibrary", "testFramework", "unknown"]
    a = one(spark, signals.auth_class(t("Flask"), t("@jwt_optional")), signals.auth_class(t("hapi"), t("auth: {mode: 'try'}")), signals.auth_class(t("hapijs"), t("auth: 'jwt'")), signals.auth_class(t("x"), t("y")))
    assert [(x.type, x.required) if x else None for x in a] == [("jwt", False), ("jwt", False), ("jwt", True), None]
    f = one(spark, signals.scenario_flags(F.array(t("Min"), t("missing-x"))), signals.scenario_categories(F.array(t("missing-x"), t("code-404"))), signals.scenario_categories(F.array(t("bearer")), signals.SCENARIO_SECURITY))
    assert (f[0].boundary_value, f[0].missing, f[1], f[2]) == (True, False, ["missing-parameter", "not-found"], ["authentication"])
    c = one(spark, signals.covers_control(t("authorization"), t("a:get:/u/{id}"), t("GET /u/{id}"), t("returns 403"), t("get('/u/7')")), signals.covers_control(t("authorization"), t("x"), t("GET /v"), t("returns 403"), t("")), signals.covers_control(t("cryptography"), t("cryptography:https"), F.lit(None).cast("string"), t("x @security cryptography:https"), t("")))
    assert c == [True, False, True]
    m = one(spark, signals.redact(F.create_map(t("Api-Key"), t("k"), t("name"), t("n"))), signals.fenced_json(t('x ```json\n{"summary": "s", "confidence": "HIGH", "items": ["a"]}\n``` y')), signals.fenced_json(t("plain")))
    assert m[0] == {"Api-Key": "[REDACTED]", "name": "n"} and m[1].asDict() == {"summary": "s", "confidence": "high", "items": ["a"]} and m[2].asDict() == {"summary": "plain", "confidence": "medium", "items": []}

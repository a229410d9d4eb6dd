from pyspark.sql import functions as F

from lakeproof.functions import keywords
from lakeproof.operators import details, keys, reports
from lakeproof.sources import parameterized


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_keywords_of_conditions(spark):
    of = lambda text: one(spark, keywords.specific_keywords(F.lit(text).cast("string")).alias("k")).k
    assert of("throw new HttpException(422, { email: ['x'] })") == ["email"]
    assert of("if (userName == null) throw new UserNotFoundException('quota exceeded')") == ["quota", "exceeded", "user", "name", "null", "found"]
    assert of(None) == of("") == of("the error") == []


def test_parameterized_tests(spark):
    java = "class A {\n @ParameterizedTest\n @CsvSource({\"a,1\", \"b,2\", \"c,3\"})\n void adds(int a) {}\n @ParameterizedTest\n @MethodSource(\"rows\")\n void reads(int a) {}\n static Stream<Arguments> rows() { return Stream.of(Arguments.of(1), Arguments.of(2)); }\n @ParameterizedTest\n @EnumSource(K.class)\n fun kinds(k: K)"
    python = "@pytest.mark.parametrize('a,b', [(1, 2), (3, 4)])\ndef test_a(a, b): pass\n@pytest.mark.parametrize('a', [1, [2, 3], 4])\ndef test_b(a): pass\n@pytest.mark.parametrize('a', open)\n"
    jest = "test.each([1, 2, 3])('test %i', (v) => {})\nit.each`\n a | b\n 1 | 2\n`('x')"
    files = spark.createDataFrame([("j", "java", java), ("p", "python", python), ("t", "typescript", jest), ("n", "python", None), ("r", "ruby", python), ("e", "java", "")], "file string, language string, content string")
    got = {(r.file, r.line): (r.test_name, r.variants, r.pattern) for r in parameterized.parameterized_tests(files).collect()}
    assert got == {
        ("j", 2): ("adds", 3, "@CsvSource"), ("j", 5): ("reads", 3, "@MethodSource(rows)"), ("j", 9): ("kinds", None, "@EnumSource"),
        ("p", 1): ("test_a", 2, "@pytest.mark.parametrize"), ("p", 3): ("test_b", 3, "@pytest.mark.parametrize"), ("p", 5): ("unknown", None, "@pytest.mark.parametrize"),
        ("t", 1): ("test %i", None, "test.each"), ("t", 2): ("parameterized test", 2, "test.each (template)"),
    }
    assert parameterized.parameterized_tests(files.limit(0)).count() == 0


def test_details_of_every_type(spark):
    rows = [
        ("endpoint", '{"endpoints": [{"method": "GET", "path": "/a", "covered": true}, {"id": "PUT /a b"}]}'),
        ("parameter", '{"parameters": [{"parameter": {"method": "GET", "path": "/a", "name": "q"}, "ratio": 0.5}, {"ratio": 0}]}'),
        ("business", '{"rules": [{"rule": {"id": "r1", "endpoints": ["GET /a", "/b"]}, "covered": true}, {"rule": {"id": "r2"}}]}'),
        ("integration", '{"flows": [{"flow": {"steps": [{"method": "GET", "path": "/a", "name": "s"}, {"path": "/b"}]}, "status": "partial"}, {"status": "missing"}]}'),
        ("error", '{"scenarios": [{"scenario": {"id": "e1", "method": "GET", "path": "/a", "errorCode": 404}, "covered": true}, {"id": "x", "description": "Null check"}]}'),
        ("security", '{"controls": [{"control": {"id": "c", "endpoint": "GET /a"}}, {"control": {"endpoint": "bare"}}]}'),
        ("performance", '{"performanceCoverages": [{"endpoint": {"id": "p", "method": "GET", "path": "/a"}, "hasLoadTestData": true}]}'),
        ("resilience", '{"resilienceCoverages": [{"scenario": {"id": "z", "endpoint": {"method": "GET", "path": "/a"}}}, {"scenario": {"id": "y"}}]}'),
        ("other", "{}"), ("endpoint", None), ("endpoint", "nonsense"),
    ]
    reports_ = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "report int, type string, details string")
    got = sorted((r.report, r.position, r.method, r.path, r.covered, r.name, ",".join(r.error_codes)) for r in details.normalized(reports_).collect())
    assert got == [
        (0, 0, "GET", "/a", True, None, ""), (0, 1, "PUT", "/a b", False, None, ""), (1, 0, "GET", "/a", True, "q", ""), (1, 1, None, None, False, None, ""),
        (2, 0, "GET", "/a", True, "r1", ""), (2, 1, None, "/b", True, "r1", ""), (2, 2, None, None, False, "r2", ""), (3, 0, "GET", "/a", True, "s", ""),
        (4, 0, "GET", "/a", True, "e1", "404"), (4, 1, None, None, False, "x", "500"), (5, 0, "GET", "/a", False, "c", ""), (6, 0, "GET", "/a", True, "p", ""), (7, 0, "GET", "/a", False, "z", ""),
    ]


def test_alerts_of_labels_and_age(spark):
    rows = [("api_coverage_ratio", {"coverage_type": "error", "service": "s"}, 0.0), ("api_coverage_ratio", {"coverage_type": "endpoint", "service": "s"}, 0.9), ("api_security_gate_passed", {"service": "s"}, 0.0), ("api_security_scan_timestamp_seconds", {"service": "s"}, 100.0), ("api_security_findings_total", {"category": "secret"}, 0.0)]
    gauges = spark.createDataFrame(rows, "metric string, labels map<string,string>, value double")
    got = sorted((r.alert, r.value) for r in reports.firing(gauges, F.lit(100_000.0)).collect())
    assert got == [("ApiCoverageRatioLow", 0.0), ("ApiErrorCoverageZero", 0.0), ("SecurityGateFailed", 0.0), ("SecurityScanStale", 99_900.0)]


def test_driver_side_settings(spark):
    assert [reports.exit_code(p, f) for p, f in ((True, None), (False, None), (False, True), (False, False))] == [0, 1, 1, 0]
    now = "2024-01-02T03:04:05.678Z"
    stamp = "2024-01-02T03-04-05-678Z"
    assert [reports.build_id(p, now, {"GITHUB_SHA": "abc", "GITHUB_REF_NAME": "a/b"}) for p in (None, "timestamp", "commit-sha", "run-number", "branch-timestamp", "mine")] == [stamp, stamp, "abc", stamp, "a-b-" + stamp, "mine"]
    got = reports.merge_config({"thresholds": {"a": 1, "b": 2}, "exclude": {"paths": ["/x"]}, "testPatterns": ["t"], "plugins": ["p"]}, {"thresholds": {"b": 3}, "exclude": {"methods": ["GET"]}, "testPatterns": [], "plugins": ["q"]})
    assert got == {"thresholds": {"a": 1, "b": 3}, "exclude": {"paths": ["/x"], "methods": ["GET"]}, "testPatterns": ["t"], "plugins": ["p", "q"]}
    files = spark.createDataFrame([("a.ts", "service", "typescript", 1), ("b.py", "test", "python", 2), ("c.ts", "test", "typescript", 3), ("d", "spec", None, 4)], "path string, kind string, language string, ord int")
    assert {(r.kind, r.value) for r in reports.scan_manifest(files, "ord").collect()} == {("service", "a.ts"), ("test", "b.py"), ("test", "c.ts"), ("spec", "d"), ("language", "typescript"), ("language", "python")}
    assert one(spark, reports.endpoint_key(F.lit(None).cast("string"), F.lit("/a")).alias("k")).k == "GET /a"
    lists = lambda *rows: spark.createDataFrame(rows, "id int, x array<string>")
    merged = keys.union_lists(lists((1, ["a", "b", "a"]), (2, None)), lists((1, ["c", "b"]), (3, ["d"])), ["id"], "x")
    assert {r.id: r.x for r in merged.collect()} == {1: ["a", "b", "c"], 2: [], 3: ["d"]}

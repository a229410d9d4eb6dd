import pytest
from pyspark.sql import functions as F

from lakeproof.functions import errors, evidence, extract, numeric, paths, risk


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_rounding_ties_go_up(spark):
    got = one(spark, *[numeric.round_half_up(F.lit(x)) for x in (2.5, -2.5, -2.6, 0.49)])
    assert got == [3, -2, -3, 0]
    assert one(spark, numeric.percent(F.lit(2), F.lit(3)), numeric.percent(F.lit(0), F.lit(0)), numeric.percent_fixed(F.lit(0), F.lit(0)), numeric.percent_whole(F.lit(1), F.lit(8))) == [66.67, 0.0, 100.0, 13.0]
    assert one(spark, numeric.to_number(F.lit(" 12.5ms")), numeric.to_number(F.lit("x")), numeric.share_of_flags(F.lit(True), F.lit(None), F.lit(False), F.lit(True))) == [12.5, None, 0.5]


@pytest.mark.parametrize(
    "template, path, fits",
    [("/users/{id}", "/users/7", True), ("/users/{id}", "/users/7/orders", False), ("/a.b", "/axb", False), ("/users", "/users", True), ("/{a}/{b}", "/x/y", True), ("/users/{id}", "/users/", False)],
)
def test_path_to_regex(spark, template, path, fits):
    assert one(spark, F.lit(path).rlike(one(spark, paths.path_to_regex(F.lit(template)))[0])) == [fits]


def test_paths(spark):
    got = one(
        spark, paths.normalize(F.lit("/users/12/550e8400-e29b-41d4-a716-446655440000/deadbeef1/my-post-2/{x}/name")), paths.url_path(F.lit("https://h.org/a/b?x#y")), paths.url_path(F.lit("https://h.org")), paths.url_path(F.lit("/a")),
        paths.compose(F.lit("/api/"), F.lit("/users/<int:id>"), F.lit(":name/")), paths.skeleton(F.lit("/u/{id}/{x}")),
    )
    assert got == ["/users/{id}/{id}/{id}/{id}/{x}/name", "/a/b", "/", "/a", "/api/users/{id}/{name}", "/u/{}/{}"]
    # contract paths keep the meaning of a dot, endpoint paths do not
    assert one(spark, F.lit("/axb").rlike(one(spark, paths.contract_regex(F.lit("/a.b")))[0])) == [True]
    assert one(spark, paths.excluded(F.lit("get"), F.lit("/x/y"), ["GET"]), paths.excluded(F.lit("get"), F.lit("/x/y/z"), [], ["/x/*"]), paths.excluded(F.lit("get"), F.lit("/x/y/z"), [], ["/x/**"])) == [True, False, True]


def test_risk_cutoffs(spark):
    values = [0, 24, 25, 49, 50, 74, 75, 100]
    assert one(spark, *[risk.band(F.lit(v)) for v in values]) == ["Low", "Low", "Moderate", "Moderate", "High", "High", "Critical", "Critical"]
    assert one(spark, *[risk.priority(F.lit(v)) for v in (85, 84, 70, 69, 50, 49)]) == ["P0", "P1", "P1", "P2", "P2", "P3"]
    assert one(spark, risk.priority(F.lit(10), F.lit(True)), risk.priority(F.lit(90), F.lit(True))) == ["P1", "P0"]
    full = {k: F.lit(100) for k, _ in risk.WEIGHTS}
    assert one(spark, risk.score(F.lit("LOW"), F.lit("x"), F.lit(None).cast("string"), F.lit(False), F.lit(False), full)) == [100]
    # the internal path rule precedes the authentication rule
    assert one(spark, risk.exposure_weight(F.lit("x"), F.lit("/admin/login")), risk.exposure_weight(F.lit("x"), F.lit("/login")), risk.exposure_weight(F.lit("x"), F.lit(None).cast("string"))) == [30, 90, 50]
    assert one(spark, risk.framework_hints(F.array(F.lit("Java"), F.lit("kotlin"), F.lit("c")))) == [["junit", "testng", "rest-assured", "spring-mockmvc", "kotest", "ktor-test"]]


def test_confidence(spark):
    t, f = F.lit(True), F.lit(False)
    level = evidence.confidence
    assert one(spark, level(t, f, f, f, f), level(t, t, f, f, f), level(t, t, t, f, f), level(t, t, t, t, f), level(t, t, t, t, t), level(t, t, t, t, t, f, t)) == ["low", "medium", "high", "high", "verified", "medium"]
    assert one(spark, evidence.coverage_class(F.lit("security"), f), evidence.coverage_class(F.lit("e2e"), t), evidence.coverage_class(F.lit(None).cast("string"), f)) == ["api-covered", "mock-covered", "uncovered"]


def test_errors(spark):
    got = one(spark, *[errors.categories_of(F.lit(c), F.lit(d)) for c, d in ((400, "Missing x"), (400, "bad type"), (400, ""), (418, ""), (502, ""), (200, ""))])
    assert got == [["missing-parameter"], ["invalid-value"], ["missing-parameter", "invalid-value"], ["invalid-value"], ["server-error"], []]
    content = F.lit("expect(res.status).toBe( 404 )")
    assert one(spark, errors.asserts_status(content, F.lit(404)), errors.asserts_status(content, F.lit(40)), errors.covers(F.lit("returns not found"), F.lit(""), F.lit(404), F.array(F.lit("not-found")))) == [True, False, True]
    assert one(spark, errors.mentions_endpoint(F.lit("POST /users creates"), F.lit(""), F.lit("POST"), F.lit("/users/{id}")), errors.mentions_endpoint(F.lit("x"), F.lit("call('/users/7', \"get\")"), F.lit("GET"), F.lit("/users/{id}"))) == [False, True]


def test_extract(spark):
    files = spark.createDataFrame(
        [
            ("a.ts", "GET /users and axios.post('https://h/x?y') then app).get(\"/z\") GET /users GET /u/{id}", "typescript"),
            ("b.java", 'given().when().get("/j"); perform(post("/k")); "DELETE /m"', "java"),
            ("c.py", "client.get('/p')\nrequests.put('http://h/q')", "python"),
            ("d.rb", "get '/r'", "ruby"),
            ("e.feature", 'When I send a GET request to "/s"', "cucumber"),
            ("f.x", None, None),
        ],
        "file string, content string, language string",
    )
    got = {(r.file, r.method, r.path) for r in extract.http_calls(files).collect()}
    assert got == {("a.ts", "GET", "/users"), ("a.ts", "POST", "/x"), ("a.ts", "GET", "/z"), ("b.java", "GET", "/j"), ("b.java", "POST", "/k"), ("b.java", "DELETE", "/m"), ("c.py", "GET", "/p"), ("c.py", "PUT", "/q"), ("d.rb", "GET", "/r"), ("e.feature", "GET", "/s")}
    tests = spark.createDataFrame([("a", "x\ntest('one', () => { a });\n it(\"two\", b)"), ("b", "none")], "file string, content string")
    assert [(r.file, r.description) for r in extract.test_entries(tests).orderBy("file", "ord").collect()] == [("a", "one"), ("a", "two")]
    java = spark.createDataFrame([("a", "@Test void adds_one() {} @Test public void b() {}")], "file string, content string")
    assert [r.description for r in extract.java_test_entries(java).orderBy("ord").collect()] == ["adds one", "b"]
    layer = lambda p, c: one(spark, extract.test_layer(F.lit(p), F.lit(c)))[0].asDict()
    assert layer("tests/e2e/a.e2e.ts", "") == {"layer": "e2e", "confidence": "high"}
    assert layer("tests/a.ts", "supertest(app)") == {"layer": "api", "confidence": "medium"}
    assert layer("tests/a.ts", "x") == {"layer": "unit", "confidence": "low"}
    assert one(spark, extract.language_of(F.lit("a/B.KT")), extract.language_of(F.lit("x")), extract.snake_case(F.lit("getUser Name")), extract.humanize(F.lit("getUser_name"))) == ["kotlin", None, "get_user_name", "Get user name"]

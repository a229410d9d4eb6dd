"""Named queries of report, rule and text operators, registered beside those of catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords
from ..operators import details, graph, keys, reports
from ..sources import parameterized
from . import adapt
from .catalog import query


def _pick(values, column: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


@query("""WITH m AS (SELECT o_custkey % 4 <> 0 AS endpoint, ['uncovered', 'mock-covered', 'api-covered'][o_orderkey % 3 + 1] AS class, o_orderkey % 5 = 0 AS verified, o_orderkey % 7 = 0 AS unresolved, o_custkey % 2 AS linked, o_orderkey % 2 AS conflicts FROM orders WHERE o_orderkey IS NOT NULL),
l AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS unit, count(*) FILTER (WHERE event_type = 'click') AS api, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS other FROM events)
SELECT count(*) AS total, count(*) FILTER (WHERE class <> 'uncovered') AS covered, count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE class = 'uncovered') AS uncovered, count(*) FILTER (WHERE class = 'mock-covered') AS mock_limited,
  count(*) FILTER (WHERE unresolved AND linked > 0) AS unresolved, sum(conflicts)::BIGINT AS n_conflicts, any_value(unit) AS unit, any_value(api) AS api, 0 AS e2e, any_value(other) AS other FROM m, l WHERE endpoint""")
def pipeline_summary(spark: SparkSession, d: str) -> DataFrame:
    """A-13."""
    o = adapt.table(spark, d, "orders")
    some = lambda n: F.when(n == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    mappings = o.select(
        F.when(F.col("o_custkey") % 4 != 0, "endpoint").otherwise("flow").alias("item_type"), _pick(("uncovered", "mock-covered", "api-covered"), "o_orderkey").alias("coverage_class"),
        F.when(F.col("o_orderkey") % 5 == 0, "verified").alias("confidence"), F.when(F.col("o_orderkey") % 7 == 0, "unresolved").alias("assertion_source"), some(F.col("o_custkey") % 2).alias("linked_tests"), some(F.col("o_orderkey") % 2).alias("conflicts"),
    )
    kind = F.col("event_type")
    tests = adapt.table(spark, d, "events").select(F.when(kind == "view", "unit").when(kind == "click", "api").otherwise("other").alias("layer"))
    row = reports.pipeline_summary(mappings, tests)
    return row.select("*", *[F.col("by_layer")[x].alias(x) for x in ("unit", "api", "e2e", "other")]).drop("by_layer")


@query(f"""WITH {adapt.FINDINGS_SQL}, r AS (SELECT l_orderkey * 10 + l_linenumber AS id, unnest([l_orderkey, l_orderkey + 1]) AS linked FROM lineitem),
g AS (SELECT r.id, coalesce(arg_min(f.category, f.ord), 'unknown') AS "group" FROM r LEFT JOIN findings f ON f.id = r.linked GROUP BY r.id)
SELECT id, "group", min(id) OVER (PARTITION BY "group") AS group_ord FROM g""")
def risks_by_category(spark: SparkSession, d: str) -> DataFrame:
    """A-20, A-21."""
    id_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    recs = adapt.table(spark, d, "lineitem").select(id_.alias("id"), id_.alias("ord"), F.array("l_orderkey", F.col("l_orderkey") + 1).alias("linked")).distinct()
    return reports.risks_by_category(recs, adapt.findings(spark, d)).select("id", "group", "group_ord")


@query("SELECT o_custkey AS id, max(o_orderkey) AS ord, arg_max(o_orderpriority, o_orderkey) AS condition FROM orders GROUP BY o_custkey")
def details_by_id(spark: SparkSession, d: str) -> DataFrame:
    """A-25."""
    return reports.details_by_id(adapt.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("condition")), "ord")


@query("""WITH g AS (SELECT o_custkey AS type, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS covered, min(o_orderkey) AS ord FROM orders GROUP BY 1), p AS (SELECT *, floor(covered / total * 10000 + 0.5) / 100 AS percent FROM g)
SELECT type, total, covered, percent, total - covered AS missing FROM p WHERE percent < 100 ORDER BY percent, ord LIMIT 5""")
def lowest_coverage(spark: SparkSession, d: str) -> DataFrame:
    """T-04."""
    from ..functions.numeric import percent

    g = adapt.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("type")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("covered"), F.min("o_orderkey").alias("ord"))
    return reports.lowest_coverage(g.withColumn("percent", percent(F.col("covered"), F.col("total")))).select("type", "total", "covered", "percent", "missing")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '`GET /s/' || s_nationkey || '`,`/bare`' WHEN 2 THEN '`' || s_name || '`' ELSE '3 item(s) not covered' END AS gaps FROM supplier""")
def report_gaps(spark: SparkSession, d: str) -> DataFrame:
    """T-07."""
    s = adapt.table(spark, d, "supplier")
    kind = F.col("s_suppkey") % 4
    at = lambda m, p: F.struct(F.lit(m).alias("method"), p.alias("path"))
    ends = F.when(kind == 1, F.array(at("get", F.concat(F.lit("/s/"), F.col("s_nationkey").cast("string"))), at("put", F.lit(None).cast("string")), at(None, F.lit("/bare"))))
    found = reports.gaps(F.lit(10), F.when(kind == 0, 10).otherwise(7), ends, F.when(kind == 2, F.array("s_name")), F.lit(None).cast("array<string>"))
    return s.select("s_suppkey", F.array_join(found, ",").alias("gaps"))


@query(f"""WITH {adapt.FINDINGS_SQL}, {adapt.SCORED_SQL} SELECT id, path, score FROM ranked WHERE category = 'other' AND band = 'High' AND contains(lower(path), 'log')""")
def filtered_findings(spark: SparkSession, d: str) -> DataFrame:
    """F-20, T-09."""
    from .catalog import _scored

    found = reports.matching(_scored(spark, d), {"severity": "all", "category": "other", "band": "High"}, "LOG")
    return reports.sorted_by(found, "score", "desc", "ord").select("id", "path", "score")


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 2""")
def first_files(spark: SparkSession, d: str) -> DataFrame:
    """T-11."""
    return reports.first_files(adapt.table(spark, d, "events"), 2, ["user_id"], "event_id").select("event_id", "event_type")


@query("""SELECT doc_id, 'quota|limit|field' || doc_id || '|user|not2|total' AS words FROM documents""")
def rule_keywords(spark: SparkSession, d: str) -> DataFrame:
    """X-30: conditions with quoted words, an object key and camel-case names around the document's number."""
    condition = F.concat(F.lit("throw new HttpException('Quota-limit the', { field"), F.col("doc_id").cast("string"), F.lit(": userNot2Total })"))
    found = adapt.table(spark, d, "documents").select("doc_id", keywords.specific_keywords(condition).alias("w"))
    return found.select("doc_id", F.array_join("w", "|").alias("words"))


@query("""SELECT 'f' || p_partkey AS file, 2 AS line, 'check' || p_partkey AS test_name, CASE p_partkey % 3 WHEN 0 THEN p_size % 5 + 1 WHEN 1 THEN 3 ELSE 2 END AS variants, CASE p_partkey % 3 WHEN 0 THEN '@pytest.mark.parametrize' WHEN 1 THEN '@ValueSource' ELSE '@CsvSource' END AS pattern FROM part""")
def parameterized_tests(spark: SparkSession, d: str) -> DataFrame:
    """X-18: variants written into source texts and counted again."""
    kind, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    values = F.array_join(F.transform(F.sequence(F.lit(0).cast("int"), (F.col("p_size") % 5).cast("int")), lambda x: F.concat(F.lit("["), x.cast("string"), F.lit(", 1]"))), ", ")
    python = F.concat(F.lit("import x\n@pytest.mark.parametrize('a,b', ["), values, F.lit("])\ndef check"), key, F.lit("(a, b):\n    pass"))
    java = F.concat(F.lit("class A {\n@ParameterizedTest\n"), F.when(kind == 1, '@ValueSource(ints = {1, 2, 3})').otherwise('@CsvSource({"a,1", "b,2"})'), F.lit("\nvoid check"), key, F.lit("(int a) {}"))
    files = adapt.table(spark, d, "part").select(F.concat(F.lit("f"), key).alias("file"), F.when(kind == 0, "python").otherwise("java").alias("language"), F.when(kind == 0, python).otherwise(java).alias("content"))
    return parameterized.parameterized_tests(files)


@query("""SELECT c_custkey AS report, c_custkey % 2 = 0 AS covered, CASE WHEN c_custkey % 3 = 2 THEN 'c' || c_custkey END AS name, CASE WHEN c_custkey % 3 = 1 THEN '404' ELSE '' END AS codes,
  CASE WHEN c_custkey % 3 <> 1 THEN 'GET' END AS method, CASE c_custkey % 3 WHEN 0 THEN '/c/' || c_nationkey WHEN 1 THEN '/cart' ELSE '/k' END AS path FROM customer WHERE c_custkey % 3 <> 1
UNION ALL SELECT c_custkey, c_custkey % 2 = 0, 'gone' || c_custkey, '404', NULL, '/cart' FROM customer WHERE c_custkey % 3 = 1""")
def normalized_details(spark: SparkSession, d: str) -> DataFrame:
    """D-09: endpoint, inferred error and security details, written as JSON and read again."""
    key = F.col("c_custkey").cast("string")
    covered = F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false")
    forms = (
        ("endpoint", F.concat(F.lit('{"items": [{"id": "GET /c/'), F.col("c_nationkey").cast("string"), F.lit('", "covered": '), covered, F.lit("}]}"))),
        ("error", F.concat(F.lit('{"items": [{"description": "Item not found", "source_location": "src/CartApi.java:3", "id": "gone'), key, F.lit('", "covered": '), covered, F.lit("}]}"))),
        ("security", F.concat(F.lit('{"controls": [{"control": {"id": "c'), key, F.lit('", "endpoint": "GET /k"}, "covered": '), covered, F.lit('}, {"control": {"id": "x"}}]}'))),
    )
    nth = lambda n: F.coalesce(*[F.when(F.col("c_custkey") % 3 == k, f[n] if n else F.lit(f[0])) for k, f in enumerate(forms)])
    rows = details.normalized(adapt.table(spark, d, "customer").select(F.col("c_custkey").alias("report"), nth(0).alias("type"), nth(1).alias("details")))
    return rows.select("report", "covered", "name", F.array_join("error_codes", ",").alias("codes"), "method", "path")


@query(f"""WITH {adapt.FINDINGS_SQL}, c AS (SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS n, count(*) FILTER (WHERE severity = 'HIGH') AS h, count(*) FILTER (WHERE category = 'other') AS o FROM findings)
SELECT 'summary' AS part, 'Security gate FAILED. ' || (n + h) || ' critical/high severity finding(s) require immediate remediation before this change can be merged.' AS sentence FROM c
UNION ALL SELECT 'risk', n || ' CRITICAL finding(s) must be fixed immediately' FROM c UNION ALL SELECT 'risk', h || ' HIGH finding(s) pose significant risk' FROM c UNION ALL SELECT 'cause', 'Findings span categories: other' FROM c WHERE o > 0""")
def security_analysis(spark: SparkSession, d: str) -> DataFrame:
    """D-11."""
    from ..operators.coverage import zero_filled_counts

    found = adapt.findings(spark, d).filter("upper(severity) in ('CRITICAL', 'HIGH') or category = 'other'")
    counts = zero_filled_counts(found.filter("severity in ('CRITICAL', 'HIGH')"), {"severity": list(reports.SEVERITIES)}).unionByName(zero_filled_counts(found, {"category": ["other", "secret"]}))
    rows = reports.security_analysis(counts, False, ["other", "secret"], ["s1"])
    return rows.filter("part in ('summary', 'risk', 'cause')").select("part", "sentence")


@query("""WITH g AS (SELECT 's' || p_brand AS service, p_type AS kind, count(*) FILTER (WHERE p_size > 40) AS n, count(*) FILTER (WHERE p_size > 25) / count(*) AS ratio FROM part GROUP BY ALL)
SELECT 'ApiCoverageRatioLow' AS alert, 'warning' AS severity, service, ratio AS value FROM g WHERE ratio < 0.8 UNION ALL SELECT 'SecurityHighFindingsDetected', 'warning', service, sum(n)::DOUBLE FROM g GROUP BY service HAVING sum(n) > 0""")
def firing_alerts(spark: SparkSession, d: str) -> DataFrame:
    """R-03."""
    g = adapt.table(spark, d, "part").groupBy(F.concat(F.lit("s"), F.col("p_brand")).alias("service"), F.col("p_type").alias("kind")).agg(F.count_if(F.col("p_size") > 40).alias("n"), (F.count_if(F.col("p_size") > 25) / F.count("*")).alias("ratio"))
    labels = lambda *more: F.create_map(F.lit("service"), F.col("service"), *[F.lit(x) for x in more])
    ratios = g.select(F.lit("api_coverage_ratio").alias("metric"), labels("coverage_type", "endpoint").alias("labels"), F.col("ratio").alias("value"))
    counts = g.select(F.lit("api_security_findings_total").alias("metric"), labels("severity", "HIGH").alias("labels"), F.col("n").cast("double").alias("value"))
    return reports.firing(ratios.unionByName(counts)).drop("labels")


@query("""WITH f AS (SELECT l_suppkey AS file, l_partkey % 50 AS name, min(l_orderkey) AS ord FROM lineitem GROUP BY ALL), c AS (SELECT DISTINCT o_custkey % 20 AS file, o_orderkey % 60 AS name FROM orders),
i AS (SELECT DISTINCT ps % 20 AS file, ps % 7 AS imported FROM (SELECT p_partkey AS ps FROM part)),
m AS (SELECT c.file, c.name, 0 AS t, f.ord AS o, f.file AS d FROM c JOIN f USING (file, name) UNION ALL SELECT c.file, c.name, 1, i.imported, f.file FROM c JOIN i USING (file) JOIN f ON f.file = i.imported AND f.name = c.name UNION ALL SELECT c.file, c.name, 2, f.ord, f.file FROM c JOIN f ON f.name = c.name)
SELECT c.file, c.name, arg_min(m.d, (m.t, m.o, m.d)) AS defined_in FROM c LEFT JOIN m ON m.file = c.file AND m.name = c.name GROUP BY c.file, c.name""")
def function_files(spark: SparkSession, d: str) -> DataFrame:
    """J-24."""
    functions = adapt.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 50).alias("name"), F.col("l_orderkey").alias("ord"))
    calls = adapt.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("file"), (F.col("o_orderkey") % 60).alias("name")).distinct()
    imports = adapt.table(spark, d, "part").select((F.col("p_partkey") % 20).alias("file"), (F.col("p_partkey") % 7).alias("imported"), (F.col("p_partkey") % 7).alias("ord")).distinct()
    return graph.function_files(calls, functions, imports)


@query("""WITH e AS (SELECT '/s/' || s_suppkey AS path, s_suppkey % 2 = 0 AS required, s_suppkey % 3 = 0 AS optional FROM supplier WHERE s_acctbal > 0)
SELECT path, unnest(list_filter([CASE WHEN required THEN 'missing-401-test' END, CASE WHEN optional THEN 'missing-optional-dual-path' END], lambda x: x IS NOT NULL)) AS gap FROM e""")
def auth_gaps(spark: SparkSession, d: str) -> DataFrame:
    """J-28."""
    key, path = F.col("s_suppkey"), F.concat(F.lit("/s/"), F.col("s_suppkey").cast("string"))
    ends = adapt.table(spark, d, "supplier").select(path.alias("path"), (key % 2 == 0).alias("required"), (key % 3 == 0).alias("optional"), "s_acctbal")
    return graph.auth_gaps(ends.drop("s_acctbal"), ends.filter("not s_acctbal > 0").select("path"))


@query("""SELECT p_type AS type, p_brand AS name, p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) AS covered FROM (SELECT DISTINCT p_type, p_brand FROM part)""")
def field_usage(spark: SparkSession, d: str) -> DataFrame:
    """J-30."""
    p = adapt.table(spark, d, "part")
    return graph.field_usage(p.select(F.col("p_type").alias("type"), F.col("p_brand").alias("name")).distinct(), p.filter("p_size > 48").select(F.col("p_brand").alias("name")))


@query("""SELECT 'SA02' AS rule, 'warning' AS severity, 'm' || n_nationkey AS file, n_regionkey::INT AS line, n_name AS subject FROM nation WHERE n_nationkey % 3 IN (0, 1) UNION ALL SELECT 'SA04', 'error', 'r' || s_suppkey, 1, s_name FROM supplier WHERE s_suppkey % 6 = 0""")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    """G-14."""
    n, s = adapt.table(spark, d, "nation"), adapt.table(spark, d, "supplier")
    mounts = n.select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("file"), F.col("n_regionkey").cast("int").alias("line"), _pick(("", "/", "/api"), "n_nationkey").alias("prefix"), F.col("n_name").alias("target"))
    key = F.col("s_suppkey")
    routes = s.select(F.concat(F.lit("r"), key.cast("string")).alias("file"), F.lit(1).alias("line"), F.col("s_name").alias("path"), (key % 2 == 0).alias("required"), (key % 3 == 0).alias("optional"))
    return graph.rule_violations(mounts, routes)


@query("""WITH a AS (SELECT o_custkey AS id, list(DISTINCT o_orderstatus) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS id, list(DISTINCT o_orderpriority) AS x FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.x, []), coalesce(b.x, [])))), ',') AS merged FROM a FULL JOIN b ON a.id = b.id""")
def merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    """U-02."""
    o = adapt.table(spark, d, "orders")
    part = lambda k, c: o.filter(f"o_orderkey % 2 = {k}").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(c).alias("evidence"))
    merged = keys.union_lists(part(0, "o_orderstatus"), part(1, "o_orderpriority"), ["id"], "evidence")
    return merged.select("id", F.array_join(F.sort_array("evidence"), ",").alias("merged"))

"""The driver tables read as the engine's entities, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENDPOINTS = (("GET", "/users/{id}"), ("POST", "/users/{id}"), ("POST", "/users/{id}/orders"), ("GET", "/users/{id}/clicks"), ("DELETE", "/users/{id}"), ("GET", "/health"))
FINDING_CATEGORIES = ("missing-auth-test", "uncovered-endpoint", "missing-flow-step-test", "compatibility-risk", "other")
FINDING_PATHS = ("/payments/1", "/admin/users", "/login", "/profile", "/items")
RULES = (("auth", ("access", "token")), ("license", ("license", "rights reserved")), ("insult", ("idiot", "stupid")), ("sum", ("total", "the sum of")), ("none", ("zzzz-never",)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, method, path, elapsed, event_type) of events."""
    kind = F.col("event_type")
    method = F.when(kind.isin("view", "click"), "GET").when(kind.isin("signup", "purchase"), "POST").otherwise("DELETE")
    tail = F.when(kind == "purchase", "/orders").when(kind == "click", "/clicks").otherwise("")
    path = F.concat(F.lit("/users/"), F.col("user_id").cast("string"), tail)
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", method.alias("method"), path.alias("path"), F.col("value").alias("elapsed"), "event_type")


CALLS_SQL = """calls AS (
  SELECT event_id, ts, user_id, CASE WHEN event_type IN ('view', 'click') THEN 'GET' WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'DELETE' END AS method,
    '/users/' || user_id || CASE event_type WHEN 'purchase' THEN '/orders' WHEN 'click' THEN '/clicks' ELSE '' END AS path, value AS elapsed, event_type FROM events
)"""


def endpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENDPOINTS), "method string, path string")


ENDPOINTS_SQL = "endpoints(method, path, re) AS (VALUES " + ", ".join(f"('{m}', '{p}', '^{p.replace('{id}', '[^/]+')}$')" for m, p in ENDPOINTS) + ")"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ord, severity, category, path, zero, signal) of orders."""
    key = F.col("o_orderkey")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(key, F.lit(n)) + 1).cast("int"))
    severity = F.element_at(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "info")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), key.alias("ord"), severity.alias("severity"), pick(FINDING_CATEGORIES, 5).alias("category"), F.element_at(F.array(*[F.lit(x) for x in FINDING_PATHS]), (F.pmod(F.col("o_custkey"), F.lit(5)) + 1).cast("int")).alias("path"),
        (F.pmod(key, F.lit(3)) == 0).alias("zero"), (F.pmod(key, F.lit(7)) == 0).alias("signal"), F.pmod(F.col("o_custkey"), F.lit(97)).alias("bucket"),
    )


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


FINDINGS_SQL = f"""findings AS (
  SELECT o_orderkey AS id, o_orderkey AS ord, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'info'][substr(o_orderpriority, 1, 1)::INT] AS severity,
    {_list(FINDING_CATEGORIES)}[o_orderkey % 5 + 1] AS category, {_list(FINDING_PATHS)}[o_custkey % 5 + 1] AS path, o_orderkey % 3 = 0 AS zero, o_orderkey % 7 = 0 AS signal, o_custkey % 97 AS bucket FROM orders
)"""
SCORED_SQL = """weights AS (
  SELECT *, CASE upper(severity) WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 ELSE 25 END AS w1,
    CASE WHEN category = 'missing-auth-test' THEN 80 WHEN regexp_matches(path, 'admin|internal') THEN 30 WHEN regexp_matches(path, 'auth|login|token|payment|wallet|transfer') THEN 90 ELSE 50 END AS w2,
    CASE WHEN category = 'missing-auth-test' THEN 90 WHEN regexp_matches(path, 'payment|wallet|transfer|refund|debit|charge') THEN 95 WHEN regexp_matches(path, 'auth|login|token') THEN 90
      WHEN regexp_matches(path, 'profile|account|user') THEN 50 ELSE CASE category WHEN 'uncovered-endpoint' THEN 70 WHEN 'missing-flow-step-test' THEN 65 WHEN 'compatibility-risk' THEN 70 ELSE 40 END END AS w3,
    CASE WHEN zero THEN 100 ELSE 75 END AS w4, CASE WHEN signal THEN 100 ELSE 0 END AS w5,
    CASE WHEN category = 'missing-flow-step-test' OR regexp_matches(path, 'payment|checkout|signup') THEN 80 ELSE CASE category WHEN 'uncovered-endpoint' THEN 30 WHEN 'compatibility-risk' THEN 60 ELSE 20 END END AS w6
  FROM findings
), scored AS (
  SELECT *, least(100, greatest(0, floor(0.30::DOUBLE * w1 + 0.20::DOUBLE * w2 + 0.15::DOUBLE * w3 + 0.15::DOUBLE * w4 + 0.10::DOUBLE * w5 + 0.05::DOUBLE * w6 + 0.05::DOUBLE * 40 + 0.5)))::INT AS score FROM weights
), ranked AS (
  SELECT *, CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Moderate' ELSE 'Low' END AS band,
    CASE WHEN score >= 85 THEN 'P0' WHEN score >= 70 THEN 'P1' WHEN regexp_matches(path, 'payment|wallet|transfer|refund|debit|charge|fund|payout') OR category = 'missing-auth-test' THEN 'P1'
      WHEN score >= 50 THEN 'P2' ELSE 'P3' END AS priority FROM scored
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, source, target): nations belong to regions and regions list nations; customers live in nations."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    parts = [
        nation.select(F.lit("in").alias("type"), node("n", "n_nationkey").alias("source"), node("r", "n_regionkey").alias("target")),
        nation.filter("n_nationkey % 4 = 0").select(F.lit("lists").alias("type"), node("r", "n_regionkey").alias("source"), node("n", "n_nationkey").alias("target")),
        customer.select(F.lit("lives").alias("type"), node("c", "c_custkey").alias("source"), node("n", "c_nationkey").alias("target")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


EDGES_SQL = """edges AS (
  SELECT 'in' AS type, 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target FROM nation
  UNION ALL SELECT 'lists', 'r:' || n_regionkey, 'n:' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0
  UNION ALL SELECT 'lives', 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
)"""

"""File listings and whole texts (S-01, S-02, S-21, X-19, F-19, T-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import language_of

# What names tell about a file.
SERVICE = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "kt", "kts", "py", "rb", "go", "cs", "cpp", "cc", "h", "rs")
TEST_FILE = r"\.(test|spec)\.[a-zA-Z]+$|Tests?\.(java|kt|kts)$|Spec\.(java|kt|kts|rb|ts|js)$|^test_|_test\.py$|_spec\.rb$"
SPEC_NAME = r"^(?:openapi|swagger).*\.(?:ya?ml|json)$|.*(?:openapi|swagger).*\.(?:ya?ml|json)$"
METADATA_NAME = r"^(?:business-rules|integration-flows)[^/]*\.(?:ya?ml|json)$"
CONFIG_NAME = r"^(?:package\.json|tsconfig\.json|config\.ya?ml|coverage\.config\.json|pom\.xml|build\.gradle(?:\.kts)?|requirements\.txt|pyproject\.toml|gemfile|go\.mod)$|\.env$|\.config\.(?:json|js|ts)$"


def listing(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("node_modules", "dist", "build"), depth: int = 20) -> DataFrame:
    """S-01: (path, length, relative) of the files below root, without excluded names and not deeper than depth. Spark's own
    listing leaves out names that start with a dot or an underscore, `.env` among them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^/*" + root.split("://")[-1].strip("/") + "/", "")
    parts = F.split(below, "/")
    hidden = F.exists(parts, lambda p: p.isin(*exclude))
    return files.withColumn("relative", below).filter(~hidden & (F.size(parts) <= depth + 1))


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S-02: (file, content, language) of whole text files."""
    read = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return read.withColumn("language", language_of(F.col("file")))


def is_test_file(name: Column) -> Column:
    """X-19."""
    return name.rlike(TEST_FILE)


def file_category(path: Column) -> Column:
    """X-19: one of ten categories, by the first rule that fits."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    low, ext = F.lower(name), F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    inside = lambda *dirs: F.exists(F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/"), lambda s: s.isin(*dirs))
    return (
        F.when(low.rlike(SPEC_NAME), "specification")
        .when(low.rlike(METADATA_NAME), "metadata")
        .when(low.rlike(CONFIG_NAME), "configuration")
        .when(ext == "feature", "bdd_scenarios")
        .when(low.endswith(".pact.json") | (inside("contracts") & (ext == "json")), "contracts")
        .when(inside("security", "security-reports", "zap", "reports-security") & (ext == "json"), "security_reports")
        .when(inside("performance", "load-tests", "jmeter", "k6") & ext.isin("jtl", "json", "csv"), "performance")
        .when(is_test_file(name), "test_code")
        .when(ext.isin(*SERVICE), "service_code")
        .otherwise("unknown")
    )


def coverage_evidence(files: DataFrame) -> DataFrame:
    """F-19: the files whose category counts as evidence."""
    return files.filter(F.col("category").isin("test_code", "bdd_scenarios"))

"""Dependencies and CI platforms from manifest files (S-20, S-21, P-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import dependency_category
from ..operators.keys import first_by

# Marker files of CI platforms in order of precedence.
CI_MARKERS = (
    ("github-actions", r"(^|/)\.github/workflows/[^/]+\.ya?ml$"),
    ("gitlab-ci", r"(^|/)\.gitlab-ci\.ya?ml$"),
    ("jenkins", r"(^|/)Jenkinsfile$"),
    ("azure-pipelines", r"(^|/)azure-pipelines\.ya?ml$"),
    ("circleci", r"(^|/)\.circleci/config\.ya?ml$"),
    ("travis", r"(^|/)\.travis\.ya?ml$"),
)
#: File name pattern, then the line pattern with the groups (name, version) of each manifest without a tree structure.
LINES = (
    ("requirements.txt", r"(^|/)requirements[^/]*\.txt$", r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:[=<>~!]=?\s*([0-9][^\s;,#]*))?"),
    ("gradle", r"\.gradle(\.kts)?$", r"""(?m)^\s*\w*(?:mplementation|api|ompile|untimeOnly|ompileOnly)\s*\(?\s*["']([^"':]+:[^"':]+)(?::([^"']+))?["']"""),
    ("gemfile", r"(^|/)Gemfile$", r"""(?m)^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?"""),
    ("go.mod", r"(^|/)go\.mod$", r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+(v[^\s]+)"),
    ("pipfile", r"(^|/)Pipfile$", r"""(?m)^([A-Za-z0-9._-]+)\s*=\s*["']([^"']*)["']"""),
    ("pyproject.toml", r"(^|/)pyproject\.toml$", r"""(?m)^\s*["']([A-Za-z0-9._-]+)\s*(?:[=<>~!]=?\s*([0-9][^"',]*))?[^"']*["']\s*,?\s*$"""),
)
DEPENDENCY = "array<struct<name:string,version:string,scope:string>>"


def _pairs(text: Column, pattern: str) -> Column:
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    return F.transform(zipped, lambda x: F.struct(x["n"].alias("name"), F.nullif(x["v"], F.lit("")).alias("version"), F.lit("production").alias("scope")))


def dependencies(manifests: DataFrame) -> DataFrame:
    """S-20: (file, name, version, scope, category) of manifests (file, content) of eight kinds; other files give nothing."""
    text, found = F.col("content"), []
    for key, scope in (("dependencies", "production"), ("devDependencies", "development")):
        entries = F.map_entries(F.from_json(F.get_json_object(text, f"$.{key}"), "map<string,string>"))
        found.append(F.when(F.col("file").rlike(r"(^|/)package\.json$"), F.transform(entries, _scoped(scope))))
    artifact = r"<dependency>[\s\S]*?<artifactId>([^<]+)</artifactId>(?:(?!</dependency>)[\s\S])*?(?:<version>([^<]+)</version>)?\s*(?:<scope>[^<]*</scope>)?\s*</dependency>"
    found.append(F.when(F.col("file").rlike(r"(^|/)pom\.xml$"), _pairs(text, artifact)))
    found += [F.when(F.col("file").rlike(name), _pairs(text, pattern)) for _, name, pattern in LINES]
    empty = F.array().cast(DEPENDENCY)
    rows = manifests.select("file", F.inline(F.concat(*[F.coalesce(f, empty) for f in found])))
    return first_by(rows.withColumn("category", dependency_category(F.col("name"))), ["file", "name"], ["scope", "version"])


def _scoped(scope: str):
    return lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(scope).alias("scope"))


def ci_platform(files: DataFrame) -> DataFrame:
    """S-21: one row (platform), the first platform that a path of files (path) marks, or null."""
    rank = F.coalesce(*[F.when(F.col("path").rlike(p), F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"))) for k, (n, p) in enumerate(CI_MARKERS)])
    return files.agg(F.min(rank)["n"].alias("platform"))

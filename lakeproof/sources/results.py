"""Load-test results, scanner reports, contracts and runtime evidence as tables (S-10 to S-19, F-21)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import first_pattern
from ..functions.numeric import to_number
from ..functions.paths import url_path
from ..operators.keys import last_by
from ..operators.load import metrics

# Name patterns in order of precedence.
ALERT_CATEGORIES = [
    ("authentication", r"(?i)authentication"),
    ("authentication", r"(?i)csrf|anti.forgery"),
    ("authorization", r"(?i)authorization|access.control"),
    ("input-validation", r"(?i)injection|xss|cross.site|parameter.tamper|path.traversal|directory.traversal"),
    ("cryptography", r"(?i)ssl|tls|certificate|cipher|transport.security|https"),
    ("session-management", r"(?i)session|cookie|token.expir"),
]
ZAP_CATEGORIES = [
    ("auth", r"(?i)authentication|csrf|anti.forgery|brute.force|session.fixation|auth.bypass"),
    ("auth", r"(?i)authorization|access.control|privilege|insecure.direct.object"),
    ("crypto", r"(?i)ssl|tls|certificate|cipher|transport.security|https|weak.cipher|insecure.transport"),
    ("data-exposure", r"(?i)information.disclosure|sensitive.data|data.exposure|stack.trace|error.message|server.banner"),
    ("misconfig", r"(?i)misconfiguration|security.header|csp|cors|clickjacking|x.frame|x.content.type"),
    ("auth", r"(?i)session|cookie|samesite|httponly|secure.flag"),
    ("injection", r"(?i)injection|sqli|xss|cross.site|path.traversal|parameter.tamper|directory.traversal|template.injection|command.injection"),
]


def jmeter_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S-10: (label, elapsed, success) of CSV results with any order and case of header. Blank labels and elapsed times that are
    no number are dropped; without a success column all succeed."""
    raw = spark.read.csv(paths, header=True)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if not {"label", "elapsed"} <= set(raw.columns):
        return raw.select(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("elapsed"), F.lit(True).alias("success")).limit(0)
    ok = F.lower(F.trim(F.coalesce("success", F.lit("true")))) == "true" if "success" in raw.columns else F.lit(True)
    return raw.select(F.trim("label").alias("label"), to_number(F.col("elapsed")).alias("elapsed"), ok.alias("success")).filter("label <> '' and elapsed is not null")


def _number(v: Column, *ways: str) -> Column:
    """The first of the JSON paths with a number."""
    return F.coalesce(*[to_number(F.get_json_object(v, w)) for w in ways])


K6 = ("label", "n", "avg", "median", "p95", "p99", "error_rate", "throughput")


def k6_summary(texts: DataFrame) -> DataFrame:
    """S-11: the K6 columns of JSON summaries (text): a row `overall`, whose gaps fall back to the average, and one per scenario,
    whose gaps are 0. Texts that are no JSON, or have no durations, give nothing."""

    def values(v: Column, metric: str) -> Column:
        m = F.get_json_object(v, f"$.metrics.{metric}")
        return F.coalesce(F.get_json_object(m, "$.values"), m)

    def row(v: Column, label: Column, overall: bool) -> list[Column]:
        d, f, r = values(v, "http_req_duration"), values(v, "http_req_failed"), values(v, "http_reqs")
        avg = F.coalesce(_number(d, "$.avg"), F.lit(0.0))
        gap = avg if overall else F.lit(0.0)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        n = zero(_number(r, "$.count")) if overall else zero(to_number(F.get_json_object(v, "$.metrics.http_reqs.count")))
        columns = [label, n, avg, F.coalesce(_number(d, "$.med", "$.median"), gap), F.coalesce(_number(d, "$['p(95)']", "$.p95"), gap), F.coalesce(_number(d, "$['p(99)']", "$.p99"), gap), zero(_number(f, "$.rate")), zero(_number(r, "$.rate")) if overall else F.lit(0.0)]
        return [c.alias(name) for c, name in zip(columns, K6)]

    timed = lambda c: F.get_json_object(c, "$.metrics.http_req_duration").isNotNull()
    whole = texts.filter(timed(F.col("text")))
    scenarios = whole.select(F.explode(F.from_json(F.get_json_object("text", "$.scenarios"), "map<string,string>")).alias("label", "v")).filter(timed(F.col("v")))
    return whole.select(*row(F.col("text"), F.lit("overall"), True)).unionByName(scenarios.select(*row(F.col("v"), F.col("label"), False)))


def load_results(spark: SparkSession, files: list[str]) -> DataFrame:
    """S-12: metrics of JSON and CSV files; a later file replaces a label of an earlier one."""
    parts = []
    for k, path in enumerate(files):
        one = k6_summary(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")) if path.lower().endswith(".json") else metrics(jmeter_samples(spark, path))
        parts.append(one.select(*K6).withColumn("n", F.col("n").cast("double")).withColumn("_file", F.lit(k)))
    return last_by(reduce(DataFrame.unionByName, parts), ["label"], ["_file"]).drop("_file")


def alert_category(name: Column) -> Column:
    """F-21: category of the first pattern that fits, else null."""
    return first_pattern(name, ALERT_CATEGORIES)


_ALERT = "struct<alert:string,name:string,title:string,riskdesc:string,severity:string,risk:string,endpoint:string,url:string>"


def scan_report(texts: DataFrame) -> DataFrame:
    """S-13: (name, category, severity, endpoint) of reports (text): sites with alerts, a list of findings, a bare list, or XML by its
    alert and name tags. Findings of no category are dropped."""
    sites = F.flatten(F.transform(F.from_json(F.get_json_object("text", "$.site"), f"array<struct<alerts:array<{_ALERT}>>>"), lambda s: s["alerts"]))
    listed = F.from_json(F.get_json_object("text", "$.findings"), f"array<{_ALERT}>")
    bare = F.when(F.ltrim("text").startswith("["), F.from_json("text", f"array<{_ALERT}>"))
    empty = F.array().cast(f"array<{_ALERT}>")
    found = texts.select(F.explode(F.coalesce(sites, listed, bare, empty)).alias("a"))
    rows = found.select(F.coalesce("a.name", "a.alert", "a.title", F.lit("")).alias("name"), F.coalesce("a.riskdesc", "a.severity", "a.risk", F.lit("")).alias("severity"), F.coalesce("a.endpoint", "a.url").alias("endpoint"))
    tags = F.regexp_extract_all("text", F.lit(r"<(?:alert|name)>([\s\S]*?)</(?:alert|name)>"), F.lit(1))
    xml = texts.filter(F.ltrim("text").startswith("<")).select(F.explode(tags).alias("name")).select(F.trim("name").alias("name"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("endpoint"))
    return rows.unionByName(xml).withColumn("category", alert_category(F.col("name"))).filter("category is not null").select("name", "category", "severity", "endpoint")


def contracts(texts: DataFrame) -> DataFrame:
    """S-14: (file, consumer, provider, description, method, path, status) of contract files (file, text); what is no JSON is skipped,
    a missing status is 200, methods are lower-case."""
    kind = "struct<consumer:struct<name:string>,provider:struct<name:string>,interactions:array<struct<description:string,request:struct<method:string,path:string>,response:struct<status:int>>>>"
    parsed = texts.select("file", F.from_json("text", kind).alias("c")).select("file", "c.consumer.name", F.col("c.provider.name").alias("provider"), F.explode("c.interactions").alias("i"))
    return parsed.select("file", F.col("name").alias("consumer"), "provider", "i.description", F.lower("i.request.method").alias("method"), F.col("i.request.path").alias("path"), F.coalesce("i.response.status", F.lit(200)).alias("status"))


IAST = "struct<eventId:string,method:string,path:string,normalizedPath:string,timestamp:string,testId:string,handlerFile:string,handlerFunction:string,statusCode:int>"
DAST = "struct<method:string,path:string,normalizedPath:string,reachable:boolean,statusCode:int,authRequired:boolean,authBypass:boolean,serverError:boolean>"


def runtime_evidence(texts: DataFrame, key: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """S-15, S-16: rows of the list `key` of JSON texts (file, text), and a diagnostic (file, reason) for texts without one; nothing fails."""
    parsed = texts.withColumn("list", F.from_json(F.get_json_object("text", f"$.{key}"), f"array<{fields}>"))
    problems = parsed.filter("list is null").select("file", F.lit(f"no list '{key}'").alias("reason"))
    return parsed.select(F.inline("list")), problems


FINDING = ("scanner", "category", "severity", "title", "description", "rule_id", "cwe", "cve", "owasp", "file_path", "line_start", "line_end", "method", "path", "package_name", "installed_version", "fixed_version", "secret_type")
_TYPES = {"cwe": "array<string>", "cve": "array<string>", "owasp": "array<string>", "line_start": "int", "line_end": "int"}


def _finding(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*[columns.get(c, F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in FINDING])


def _tags(json: Column) -> Column:
    """A JSON string or list of strings as an array."""
    return F.when(json.startswith("["), F.from_json(json, "array<string>")).when(json.isNotNull(), F.array(json)).otherwise(F.array().cast("array<string>"))


def semgrep(texts: DataFrame) -> DataFrame:
    """S-17."""
    meta = "struct<category:string,cwe:string,owasp:string>"
    kind = f"array<struct<checkId:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,message:string,lines:string,metadata:{meta}>>>"
    r = texts.select(F.explode(F.from_json(F.get_json_object("text", "$.results"), kind)).alias("r")).select("r.*")
    cwe, owasp = _tags(F.col("extra.metadata.cwe")), _tags(F.col("extra.metadata.owasp"))
    low, cat = F.lower("checkId"), F.lower(F.coalesce("extra.metadata.category", F.lit("")))
    has = lambda tags, *codes: F.exists(tags, lambda c: c.rlike("|".join(codes)))
    security = (
        F.when(has(cwe, "89", "943") | low.rlike("injection|sqli|xss"), "injection")
        .when(has(cwe, "798", "259", "321") | low.rlike("hardcoded|secret|password"), "secret")
        .when(has(cwe, "287", "306", "384") | low.rlike("auth"), "auth")
        .when(has(cwe, "311", "319", "327") | low.rlike("crypto|cipher|tls|ssl"), "crypto")
        .when(has(owasp, "A3", "sensitive"), "data-exposure")
        .otherwise("sast")
    )
    other = F.coalesce(first_pattern(cat, [("secret", "secret|credential"), ("injection", "inject"), ("auth", "auth"), ("crypto", "crypto|cipher"), ("data-exposure", "exposure|disclosure"), ("misconfig", "config|misconfiguration")]), F.lit("sast"))
    level = F.upper(F.coalesce("extra.severity", F.lit("")))
    severity = F.when(level == "CRITICAL", "CRITICAL").when(level == "ERROR", "HIGH").when(level.isin("INFO", "NOTE"), "LOW").otherwise("MEDIUM")
    some = lambda a: F.when(F.size(a) > 0, a)
    return _finding(
        r, scanner=F.lit("semgrep"), category=F.when(cat == "security", security).otherwise(other), severity=severity, title=F.coalesce("extra.message", "checkId"), description=F.col("extra.lines"), rule_id=F.col("checkId"),
        cwe=some(cwe), owasp=some(owasp), file_path=F.col("path"), line_start=F.col("start.line"), line_end=F.col("end.line"),
    )


def trivy(texts: DataFrame) -> DataFrame:
    """S-18."""
    vulnerability = "struct<VulnerabilityID:string,Title:string,Description:string,Severity:string,CweIDs:array<string>,PkgName:string,InstalledVersion:string,FixedVersion:string>"
    secret = "struct<RuleID:string,Title:string,Match:string,Severity:string,StartLine:int,EndLine:int,Category:string>"
    misconfig = "struct<ID:string,Title:string,Description:string,Severity:string,CauseMetadata:struct<StartLine:int,EndLine:int>>"
    kind = f"array<struct<Target:string,Vulnerabilities:array<{vulnerability}>,Secrets:array<{secret}>,Misconfigurations:array<{misconfig}>>>"
    results = texts.select(F.explode(F.from_json(F.get_json_object("text", "$.Results"), kind)).alias("t")).select("t.*")
    each = lambda c: results.select("Target", F.explode(c).alias("x")).select("Target", "x.*")
    level = F.upper("Severity")
    common = {"scanner": F.lit("trivy"), "severity": F.when(level.isin("CRITICAL", "HIGH", "MEDIUM"), level).otherwise("LOW"), "file_path": F.col("Target")}
    v = _finding(
        each("Vulnerabilities"), **common, category=F.lit("sca"), title=F.coalesce("Title", "VulnerabilityID"), description=F.col("Description"), rule_id=F.col("VulnerabilityID"), cve=F.array("VulnerabilityID"), cwe=F.col("CweIDs"),
        package_name=F.col("PkgName"), installed_version=F.col("InstalledVersion"), fixed_version=F.col("FixedVersion"),
    )
    s = _finding(each("Secrets"), **common, category=F.lit("secret"), title=F.col("Title"), description=F.col("Match"), rule_id=F.col("RuleID"), line_start=F.col("StartLine"), line_end=F.col("EndLine"), secret_type=F.col("Category"))
    m = _finding(each("Misconfigurations"), **common, category=F.lit("misconfig"), title=F.col("Title"), description=F.col("Description"), rule_id=F.col("ID"), line_start=F.col("CauseMetadata.StartLine"), line_end=F.col("CauseMetadata.EndLine"))
    return v.unionByName(s).unionByName(m)


def zap(texts: DataFrame) -> DataFrame:
    """S-19: top-level alerts, else those of one or many sites."""
    alert = "struct<alert:string,name:string,riskdesc:string,riskcode:string,description:string,pluginid:string,sourceid:string,cweid:string,uri:string,url:string,method:string,instances:array<struct<uri:string,method:string>>>"
    site = F.get_json_object("text", "$.site")
    sites = F.from_json(F.when(site.startswith("["), site).otherwise(F.concat(F.lit("["), site, F.lit("]"))), f"array<struct<alerts:array<{alert}>>>")
    top = F.from_json(F.get_json_object("text", "$.alerts"), f"array<{alert}>")
    a = texts.select(F.explode(F.when(F.size(top) > 0, top).otherwise(F.flatten(F.transform(sites, lambda s: s["alerts"])))).alias("a")).select("a.*")
    name = F.coalesce("alert", "name", F.lit("Unknown ZAP finding"))
    text, code = F.lower(F.coalesce("riskdesc", F.lit(""))), F.coalesce(to_number(F.col("riskcode")), F.lit(-1.0))
    severity = F.when(text.startswith("critical") | (code == 4), "CRITICAL").when(text.startswith("high") | (code == 3), "HIGH").when(text.startswith("medium") | (code == 2), "MEDIUM").otherwise("LOW")
    first = F.get("instances", F.lit(0))
    return _finding(
        a, scanner=F.lit("zap"), category=F.coalesce(first_pattern(name, ZAP_CATEGORIES), F.lit("dast")), severity=severity, title=name, description=F.col("description"), rule_id=F.coalesce("pluginid", "sourceid"),
        cwe=F.when(F.col("cweid").isNotNull(), F.array(F.concat(F.lit("CWE-"), "cweid"))), method=F.upper(F.coalesce("method", first["method"])), path=url_path(F.coalesce("uri", "url", first["uri"])),
    )

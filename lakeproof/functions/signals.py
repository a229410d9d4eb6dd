"""Signals in source lines, scenarios and names (X-13, X-14, X-15, X-17, X-26, X-32, P-14, P-15, P-17, F-13, D-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.keys import first_by
from .errors import contains_any
from .extract import first_pattern, tagged
from .paths import escape_regex, prefix, url_path

# Patterns and words in order of precedence.
MOCKS = {
    "java": (
        ("mockito", "return-value", r"@Mock\b"), ("mockito", "spy", r"@Spy\b"), ("spring-test", "return-value", r"@MockBean\b"), ("spring-test", "spy", r"@SpyBean\b"), ("mockito", "return-value", r"Mockito\.mock\("),
        ("mockito", "spy", r"Mockito\.spy\("), ("mockito", "return-value", r"when\(.*\)\.thenReturn\("), ("mockito", "exception", r"when\(.*\)\.thenThrow\("), ("mockito", "return-value", r"doReturn\(.*\)\.when\("),
        ("mockito", "exception", r"doThrow\(.*\)\.when\("), ("mockk", "return-value", r"mockk<"), ("mockk", "spy", r"spyk\("), ("mockk", "return-value", r"every\s*\{"), ("mockk", "return-value", r"coEvery\s*\{"), ("mockk", "spy", r"verify\s*\{"),
    ),
    "javascript": (
        ("jest", "return-value", r"jest\.mock\("), ("jest", "return-value", r"jest\.fn\("), ("jest", "spy", r"jest\.spyOn\("), ("jest", "return-value", r"\.mockReturnValue\("), ("jest", "return-value", r"\.mockResolvedValue\("),
        ("jest", "exception", r"\.mockRejectedValue\("), ("jest", "return-value", r"\.mockImplementation\("), ("sinon", "return-value", r"sinon\.stub\("), ("sinon", "return-value", r"sinon\.mock\("), ("sinon", "spy", r"sinon\.spy\("),
        ("sinon", "return-value", r"\.returns\("), ("sinon", "exception", r"\.throws\("), ("nock", "return-value", r"nock\("), ("jest", "timer", r"\.useFakeTimers\("), ("sinon", "timer", r"sinon\.useFakeTimers\("),
    ),
    "python": (
        ("unittest.mock", "return-value", r"@patch\("), ("unittest.mock", "return-value", r"@patch\.object\("), ("unittest.mock", "return-value", r"Mock\(\)"), ("unittest.mock", "return-value", r"MagicMock\(\)"), ("unittest.mock", "return-value", r"AsyncMock\(\)"),
        ("pytest-mock", "return-value", r"mocker\.patch\("), ("pytest-mock", "spy", r"mocker\.spy\("), ("unittest.mock", "return-value", r"\.return_value\s*="), ("unittest.mock", "exception", r"\.side_effect\s*="), ("responses", "return-value", r"responses\.add\("),
        ("requests-mock", "return-value", r"requests_mock\."), ("freezegun", "timer", r"freezegun|freeze_time"),
    ),
    "ruby": (
        ("rspec-mocks", "return-value", r"allow\(.*\)\.to\s+receive\("), ("rspec-mocks", "spy", r"expect\(.*\)\.to\s+receive\("), ("rspec-mocks", "return-value", r"double\("), ("rspec-mocks", "return-value", r"instance_double\("), ("webmock", "return-value", r"stub_request\("),
    ),
}
RULE_PATTERNS = (
    ("business_logic", r"(?i)throw\s+new\s+(\w+Exception|\w+Error)\s*\(([^)]*)\)"),
    ("business_logic", r"raise\s+(\w+(?:Exception|Error))\s*(?:\(([^)]*)\))?"),
    ("validation", r"return\s+(?:ResponseEntity\.)?(?:status\s*\()?(4\d\d)(?:\))?"),
    ("validation", r"\.status\s*\(\s*(4\d\d)\s*\)"),
    ("validation", r"abort\s*\(\s*(4\d\d)\s*\)"),
    ("validation", r"render\s+json:.*,\s*status:\s*:(\w+)"),
    ("validation", r"if\s*\(?\s*([\w.]+)\s*(?:==\s*null|===\s*null|===\s*undefined|is\s+None|\.nil\?|\.blank\?|\.empty\?)\s*\)?"),
    ("authorization", r"(?i)if\s*\(?\s*!?\s*(?:user\.)?(?:isAdmin|hasRole|hasPermission|can|authorize|authenticated)\s*\(?([^)]*)\)?"),
    ("business_logic", r"(?i)if\s*\(?\s*(\w+)\s*>\s*(\w+)\s*\)?.*(?:throw|raise|return\s+4)"),
)
#: (method group, path group, pattern) of a call in a line.
CALLS = (
    (1, 2, r"""(?i)(?:axios|request|client|api|http|supertest)\.(get|post|put|patch|delete|head)\s*\(\s*['"`]([^'"`]+)['"`]"""),
    (1, 2, r"""(?i)\.(?:when\(\)\.)?(get|post|put|patch|delete)\s*\(\s*['"`]([^'"`]+)['"`]"""),
    (1, 2, r"""(?i)(?:requests|client|self\.client|self\.app\.test_client\(\))\.(get|post|put|patch|delete)\s*\(\s*['"`]([^'"`\s]+)['"`]"""),
    (1, 2, r"""(?i)\b(get|post|put|patch|delete)\s+['"`]([^'"`\s]+)['"`]"""),
    (2, 1, r"""(?i)fetch\s*\(\s*['"`]([^'"`]+)['"`]\s*,\s*\{[^}]*method\s*:\s*['"`](GET|POST|PUT|PATCH|DELETE|HEAD)['"`]"""),
)
TEST_NAMES = (
    r"""(?:^|\s)(?:it|test|describe)\s*\(\s*['"`]([^'"`]+)['"`]""", r"@Test[\s\S]{0,200}void\s+(\w+)", r"def\s+(test_\w+)\s*\(", r"""it\s+['"]([^'"]+)['"]\s+do""", r"Scenario(?:\s+Outline)?:\s*(.+)",
)
SCENARIO_FLAGS = {
    "valid_value": ("valid", "happy-path", "success", "positive"),
    "boundary_value": ("boundary", "min", "max", "edge", "zero", "empty", "oversized"),
    "missing": ("missing", "missing-required", "absent", "omitted"),
    "invalid_value": ("invalid", "invalid-value", "bad-value", "wrong-type", "malformed", "null", "invalid-enum"),
}
SCENARIO_ERRORS = {
    "missing-parameter": "missing|required",
    "invalid-value": "invalid|bad|malformed",
    "unauthorized": "unauth|401",
    "forbidden": "forbidden|403",
    "not-found": "not-found|404",
    "conflict": "conflict|409",
    "server-error": "server|5xx|500",
}
SCENARIO_SECURITY = {
    "authentication": "unauth|token|bearer|credential|login|401",
    "authorization": "forbidden|permission|role|access|403",
    "input-validation": "invalid|missing|malformed|injection|xss|400|422",
    "cryptography": "https|ssl|tls|encrypt",
    "session-management": "session|cookie|logout|refresh|expir",
}
SECURITY_WORDS = {
    "authentication": ("401", "unauthorized", "unauthenticated", "authentication", "bearer", "jwt", "api key", "apikey", "login", "sign in", "credential", "no token", "missing token", "invalid token", "auth token"),
    "authorization": ("403", "forbidden", "authorization", "permission", "access denied", "role", "privilege", "rbac", "access control", "not allowed"),
    "input-validation": (
        "400", "422", "invalid", "validation", "bad request", "malformed", "boundary", "required field", "missing field", "missing required", "special characters", "sql injection", "xss", "injection", "overflow", "sanitize", "required name", "required email",
    ),
    "cryptography": ("https", "ssl", "tls", "certificate", "encrypt", "secure connection", "cipher", "hash", "hmac", "signing algorithm"),
    "session-management": ("session", "cookie", "logout", "sign out", "refresh token", "token expiry", "expired token", "session timeout", "revoke", "invalidate"),
}
PREFIXES = (
    ("spring-security", "securityLibrary"), ("spring-boot-starter", "framework"), ("junit-jupiter", "testFramework"), ("mockito-", "mockingLibrary"), ("kotest-", "testFramework"), ("cucumber-", "e2eFramework"), ("@nestjs/", "framework"),
    ("passport-", "securityLibrary"), ("chai-", "assertionLibrary"), ("rspec-", "testFramework"), ("pytest-", "testFramework"), ("ktor-server", "framework"), ("ktor-client", "httpClient"), ("@playwright/", "e2eFramework"),
)
AUTH_RULES = (
    (r"flask:@?jwt_required", "jwt", True), (r"flask:@?jwt_optional", "jwt", False), (r"flask:@?login_required", "session", True), (r"express:auth\.required|express:credentialsrequired: true", "jwt", True),
    (r"express:auth\.optional|express:credentialsrequired: false", "jwt", False), (r"express:passport\.authenticate", "jwt", True), (r"^hapi(?:js)?:(?=.*auth)(?=.*mode).*(?:try|optional)", "jwt", False),
    (r"^hapi(?:js)?:(?=.*auth)(?!.*(?:false|try|optional))", "jwt", True), (r"spring:@preauthorize|spring:@secured", "custom", True),
)
SECRET_KEYS = r"password|secret|token|apikey|authorization|credential|privatekey"


def lines_of(files: DataFrame) -> DataFrame:
    """(file, line, text) of files (file, content); lines count from 0."""
    return files.select("file", F.posexplode(F.split("content", "\n")).alias("line", "text"))


def mock_of(line: Column, family: str | None = None) -> Column:
    """X-17: struct (library, kind, target) of the first mock pattern in a line, of one family or of all, else null."""
    patterns = MOCKS[family] if family else MOCKS["javascript"] + MOCKS["java"] + MOCKS["python"] + MOCKS["ruby"]
    target = F.coalesce(F.nullif(F.regexp_extract(line, r"""\(\s*['"`]?([a-zA-Z0-9_./@]+)['"`]?""", 1), F.lit("")), F.lit("unknown"))
    return F.coalesce(*[F.when(line.rlike(p), F.struct(F.lit(library).alias("library"), F.lit(kind).alias("kind"), target.alias("target"))) for library, kind, p in patterns])


def call_of(line: Column) -> Column:
    """X-14: struct (method, path) of the first call pattern in a line that gives a path, else null; full addresses without /api are no paths."""
    found = []
    for m, p, pattern in CALLS:
        path = F.regexp_extract(line, pattern, p)
        good = line.rlike(pattern) & ~(path.startswith("http") & ~F.contains(path, F.lit("/api")))
        found.append(F.when(good, F.struct(F.upper(F.regexp_extract(line, pattern, m)).alias("method"), url_path(path).alias("path"))))
    return F.coalesce(*found)


def test_name_of(line: Column) -> Column:
    """The test that a line declares, else null."""
    return F.coalesce(*[F.when(line.rlike(p), F.trim(F.regexp_extract(line, p, 1))) for p in TEST_NAMES])


def named_calls(files: DataFrame) -> DataFrame:
    """X-14, X-15: (file, line, method, path, test_name) of calls with the nearest test name in the 20 lines before and their own."""
    near = W.partitionBy("file").orderBy("line").rowsBetween(-20, 0)
    rows = lines_of(files).withColumns({"call": call_of(F.col("text")), "test_name": F.last(test_name_of(F.col("text")), ignorenulls=True).over(near)})
    return rows.filter("call is not null").select("file", "line", "call.method", "call.path", "test_name")


def inferred_rules(files: DataFrame) -> DataFrame:
    """X-13: (file, line, kind, condition) of lines that guard or reject, each pattern once a line, equal conditions of a file and line once."""
    rows = lines_of(files)
    hits = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("ord"), F.lit(kind).alias("kind"), F.regexp_extract("text", p, 0).alias("condition"))) for k, (kind, p) in enumerate(RULE_PATTERNS)])
    each = rows.select("file", "line", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("file", "line", "h.*")
    return first_by(each, ["file", "line", "condition"], ["ord"]).drop("ord")


def asserted(variable: Column, content: Column) -> Column:
    """X-26: the content asserts something of the response variable, in one of six styles; an empty variable never."""
    v = F.concat(F.lit(r"\b"), escape_regex(variable), F.lit(r"\b"))
    pattern = F.concat(
        F.lit(r"\bexpect\s*\(\s*"), v, F.lit(r"|\b(?:assertEquals|assertNotNull|assertThat|assertFalse|assertTrue|assertNull)\s*\([^)]*"), v, F.lit(r"|\bassert\s+"), v,
        F.lit(r"|\bself\.assert(?:Equal|NotEqual|In|NotIn|True|False)\s*\([^)]*"), v, F.lit("|"), v, F.lit(r"[^\n]*\bshould|"), v, F.lit(r"[^\n]*\.then\(\)"),
    )
    return F.coalesce((variable != "") & F.call_function("rlike", content, pattern), F.lit(False))


def scenario_flags(scenarios: Column) -> Column:
    """X-32: the four parameter flags, by exact scenario names."""
    low = F.transform(scenarios, F.lower)
    return F.struct(*[F.arrays_overlap(low, F.array(*[F.lit(w) for w in words])).alias(k) for k, words in SCENARIO_FLAGS.items()])


def scenario_categories(scenarios: Column, table: dict[str, str] = SCENARIO_ERRORS) -> Column:
    """X-32: error or security categories, by parts of scenario names."""
    low = F.transform(scenarios, F.lower)
    joined = F.array_join(low, "\n")
    return F.filter(F.array(*[F.when(joined.rlike(p), F.lit(c)) for c, p in table.items()]), lambda c: c.isNotNull())


def covers_control(category: Column, id_: Column, endpoint: Column, description: Column, content: Column) -> Column:
    """F-13: by a @security tag, or by a word of the category where the endpoint's path before its first placeholder appears."""
    words = None
    for c, w in SECURITY_WORDS.items():
        hit = contains_any(description, w)
        words = F.when(category == c, hit) if words is None else words.when(category == c, hit)
    base = F.lower(prefix(F.split_part(endpoint, F.lit(" "), F.lit(2))))
    there = endpoint.isNull() | F.contains(F.lower(description), base) | F.contains(F.lower(content), base)
    both = F.concat_ws("\n", description, content)
    return F.coalesce(tagged(both, "security", escape_regex(id_)), F.lit(False)) | F.coalesce(words & there, F.lit(False))


def dependency_category(name: Column, known: dict[str, str] | None = None) -> Column:
    """P-14: an exact name, lower-cased or as it is, before the prefixes; else unknown."""
    low = F.lower(name)
    exact = F.lit(None).cast("string")
    if known:
        table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        exact = F.coalesce(F.try_element_at(table, low), F.try_element_at(table, name))
    by_prefix = F.coalesce(*[F.when(F.startswith(low, F.lit(p)), F.lit(c)) for p, c in PREFIXES])
    return F.coalesce(exact, by_prefix, F.lit("unknown"))


def auth_class(framework: Column, pattern: Column) -> Column:
    """P-15: struct (type, required, optional, source_pattern) of a framework's authentication pattern, else null."""
    key, out = F.lower(F.concat_ws(":", framework, pattern)), []
    for rule, kind, required in AUTH_RULES:
        out.append(F.when(key.rlike(rule), F.struct(F.lit(kind).alias("type"), F.lit(required).alias("required"), F.lit(not required).alias("optional"), pattern.alias("source_pattern"))))
    return F.coalesce(*out)


def redact(values: Column) -> Column:
    """P-17: a map with the values of tell-tale keys masked."""
    return F.transform_values(values, lambda k, v: F.when(F.regexp_replace(F.lower(k), "[^a-z0-9]", "").rlike(SECRET_KEYS), F.lit("[REDACTED]")).otherwise(v))


def fenced_json(answer: Column) -> Column:
    """D-12: struct (summary, confidence, items) of a JSON text, fenced or bare; a summary has at most 500 characters, confidence is
    medium unless low or high, and what is no JSON becomes the summary."""
    body = F.coalesce(F.nullif(F.regexp_extract(answer, r"```(?:json)?\s*([\s\S]*?)```", 1), F.lit("")), answer)
    parsed = F.from_json(body, "struct<summary:string,confidence:string,items:array<string>>")
    level = F.lower(parsed["confidence"])
    return F.struct(F.substring(F.coalesce(parsed["summary"], answer), 1, 500).alias("summary"), F.when(level.isin("low", "high"), level).otherwise("medium").alias("confidence"), F.coalesce(parsed["items"], F.array().cast("array<string>")).alias("items"))

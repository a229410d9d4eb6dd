"""Text extraction with built-in regular expressions (X-01 to X-09, X-16, X-17, X-19, X-28, X-31, X-32)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import first_by
from .paths import url_path

# Extensions, and the patterns of HTTP calls in each language. Group 1 is the method, group 2 the path or URL.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "kt": "kotlin",
    "kts": "kotlin", "py": "python", "rb": "ruby", "feature": "cucumber",
}
_VERBS = "get|post|put|patch|delete|head|options"
_ALL = "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|TRACE"
_ANY_QUOTE, _QUOTE = r"""['"`]([^'"`]+)['"`]""", r"""['"]([^'"]+)['"]"""
PATTERNS = {
    "javascript": (
        rf"""(?i)\b({_ALL})\s+(/[^\s'"`,)]*)""",
        rf"(?i)\b(?:axios|request|supertest|got|agent)\.({_VERBS})\s*\(\s*{_ANY_QUOTE}",
        rf"(?i)\)\s*\.({_VERBS})\s*\(\s*{_ANY_QUOTE}",
    ),
    "java": (
        rf"(?i)\.when\(\)\s*\.\s*({_VERBS})\s*\(\s*{_ANY_QUOTE}",
        rf"(?i)(?:given\(\)|RestAssured)[^;.(]*\.({_VERBS})\s*\(\s*{_ANY_QUOTE}",
        rf"(?i)perform\s*\(\s*(?:\w+\s*\.\s*)?({_VERBS})\s*\(\s*{_ANY_QUOTE}",
        rf"(?i)webTestClient\s*\.\s*({_VERBS})\s*\(\s*\)\s*\.uri\s*\(\s*{_ANY_QUOTE}",
        rf"(?i)\bclient\s*\.\s*({_VERBS})\s*\(\s*{_ANY_QUOTE}",
        rf"""(?i)["'`]({_ALL})\s+(/[^"'`\s]+)["'`]""",
    ),
    "python": (
        rf"(?i)\brequests\.({_VERBS})\s*\(\s*{_QUOTE}",
        rf"(?i)\bhttpx\.({_VERBS})\s*\(\s*{_QUOTE}",
        rf"(?i)(?:self\.)?\bclient\.({_VERBS})\s*\(\s*{_QUOTE}",
        rf"""(?i)['"]?({_ALL})\s+(/[^'")\s]+)['"]?""",
    ),
    "ruby": (
        rf"(?i)\b({_VERBS})\s+{_QUOTE}",
        rf"(?i)HTTParty\.({_VERBS})\s*\(\s*{_QUOTE}",
        rf"(?i)(?:conn|connection|faraday)\.({_VERBS})\s*\(\s*{_QUOTE}",
        rf"""(?i)["']({_ALL})\s+(/[^"'\s]+)["']""",
    ),
    "gherkin": (
        rf"""(?i)\b(?:When|Given|Then|And)\s+I\s+(?:send|make|perform)\s+(?:an?\s+)?["']?({_ALL})["']?\s+request\s+to\s+["']?(/[^"'\s]+)["']?""",
        rf"""(?i)\b(?:When|Given|Then|And)[^"']*["']({_ALL})\s+(/[^"'\s]+)["']""",
    ),
}
FAMILIES = {
    "typescript": ("javascript",), "javascript": ("javascript",), "java": ("java",), "kotlin": ("java",), "python": ("python",),
    "ruby": ("ruby",), "cucumber": ("gherkin", "java", "python", "ruby"),
}
DECLARATION = r"""(?:test|it)\s*\(\s*(['"`])((?:(?!\1).)*)\1"""
JAVA_TEST = r"@Test\b[\s\S]*?\b(?:void|fun)\s+`?([A-Za-z_][\w ]*)`?\s*\("

#: Test layers by priority: patterns of the directory, of the file name, of the content.
LAYERS = (
    ("e2e", r"(?i)\be2e\b|\bcypress\b|\bplaywright\b|\bselenium\b|\bfunctional\b|\bacceptance\b", r"(?i)\.e2e\.|\.feature$",
     r"cy\.\w+|(?i:test\.goto|page\.\w+|playwright)|(?i:driver\.|WebDriver|selenium)|Given|When|Then|Scenario:|(?i:browser\.\w+)"),
    ("performance", r"(?i)\bperformance\b|\bperf\b|\bload\b|\bstress\b|\bbenchmark\b", r"(?i)\.perf\.|\.bench\.|\.load\.|\.k6\.",
     r"import\s.*k6|from\s+['\"]k6|(?i:io\.gatling)|(?i:locust|HttpUser|TaskSet)|(?i:import\s.*artillery)|(?i:autocannon)"),
    ("security", r"(?i)\bsecurity\b|\bsec-test\b|\bpentest\b", r"(?i)\.security\.|\.sec\.",
     r"(?i)@Tag\([\"']security[\"']\)|csrf|xss|sql.?injection|auth.?bypass|ZAP|OWASP|pentest"),
    ("api", r"(?i)\bapi\b|\bapi[-_]?test\b|\bcontract\b", r"(?i)\.api\.|\.contract\.",
     r"(?i:supertest|request\(app\))|MockMvc|mockMvc|TestRestTemplate|restTemplate|(?i:httpx\.AsyncClient)|(?i:RestAssured|given\(\)\.)|(?i:\.pact\.)"
     r"|TestApp\s*\(|\.\s*(?:post_json|put_json|delete_json|patch_json)\s*\("),
    ("integration", r"(?i)\bintegration\b|\bint[-_]?test\b", r"(?i:\.integration\.|\.int\.)|IT\.java$",
     r"@SpringBootTest|TestRestTemplate|(?i:@Testcontainers)|(?i:@DataJpaTest)|(?i:@WebMvcTest)|(?i:testcontainers)"
     r"|@pytest\.fixture.*scope\s*=\s*['\"]session['\"]|factory\.(?:Factory|DjangoModelFactory|SQLAlchemyModelFactory)|create_engine|sessionmaker|Base\.metadata"),
    ("component", r"(?i)\bcomponent\b", r"(?i)\.component\.", r"render\(|screen\.|@testing-library|shallow\(|mount\(|ComponentFixture|TestBed"),
    ("unit", r"(?i)\bunit\b", r"(?i)\.unit\.", None),
)


def language_of(path: Column) -> Column:
    """X-01: language of a file by its extension, else null."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)))


def http_calls(files: DataFrame) -> DataFrame:
    """X-02 to X-07: (file, method, path, ord) of files (file, content, language), each call of a file once, the first found.

    Unknown or null languages are read like JavaScript. Calls with a placeholder in a bare JavaScript string are skipped.
    """
    family = F.create_map(*[x for k, v in FAMILIES.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    named = files.withColumn("_families", F.coalesce(F.try_element_at(family, F.lower("language")), F.array(F.lit("javascript"))))
    found = []
    for name, patterns in PATTERNS.items():
        for k, pattern in enumerate(patterns):
            pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("m"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("p"))
            hits = F.transform(pairs, lambda x, i: F.struct(F.upper(x["m"]).alias("method"), x["p"].alias("path"), (F.lit(k * 1_000_000) + i).cast("long").alias("ord")))
            if name == "javascript" and k == 0:
                hits = F.filter(hits, lambda x: ~F.contains(x["path"], F.lit("{")))
            place = F.array_position("_families", name)
            found.append(F.when(place > 0, F.transform(hits, lambda x: F.struct(x["method"].alias("method"), url_path(x["path"]).alias("path"), ((place - 1) * 100_000_000 + x["ord"]).alias("ord")))).otherwise(F.array().cast("array<struct<method:string,path:string,ord:bigint>>")))
    calls = named.select("file", F.explode(F.concat(*found)).alias("c")).select("file", "c.method", "c.path", "c.ord")
    return first_by(calls, ["file", "method", "path"], ["ord"])


def test_entries(files: DataFrame) -> DataFrame:
    """X-08: (file, description, content, ord): from each test declaration of a file (file, content) to the next."""
    pieces = F.split("content", r"(?=\b(?:test|it)\s*\()", -1)
    each = files.select("file", F.posexplode(pieces).alias("ord", "content"))
    return each.filter(F.col("content").rlike("^" + DECLARATION)).select("file", F.regexp_extract("content", "^" + DECLARATION, 2).alias("description"), "content", F.col("ord").cast("long").alias("ord"))


def java_test_entries(files: DataFrame) -> DataFrame:
    """X-09: the same for annotated methods; underscores of the name become spaces."""
    each = files.select("file", F.posexplode(F.split("content", r"(?=@Test\b)", -1)).alias("ord", "content"))
    named = F.regexp_replace(F.regexp_extract("content", JAVA_TEST, 1), "_", " ")
    return each.filter(F.col("content").rlike("^" + JAVA_TEST)).select("file", named.alias("description"), "content", F.col("ord").cast("long").alias("ord"))


def test_layer(path: Column, content: Column) -> Column:
    """X-16: struct (layer, confidence) by the first rule with a signal: two signals are high, one medium, none unit and low."""
    name, out = F.regexp_extract(path, r"([^/\\]*)$", 1), None
    for layer, directory, file, text in LAYERS:
        signals = path.rlike(directory).cast("int") + name.rlike(file).cast("int") + (F.lit(0) if text is None else F.coalesce(content.rlike(text), F.lit(False)).cast("int"))
        hit = F.struct(F.lit(layer).alias("layer"), F.when(signals >= 2, "high").otherwise("medium").alias("confidence"))
        out = F.when(signals > 0, hit) if out is None else out.when(signals > 0, hit)
    return out.otherwise(F.struct(F.lit("unit").alias("layer"), F.lit("low").alias("confidence")))


def tagged(text: Column, tag: str, id_: Column) -> Column:
    """X-28: the text has `@tag id`, case-insensitively; the id is a pattern."""
    return F.call_function("rlike", text, F.concat(F.lit(rf"(?i)@{tag}\s+"), id_))


def snake_case(text: Column) -> Column:
    """X-31."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))


def humanize(text: Column) -> Column:
    """X-31: words of an identifier with a capital first letter."""
    words = F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_-]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def first_pattern(line: Column, patterns: list[tuple[str, str]]) -> Column:
    """X-14, X-17, F-21: the name of the first (name, pattern) that the line has, else null."""
    return F.coalesce(*[F.when(line.rlike(p), F.lit(n)) for n, p in patterns])

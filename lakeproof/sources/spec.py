"""Specifications, rules and flows: small documents parsed on the driver into tables (S-03 to S-09, U-07).

YAML needs the optional yaml package; JSON is always read. Documents are given as text; `read_text` reads any path Spark can.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import categories_of
from ..functions.paths import path_to_regex
from ..operators.keys import last_by

# Methods, the schema fields that limit a value, and the descriptions of transport controls.
METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
LIMITS = ("enum", "pattern", "format", "minLength", "maxLength", "minimum", "maximum")
TRANSPORT = {
    "unspecified": "Verify that the API enforces secure transport (HTTPS/TLS)",
    "https": "API servers use HTTPS – verify TLS configuration in tests",
    "mixed": "API servers include non-HTTPS URLs – cryptographic transport security may be missing",
}


def read_text(spark: SparkSession, path: str) -> str:
    """Whole text of one small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def load(text: str):
    """A JSON or YAML document."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the document is not JSON, and no YAML parser is installed") from e
        return yaml.safe_load(text)


def resolve(spec, node=None, seen: tuple[str, ...] = ()):
    """The document with local `$ref`s put in place; a reference to itself stays as it is."""
    node = spec if node is None else node
    if isinstance(node, dict):
        ref = node.get("$ref")
        if isinstance(ref, str) and ref.startswith("#/"):
            if ref in seen:
                return node
            target = spec
            for part in ref[2:].split("/"):
                target = target[part.replace("~1", "/").replace("~0", "~")]
            return resolve(spec, target, (*seen, ref))
        return {k: resolve(spec, v, seen) for k, v in node.items()}
    return [resolve(spec, x, seen) for x in node] if isinstance(node, list) else node


def _operations(spec: dict) -> Iterator[tuple[int, str, str, dict, dict]]:
    """(ord, METHOD, path, operation, path item) of a resolved specification."""
    n = 0
    for path, item in (spec.get("paths") or {}).items():
        for method in METHODS:
            if isinstance((item or {}).get(method), dict):
                yield n, method.upper(), path, item[method], item
                n += 1


def endpoints(spark: SparkSession, text: str) -> DataFrame:
    """S-03, S-04: (ord, id, method, path, path_regex)."""
    rows = [(n, f"{m} {p}", m, p) for n, m, p, _, _ in _operations(resolve(load(text)))]
    return spark.createDataFrame(rows, "ord long, id string, method string, path string").withColumn("path_regex", path_to_regex(F.col("path")))


PARAMETER = "ord long, endpoint string, method string, path string, name string, location string, required boolean, level int, type string, format string, minimum double, maximum double, min_length int, max_length int, pattern string, enum array<string>"


def parameters(spark: SparkSession, text: str) -> DataFrame:
    """S-05: parameters of every operation; one of the operation replaces that of its path with the same place and name; path
    parameters are required; properties of a JSON body object are parameters too."""
    rows = []

    def add(n, m, p, name, place, required, level, s):
        s = s or {}
        number = lambda k: None if s.get(k) is None else float(s[k])
        choices = None if s.get("enum") is None else [str(x) for x in s["enum"]]
        rows.append((n, f"{m} {p}", m, p, name, place, required, level, s.get("type"), s.get("format"), number("minimum"), number("maximum"), s.get("minLength"), s.get("maxLength"), s.get("pattern"), choices))

    for n, m, p, operation, item in _operations(resolve(load(text))):
        for level, part in enumerate((item, operation)):
            for x in part.get("parameters") or ():
                add(n, m, p, x["name"], x["in"], x.get("required") is True or x["in"] == "path", level, x.get("schema"))
        body = (((operation.get("requestBody") or {}).get("content") or {}).get("application/json") or {}).get("schema") or {}
        if body.get("type") == "object":
            for name, s in (body.get("properties") or {}).items():
                add(n, m, p, name, "body", name in (body.get("required") or ()), 1, s)
    return last_by(spark.createDataFrame(rows, PARAMETER), ["endpoint", "location", "name"], ["level"]).drop("level")


def error_scenarios(spark: SparkSession, text: str) -> DataFrame:
    """S-06: (id, endpoint, method, path, status_code, description, categories) of responses from 400 on; codes may have a prefix of digits."""
    rows = []
    for n, m, p, operation, _ in _operations(resolve(load(text))):
        for code, response in (operation.get("responses") or {}).items():
            rows.append((n, m, p, str(code), (response or {}).get("description") or ""))
    d = spark.createDataFrame(rows, "ord long, method string, path string, code string, description string")
    d = d.withColumn("status_code", F.nullif(F.regexp_extract("code", r"^\s*(\d+)", 1), F.lit("")).cast("int")).filter("status_code >= 400")
    endpoint = F.concat_ws(" ", "method", "path")
    return d.select(F.concat_ws(":", "method", "path", "status_code").alias("id"), endpoint.alias("endpoint"), "method", "path", "status_code", "description", categories_of(F.col("status_code"), F.col("description")).alias("categories"))


def _limited(schema: dict | None) -> bool:
    return any((schema or {}).get(k) is not None for k in LIMITS)


def security_controls(spark: SparkSession, text: str) -> DataFrame:
    """S-07: controls (id, category, description, endpoint, detail) for schemes, transport, and per operation for authorization (its
    own security, even empty, replaces the global) and input validation."""
    spec, rows = resolve(load(text)), []
    for name, s in ((spec.get("components") or {}).get("securitySchemes") or {}).items():
        kind = s.get("type")
        cookie = kind == "apiKey" and s.get("in") == "cookie"
        detail = {"http": f"http/{s.get('scheme')}", "apiKey": f"apiKey/{s.get('in')}"}.get(kind, kind)
        what = f'Session management via cookie-based security scheme "{name}"' if cookie else f'Authentication via security scheme "{name}" ({detail})'
        category = "session-management" if cookie else "authentication"
        rows.append((f"{category}:{name}", category, what, None, detail))
    servers = [s.get("url", "") for s in spec.get("servers") or ()]
    secure = all(u.startswith(("https://", "/")) for u in servers)
    state = ("transport", "unspecified") if not servers else ("https", "https" if secure else "mixed")
    rows.append((f"cryptography:{state[0]}", "cryptography", TRANSPORT[state[1]], None, state[1]))
    for _, m, p, operation, item in _operations(spec):
        demands = operation["security"] if operation.get("security") is not None else spec.get("security") or []
        if demands:
            rows.append((f"authorization:{m.lower()}:{p}", "authorization", f"Authorization check for {m} {p}", f"{m} {p}", ", ".join(k for d in demands for k in d)))
        given = [*(item.get("parameters") or ()), *(operation.get("parameters") or ())]
        of_parameters = any(x.get("schema") and (x.get("required") or _limited(x["schema"])) for x in given)
        body = operation.get("requestBody") or {}
        schemas = [c.get("schema") or {} for c in (body.get("content") or {}).values()]
        of_body = bool(body) and (body.get("required") is True or any(s.get("required") or any(_limited(v) for v in (s.get("properties") or {}).values()) for s in schemas))
        if of_parameters or of_body:
            detail = "+".join(["parameters"] * of_parameters + ["body"] * of_body)
            rows.append((f"input-validation:{m.lower()}:{p}", "input-validation", f"Input validation for {m} {p}", f"{m} {p}", detail))
    return spark.createDataFrame(rows, "id string, category string, description string, endpoint string, detail string")


def _required_list(document, key: str) -> list:
    if not isinstance(document, dict) or not isinstance(document.get(key), list):
        raise ValueError(f"the document has no list '{key}' at its top level")
    return document[key]


def business_rules(spark: SparkSession, text: str) -> DataFrame:
    """S-08: rules with their scenarios; missing lists are empty, a missing top-level list is an error."""
    words = lambda x: [str(k) for k in x.get("keywords") or ()]
    rows = [(n, r["id"], r.get("description"), [str(e) for e in r.get("endpoints") or ()], words(r), [(s["id"], s.get("description"), words(s)) for s in r.get("scenarios") or ()]) for n, r in enumerate(_required_list(load(text), "rules"))]
    scenario = "struct<id:string,description:string,keywords:array<string>>"
    return spark.createDataFrame(rows, f"ord long, id string, description string, endpoints array<string>, keywords array<string>, scenarios array<{scenario}>")


def integration_flows(spark: SparkSession, text: str) -> DataFrame:
    """S-09: flows with their steps."""
    words = lambda x: [str(k) for k in x.get("keywords") or ()]
    rows = [(n, f["id"], f.get("name"), f.get("description"), [(s["id"], s.get("description"), s.get("type"), s.get("method"), s.get("path"), words(s)) for s in f.get("steps") or ()]) for n, f in enumerate(_required_list(load(text), "flows"))]
    step = "struct<id:string,description:string,type:string,method:string,path:string,keywords:array<string>>"
    return spark.createDataFrame(rows, f"ord long, id string, name string, description string, steps array<{step}>")


def merge_config(base: dict, over: dict) -> dict:
    """U-07: nested tables merge, lists and values are replaced, missing ones and None keep the base."""
    out = dict(base)
    for k, v in over.items():
        if v is not None:
            out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out

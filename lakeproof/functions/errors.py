"""Error scenarios and how test segments cover them (F-06 to F-10, F-21, F-22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import prefix

# Categories, and the words and patterns that tell them.
CATEGORIES = ("missing-parameter", "invalid-value", "unauthorized", "forbidden", "not-found", "conflict", "server-error")
DESCRIPTION_WORDS = {
    "missing-parameter": ("missing", "without", "omit", "no body", "required field"),
    "invalid-value": ("invalid", "wrong type", "bad value", "malformed", "incorrect format", "out of range", "exceeds"),
    "unauthorized": (
        "unauthorized", "unauthenticated", "no token", "missing token", "invalid token", "no auth", "missing auth",
        "without auth", "without token", "missing api key", "invalid api key", "no api key",
    ),
    "forbidden": ("forbidden", "not allowed", "insufficient permission", "access denied", "no permission"),
    "not-found": ("not found", "nonexistent", "non-existent", "unknown id", "does not exist", "missing resource"),
    "conflict": ("conflict", "duplicate", "already exists", "already registered", "already in use", "taken"),
    "server-error": ("server error", "internal error", "service unavailable", "unexpected error"),
}
CONTENT_PATTERNS = {
    "missing-parameter": (r"delete\s+\w+\.\w+", r"\w+\s*=\s*undefined"),
    "invalid-value": (r"""['"]?\w+['"]?\s*:\s*(null|undefined)\b""",),
    "unauthorized": (r"""(?i)authorization\s*:\s*['"]\s*['"]""", r"""(?i)authorization\s*:\s*['"]bearer\s+['"]"""),
    "not-found": (r"/\d{6,}", r"""['"`]\d{6,}['"`]""", r"00000000-0000-0000-0000-000000000000"),
}
MESSAGE_WORDS = {
    "missing-parameter": ("required", "missing", "must be provided"),
    "invalid-value": ("invalid", "format", "type", "must be", "out of range"),
    "unauthorized": ("unauthorized", "unauthenticated", "token", "api key"),
    "forbidden": ("forbidden", "permission", "access denied"),
    "not-found": ("not found", "does not exist"),
    "conflict": ("conflict", "duplicate", "already", "in use"),
    "server-error": ("internal", "server error", "unexpected"),
}
ERROR_BODY = r"""tohaveproperty\s*\(\s*['"]error['"]|\.body\.error|\.body\.message"""


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """The lower-cased text contains one of the words as they are."""
    low = F.lower(text)
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def categories_of(code: Column, description: Column) -> Column:
    """F-22: one or two categories of a status code; none below 400. A 400 is told apart by its description."""
    one = lambda *names: F.array(*[F.lit(x) for x in names])
    d = F.coalesce(description, F.lit(""))
    bad_request = (
        F.when(contains_any(d, ("missing", "required")), one("missing-parameter"))
        .when(contains_any(d, ("invalid", "format", "type", "value")), one("invalid-value"))
        .otherwise(one("missing-parameter", "invalid-value"))
    )
    return (
        F.when(code == 400, bad_request)
        .when(code == 401, one("unauthorized"))
        .when(code == 403, one("forbidden"))
        .when(code == 404, one("not-found"))
        .when(code == 409, one("conflict"))
        .when((code > 400) & (code < 500), one("invalid-value"))
        .when(code >= 500, one("server-error"))
        .otherwise(F.array().cast("array<string>"))
    )


def hints_at(category: Column, description: Column, content: Column) -> Column:
    """F-07: words of the description, or patterns of the content, that go with the category."""
    out = None
    for name in CATEGORIES:
        test = contains_any(description, DESCRIPTION_WORDS[name])
        for pattern in CONTENT_PATTERNS.get(name, ()):
            test = test | content.rlike(pattern)
        out = F.when(category == name, test) if out is None else out.when(category == name, test)
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def asserts_status(content: Column, code: Column) -> Column:
    """F-08: the content asserts this status code."""
    c = code.cast("string")
    pattern = F.concat(F.lit(r"\.toBe\(\s*"), c, F.lit(r"\s*\)|\.toEqual\(\s*"), c, F.lit(r"\s*\)|status(Code)?\s*[=!]=+\s*"), c, F.lit(r"\b|statusCode\s*:\s*"), c, F.lit(r"\b"))
    return F.coalesce(F.call_function("rlike", content, pattern), F.lit(False))


def asserts_message(category: Column, content: Column) -> Column:
    """F-09: the content asserts an error body and has a word of the category."""
    out = None
    for name in CATEGORIES:
        test = contains_any(content, MESSAGE_WORDS[name])
        out = F.when(category == name, test) if out is None else out.when(category == name, test)
    return F.coalesce(F.lower(content).rlike(ERROR_BODY) & out.otherwise(F.lit(False)), F.lit(False))


def mentions_endpoint(description: Column, content: Column, method: Column, path: Column) -> Column:
    """F-06: the description names method and path base, or the content has both, the method quoted."""
    base, verb, d, c = F.lower(prefix(path)), F.lower(method), F.lower(description), F.lower(content)
    quoted = F.contains(c, F.concat(F.lit("'"), verb, F.lit("'"))) | F.contains(c, F.concat(F.lit('"'), verb, F.lit('"')))
    named = F.contains(d, F.concat_ws(" ", verb, base)) | (F.contains(d, base) & F.contains(d, verb))
    return named | (F.contains(c, base) & quoted)


def covers(description: Column, content: Column, code: Column, categories: Column) -> Column:
    """F-10: by status assertion, or by any category's words or message assertion."""
    return asserts_status(content, code) | F.exists(categories, lambda k: hints_at(k, description, content) | asserts_message(k, content))

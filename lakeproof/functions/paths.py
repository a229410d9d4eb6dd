"""Path templates, globs and URL parts as Column expressions (F-01 to F-05, F-16, F-17, P-01, X-11, X-23, X-27)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

META = r"([.*+?^${}()|\[\]\\])"
PLACEHOLDER = r"\{[^}/]+\}"
#: Segments that stand for an identifier: digits, UUID, hexadecimal with a digit, or a slug with a digit.
IDENTIFIER = (
    r"^(?:\d+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{8,}"
    r"|(?=[A-Za-z0-9_-]*\d)[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)+)$"
)


def escape_regex(text: Column) -> Column:
    """P-01: the text as a literal pattern."""
    return F.regexp_replace(text, META, r"\\$1")


def path_to_regex(template: Column) -> Column:
    """F-01: anchored pattern of a path template; a placeholder matches one segment."""
    literals = F.transform(F.split(template, r"\{[^}]+\}", -1), escape_regex)
    return F.concat(F.lit("^"), F.array_join(literals, "[^/]+"), F.lit(r"\z"))


def contract_regex(template: Column) -> Column:
    """F-17: like path_to_regex after `:id` becomes `{id}`, but other characters keep their meaning in patterns."""
    named = F.regexp_replace(template, r":([A-Za-z0-9_]+)", r"{$1}")
    return F.concat(F.lit("^"), F.regexp_replace(named, r"\{[^}]+\}", "[^/]+"), F.lit(r"\z"))


def skeleton(template: Column) -> Column:
    """F-02: two templates match exactly if their skeletons are equal, which turns the theta join into an equi join."""
    return F.regexp_replace(template, PLACEHOLDER, "{}")


def normalize(path: Column) -> Column:
    """X-23: identifiers become `{id}`, other segments and placeholders stay."""
    segments = F.transform(F.split(path, "/", -1), lambda s: F.when(s.rlike(IDENTIFIER), F.lit("{id}")).otherwise(s))
    return F.array_join(segments, "/")


def url_path(url: Column) -> Column:
    """X-11: path of an absolute URL; other texts stay."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    absolute = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    return F.when(absolute, F.when(path == "", F.lit("/")).otherwise(path)).otherwise(url)


def compose(*parts: Column) -> Column:
    """X-27: parts joined by single slashes, with `<int:id>` and `:id` as `{id}`."""
    joined = F.concat_ws("/", F.lit(""), *parts)
    named = F.regexp_replace(F.regexp_replace(joined, r"<(?:[A-Za-z_]+:)?([A-Za-z0-9_]+)>", r"{$1}"), r"(?<=/):([A-Za-z0-9_]+)", r"{$1}")
    single = F.regexp_replace(named, "/{2,}", "/")
    return F.when(F.length(single) > 1, F.regexp_replace(single, r"/\z", "")).otherwise(single)


def has_placeholder(path: Column) -> Column:
    """F-03."""
    return F.contains(path, F.lit("{"))


def prefix(template: Column) -> Column:
    """F-16: what stands before the first placeholder."""
    return F.split_part(template, F.lit("{"), F.lit(1))


def under_prefix(path: Column, template: Column) -> Column:
    """F-16: the path equals the template or starts with what precedes its first placeholder."""
    return (path == template) | (F.contains(template, F.lit("{")) & F.startswith(path, prefix(template)))


def glob_regex(glob: str) -> str:
    """F-04, F-05: `**` stands for anything, `*` for anything but a slash."""
    out = []
    for k, part in enumerate(glob.split("**")):
        out += [".+"] * (k > 0) + ["[^/]+".join("".join("\\" + c if c in r".+?^${}()|[]\\" else c for c in p) for p in part.split("*"))]
    return "^" + "".join(out) + "$"


def excluded(method: Column, path: Column, methods: Sequence[str] = (), globs: Sequence[str] = ()) -> Column:
    """F-04: excluded by method, case-insensitively, or by a glob of the path."""
    by_method = F.upper(method).isin([m.upper() for m in methods]) if methods else F.lit(False)
    by_path = F.lit(False)
    for g in globs:
        by_path = by_path | path.rlike(glob_regex(g))
    return by_method | by_path


def parent_directories(path: Column) -> Column:
    """S-01: depth of a file below the listing root."""
    return F.size(F.split(path, "/")) - 1

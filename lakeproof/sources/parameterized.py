"""Variants of parameterised tests in source files (X-18)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file string, line int, test_name string, variants int, pattern string"
_CLOSING = {"[": "]", "(": ")", "{": "}"}


def bracketed(text: str) -> str | None:
    """What the first square bracket of a text encloses; None if it never closes."""
    depth, start = 0, text.find("[")
    for m in re.finditer(r"[\[\]]", text[start:] if start >= 0 else ""):
        depth += 1 if m.group() == "[" else -1
        if not depth:
            return text[start + 1 : start + m.start()]
    return None


def elements(text: str) -> int:
    """Elements that commas outside all brackets set apart; none in a blank text."""
    if not text.strip():
        return 0
    depth = commas = 0
    for c in re.findall(r"[\[\](){},]", text):
        depth += (c in _CLOSING) - (c in _CLOSING.values())
        commas += c == "," and depth == 0
    return commas + 1


def _method_source(content: str, name: str) -> int | None:
    """Arguments listed in the body of a factory method."""
    body = re.search(rf"(?:Stream|List|Collection|Set).*?\s+{name}\s*\([^)]*\)\s*\{{([\s\S]*?)\}}", content)
    return len(re.findall(r"(?:Arguments\.of|of)\s*\(", body[1])) or None if body else None


def _junit(lines: list[str], at: int, content: str) -> tuple[str, int | None, str] | None:
    """The last source annotation between the marker and the method, in the nine lines after the marker."""
    if "@ParameterizedTest" not in lines[at]:
        return None
    variants, pattern = None, "@ParameterizedTest"
    for line in lines[at + 1 : at + 10]:
        if m := re.search(r"(?:void|fun)\s+(\w+)\s*\(", line):
            return m[1], variants, pattern
        if m := re.search(r"@ValueSource\(\s*\w+\s*=\s*\{([^}]+)\}", line):
            variants, pattern = m[1].count(",") + 1, "@ValueSource"
        elif m := re.search(r"@CsvSource\(\s*(?:value\s*=\s*)?\{([^}]+)\}", line):
            variants, pattern = len(re.split(r'",\s*"', m[1])), "@CsvSource"
        elif m := re.search(r'@MethodSource\(\s*"(\w+)"', line):
            variants, pattern = _method_source(content, m[1]) or variants, f"@MethodSource({m[1]})"
        elif "@EnumSource" in line:
            variants, pattern = None, "@EnumSource"
    return "unknown", variants, pattern


def _jest(lines: list[str], at: int, content: str) -> tuple[str, int | None, str] | None:
    """`each` over an array, whose variants stay unknown, or over a table, whose rows after the heading's line are counted."""
    if m := re.search(r"(?:test|it|describe)\.each\s*\(\s*\[", lines[at]):
        name = re.search(r"\)\s*\(\s*['\"`]([^'\"`]+)['\"`]", content[content.find(m[0]) :])
        return name[1] if name else "parameterized test", None, "test.each"
    if re.search(r"(?:test|it|describe)\.each\s*`", lines[at]):
        end = next((k for k in range(at + 1, len(lines)) if "`" in lines[k]), len(lines))
        return "parameterized test", sum(bool(x.strip()) for x in lines[at + 1 : end]) or None, "test.each (template)"
    return None


def _pytest(lines: list[str], at: int, content: str) -> tuple[str, int | None, str] | None:
    """Parenthesised groups of the argument list, else its elements."""
    if not re.search(r"@pytest\.mark\.parametrize\s*\(", lines[at]):
        return None
    listed = bracketed("\n".join(lines[at : at + 20]))
    variants = None if not listed else len(re.findall(r"\([^)]*\)", listed)) or elements(listed)
    names = (re.search(r"def\s+(\w+)\s*\(", x) for x in lines[at + 1 : at + 10])
    return next((m[1] for m in names if m), "unknown"), variants, "@pytest.mark.parametrize"


READERS = {"java": _junit, "kotlin": _junit, "javascript": _jest, "typescript": _jest, "python": _pytest}


def parameterized_tests(files: DataFrame) -> DataFrame:
    """X-18: (file, line, test_name, variants, pattern) of files (file, language, content); variants is null where they cannot be
    told. Files of other languages and null contents have none. Balanced brackets need Python; every file is read by itself."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, language, content in batch.itertuples(index=False):
                lines = content.split("\n") if language in READERS and content is not None else []
                found = ((k, READERS[language](lines, k, content)) for k in range(len(lines)))
                out += [(file, k + 1, *x) for k, x in found if x]
            rows = pd.DataFrame(out, columns=["file", "line", "test_name", "variants", "pattern"])
            yield rows.astype({"line": "Int32", "variants": "Int32"})

    return files.select("file", "language", "content").mapInPandas(read, SCHEMA)

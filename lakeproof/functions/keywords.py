"""Keywords of rule conditions (X-30)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too general to tell a rule by.
STOP_WORDS = (
    "http", "exception", "error", "errors", "throw", "throws", "raise", "raises",
    "new", "return", "returns", "status", "response", "request", "abort",
    "the", "and", "for", "with", "that", "this", "from", "not", "has",
    "can", "cant", "be", "been", "must", "will", "was", "are", "have",
    "its", "too", "also", "just", "only", "than", "then", "when",
)
QUOTED = r"""['"]([^'"]{2,})['"]"""
SEPARATORS = r"[\s\-_.,!?:;/\\]+"
OBJECT_KEY = r"""\{\s*('[^']+'|"[^"]+"|\w+)\s*:"""
IDENTIFIER = r"\b([A-Za-z][A-Za-z0-9]{2,})\b"


def specific_keywords(condition: Column) -> Column:
    """X-30: distinct lower-case words of a condition, in order: those within quotes, then keys of objects, then parts of
    camel-case identifiers of three letters or more, all without stop words. Null gives an empty array."""
    text = F.coalesce(condition, F.lit(""))
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    quoted = F.flatten(F.transform(every(QUOTED), lambda q: F.split(F.lower(q), SEPARATORS)))
    keys = F.transform(every(OBJECT_KEY), lambda k: F.lower(F.regexp_replace(k, "['\"]", "")))
    parts = F.flatten(F.transform(every(IDENTIFIER), lambda i: F.split(F.trim(F.lower(F.regexp_replace(i, "([A-Z])", " $1"))), r"\s+")))
    words = F.concat(
        F.filter(quoted, lambda w: (F.length(w) >= 2) & w.rlike("[a-z]")), F.filter(keys, lambda w: F.length(w) >= 2), F.filter(parts, lambda w: F.length(w) >= 3)
    )
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w)))

"""Quality rules, line first: lines that fail are cut, documents that lose too much text are rejected.

Only DataFrame functions; no shuffle, one pass over the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RE, BLANKS, WORD_RE, columns, let, words

SYMBOLS = "#*$%&|<>"
#: Regular expressions of the line rules, valid for Java and RE2. A line must match ENDING; matching any other rejects it.
ENDING = r"[.!?…:;。！？][\"'”’)\]»]*\z"
NAVIGATION = r"([|»›•][^|»›•]*){3}"
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie policy|enable javascript"
    r"|lorem ipsum|click here|sign up for|subscribe to|powered by|skip to content)"
)
SHOUTING = r"(!![^!]*){3}"
SYMBOL_RUNS = r"([#*$%&|<>]{2,}[^#*$%&|<>]*){3}"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_lost_percent: int = 50


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK_RE, ""))


def line_fails(line: Column) -> Column:
    """True for a line that breaks the punctuation, navigation or boilerplate rules; lines without a word never fail."""
    return let(
        F.btrim(line, F.lit(BLANKS)),
        lambda t: (t != "")
        & (~t.rlike(ENDING) | t.rlike(NAVIGATION) | t.rlike(BOILERPLATE) | t.rlike(SHOUTING) | t.rlike(SYMBOL_RUNS)),
    )


def clean_text(text: Column) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line_fails(line)), "\n")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_RE)),
        lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    )


def repeated_words(ws: Column, width: int) -> Column:
    """Words that lie in a window of `width` words found at least twice in the array, first occurrence included.

    Windows are compared by a 64-bit hash. Sorting (hash, position) once per text with a repeat keeps this O(n log n).
    """

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            same = F.filter(
                s, lambda x, k: (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | ((k > 0) & F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))))
            )
            return F.array_sort(F.transform(same, lambda x: x["p"]))

        total = F.aggregate(
            let(ranked, positions),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct((p + width).alias("end"), (acc["n"] + p + width - F.greatest(acc["end"], p)).alias("n")),
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total["n"])

    n = F.size(ws)
    hashes = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(width))))
    return F.when(n > width, let(hashes, covered)).otherwise(F.lit(0)).cast("long")


def assess(docs: DataFrame, rules: Rules = Rules(), text: str = "text", out_column: str = "quality") -> DataFrame:
    """All rows and columns of docs with one struct column, out_column, of measures and verdicts.

    Null texts count as empty and empty texts fail the word minimum. Repeated rows are judged alike.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def measures(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws, rules.window).alias("n_repeat_words"))

    name, cleaned, base = "_lq_words", "_lq_clean", "_lq_base"
    out = docs.withColumns({name: let(words(t), measures), cleaned: clean_text(t)})
    out = out.withColumn(
        base,
        F.struct(
            F.col(name)["n_words"].alias("n_words"),
            word_chars(t).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            duplicate_lines(t).alias("n_dup_lines"),
            F.col(name)["n_repeat_words"].alias("n_repeat_words"),
            F.col(cleaned).alias("clean_text"),
            word_chars(F.col(cleaned)).cast("long").alias("clean_chars"),
        ),
    )
    b = F.col(base)
    failed = (b["n_words"] < rules.min_words) | (100 * b["n_repeat_words"] > rules.max_repeat_percent * b["n_words"])
    lost = 100 * (b["word_chars"] - b["clean_chars"]) > rules.max_lost_percent * b["word_chars"]
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "clean_chars"]
    verdict = F.struct(*[b[f].alias(f) for f in fields], failed.alias("base_failed"), (~failed & ~lost).alias("kept"))
    return out.withColumn(out_column, verdict).drop(name, cleaned, base)


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Accepted documents, with their failing lines cut and n_chars following the text."""
    mine = "_lq_quality"
    clean = F.col(mine)["clean_text"]
    judged = assess(docs, rules, out_column=mine).filter(F.col(mine)["kept"])
    changed = {"text": clean.alias("text"), "n_chars": F.length(clean).cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None}
    return judged.select(*[changed.get(name, c) for name, c in zip(docs.columns, columns(docs))])

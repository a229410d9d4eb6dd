import re

import pytest

from lakeproof.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


GOOD = "One two three four five six seven eight nine ten. Eleven twelve 13 14 15 16 17 18 19 20 21 are words too."
TEXTS = [
    None, "", " \n\t ", GOOD, GOOD + "\n" + GOOD, "a b c d e f g h " * 5, "x " * 9, "é ü b\x0bc", "| a | b | c |\n" * 4 + GOOD, "LOUD!! WORDS!! HERE!! NOW!!\n" * 9, "a### b$$$ c&&& d***\n" * 9,
    "All rights reserved.\n" + GOOD, "word " * 30000, "no end mark here\n" * 30, GOOD + "\n" + GOOD,
]


def test_measures_match_a_plain_count(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: r.quality for r in quality.assess(df).collect()}
    for k, t in enumerate(TEXTS):
        q = got[k]
        n, chars, symbols, lines, repeats = plain(t)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (n, chars, symbols, lines, repeats), k
        assert q.base_failed == (n < 20 or 100 * repeats > 30 * n), k
    assert got[3].kept and got[11].kept and not any(got[k].kept for k in (0, 1, 2, 6, 9, 10, 13))


def test_cleaning_keeps_columns(spark):
    rows = [(1, GOOD + "\n| a | b | c |", 9, "q", "d"), (2, "short.", 6, "q", "d"), (1, GOOD + "\n| a | b | c |", 9, "q", "d")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_chars long, quality string, `a.b` string")
    out = quality.keep_clean(df)
    assert out.columns == df.columns and [(r.doc_id, r.text, r.n_chars, r.quality) for r in out.collect()] == [(1, GOOD, len(GOOD), "q")] * 2
    assert quality.keep_clean(df.limit(0)).count() == 0


@pytest.mark.parametrize("line, bad", [("A sentence.", False), ("A heading", True), ("Home | News | About | Contact.", True), ("Subscribe to our news.", True), ('He said "yes."', False), ("  ", False)])
def test_line_rules(spark, line, bad):
    from pyspark.sql import functions as F

    assert spark.range(1).select(quality.line_fails(F.lit(line))).first()[0] == bad

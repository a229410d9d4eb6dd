import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeproof.llm import language

WORDS = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["omikron", "sigma", "tau", "phi"]}


def make(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(k, make(rng, lang, rng.randint(3, 40)), lang if k % 7 else None, f"h{k % 3}" if lang == "xx" else f"g{k % 3}", "s" + lang) for k, lang in ((k, rng.choice(["xx", "yy"])) for k in range(200))]
    # no letters: other evidence decides; nothing at all; a wrong declaration; repeated rows; a null id
    return out + [(900, "123 !!", "xx", "h1", "sxx"), (901, None, None, None, None), (902, "", None, "g1", None), (903, make(rng, "yy", 30), "xx", "g0", "syy"), (904, "sigma tau " * 20000, None, None, None), (904, "sigma tau " * 20000, None, None, None), (None, "beta beta beta", None, None, None)]


def plain(rows, s=language.Settings()):
    """The same posterior by loops over all rows."""
    langs = sorted({r[2] for r in rows if r[2]})
    table = np.zeros((1 << s.bits, len(langs)))
    for _, text, said, *_ in rows:
        if said:
            table[:, langs.index(said)] += np.bincount(language.trigrams(text, s.bits), minlength=1 << s.bits)
    table += 0.5
    logs = np.log(table / table.sum(axis=0)).astype(np.float32).astype(float)
    fits = [(language.trigrams(r[1], s.bits).size, logs[language.trigrams(r[1], s.bits)].sum(axis=0)) for r in rows]
    tops = [int(np.argmax(f)) if n else None for n, f in fits]
    total = Counter(t for t in tops if t is not None)
    n_all, width = sum(total.values()), len(langs)
    overall = np.array([(total[k] + 1) / (n_all + width) for k in range(width)])
    counts = {e: {} for e in (2, 3, 4)}
    for r, t in zip(rows, tops):
        for e in counts:
            if r[e] is not None and t is not None:
                counts[e].setdefault(r[e], np.zeros(width))[t] += 1
    out = []
    for r, (n, f) in zip(rows, fits):
        c = {e: counts[e].get(r[e], np.zeros(width)) if r[e] is not None else None for e in counts}
        zero = np.zeros(width)
        suffix = ((c[4] if c[4] is not None else zero) + s.smoothing * overall) / ((c[4].sum() if c[4] is not None else 0) + s.smoothing)
        host = c[3] if c[3] is not None else zero
        prior = (host + s.smoothing * suffix) / (host.sum() + s.smoothing)
        post = f * min(1.0, s.cap / max(n, 1)) + np.log(prior)
        for e in (2, 4):
            if c[e] is not None:
                post = post + np.log((c[e] + s.smoothing * (c[e].sum() + 1) / (n_all + 1)) / (n_all * overall + s.smoothing))
        sure = 1 / np.exp(post - post.max()).sum()
        nothing = n == 0 and all(r[e] is None for e in (2, 3, 4))
        ok = not nothing and sure >= s.accept
        out.append((r[0], langs[int(np.argmax(post))] if ok else "und", round(float(sure), 6), ok, n))
    return out


def test_posteriors_match_a_plain_version(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, host string, suffix string, top string").repartition(3)
    got = [(r.doc_id, r.language, r.confidence, r.accepted, r.n_trigrams) for r in language.identify(df, df["lang"], df["suffix"], df["host"]).collect()]
    want = plain(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and g[3:] == w[3:] and math.isclose(g[2], w[2], abs_tol=1e-4), (g, w)
    by = {g[0]: g[1] for g in got}
    assert (by[900], by[901], by[902], by[903], by[904], by[None]) == ("xx", "und", "yy", "yy", "yy", "xx")


def test_every_declared_language_is_told(spark):
    """Of 70 languages with their own words, none is given another's code."""
    rng = random.Random(8)
    own = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for k in range(70)}
    rows = [(k, " ".join(rng.choice(own[x]) for _ in range(30)), x) for k, x in enumerate(sorted(own) * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.language for r in language.identify(df, df["lang"]).collect()}
    assert got == {k: x for k, _, x in rows}


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(empty, empty["lang"]).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], empty.schema)
    assert [r.language for r in language.identify(unlabelled, unlabelled["lang"]).collect()] == ["und"]
    one = spark.createDataFrame([(1, "some text", "en"), (2, None, "en")], empty.schema)
    assert {r.language for r in language.identify(one, one["lang"]).collect()} == {"en"}


def test_documents_held_out(spark):
    """The text model alone, fitted on declared documents, tells nearly all documents whose declaration is withheld."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = F.col("doc_id") % 4 == 0
    shown = docs.withColumn("said", F.when(~hidden, F.col("lang")))
    got = language.identify(shown, shown["said"]).join(docs.select("doc_id", "lang"), "doc_id").filter(hidden)
    assert got.filter("language = lang").count() >= 0.98 * got.count()

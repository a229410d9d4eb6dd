"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per document: hashed letter-trigram likelihoods of the whole text, the declared
(markup) language, the address suffix, and the host's prior. Host priors are smoothed towards their suffix, and these towards
the whole corpus; all of them, and the reliability of declarations, are counts of text decisions from grouped aggregations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """bits: size of the trigram table. sample: labelled rows per language that fit the text model, about. cap: trigrams
    that one text counts for at most. smoothing: pseudo-counts of the priors. accept: least posterior of an accepted language."""

    bits: int = 15
    sample: int = 2000
    cap: float = 60.0
    smoothing: float = 20.0
    accept: float = 0.5


def trigrams(text: str | None, bits: int) -> np.ndarray:
    """Bucket of every letter trigram of the text, white space included once between words."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words:
        return np.array([], np.uint32)
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits)


def fit(labelled: DataFrame, s: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """All declared languages and log-probabilities (bucket, language) from rows (doc_id, text, declared).

    Fits on about s.sample rows per language, those of the smallest hashes of doc_id and text; unlabelled rows are ignored.
    """
    known = labelled.filter(F.col("declared").isNotNull() & (F.trim("declared") != ""))
    sizes = known.groupBy("declared").count().collect()
    langs = sorted(r["declared"] for r in sizes)
    if not langs:
        return [], np.zeros((1 << s.bits, 0), np.float32)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["declared"], min(1.0, s.sample / r["count"]))])[F.col("declared")]
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) / float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text.as_py(), s.bits), minlength=1 << s.bits)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = known.filter(draw < share).select("text", "declared").mapInArrow(count, "lang string, bucket long, n long")
    table, number = np.zeros((1 << s.bits, len(langs))), {x: k for k, x in enumerate(langs)}
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        table[r["bucket"], number[r["lang"]]] = r["n"]
    table += 0.5
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _weights(counts: list[Column], n: Column, prior: list[Column], m: float) -> list[Column]:
    return [(c + m * p) / (n + m) for c, p in zip(counts, prior)]


def _clean(c: Column | None) -> Column:
    return F.lit(None).cast("string") if c is None else F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def row_hash(docs: DataFrame, *evidence: Column | None) -> Column:
    """What tells rows of docs apart, and decides their language but for the corpus: doc_id, text and evidence, nulls as such."""
    parts = [docs["text"], *map(_clean, evidence)]
    return F.xxhash64(docs["doc_id"].cast("long"), *[x for p in parts for x in (p.isNull(), p)])


def identify(docs: DataFrame, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, s: Settings = Settings()) -> DataFrame:
    """(doc_id, language, confidence, accepted, n_trigrams, row) for each row of docs (doc_id, text); row is its row_hash.

    A text without letters has no text evidence: the other evidence decides. Rows of which nothing is known, or no language
    reaches s.accept, get language `und` and are not accepted. Null evidence of any kind is left out of the product. Equal
    posteriors go to the language of the smaller code. Without any declared language all rows are `und`.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", _clean(declared).alias("declared"), _clean(suffix).alias("suffix"), _clean(host).alias("host"),
        row_hash(docs, declared, suffix, host).alias("row"),
    )
    langs, table = fit(base, s)
    if not langs:
        return base.select("doc_id", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("n_trigrams"), "row")

    model = base.sparkSession.sparkContext.broadcast(table)  # 2 ** bits * languages * 4 bytes, 128 KB for each language
    width = len(langs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for b in batches:
            sizes, sums = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, width))
            for k, text in enumerate(b.column(1)):
                t = trigrams(text.as_py(), s.bits)
                sizes[k] = t.size
                for a in range(0, t.size, 1 << 16):
                    sums[k] += weights[t[a : a + (1 << 16)]].sum(axis=0)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), b.column(5), pa.array(sizes), lists], names=["doc_id", "declared", "suffix", "host", "row", "n_trigrams", "fit"])

    scored = base.mapInArrow(score, "doc_id long, declared string, suffix string, host string, row long, n_trigrams long, fit array<double>")
    best = F.array_position(F.col("fit"), F.array_max("fit")).cast("int") - 1
    scored = materialize(scored.withColumn("top", F.when(F.col("n_trigrams") > 0, best)), "language-text")

    hits = [F.sum(F.when(F.col("top") == k, 1.0).otherwise(0.0)).alias(f"c{k}") for k in range(width)]
    total = scored.agg(*hits).first()
    n_all = sum(x or 0.0 for x in total)
    overall = [((x or 0.0) + 1.0) / (n_all + width) for x in total]
    out = scored

    def counts(key: str) -> DataFrame:
        """Text decisions by value of key."""
        return materialize(scored.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(*hits), f"language-{key}")

    def attach(rows: DataFrame, key: str) -> DataFrame:
        """Counts of the row's key as a struct; rows without the key are spread over many join keys instead of one null."""
        found = counts(key).select(F.col(f"_{key}"), F.array(*[F.col(f"c{k}") for k in range(width)]).alias(f"{key}_counts"))
        spread = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id"), F.lit(4096)).cast("string")))
        return rows.join(found, spread == F.col(f"_{key}"), "left").drop(f"_{key}")

    for key, given in (("declared", declared), ("suffix", suffix), ("host", host)):
        out = out.withColumn(f"{key}_counts", F.lit(None).cast("array<double>")) if given is None else attach(out, key)
    at = lambda key, k: F.coalesce(F.col(f"{key}_counts")[k], F.lit(0.0))
    of = lambda key: F.coalesce(F.aggregate(f"{key}_counts", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    m = s.smoothing
    by_suffix = _weights([at("suffix", k) for k in range(width)], of("suffix"), [F.lit(p) for p in overall], m)
    prior = _weights([at("host", k) for k in range(width)], of("host"), by_suffix, m)
    logs = []
    for k in range(width):
        text = F.col("fit")[k] * F.least(F.lit(1.0), s.cap / F.greatest(F.col("n_trigrams"), F.lit(1)))
        in_k = n_all * overall[k]
        # the chance of this declaration, and of this suffix, among documents of language k
        said, lies = ((at(e, k) + m * (of(e) + 1.0) / (n_all + 1.0)) / (in_k + m) for e in ("declared", "suffix"))
        neutral = lambda e, p: F.when(F.col(f"{e}_counts").isNull(), F.lit(0.0)).otherwise(F.log(p))
        logs.append(text + F.log(prior[k]) + neutral("declared", said) + neutral("suffix", lies))
    out = out.withColumn("logs", F.array(*logs)).withColumn("most", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    sure = F.round(F.lit(1.0) / mass, 9)
    nothing = (F.col("n_trigrams") == 0) & F.col("declared").isNull() & F.col("suffix").isNull() & F.col("host").isNull()
    accepted = ~nothing & (sure >= s.accept)
    language = F.when(accepted, F.array(*[F.lit(x) for x in langs])[F.array_position("logs", F.col("most")).cast("int") - 1]).otherwise(F.lit("und"))
    return out.select("doc_id", language.alias("language"), sure.alias("confidence"), accepted.alias("accepted"), "n_trigrams", "row")

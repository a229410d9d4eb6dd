"""The op queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lzprint, mixing, oracles, packing, pitmanyor, quality, simhash, toxicity, urls, warc
from .common import table


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.assess(docs).select("doc_id", *[F.col("quality")[f].alias(f) for f in fields])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents declare a language and name their source, which stands for the host; they have no address."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, declared=docs["lang"], host=docs["source"]).drop("row")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages"))


def op8_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op10_toxicity": op10_toxicity,
    "op8_lz_fingerprints": op8_lz_fingerprints,
    "op2_warc": op2_warc,
    "op3_url_filters": op3_url_filters,
    "op5_language_id": op5_language_id,
    "op4_mixing": op4_mixing,
    "op9_packing": op9_packing,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
}
ORACLES = {
    "op3_url_filters": oracles.URLS,
    "op7_quality_rules": oracles.QUALITY,
}

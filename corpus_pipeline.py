"""Corpus pipeline: language ID, quality rules, near-dedup, mixing and packing over documents, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.llm import language, mixing, packing, quality, simhash
from lakeproof.llm.common import columns, materialize, scratch
from lakeproof.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is certain; every row follows its own verdict."""
    evidence = docs["lang"], None, docs["source"]
    found = language.identify(docs, *evidence)
    rejected = materialize(found.filter("not accepted").select(F.col("row").alias("_rejected")).distinct(), "pipeline-rejected")
    return docs.join(rejected, language.row_hash(docs, *evidence) == rejected["_rejected"], "left_anti").select(*columns(docs))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 or more between sets of five-word shingles."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("quality rules", clean_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Packing places ids by a tokenizer, which SQL cannot express; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

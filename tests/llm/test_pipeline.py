"""Every stage of the pipeline against what its operator says of the stage's own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeproof.llm import language, mixing, queries, quality, simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    before, after = stages[0]
    assert ids(after) == ids(language.identify(before, declared=before["lang"], host=before["source"]).filter("accepted"))
    before, after = stages[1]
    judged = quality.assess(before).filter("quality.kept")
    assert {(r.doc_id, r.text) for r in after.collect()} == {(r.doc_id, r.quality.clean_text) for r in judged.collect()}
    before, after = stages[2]
    grams = {r.doc_id: set(simhash.shingles((r.text or "").encode(), 5).tolist()) for r in before.collect()}
    alike = lambda a, b: len(grams[a] & grams[b]) / max(1, len(grams[a] | grams[b]))
    stayed = ids(after)
    assert not [(a, b) for a in stayed for b in stayed if a < b and alike(a, b) >= 0.8]
    # the similarity is estimated from 384 bits, to about 0.04, and the limit is one such step below 0.8
    for gone in set(grams) - set(stayed):
        assert max(alike(gone, x) for x in grams if x != gone) >= 0.7
    before, after = stages[3]
    counted = {(r.doc_id): r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert counted == {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    before, after = stages[4]
    whole = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("each"))
    assert {r.doc_id: r.n // r.each for r in whole.collect()} == {r.doc_id: r["count"] for r in before.groupBy("doc_id").count().collect()}


def test_clean_documents_stay(spark, stages):
    """Of documents labelled good, hardly any is lost to language ID, and none to quality rules but short and repetitive ones."""
    good = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1")
    for before, after in stages[:2]:
        had, has = before.join(good, "doc_id", "left_semi"), after.join(good, "doc_id", "left_semi")
        lost = had.join(has.select("doc_id"), "doc_id", "left_anti")
        assert quality.assess(lost).filter("not quality.base_failed").count() <= 0.01 * had.count()


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_rows_follow_their_own_verdicts(spark):
    """Null and repeated ids, repeated rows, null and empty texts, extra columns of clashing names, and an empty table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).withColumns({"row": F.lit("r"), "_copies": F.lit(1), "size": F.col("n_chars"), "key": F.lit(2)})
    one = docs.filter("lang = 'en'").limit(1)
    odd = one.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})
    named = one.withColumn("text", F.lit(""))
    rows = docs.unionByName(odd).unionByName(named).unionByName(one).unionByName(one.withColumn("doc_id", F.lit(None).cast("long")))
    before = rows
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = mixing.materialize(f(spark, before, DATA), "test-stage")
        assert after.columns == rows.columns and after.count() <= 3 * before.count()
        empty = f(spark, before.limit(0), DATA)
        assert empty.columns == rows.columns and empty.count() == 0
        before = after
    text = one.first().text
    kept = corpus_pipeline.drop_near_copies(spark, rows, DATA)
    assert kept.filter(F.col("text") == text).count() == 1 and kept.filter("coalesce(text, '') = ''").count() == 1
    assert corpus_pipeline.pack_sequences(spark, before, DATA).count() > 0

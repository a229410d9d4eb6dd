from lakeproof.streaming import metrics


def test_windows_and_sessions_agree_with_batch(spark, tmp_path):
    folder, file = "/root/testdata/sf0.001", "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(file).schema
    seen = []
    stream = metrics.source(spark, folder, schema, "events.parquet")

    def failing(batch, number):
        raise RuntimeError

    q = metrics.subscribe(stream, [failing, lambda b, n: seen.append(b.count())], str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sum(seen) == spark.read.parquet(file).count()

    counts = metrics.windowed_counts(metrics.source(spark, folder, schema, "events.parquet"))
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from w").first()[0] == spark.read.parquet(file).count()
    assert metrics.alerts(spark.table("w"), 0.0).count() == 0

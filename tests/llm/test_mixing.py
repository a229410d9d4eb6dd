import pytest
from pyspark.sql import functions as F

from lakeproof.llm import mixing


def plain_targets(sizes, weights=(5.0, 2.0, 1.0)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, set(order)
    while free:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in free)
        full = {s for s in free if 3 * sizes[s] <= level * w[s]}
        if not full:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: 3.0 * sizes[s] for s in full}
        free -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 200, "c": 1000, None: 5}, {"a": 1, "b": 1000, "c": 1}, {"a": 0, "b": 0}, {"a": 7}, {"Z": 3, "a": 900, "é": 40, "b": 1, "c": 1, "d": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, z) for s, z in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_follows_virtual_time(spark):
    rows = [(k, "w " * (1 + k * 7 % 23), ["a", "b", "c", None][k % 4 if k % 3 else 0]) for k in range(400)] + [(1000, None, "a"), (1001, " ", "z"), (None, "x y", "b"), (5, "w " * 13, "b"), (5, "w " * 13, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df.repartition(3)).collect()
    again = mixing.mix(df.repartition(2)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "~", r.size, r.copies)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    sizes, taken = {}, {}
    for r in sorted(got, key=key):
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == r.copies * r.size and r.copies <= 3
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - want[s]) <= 2 * longest for s in want)
    assert sum(sizes.values()) - longest <= sum(taken.values()) <= sum(sizes.values())
    mixed = mixing.repeat_mix(df.filter("doc_id is null or doc_id <> 5"))
    assert mixed.columns == df.columns
    counted = {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    alone = mixing.mix(df.filter("doc_id is null or doc_id <> 5")).collect()
    assert counted == {(r.doc_id, r.source): r.copies for r in alone if r.copies}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], df.schema)
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2


def test_rows_with_equal_or_no_ids_are_served_as_often_as_the_mix_says(spark):
    rows = [(7, f"text {k} " * (k + 1), "a") for k in range(10)] + [(None, f"none {k}", "b") for k in range(20)] + [(1, "same same", "a")] * 5 + [(2, "word " * 30000, "b"), (3, None, "c")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, copies int").repartition(3)
    want = {}
    for r in mixing.mix(df).collect():
        want[r.row] = want.get(r.row, 0) + r.copies
    got = {}
    mixed = mixing.repeat_mix(df)
    for r in mixed.select(mixing.row_hash(mixed).alias("row")).collect():
        got[r.row] = got.get(r.row, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    each = {r.copies: r["count"] for r in mixing.repeat_mix(df).filter("doc_id = 1").groupBy("copies").count().collect()}
    assert len(each) <= 5 and max(each.values(), default=0) - min(each.values(), default=0) <= 1

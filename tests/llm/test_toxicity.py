import random

import numpy as np
import pytest

from lakeproof.llm import toxicity


def make(n=1200, seed=3):
    """Documents of neutral words; toxic ones have words of a small list, or several words with one start."""
    rng = random.Random(seed)
    neutral = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(neutral) for _ in range(rng.randint(10, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            words += rng.sample(["zork", "quib", "blarg", "wexx"], 2) if rng.random() < 0.6 else [f"vuzzk{rng.choice('abcdefghij')}{rng.randint(1, 9)}".rstrip("0123456789") + rng.choice(["on", "er", "ish", "ing"]) for _ in range(4)]
            rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, truth = make()
    labels = [(k, t) for k, t in truth if k % 2] + [(None, 1), (7, None), (99999, 1)]
    docs = spark.createDataFrame([(*r, "c") for r in rows] + [(5000, None, "c"), (5001, "", "c"), (None, "zork quib", "c"), (5002, "zork quib " * 30000, "c"), (5002, "zork quib " * 30000, "c")], "doc_id long, text string, fired string")
    got = toxicity.score(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    hits = [by[k].predicted for k, t in truth if t and by[k].held_out]
    clean = [by[k].predicted for k, t in truth if not t and by[k].held_out]
    assert np.mean(hits) > 0.9 and np.mean(clean) < 0.03
    assert not by[5000].predicted and by[5000].score == by[5001].score and by[None].predicted and by[5002].predicted


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, truth = make(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r.doc_id for r in docs.select("doc_id", toxicity.held_out(docs["doc_id"]).alias("h")).filter("h").collect()}
    run = lambda ls: sorted(map(tuple, toxicity.score(docs, spark.createDataFrame(ls, "doc_id long, toxic int")).collect()))
    assert run(truth) == run([(k, 1 - t if k in held else t) for k, t in truth])


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_without_both_kinds_of_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 2 and len({r.score for r in got}) == 1
    assert toxicity.score(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_correlated_voters_are_discounted(spark):
    """Ten voters that always fire together weigh about as one."""
    rng = random.Random(0)
    patterns = []
    for _ in range(2000):
        y = int(rng.random() < 0.3)
        group = rng.random() < (0.6 if y else 0.1)
        alone = rng.random() < (0.6 if y else 0.1)
        patterns.append((list(range(10)) * group + [10] * alone, y, 1))
    df = spark.createDataFrame(patterns, "fired array<int>, label int, n long")
    m = toxicity.fit_label_model(df, 11, toxicity.Settings())
    add, _ = m.terms()
    assert m.weight[10] > 3 * m.weight[0] and abs(m.fires[1][10] - 0.6) < 0.08 and abs(m.fires[0][10] - 0.1) < 0.05
    assert abs(m.prior - 0.3) < 0.05 and add[10] > 1.0

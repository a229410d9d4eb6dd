import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeproof.llm import components, simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, by a search over all pairs."""
    ids, out = list(prints), {}
    for i in sorted(k for k in ids):
        if i in out:
            continue
        stack = [i]
        while stack:
            x = stack.pop()
            if x in out:
                continue
            out[x] = i
            stack += [y for y in ids if y not in out and (prints[x] ^ prints[y]).bit_count() <= 4]
    return out


def near(x, rng, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("limit", [1, 3, simhash.LONG_RUN])
def test_links_lose_nothing(spark, limit):
    rng = random.Random(limit)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base) | {0, 1, 2**64 - 1}
    for x in base[:10]:
        for _ in range(40):  # dense groups, chains of up to 4 bits
            x = near(x, rng, rng.randint(1, 4)) if rng.random() < 0.5 else near(base[0], rng, 4)
            values.add(x)
    prints = {k: v for k, v in enumerate(sorted(values))}
    df = spark.createDataFrame([(k, v - 2**64 if v >= 2**63 else v) for k, v in prints.items()], "id long, fp long")
    found = components.components(simhash.links(df.select("fp"), limit))
    roots = {r.node: r.root for r in found.collect()}
    got = {}
    for r in df.collect():
        got.setdefault(roots.get(r.fp, r.fp), []).append(r.id)
    want = {}
    for k, c in plain_components(prints).items():
        want.setdefault(c, []).append(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_documents(spark):
    a = " ".join(f"word{k}" for k in range(300))
    texts = [None, "", "one two", "ONE two", "one two three four five", a, a.replace("word7 ", "other "), "É x y z", " \t\n", a, "word " * 20000]
    rows = [(k if k != 9 else 5, t) for k, t in enumerate(texts)] + [(None, "alone here"), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash.near_duplicates(df.withColumn("fp", F.lit("clash"))).collect()}
    prints = {k: plain_print(t) for k, t in rows if k is not None}
    want = plain_components(prints)
    assert {k: v for k, v in got.items() if k[0] is not None} == {(k, prints[k]): want[k] for k in prints}
    assert got[None, plain_print("alone here")] is None and got[None, plain_print("one two")] == 2
    kept = simhash.keep_one(df)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, c) for c in set(want.values())] + [(True, 0)])  # the copy without id goes
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(50)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_search_finds_a_spanning_forest():
    x = np.array([0, 1, 3, 1 << 20, (1 << 40) - 1], np.uint64)
    roots, members = simhash.search(x)
    assert sorted(np.concatenate(members).tolist()) == [1, 3, 1 << 20] and set(np.concatenate(roots).tolist()) == {0}


def jaccard(a, b):
    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def edited(words, rng, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


def test_keep_one_row_of_near_copies(spark):
    """Similar texts leave the smallest id; texts that share an id or have none are judged one by one."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(3000)}" for _ in range(400)] for _ in range(6)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    rows += [(10 + k, edited(b, rng, 4)) for k, b in enumerate(base) for _ in range(3)]  # similarity of about 0.9
    rows += [(30 + k, edited(b, rng, 60)) for k, b in enumerate(base)]  # about 0.3
    rows += [(None, "no id but its own text here"), (None, " ".join(base[0])), (None, "another text without any id"), (None, "another text without any id")]
    rows += [(5, "a second text under id five"), (50, "a second text under id five"), (60, None), (61, ""), (62, " \n"), (63, "long " * 50000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, key int").repartition(3)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = rows[:6] + [r for r in rows if r[0] is not None and 30 <= r[0] < 40]
    want += [(None, "no id but its own text here"), (None, "another text without any id"), (5, "a second text under id five"), (60, None), (63, "long " * 50000)]
    assert got == sorted(want, key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [2, simhash.LONG_RUN])
def test_similar_links_find_what_is_similar(spark, limit):
    rng = random.Random(limit)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(words)] + [edited(words, rng, n) for n in (2, 4, 6, 30)]
    prints = [simhash.wide_fingerprint(t.encode()) for t in texts]
    nodes = [int(simhash.node(p[None, :])[0].view(np.int64)) for p in prints]
    df = spark.createDataFrame([(n, *map(int, p.view(np.int64))) for n, p in zip(nodes, prints)], "node long, " + ", ".join(f"f{k} long" for k in range(6)))
    root = {r.node: r.root for r in components.components(simhash.similar_links(df, limit=limit)).collect()}
    same = lambda a, b: root.get(nodes[a], a) == root.get(nodes[b], b)
    pairs = [(a, b, jaccard(texts[a], texts[b])) for a in range(len(texts)) for b in range(a) if a // 5 == b // 5]
    near = [(a, b) for a, b, j in pairs if j >= 0.85]
    assert len(near) > 30 and sum(same(a, b) for a, b in near) >= 0.98 * len(near)
    assert not any(same(a, b) for a, b, j in pairs if j < 0.6)


def similar_roots(spark, prints, limit):
    nodes = [int(simhash.node(p[None, :])[0].view(np.int64)) for p in prints]
    df = spark.createDataFrame([(n, *map(int, p.view(np.int64))) for n, p in zip(nodes, prints)], "node long, " + ", ".join(f"f{k} long" for k in range(6)))
    df = df.repartition(4)
    root = {r.node: r.root for r in components.components(simhash.similar_links(df, limit=limit)).collect()}
    return [root.get(n, n) for n in nodes]


def differ_everywhere(print_, rng, bits, but=0):
    """A fingerprint with as many other bits in every segment but one."""
    out = [int(w) for w in print_]
    for s, (k, (low, width)) in enumerate((k, segment) for k in range(6) for segment in simhash.SEGMENTS):
        for b in rng.sample(range(low, low + width), bits if s != but else 0):
            out[k] ^= 1 << b
    return np.array(out, np.uint64)


@pytest.mark.parametrize("but", [0, 10])
def test_long_runs_lose_no_pair(spark, monkeypatch, but):
    """Fingerprints that share the variants of one segment only: a run over the limit links what a shorter one does."""
    rng = random.Random(but)
    top = [np.array([rng.getrandbits(64) for _ in range(6)], np.uint64) for _ in range(12)]
    k, (low, width) = [(k, segment) for k in range(6) for segment in simhash.SEGMENTS][but]
    mask = np.uint64(((1 << width) - 1) << low)
    for p in top[1:]:
        p[k] = p[k] & ~mask | top[0][k] & mask  # one run for all
    prints = [*top, *(differ_everywhere(p, rng, 3, but) for p in top[:8])]  # 51 bits, alike in one segment
    for _ in range(120):  # a dense group
        prints.append(differ_everywhere(top[9], rng, 1, but))
    monkeypatch.setattr(simhash, "TWO_BLOCKS", 32)
    monkeypatch.setattr(simhash, "HEADS", 3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # runs are counted from batch to batch
    try:
        whole, cut = similar_roots(spark, prints, simhash.LONG_RUN), similar_roots(spark, prints, 50)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert cut == whole
    assert all(cut[12 + j] == cut[j] for j in range(8)) and len(set(cut)) == 12 and len(set(cut[20:])) == 1


def test_routes_spell_out_every_variant_once(spark):
    fps = [0, -1, 1 << 20, 1 << 41, -(1 << 63), 0x123456789ABCDEF, -987654321987654321]
    d = spark.createDataFrame([(x,) for x in fps], "fp long")
    whole = d.select("fp", F.explode(simhash.variants(F.col("fp"))).alias("key"))
    routed = d.select("fp", F.explode(simhash.routes(F.col("fp"))).alias("route"))
    spelled = routed.select("fp", "route", F.explode(simhash.routed_variants(F.col("fp"), F.col("route"))).alias("key"))
    assert sorted(whole.collect()) == sorted(spelled.select("fp", "key").collect())
    assert spelled.groupBy("key").agg(F.count_distinct("route").alias("n")).filter("n > 1").isEmpty()

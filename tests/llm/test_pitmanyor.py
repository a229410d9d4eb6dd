import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeproof.llm import pitmanyor as lm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [w.lower() for w in WORD.findall((text or "").encode())] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def texts(n=140):
    rng = np.random.default_rng(0)
    vocab = [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        size, w, at = int(rng.integers(0, 60)), [], 0
        for _ in range(size):
            at = int(rng.choice([(at * 7 + 1) % 60, (at * 3 + 2) % 60, rng.integers(0, 60)], p=[0.6, 0.3, 0.1]))
            w.append(vocab[at])
        out.append((k, " ".join(w)))
    return out + [(500, None), (501, ""), (502, "W1 É\tw2"), (None, "w1 w8"), (503, "the " * 30000), (7, "w1 w8"), (7, "w1 w8")]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(*r, "c") for r in texts()], "doc_id long, text string, score string").repartition(3)
    return sorted(map(tuple, lm.score(df, lm.Settings(block_tokens=500)).collect()), key=str)


def test_base_columns(scored):
    rows = texts()
    count = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    want = []
    for i, x in rows:
        t = tokens(x)
        want.append((i, held(i), len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)))
    for g, w in zip(scored, sorted(want, key=str)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)


def test_better_than_base_on_held_out_texts(scored):
    rows = [r for r in scored if r[1]]
    assert rows and sum(r[6] for r in rows) > 0.9 * sum(r[5] for r in rows)
    assert all(r[6] < 0 for r in scored)


def test_blocks_and_seeds_do_not_matter_much(spark, scored):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    other = sorted(map(tuple, lm.score(df, lm.Settings(block_tokens=10**6, seed=9)).collect()), key=str)
    for a, b in zip(other, scored):
        assert a[:5] == b[:5] and math.isclose(a[6], b[6], rel_tol=0.05)


def test_contexts_matter_and_unknown_words_have_a_chance(spark):
    train = [(k, "red apple red apple green pear") for k in range(60) if not held(k)]
    probes = [k for k in range(1000, 1100) if held(k)][:4]
    asked = dict(zip(probes, ("red apple", "red pear", "red never-seen", "")))
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(train + list(asked.items()), "doc_id long, text string")).collect()}
    good, bad, new, none = (got[k] for k in probes)
    assert good > bad > -20 and new > -20 and all(x < 0 for x in (good, bad, new, none))


def seat_plainly(pairs, s, sweeps, rng):
    """Mean predictive probabilities of a small bigram model, dish by dish in plain loops."""
    contexts, words = sorted({u for u, _ in pairs}), sorted({w for _, w in pairs})
    t = {p: 1 for p in pairs}
    c_u = {u: sum(c for (x, _), c in pairs.items() if x == u) for u in contexts}
    mean, kept, root_tables = Counter(), 0, {w: 1 for w in words}

    def draw(c, others, parent, strength, discount):
        table = lm.stirling(discount, np.array([c]))[c] if c > 1 else [0.0]
        w = [math.exp(table[k - 1] + sum(math.log((strength + discount * (others + j)) * parent) for j in range(k))) for k in range(1, c + 1)]
        return 1 + int(rng.choice(c, p=np.array(w) / sum(w)))

    for sweep in range(sweeps):
        c0 = Counter()
        for (_, w), n in t.items():
            c0[w] += n
        for w in words:
            others = sum(root_tables.values()) - root_tables[w]
            root_tables[w] = draw(c0[w], others, 1 / (len(words) + 1), s.root_strength, s.root_discount)
        opened, n0 = sum(root_tables.values()), sum(c0.values())
        root = {w: (c0[w] - s.root_discount * root_tables[w] + (s.root_strength + s.root_discount * opened) / (len(words) + 1)) / (s.root_strength + n0) for w in words}
        if sweep >= 5:
            kept += 1
            for u in contexts:
                tables = sum(n for (x, _), n in t.items() if x == u)
                for w in words:
                    c, n = pairs.get((u, w), 0), t.get((u, w), 0)
                    mean[u, w] += (c - s.discount * n + (s.strength + s.discount * tables) * root[w]) / (s.strength + c_u[u])
        for u, w in pairs:
            others = sum(n for (x, v), n in t.items() if x == u and v != w)
            t[u, w] = draw(pairs[u, w], others, root[w], s.strength, s.discount)
    return {k: x / kept for k, x in mean.items()}


def test_scores_are_those_of_dish_by_dish_seating(spark):
    """Averaged predictive probabilities of the dealt-out model against plain loops."""
    words = ["a b a c a b", "b c a b a b a b", "c c c a", "a a b", "b", "d a b a"]
    rows = [(k, words[k % len(words)]) for k in range(48) if not held(k)]
    pairs = Counter()
    for _, x in rows:
        t = [w or b"" for w in tokens(x)]
        pairs.update(zip([b"^", *t], t))
    want = seat_plainly(pairs, lm.Settings(), 400, np.random.default_rng(3))
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), lm.Settings(sweeps=24, burn_in=4)).collect()}
    for k, x in rows[:6]:
        t = [w or b"" for w in tokens(x)]
        assert got[k] == pytest.approx(sum(math.log10(want[p]) for p in zip([b"^", *t], t)), rel=0.02)


def test_chances_of_a_context_sum_to_one():
    """Over all words and one unknown, in any state."""
    s, rng = lm.Settings(), np.random.default_rng(0)
    key = np.unique(rng.integers(0, 7 * 80, 300))
    u, w = key // 80, key % 80
    c = rng.integers(1, 300, key.size)
    t = lm.sweep_contexts(c, np.minimum(c, 1), u, np.full(key.size, 1 / 80), np.zeros(7), s, rng)
    assert (t >= 1).all() and (t <= c).all()
    dish = np.bincount(w, t, minlength=80).astype(np.int64)
    tables = lm.draw_tables(dish, np.full(80, 79.0), np.full(80, 1 / 81), s.root_strength, s.root_discount, rng)
    unknown = (s.root_strength + s.root_discount * tables.sum()) / 81
    root = np.append(dish - s.root_discount * tables + unknown, unknown) / (s.root_strength + dish.sum())
    for k in range(7):
        mine = u == k
        left = np.append(np.bincount(w[mine], c[mine] - s.discount * t[mine], minlength=80), 0.0)
        chance = (left + (s.strength + s.discount * t[mine].sum()) * root) / (s.strength + c[mine].sum())
        assert chance.sum() == pytest.approx(1.0) and (chance > 0).all()


def test_a_context_over_many_buckets_is_one_restaurant(spark):
    """A hot context, a third of its rows on one pair, scores as it does when seated in one bucket."""
    rng = np.random.default_rng(6)
    follow = ["heavy"] * 4000 + [f"v{k}" for k in rng.zipf(1.3, 8000) % 1500]
    rows = [(k, " ".join(f"hot {w}" for w in follow[k::100])) for k in range(1000) if not held(k)][:100]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    one, many = ({r.doc_id: r.score for r in lm.score(df, lm.Settings(spread=n)).collect()} for n in (1, 64))
    assert all(many[k] == pytest.approx(one[k], rel=0.01) for k in one)


def test_empty_and_all_held_out(spark):
    schema = "doc_id long, text string"
    assert lm.score(spark.createDataFrame([], schema)).count() == 0
    i = next(k for k in range(100) if held(k))
    r = lm.score(spark.createDataFrame([(i, "a b")], schema)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score <= 0.0


def test_stirling_and_draws():
    d = 0.4
    s = lm.stirling(d, np.array([3, 4]))
    # S(3, 1) = (1 - d)(2 - d), S(3, 2) = 3(1 - d), S(3, 3) = 1
    assert np.exp(s[3]) == pytest.approx([(1 - d) * (2 - d), 3 * (1 - d), 1.0])
    rng = np.random.default_rng(1)
    n, parent, strength, others = 40_000, 0.3, 1.5, 2.0
    t = lm.draw_tables(np.full(n, 4), np.full(n, others), np.full(n, parent), strength, d, rng)
    opening = np.cumprod((strength + d * (others + np.arange(4))) * parent)
    w = np.exp(s[4]) * opening
    assert np.bincount(t, minlength=5)[1:] / n == pytest.approx(w / w.sum(), abs=0.01)


@pytest.mark.parametrize("parent, others", [(0.3, 5.0), (0.01, 400.0), (0.0005, 3000.0), (0.2, 4000.0)])
def test_large_dishes_follow_the_conditional(monkeypatch, parent, others):
    """The limit form beyond EXACT customers gives the mean that the tabulated conditional gives."""
    rng, d, c, n = np.random.default_rng(2), 0.8, 4000, 4000
    args = np.full(n, c), np.full(n, others), np.full(n, parent), 1.0, d, rng
    limit = lm.draw_tables(*args).mean()
    monkeypatch.setattr(lm, "EXACT", c)
    assert limit == pytest.approx(lm.draw_tables(*args).mean(), rel=0.05)


def test_packets_round_trip():
    x = np.array([0, 1, 70_000, 2**32 - 1], np.uint32)
    assert lm.unpack(lm.pack(x), np.uint32).tolist() == x.tolist()
    assert lm.unpack(lm.pack(x[:0]), np.uint32).size == 0
    assert lm.unpack_sorted(lm.pack_sorted(x)).tolist() == x.tolist()

import hashlib
import random

import pytest

from lakeproof.llm import lzprint


def phrases(data):
    seen, now = set(), b""
    for c in data:
        now += bytes([c])
        if now not in seen:
            seen.add(now)
            now = b""
    return seen


def plain_edit(texts, k):
    t, nxt = texts[k], texts[(k + 1) % len(texts)]
    half = len(t) // 2
    return t[: len(t) - half] + nxt[:half]


def random_text(rng, n):
    return " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_rows_match_a_plain_version(spark):
    rng = random.Random(2)
    texts = [random_text(rng, rng.choice([1, 5, 60, 300])) for _ in range(60)] + ["", "a", "日本🙂", "x" * 100_000]
    texts[10] = texts[30]
    rows = [(k * 3, t if k != 60 else None, "c") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in lzprint.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)).collect()}
    assert sorted(got) == [k * 3 for k in range(len(texts))]
    gaps = []
    for k, t in enumerate(texts):
        r, e, nxt = got[k * 3], plain_edit(texts, k), texts[(k + 1) % len(texts)]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        for other, near in ((e, r.near_edited), (nxt, r.near_next)):
            a, b = phrases(t.encode()), phrases(other.encode())
            if len(a | b) < 50:  # a few phrases fill few bins
                continue
            gaps.append(abs(near - len(a & b) / len(a | b)))
    assert got[30].fingerprint == got[90].fingerprint and got[0].fingerprint != got[3].fingerprint
    assert sum(gaps) / len(gaps) < 0.07 and max(gaps) < 0.3


@pytest.mark.parametrize("rows", [[], [(1, "only one text here")], [(None, "n"), (5, "a b"), (5, "a b"), (5, "c"), (6, None)]])
def test_small_tables(spark, rows):
    got = lzprint.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in got)) == sorted(((i is None, i or 0) for i, _ in rows))
    if len(rows) == 1:
        assert got[0].near_next == 1.0


def test_parse_continues_and_copies():
    data = random_text(random.Random(1), 400).encode()
    whole = lzprint.Parser().feed(data)
    parts = lzprint.Parser().feed(data[:333])
    assert parts.copy().feed(data[333:]).ends == whole.ends and parts.size == 333
    starts = [0, *whole.ends[:-1]]
    found = [data[a:b] for a, b in zip(starts, whole.ends)]
    assert set(found) == phrases(data) and len(found) == len(set(found))
    h = lzprint.phrase_hashes(data, whole.ends)
    assert len(set(h.tolist())) == len(found)

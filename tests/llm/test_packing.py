import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lakeproof.llm import packing
from lakeproof.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(plain):
    e = Encoder(PATH)
    odd = ["", " ", "\n", "  a  b\n\n c", "\x1c a\x1d", "it's  'll x y\t\tz ", "<|endoftext|> a²½ b_c １２", "a\x85b c　d  ", "日本語\r\n\r\n x", "x" * 5000, "🙂 é"]
    texts = odd + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    for x in texts + odd:
        assert e.encode(x).tolist() == plain(x), x[:50]


def test_round_trip(spark, plain):
    rng = random.Random(0)
    texts = [None, "", "a"] + [" ".join(rng.choice(["tion", "the", "Ünder", "x1"]) for _ in range(rng.randrange(1, 3000))) for _ in range(40)] + ["a"]
    rows = [(k if k else None, t, "x") for k, t in enumerate(texts)] + [(2, "a", "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3), PATH).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for k, t in enumerate(texts):
        ids = np.array([*plain(t), 0], "<u4")
        mine = sorted(pieces[k if k else None], key=lambda r: r.start)
        if k == 2:  # the repeated row is packed twice
            assert len(mine) == 2
            continue
        at = 0
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in windows.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_levels_follow_the_rule(seed):
    """Every placement is one of the least sums of squares."""
    rng, p, window = random.Random(seed), packing.LevelPacker(32), 32
    fill = {}
    for _ in range(400):
        size = rng.randint(1, 31)
        levels = defaultdict(int)
        for f in fill.values():
            levels[f] += f < window
        cost = lambda lv: sum(n * n for h, n in lv.items() if 0 < h < window)
        options = []
        for h in [0, *[h for h in levels if levels[h] and h + size <= window]]:
            after = dict(levels)
            if h:
                after[h] -= 1
            after[h + size] = after.get(h + size, 0) + 1
            options.append(cost(after))
        at, level, full = p.place(size)
        assert fill.get(at, 0) == level and full == (level + size == window)
        fill[at] = level + size
        now = defaultdict(int)
        for f in fill.values():
            now[f] += f < window
        assert cost(now) == min(options)
        assert [int(x) for x in p.counts[1:window]] == [now[h] for h in range(1, window)]


def test_open_windows_keep_their_placements():
    """Of the tails' tokens the flush moves few; sequences are gapless, whole or a power of two, and every id lies in one piece."""
    rng, p = np.random.default_rng(1), packing.Packing()
    rows, tails = [], 0
    for d in range(1250):
        n = int(rng.lognormal(6, 1)) + 1
        tails += n % 1024
        rows += list(p.add(d, np.arange(n).astype("<u4")))
    held = {(q[0], q[1], len(q[2]), at) for at, parts in p.held.items() for q in parts}
    flushed = list(p.flush())
    kept = sum(r[2] for r in flushed if (r[0], r[1], r[2], r[5]) in held)
    assert sum(r[2] for r in flushed) - kept < 0.08 * tails
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows + flushed:
        pieces[r[0]].append((r[1], r[2], r[4]))
        sequences[r[5]].append((r[6], r[2]))
        assert r[3] == zlib.crc32(np.arange(r[1], r[1] + r[2]).astype("<u4").tobytes())
    for parts, whole in [*((v, v[0][2]) for v in pieces.values()), *((v, 0) for v in sequences.values())]:
        at = 0
        for start, length, *_ in sorted(parts):
            assert start == at
            at += length
        assert at == whole if whole else at == 1024 or at & (at - 1) == 0

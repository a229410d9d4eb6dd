import base64
import gzip
import hashlib
import io
import random

import pytest

from lakeproof.llm import warc
from lakeproof.llm.common import scratch


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and i != f
        out.append((i, len(b), sha(b), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


ROWS = [(k, f"http://x/{k}", h) for k, h in enumerate(["a" * 5000, None, "", "ünï \x1f\x8b\x08 x" * 50, "b", "a" * 5000, "b", "", "WARC/1.1\r\n\r\n" * 40])]
ROWS += [(None, "u", "b"), (4, "dup\r\nX: y", "b"), (9, None, "solo"), (-3, "n", "solo"), (20, "long", "z" * 3_000_000)]


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, split, least):
    rng = random.Random(1)
    rows = ROWS + [(100 + k, "r", base64.b64encode(rng.randbytes(2000)).decode()) for k in range(20)]
    if split == 37:
        rows = [r for r in rows if r[0] != 20]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, path string").repartition(3)
    manifest = warc.write(df, scratch(spark, "warc"), least)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.digests(warc.read(manifest, split)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, least)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(spark, df).count() == 0


def test_archives_are_plain_gzip_members(spark):
    raw = b"".join(warc.encode_record("response", k, "u", b"x" * k, sha(b"x" * k), None) for k in range(3))
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 3


def test_damage_and_false_magic_are_passed_over():
    good = [warc.encode_record("response", k, "u", b"payload %d" % k, sha(b"payload %d" % k), None) for k in range(4)]
    other = gzip.compress(b"not an archive")
    torn = good[2][: len(good[2]) // 2]
    data = good[0] + b"junk" + warc.MAGIC + good[1] + other + torn + good[3]
    for step in (1, 13, len(data)):
        found = []
        for start in range(0, len(data), step):
            found += [body for _, _, body in warc.read_range(io.BytesIO(data), len(data), start, min(len(data), start + step))]
        assert found == [b"payload 0", b"payload 1", b"payload 3"]


def test_a_very_long_url_loses_no_page(spark):
    import random

    url = "http://h/" + "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=5 << 20))
    df = spark.createDataFrame([(1, url, "x"), (2, "http://h/", "y"), (3, url[:200_000], "x")], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_and_read(spark, df).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1)}

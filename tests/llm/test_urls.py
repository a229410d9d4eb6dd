import random
import re
from collections import Counter, defaultdict

import pytest

from lakeproof.llm import urls

LINK = re.compile(urls.LINK)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^/?#]*([^?#]*)", rest)[1]


def rule(host, path):
    best = None
    for verdict, r in urls.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
            best = (r, verdict)
    return best or (None, None)


def plain(pages, p=urls.Propagation()):
    rows, links, seeds = [], Counter(), {"trust": Counter(), "distrust": Counter()}
    for i, url, html in pages:
        host, path = split(url)
        r, v = rule(host, path)
        rows.append((i, host, path, r, v))
        if v:
            seeds["trust" if v == "allow" else "distrust"][host] += 1
        for dst in {m[1].lower() for m in LINK.findall(html or "")}:
            if host and dst and dst != host:
                links[host, dst] += 1
    score = {}
    for kind, pairs in (("trust", links), ("distrust", Counter({(b, a): n for (a, b), n in links.items()}))):
        out = Counter()
        for (a, _), n in pairs.items():
            out[a] += n
        mass = {h: n / sum(seeds[kind].values()) for h, n in seeds[kind].items()}
        now = {h: (1 - p.damping) * m for h, m in mass.items()}
        for _ in range(p.rounds):
            after = defaultdict(float, {h: (1 - p.damping) * m for h, m in mass.items()})
            for (a, b), n in pairs.items():
                after[b] += p.damping * now.get(a, 0.0) * n / out[a]
            now = after
        score[kind] = now
    out = []
    for i, host, path, r, v in rows:
        t, d = (round(score[k].get(host, 0.0), 12) for k in ("trust", "distrust"))
        out.append((i, host, path, r, v or ("block" if d > t else "allow")))
    return sorted(out, key=str)


@pytest.mark.parametrize("linked", [True, False])
def test_judgement_matches_a_plain_version(spark, linked):
    rng = random.Random(5)
    hosts = [f"h{i}.example.{t}" for i in range(8) for t in ("org", "com", "net")] + ["example.org", "EXAMPLE.com", "notexample.org", "org"]
    pages = []
    for i in range(300):
        url = f"http://{rng.choice(hosts)}{rng.choice(['', '/'])}{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.randint(1, 30)}{rng.choice(['', '?a=://x', '#t'])}"
        url = {7: None, 8: "mailto:x", 9: "://", 10: "http://a?b/c"}.get(i % 40, url)
        html = "".join(f"<a HREF='https://{rng.choice(hosts)}/x'>q</a><a href=//{rng.choice(hosts)}>" for _ in range(rng.randint(0, 3))) if linked else '<a href="/x">'
        pages.append((i if i % 50 else None, url, html if i % 31 else None))
    pages += pages[:3]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, src string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df.repartition(3)).collect()]
    assert sorted(got, key=str) == plain(pages)
    assert not linked or {v for *_, r, v in got if r is None} == {"allow", "block"}


def test_distrust_reaches_far_and_weak(spark):
    """A chain of 12 links to a blocked host, and hosts three links from one blocked page among 100,000, each of many linkers."""
    link = lambda *hosts: "".join(f"<a href='//{h}/'>" for h in hosts)
    pages = [("http://b.com/de/1", None)] + [(f"http://c{k}.net/", link("b.com" if k == 0 else f"c{k - 1}.net")) for k in range(12)]
    weak = [("http://w.com/de/1", None)] + [(f"http://x{k}.net/", link("w.com")) for k in range(1000)] + [(f"http://y{k}.net/", link("x0.net")) for k in range(1000)] + [(f"http://z{k}.net/", link("y0.net")) for k in range(1000)]
    pages += weak + [("http://far.net/", link("nowhere.net"))]
    many = spark.range(100_000).selectExpr("id as page_id", "'http://seed.com/de/1' as url", "cast(null as string) as html")
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string").unionByName(many)
    got = {r.host: r.verdict for r in urls.judge(df).filter("host <> 'seed.com'").collect()}
    assert {h for h, v in got.items() if v == "allow"} == {"far.net"}


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

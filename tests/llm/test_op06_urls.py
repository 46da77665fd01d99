import random
import re

import duckdb
import pandas as pd
import pytest
from llm_data import lower

from review_trust.llm import urls

PAGES = "page_id bigint, url string, html string, src string, trust string"


def judged(spark, rows):
    return urls.judge(spark.createDataFrame([(*r, "s", "t") for r in rows], PAGES))


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fits = [
        r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])
    ]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [
    None, "", "x", "://", "http://", "http://ORG", "http://org/", "https://a.EXAMPLE.org/es/x?y#z", "http://example.org/en/1",
    "http://example.org/en/2", "http://badexample.org/es/", "http://a.com/fr/", "http://a.com/de/1", "http://com/fr/q",
    "http://a.net?x=/fr/", "http://a.b://c.org/", "http://É.com/de/", "http://a.org#/es/", "http://a.com\n/fr/",
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(3, URLS[7], ""), (None, URLS[11], "x")]
    got = judged(spark, rows).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[11] if r.page_id is None else URLS[r.page_id]
        if r.page_id == 3 and r.host:
            url = URLS[7] if "example" in r.host else url
        host, path, rule, verdict = brute_rule(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_trust_and_distrust_follow_links(spark):
    link = '<a href="http://%s/x">x</a>'
    rows = [
        (1, "http://good.com/fr/", link % "friend.net"),
        (2, "http://bad.com/de/", ""),
        (3, "http://promoter.net/", link % "BAD.com" + link % "also-bad.com"),
        (4, "http://friend.net/", link % "neutral.net"),
        (5, "http://neutral.net/", ""),
        (6, "http://www.promoter.net/", ""),
        (7, "http://also-bad.com/de/", None),
        (8, "http://alone.net/", '<a href="/local">x</a>'),
    ]
    verdict = {r.page_id: r for r in judged(spark, rows).collect()}
    assert [verdict[i].verdict for i in range(1, 9)] == [
        "allow", "block", "block", "allow", "allow", "block", "block", "allow",
    ]
    assert verdict[4].trust > verdict[5].trust > 0 and verdict[3].distrust > 0 and verdict[6].distrust > 0


def brute_converged(edges, seeds):
    """Trust and distrust by dense iteration until nothing changes any more."""
    hosts = sorted({h for e in edges for h in e} | {h for s in seeds.values() for h in s})
    value = {}
    for kind, seed in seeds.items():
        way = edges if kind == "trust" else [(y, x) for x, y in edges]
        out = {h: sum(x == h for x, _ in way) for h in hosts}
        value[kind] = dict.fromkeys(hosts, 0.0)
        for _ in range(400):
            gain = {h: sum(value[kind][x] / out[x] for x, y in way if y == h) for h in hosts}
            value[kind] = {h: 0.15 * seed.get(h, 0) + 0.85 * gain[h] for h in hosts}
    return value


def converged(spark, edges, seeds, **options):
    hosts = sorted({h for s in seeds.values() for h in s})
    table = [(h, seeds["trust"].get(h, 0.0), seeds["distrust"].get(h, 0.0)) for h in hosts]
    seeds = spark.createDataFrame(table, "host string, trust double, distrust double")
    return urls.converged(spark.createDataFrame(edges, "src string, dst string"), seeds, **options)


def test_converged_ranks_equal_brute_force(spark):
    chain = [(f"h{i}", f"h{i + 1}") for i in range(9)]
    loop = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a"), ("c", "d")]
    edges, seeds = chain + loop, {"trust": {"h0": 1.0, "a": 1.0, "d": 0.25}, "distrust": {"h9": 1.0, "c": 0.5}}
    want = brute_converged(edges, seeds)
    got = {r.host: r for r in converged(spark, edges, seeds).collect()}
    assert got.keys() == want["trust"].keys()
    for h, r in got.items():
        assert (r.trust, r.distrust) == pytest.approx((want["trust"][h], want["distrust"][h]), abs=6e-6)
    assert got["h2"].distrust == pytest.approx(0.15 * 0.85**7)
    with pytest.raises(RuntimeError):
        converged(spark, edges, seeds, limit=3)


def test_distrust_reaches_the_end_of_a_chain(spark):
    link = '<a href="http://%s/x">x</a>'
    rows = [(i, f"http://h{i}.net/", link % f"h{i + 1}.net") for i in range(9)]
    rows.append((9, "http://h9.net/", link % "bad.com"))
    rows += [(10, "http://bad.com/de/", None), (11, "http://good.com/fr/", link % "h4.net")]
    got = {r.page_id: r for r in judged(spark, rows).collect()}
    # Half of what h4 passes on goes to good.com, which links to it as well.
    want = [0.15 * 0.85 ** (10 - i) / (2 if i < 4 else 1) for i in range(10)]
    assert [got[i].distrust for i in range(10)] == pytest.approx(want)
    # Six links from the blocked host and one from the allowed one: 0.0566 of distrust, 0.1275 of trust.
    assert got[4].trust == pytest.approx(0.1275) and got[4].verdict == "allow"
    assert [got[i].verdict for i in range(4)] == ["block"] * 4


def test_the_nearest_host_above_is_tied(spark):
    hosts = ["b.com", "x.a.b.com", "y.a.b.com", "z.x.a.b.com", "c.org", "b.com.net", ".".join(["l"] * 130) + ".b.com"]
    pages = spark.createDataFrame([(h, "") for h in hosts], "host string, html string")
    got = {(r.src, r.dst) for r in urls.host_edges(pages).collect()}
    below = {("x.a.b.com", "b.com"), ("y.a.b.com", "b.com"), ("z.x.a.b.com", "x.a.b.com")}
    assert got == below | {(y, x) for x, y in below}


@pytest.mark.parametrize("seed", [1, 2])
def test_sql_on_planted_links(spark, seed):
    """Chains of ten hosts to a blocked and from an allowed host, and random links below them."""
    rng = random.Random(seed)
    names = [f"h{i}.net" for i in range(10)] + [f"g{i}.net" for i in range(10)] + [f"s{i}.u.h{i}.net" for i in range(5)]
    names += [f"r{i}.info" for i in range(30)]
    goes = {n: [] for n in names}
    for i in range(10):
        goes[f"h{i}.net"].append(f"h{i + 1}.net" if i < 9 else "bad.com")
        goes[f"g{i}.net"].append(f"g{i + 1}.net" if i < 9 else "far.net")
    for i in range(30):
        goes[f"r{i}.info"] += rng.sample([*names, "bad.com", "good.com"], rng.randrange(4))
    goes |= {"good.com/fr": ["g0.net", "r1.info"], "bad.com/de": ["r2.info"]}
    rows = [
        (i, f"http://{n}/{i}", "".join(f'<a HREF="//{x.upper()}/q">x</a>' for x in to)) for i, (n, to) in enumerate(goes.items())
    ]
    rows += [(900 + i, u, None) for i, u in enumerate(URLS)]
    with duckdb.connect() as con:
        con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
        want = sorted(con.sql(urls.SQL).fetchall(), key=str)
    got = judged(spark, rows).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == want
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_empty_table(spark):
    assert judged(spark, []).count() == 0

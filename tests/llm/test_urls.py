"""URL filters: parsing, rules, and trust that spreads over links."""

import random

import pytest

from tagwright.llm import urls
from tagwright.llm.urls import Rule


def judge(spark, pages, **options):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r for r in urls.filtered(frame, **options).collect()}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.ORG/en/1x?q#f", "a.example.org", "/en/1x", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("https://www.example.org/es/", "www.example.org", "/es/", "example.org/es/", "block"),
        ("ftp://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        ("x.com/de/1", "", "", None, "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("http://org?x=/", "org", "", None, "allow"),
        ("http://org/?x=/", "org", "/", "org/", "allow"),
        ("http://ÄB.net/a://b", "Äb.net", "/a://b", None, "allow"),
        ("://h#/p", "h", "", None, "allow"),
        ("http://h\n.net/a\nb", "h\n.net", "/a\nb", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_parse_and_rules(spark, url, host, path, rule, verdict):
    row = judge(spark, [(1, url, None)])[1]
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def link(*targets):
    return "".join(f'<a href="{t}">x</a>' for t in targets)


def test_links_between_hosts(spark):
    html = link("/in", "http://B.net/x", "https://b.net/y", "//c.net", "mailto:x@y", "http://a.net/own", "x?u=http://d.net") + " HREF = e.net <a href='ftp://f.net'>"
    frame = spark.createDataFrame([(1, "http://a.net/", html), (2, None, link("http://b.net"))], "page_id long, url string, html string")
    got = {(r.source, r.target): r.links for r in urls.host_links(frame).collect()}
    assert got == {("a.net", "b.net"): 2, ("a.net", "c.net"): 1, ("a.net", "f.net"): 1}


RULES = (Rule.read("allow", "good.net/"), Rule.read("block", "bad.net/"))
PAGES = [
    (1, "http://good.net/", link("http://friend.net/", "http://mixed.net/")),
    (2, "http://friend.net/", link("http://far.net/")),
    (3, "http://far.net/", None),
    (4, "http://bad.net/", link("http://victim.net/")),
    (5, "http://farm.net/", link("http://bad.net/")),
    (6, "http://feeder.net/", link("http://farm.net/")),
    (7, "http://victim.net/", ""),
    (8, "http://mixed.net/", link("http://bad.net/", "http://good.net/", "http://far.net/")),
    (9, "http://alone.net/", link("/x")),
    (None, "http://farm.net/again", None),
]


def power_iteration(links, trust, distrust, rounds):
    hosts = {h for pair in links for h in pair} | set(trust) | set(distrust)
    t, d = ({h: s.get(h, 0.0) for h in hosts} for s in (trust, distrust))
    for _ in range(rounds):
        nt, nd = {h: 0.15 * trust.get(h, 0.0) for h in hosts}, {h: 0.15 * distrust.get(h, 0.0) for h in hosts}
        for (a, b), n in links.items():
            nt[b] += 0.85 * t[a] * n / sum(m for (x, _), m in links.items() if x == a)
            nd[a] += 0.85 * d[b] * n / sum(m for (_, y), m in links.items() if y == b)
        t, d = nt, nd
    return t, d


def test_trust_and_distrust(spark):
    got = judge(spark, PAGES, rules=RULES, tolerance=1e-4)
    links = {
        ("good.net", "friend.net"): 1, ("good.net", "mixed.net"): 1, ("friend.net", "far.net"): 1, ("bad.net", "victim.net"): 1,
        ("farm.net", "bad.net"): 1, ("feeder.net", "farm.net"): 1, ("mixed.net", "bad.net"): 1, ("mixed.net", "good.net"): 1,
        ("mixed.net", "far.net"): 1,
    }
    t, d = power_iteration(links, {"good.net": 1.0}, {"bad.net": 1.0}, 300)
    for row in got.values():
        assert row.trust == pytest.approx(t.get(row.host, 0.0), abs=1e-3) and row.distrust == pytest.approx(d.get(row.host, 0.0), abs=1e-3)
    verdicts = {row.page_id: row.verdict for row in got.values()}
    assert verdicts[2] == verdicts[3] == verdicts[7] == verdicts[9] == "allow"
    assert verdicts[4] == verdicts[5] == verdicts[6] == verdicts[None] == "block"


def test_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string, host string, verdict int")
    assert urls.digest(frame).collect() == []
    frame = spark.createDataFrame([(1, "http://a.org/", None, "x", 1)], frame.schema)
    assert tuple(urls.digest(frame).first()) == (1, "a.org", "/", "org/", "allow")


def test_no_rules_allow_all(spark):
    assert {r.verdict for r in judge(spark, PAGES, rules=()).values()} == {"allow"}


def chain(n):
    """Hosts that each link to the next one, the last of them to a blocked host."""
    pages = [(i, f"http://h{i}.net/", link(f"http://h{i + 1}.net/")) for i in range(n)]
    return [*pages, (n, f"http://h{n}.net/", link("http://bad.com/")), (n + 1, "http://bad.com/de/", None)]


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    got = judge(spark, chain(30))
    assert {r.verdict for r in got.values()} == {"block"}
    assert got[0].distrust == pytest.approx(0.15 * 0.85**31, rel=1e-3)


def test_cycles_settle(spark):
    pages = [(1, "http://a.org/", link("http://b.net")), (2, "http://b.net/", link("http://a.org"))]
    got = judge(spark, pages, tolerance=1e-4)
    t, _ = power_iteration({("a.org", "b.net"): 1, ("b.net", "a.org"): 1}, {"a.org": 1.0}, {}, 500)
    assert got[1].trust == pytest.approx(t["a.org"], abs=1e-3) and got[2].trust == pytest.approx(t["b.net"], abs=1e-3)
    assert urls.most_rounds(1e-9) > urls.most_rounds() > 50
    for wrong in ({"tolerance": 0.0}, {"damping": 1.0}):
        with pytest.raises(ValueError):
            urls.most_rounds(**wrong)


def test_equals_sql_on_linked_hosts(spark):
    import duckdb
    import pandas as pd

    ends = ["org/", "com/fr/", "com/de/", "net/", "edu/x"]
    draw = random.Random(5)
    names = [f"http://h{i}.{draw.choice(ends)}" for i in range(60)]
    rows = [(i, draw.choice(names), link(*draw.choices(names, k=draw.randrange(4)))) for i in range(300)]
    rows += [(1000 + i, u, h) for i, u, h in chain(20)]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841 (duckdb reads it)
    want = sorted(duckdb.sql(urls.sql()).fetchall())
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, urls.digest(frame).collect())) == want
    by_seed = sum(r[4] == "block" and r[3] is None for r in want)
    assert by_seed > 30

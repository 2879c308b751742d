"""Verdicts against plain rules and a plain PageRank."""

from __future__ import annotations

from collections import defaultdict

from sigtrail.llm.urls import Rule, judge

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
PAGES = "page_id long, url string, html string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at], rest[at:]
    cut = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in host), path[:cut]


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name()), default=None)


def plain_rank(edges, seeds, rounds=30):
    rank = dict(seeds)
    for _ in range(rounds):
        new = defaultdict(float)
        for a, r in rank.items():
            total = sum(edges.get(a, {}).values())
            for b, w in edges.get(a, {}).items():
                new[b] += 0.85 * r * w / total
        kept = sum(new.values())
        for h, s in seeds.items():
            new[h] += s * (1 - kept / sum(seeds.values()))
        rank = dict(new)
    return rank


def test_parts_and_rules(spark):
    urls = ["http://A.Example.net/en/x?q=1", "https://example.net/de", "ftp://net", "http://net/", "http://x.org/fr/#a", "http://x.org/fr", "http://ÉX.com/de/?://z", "http://example.com/de/1", "notexample.com/de/", None, "", "a://b://c/", "http://myexample.com/de/", "http://x.com?u=/de/", "HTTP://Example.COM/de//\nb"]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(None, urls[0], "<a href='//x.y'>"), (0, urls[0], None)]
    table = spark.createDataFrame([(*r, "mine") for r in rows], PAGES + ", host string")
    got = judge(table, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = plain_parts(r.url)
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name()), r.url
        if rule:
            assert r.verdict == rule.verdict
    assert judge(spark.createDataFrame([], PAGES), RULES).count() == 0


def test_trust_and_distrust_spread_over_links(spark):
    link = lambda *hosts: "".join(f'<p><a class="x" href="https://{h}/p?q">t</a><a href="/local">l</a>' for h in hosts)
    rows = [
        (1, "http://good.org/fr/1", link("friend.io", "friend.io", "shop.io")), (2, "http://friend.io/", link("shop.io")),
        (3, "http://farm.io/1", link("bad.net")), (4, "http://farm.io/2", link("bad.net", "worse.net")), (5, "http://bad.net/", link("friend.io")),
        (6, "http://worse.net/a", None), (7, "http://quiet.io/", ""), (8, "http://feeder.io/", link("farm.io", "FARM.io")),
    ]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, PAGES), RULES, rounds=30, least_change=0.0).collect()}
    edges = {"good.org": {"friend.io": 1, "shop.io": 1}, "friend.io": {"shop.io": 1}, "farm.io": {"bad.net": 2, "worse.net": 1}, "bad.net": {"friend.io": 1}, "feeder.io": {"farm.io": 1}}
    back = defaultdict(dict)
    for a, own in edges.items():
        for b, w in own.items():
            back[b][a] = w
    trust, distrust = plain_rank(edges, {"good.org": 1.0}), plain_rank(back, {"bad.net": 1.0, "worse.net": 1.0})
    for r in got.values():
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-9 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-9
        if r.rule is None:
            assert r.verdict == ("block" if distrust.get(r.host, 0) - trust.get(r.host, 0) > 0.5 else "allow")
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "block"}


def test_one_blocked_host_blocks_all_that_only_link_to_it(spark):
    link = lambda *hosts: "".join(f"<a href='//{h}/'>" for h in hosts)
    for n in (1, 5):
        rows = [(0, "http://bad.net/", None), (90, "http://good.org/fr/", link("both.io")), (91, "http://both.io/", link("bad.net")), (92, "http://quiet.io/", None), (93, "http://fan.io/", link("good.org"))]
        rows += [(i, f"http://l{i}.io/", link("bad.net")) for i in range(1, n + 1)]
        rows += [(100 + i, f"http://example.com/{'de' if i < 3 else 'en'}/{i}", None) for i in range(10)] + [(120, "http://reader.io/", link("example.com"))]
        got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, PAGES), RULES).collect()}
        assert {i: got[i] for i in range(n + 1)} == dict.fromkeys(range(n + 1), "block")
        assert {i for i, v in got.items() if v == "block"} == {*range(n + 1), 100, 101, 102}


def test_links_to_a_mostly_blocked_host_keep_its_other_pages_blocked(spark):
    rows = [(i, f"http://example.com/{'de' if i < 8 else 'en'}/{i}", None) for i in range(10)] + [(10 + i, f"http://l{i}.io/", "<a href='//example.com/'>") for i in range(3)]
    assert {r.verdict for r in judge(spark.createDataFrame(rows, PAGES), RULES).collect()} == {"block"}

"""Wrappers on small streams, and main text of pages of known shape."""

from __future__ import annotations

import random
import re
import time

import pytest

from sigtrail.llm.extraction import Item, Slot, _common, align, article_region, extract, main_slots, read_page

PAGES = "page_id long, url string, html string, text string"


def items(page):
    out, at = [], 0
    for symbol in read_page(page).stream:
        n = str(symbol).count("'#'") if isinstance(symbol, tuple) else int(symbol == "#")
        out.append(Item(symbol, False, [Slot(1, k, k, 5, 0) for k in range(at, at + n)]))
        at += n
    return out


def test_repeats_become_groups_and_rare_parts_optional():
    one = items("<body><ul><li>a</li><li>b</li></ul><p>x</p></body>")
    two = items("<body><ul><li>a</li></ul><div>new</div><p>y</p></body>")
    assert ("+", ("li", "#", "/li")) in [x.symbol for x in one]
    both = align(one, two)
    assert [x.symbol for x in both] == ["body", "ul", ("+", ("li", "#", "/li")), "/ul", "div", "#", "/div", "p", "#", "/p", "/body"]
    assert [x.symbol for x in both if x.optional] == ["div", "#", "/div"]
    assert align(both, one) == align(align(one, two), one)


def test_slots_without_an_article_must_change():
    same, new = Slot(9, 1, 1, 50, 0), Slot(9, 1, 2, 50, 0)
    wrapper = [Item("body", False, []), Item("p", False, []), Item("#", False, [same]), Item("/p", False, []), Item("p", False, []), Item("#", False, [new]), Item("/p", False, [])]
    assert main_slots(wrapper, wrapper) == [1]


def page(rng, number, article=True):
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "d&eacute;j&agrave;", "&lt;b&gt;"]) for _ in range(n))
    plain = lambda s: s.replace("&eacute;", "é").replace("&agrave;", "à").replace("&lt;", "<").replace("&gt;", ">")
    blocks = [words(rng.randint(1, 9)) for _ in range(rng.randint(1, 6))]
    menu = "".join(f"<li><a href='/{i}'>entry {words(1)}</a>" for i in range(rng.randint(2, 5)))
    body = "".join(f"<p>\n {b[:4]}<b>{b[4:]}</b><br> </p>" for b in blocks)
    side = f"<aside><h2>More</h2><p>{words(3)}</p></aside><div class='cookie-notice'>We use cookies {words(2)}</div><form><p>Sign up</p></form>"
    comments = f"<div id=comments><p>{words(4)}</p></div>"
    inner = f"<article><h1>Title {number}</h1>{body}</article>" if article else f"<div><h1>Title {number}</h1>{body}</div>"
    html = f"<!DOCTYPE html><html><head><title>t {number}</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><header><p>Site</p></header><nav><ul>{menu}</ul></nav><!-- <p>c</p> --><div class='ad'>{words(3)}</div>{inner}{side}{comments}<footer>(c) {words(2)}"
    return html + rng.choice(["", "</footer></body></html>"]), "\n\n".join([f"Title {number}", *[plain(b) for b in blocks]])


def test_main_text_of_many_pages(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(90):
        html, text = page(rng, i, article=i % 3 != 0)
        host = "plain.example" if i % 3 == 0 else f"h{i % 2}.example"
        rows.append((i, f"http://{host}/{i}", html, "mine"))
        want[i] = text
    rows += [(200, None, None, None), (201, "http://x/", "", None), (202, "nourl", "<p>unclosed <b>text", None), (203, "http://h1.example/z", "<<<>>> <div cla", None), (204, "http://h1.example/y", "<article><p>" + "long " * 50_000, None), (1, rows[1][1], rows[1][2], None)]
    got = extract(spark.createDataFrame(rows, PAGES), per_task=3).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert {i: texts[i] for i in want} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert texts[200] == texts[201] == "" and texts[204] == ("long " * 50_000).strip()
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


def test_templates_with_and_without_an_article_share_a_host(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(24):
        html, text = page(rng, i, article=i % 2 == 0)
        rows.append((i, ["http://mixed.example/a", None, "no host"][i % 3], html, None))
        want[i] = text
    got = extract(spark.createDataFrame(rows, PAGES), per_task=3).collect()
    assert {r.page_id: r.text for r in got} == want


def test_copies_of_a_page_are_no_boilerplate(spark):
    shape = "<body><div><p>Read our terms</p></div><div><h2>{0}</h2><p>{0} text</p></div><footer><p>seen {1}</p></footer></body>"
    rows = [(i, "http://copies.example/", shape.format("One", i), None) for i in range(5)]
    rows += [(10 + i, "http://more.example/", shape.format("Two", i), None) for i in range(3)] + [(20, "http://more.example/", shape.format("Three", 0), None)]
    rows += [(30, "http://twice.example/", "<p>a</p><p>a</p>", None)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert {got[i] for i in range(5)} == {"Read our terms\n\nOne\n\nOne text"}
    assert {got[10 + i] for i in range(3)} == {"Two\n\nTwo text"} and got[20] == "Three\n\nThree text" and got[30] == "a\n\na"


def test_nothing_takes_the_rest_or_the_whole_of_a_page(spark):
    bodies = [
        "<article><p>one</p><svg class='a'/><p>two</p><svg><text>no</text></svg><math /><p>three</p></article>",
        "<article><p>one</p><button>two<p>three</p><button>no</button></article>",
        "<article><p>one</p><object data=http://x/>no<object>no</object></object><iframe src='x'><p>two</p><select><p>three</p></article>",
        "<div id='page' class='has-header'><article class='post comments-open'><p>one</p><p>two</p><p>three</p></article><div class='related'><article><p>no</p></article></div></div>",
        "<form id='form'><main class='no-sidebar'><p>one</p><p>two</p><p>three</p></main><aside><p>no</p></aside></form>",
        "<p>skip</p><div id='page' class='has-header'><p>one is long</p><p>two is long</p><p>three is long</p><div class='sidebar'><p>no</p></div></div>",
        "<div class='no-menu'><div class='menu'><p>no</p></div><form><p>one is long</p><p>two is long</p><p>three is long</p></form></div>",
        "<article><p>one</p><p>two</p><p>three</p></article><script>no<p>no</p>",
        "<div><p>one</p><p>two</p><p>three</p></div><div class='sidebar'><article><p>no</p></article></div>",
    ]
    rows = [(i, f"http://h{i}/", f"<html class='no-nav'><body class='no-sidebar'>{b}", None) for i, b in enumerate(bodies)]
    got = {r.page_id: r.text.replace(" is long", "").removeprefix("skip").split() for r in extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: ["one", "two", "three"] for i in range(len(bodies))}


@pytest.fixture(scope="module")
def given(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    return rows, {r.page_id: r.text for r in extract(spark.createDataFrame(rows)).collect()}


@pytest.mark.parametrize("marks", [True, False])
def test_pages_without_article_elements_and_names(spark, given, marks):
    """The wrapper finds the article by where pages differ, whatever parts are called."""
    rows, want = given

    def plain(html):
        html = re.sub(r"(</?)(?:article|main)\b", r"\1div", html or "")
        return html if marks else re.sub(r'\s(?:class|id|role)="[^"]*"', "", html)

    pages = spark.createDataFrame([(r.page_id, r.url, plain(r.html)) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert got == want


def test_a_part_without_text_of_its_own_gives_way():
    def region(html):
        page = read_page(html)
        slots = [Slot(1, k, k, len(t), n) for k, (_, t, n) in enumerate(page.blocks)]
        items, at = [], 0
        for symbol in page.stream:
            n = 1 if symbol == "#" else 0
            items.append(Item(symbol, False, slots[at : at + n]))
            at += n
        return [t for (_, t, _), inside in zip(page.blocks, article_region(items)) if inside]

    long = "a long text of an article " * 8
    assert region(f"<body><div>notice</div><div><h1>Head</h1><p>{long}</p></div><div>more</div></body>") == ["Head", long.strip()]
    assert region(f"<body><p>own</p><div><p>{long}</p></div></body>") == ["own", long.strip()]
    assert region(f"<body><div><p>{long}</p></div><div><h2>{long}</h2></div></body>") == [long.strip()] * 2
    assert region("<body></body>") == []


def test_alignment_is_bounded_and_right():
    rng = random.Random(4)

    def subsequence(pairs, a, b):
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = _common(a, b)
        subsequence(pairs, a, b)
        assert len(pairs) == longest(a, b)
    begin = time.time()
    base = [rng.choice("abcdefgh") if k % 7 else f"only {k}" for k in range(50_000)]
    other = [x for x in base if rng.random() > 0.1]
    pairs = _common(base, other)
    subsequence(pairs, base, other)
    assert len(pairs) > 0.95 * len(other)
    mixed = [[rng.choice("abcdefgh") for _ in range(50_000)] for _ in range(2)]
    subsequence(_common(*mixed), *mixed)
    assert time.time() - begin < 30

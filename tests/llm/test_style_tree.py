"""Style trees against a plain count of pages, planted noise without names, wrappers and long markup."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest

from graphloom.llm import html_text
from graphloom.llm.html_text import host, low_nodes, main_text, parse, style_tree

SCHEMA = "page_id long, url string, html string"


def words(r, n):
    return " ".join("".join(r.choice("aeioudnrst") for _ in range(r.randrange(2, 9))) for _ in range(n))


def planted(r, sizes):
    """Pages of hosts of so many pages: an article between boxes that repeat, neither with telling names."""
    menu, rows = [words(r, 12), words(r, 30)], []
    for k, n in enumerate(sizes):
        for i in range(n):
            body = "".join(f"<p>{words(r, r.randrange(20, 60))}</p>" for _ in range(r.randrange(3, 8)))
            page = f"<body><div class=c1><ul><li>{menu[0]}<li>{menu[1]}</ul></div><div class=c2><h1>{words(r, 5)}</h1>{body}</div><section class=c3><p>{menu[1]} {menu[0]}</p></section></body>"
            rows.append((len(rows), f"http://h{k}-{n}.example/{i}", page))
    return rows


def expected(page):
    return "\n".join(parse(page[page.index("<div class=c2>") : page.index("<section")], names=False).blocks)


def tree_of(rows):
    """{(host, node): (inside, pages, importance)} page by page."""
    pages = {}
    for _, url, source in rows:
        page = parse(source)
        pages[host(url), "\n".join(page.blocks)] = page
    at = {"host": defaultdict(list), "all": defaultdict(list)}
    within = defaultdict(bool)
    for (name, _), page in pages.items():
        for node, (seen, inside) in page.nodes().items():
            content, look = (tuple(sorted(x)) for x in zip(*seen, strict=True))
            at["host"][name, node].append((content, look))
            at["all"][node].append((content, look))
            within[name, node] |= inside

    def estimate(found, prior):
        m, parts = len(found), []
        for what in (0, 1):
            n = Counter(x[what] for x in found)
            parts.append(1 - sum(c * math.log(c) for c in n.values()) / (m * math.log(m)) if m > 1 else 1.0)
        seen = (1 - html_text.LOOK_SHARE) * parts[0] + html_text.LOOK_SHARE * parts[1]
        return ((m - 1) * seen + html_text.PRIOR_PAGES * prior) / (m - 1 + html_text.PRIOR_PAGES)

    prior = {node: estimate(found, html_text.NEUTRAL) for node, found in at["all"].items()}
    return {k: (within[k], len(found), estimate(found, prior[k[1]])) for k, found in at["host"].items()}


def test_tree_is_the_plain_count(spark):
    r = random.Random(3)
    rows = planted(r, [1, 2, 3, 7, 12]) + [(900, "http://h0-1.example/x", "<article><p>x<p class=y>z</article>"), (901, None, None), (902, None, "")]
    rows += rows[:4]  # pages that repeat count once
    got = {(x.host, x.node): (x.inside, x.n_pages, x.importance) for x in style_tree(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = tree_of(rows)
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=1e-9) for k in want)


@pytest.mark.parametrize("sizes", [[1] * 6, [3], [10], [100], [1, 3, 10, 100]])
def test_planted_noise_goes_without_names(spark, sizes):
    rows = planted(random.Random(7), sizes)
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, SCHEMA), names=False).collect()}
    assert got == {i: expected(page) for i, _, page in rows}


def test_one_article_on_many_pages_stays(spark):
    r = random.Random(1)
    text = words(r, 80)
    rows = [(i, f"http://a.example/{i}", f"<body><div class=m>{words(r, 3)}</div><div class=t><p>{text}</p></div></body>") for i in range(20)]
    got = main_text(spark.createDataFrame(rows, SCHEMA), names=False).collect()
    assert all(text in x.text for x in got)
    assert low_nodes(style_tree(spark.createDataFrame(rows, SCHEMA))).count() > 0


BODY = "<h1>Title of it</h1><p>first paragraph of some length</p><p>second one</p>"
WHOLE = "Title of it\nfirst paragraph of some length\nsecond one"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f"<form action=x><div>{BODY}</div></form>", WHOLE),
        ("<form><fieldset><p>only a text</p></fieldset></form>", "only a text"),
        (f"<div class='has-sidebar'>{BODY}<div class='sidebar'>side</div></div>", WHOLE),
        (f"<div class='ads-free-story'>{BODY}</div>", WHOLE),
        (f"<div id=newsletter-page>{BODY}<form>mail <input></form></div>", WHOLE),
        (f"<div>{BODY}</div><form><p>your name</p></form>", WHOLE),
        (f"<nav>menu</nav><article>{BODY}</article><div class='comment-list'>{'<p>a long answer of a reader</p>' * 30}</div>", WHOLE),
        (f"<div class=ad>{'buy this thing now ' * 40}</div><div>{BODY}</div>", WHOLE),
        ("<div class=ad>buy</div><footer>us</footer>", ""),
        ("<nav>a</nav>", ""),
        (f"<div data-x=\"{'y' * 20_000}>LEAK me\">{BODY}</div>", WHOLE),
        (f"<div title='{'>' * 12_000}'>{BODY}</div>", WHOLE),
        (f"<main><header><h1>Title of it</h1></header>{BODY.partition('</h1>')[2]}</main>", WHOLE),
    ],
)
def test_wrappers_and_attributes(source, text):
    assert parse(source).text(set()) == text


def test_deep_and_odd_markup_in_time():
    began = time.perf_counter()
    for piece in ("<div class='a b'>", "<b>", "<li><dd>", "<ul><li><dt>", "<p><span>", "<a \"", "<a '", "<!-", "</p>", "<table><td>", "&amp;<"):
        page = parse(piece * 20_000 + "text")
        page.nodes()
        page.text({0})
    assert time.perf_counter() - began < 30

"""Decontamination, mixing, personal data, HTML, quotes and language ID on small cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import language, mixing, private, queries
from graphloom.llm.decontaminate import Rules, contaminated, index, normalise, search, windows
from graphloom.llm.html_text import main_text, parse
from graphloom.llm.quotes import reply_ordered

SF = "/root/testdata/sf0.001"


# --- decontamination ---


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_contaminated(spark, monkeypatch):
    r = random.Random(8)
    items = [sentence(r, n) for n in (12, 25, 40, 60, 3)] + [None, "", "abc"]
    texts = [sentence(r, 300), None, "", "x" * 3000]
    for item in items[:4]:
        chars = list(item)
        for _ in range(len(chars) // 40):
            chars[r.randrange(len(chars))] = "z"
        texts += [sentence(r, 50) + " " + item.upper().replace(" ", " \n ") + " " + sentence(r, 50), "".join(chars), item + " " + item]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want = {(4 + 3 * k + j, k) for k in range(4) for j in range(3)}
    # an item too short for q-grams is found as a word of its own
    want |= {(i, 7) for i, t in enumerate(texts) if re.search(r"\babc\b", t or "", re.I)}
    for most in (4_000_000, 100):  # one pass and several
        monkeypatch.setattr("graphloom.llm.decontaminate.PASS_CHARS", most)
        got = contaminated(docs, bench).collect()
        assert {(g.doc_id, g.item_id) for g in got} == want
    exact = next(g for g in got if (g.doc_id, g.item_id) == (4, 0))
    assert exact.edits == 0 and texts[4][exact.start : exact.end] == items[0].upper().replace(" ", " \n ")
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0


def distance(a, b):
    """Least edits of `a` in any part of `b`."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_no_window_is_lost():
    """What the filter lets through, verified, is what a full alignment finds."""
    r, rules = random.Random(3), Rules(window=48, step=24)
    for _ in range(60):
        item = sentence(r, 8)[:60].strip()
        chars = list(item)
        for _ in range(r.randrange(8)):
            p = r.randrange(len(chars))
            chars[p : p + 1] = r.choice([[], ["q"], [chars[p], "q"]])
        text = sentence(r, 10) + " " + "".join(chars) + " " + sentence(r, 10)
        cut = windows(0, normalise(item)[0], rules)
        found = {offset for _, _, offset, _, _ in search(text, index(cut, rules))}
        points = normalise(text)[0].tolist()
        want = {o for _, o, p in cut if distance(p.tolist(), points) <= rules.edits(len(p))}
        assert found == want


# --- mixing ---


def test_targets():
    got = mixing.targets({"a": 10, "b": 100, "c": 100, None: 1000}, mixing.Recipe())
    assert sum(got.values()) == pytest.approx(1.5 * 1210) and got["a"] == 20 and got["b"] == 200
    assert mixing.targets({}, mixing.Recipe()) == {}
    assert mixing.targets({"a": 0}, mixing.Recipe()) == {"a": 0.0}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_flow(seed):
    r = random.Random(seed)
    quotas = [r.randrange(1, 60) for _ in range(4)]
    members = [sorted(r.sample(range(4), r.randrange(1, 4))) for _ in range(5)]
    sizes = [r.randrange(0, 40) for _ in members]
    got = mixing.flow(sizes, members, quotas, 2)
    assert all(-1e-6 <= g <= 2 * s + 1e-6 for g, s in zip(got, sizes, strict=True))
    # as much as any flow: the least cut over subsets of sources
    best = min(sum(quotas[s] for s in range(4) if mask >> s & 1) + sum(2 * n for n, m in zip(sizes, members, strict=True) if any(not mask >> s & 1 for s in m)) for mask in range(16))
    assert sum(got) == pytest.approx(best, abs=1e-3)


def test_mix_overlapping_sources(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(1, 30), r.choice([["a"], ["b"], ["a", "b"], ["c"]])) for i in range(300)] + [(300, None, ["a"]), (None, "w", ["c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mix(docs, F.col("sources")).collect()
    assert len(got) == len(rows) and all(g.taken <= 2 * g.size for g in got)
    assert {g.doc_id: g.taken for g in got} == {g.doc_id: g.taken for g in mixing.mix(docs.repartition(7), F.col("sources")).collect()}
    assert mixing.mix(docs.limit(0), F.col("sources")).count() == 0


def test_mix_null_source(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(1, 30), r.choice(["a", "b", None]), 0) for i in range(200)] + [(1, "w w", None, 0)] * 2 + [(None, None, None, 0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, h int")).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in ("a", "b", None)}
    for s, goal in mixing.targets(sizes, mixing.Recipe()).items():
        taken = sum(g.taken for g in got if g.source_size == sizes[s] and abs(g.target - goal) < 1e-6)
        assert abs(taken - goal) <= 30
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(g.size, g.taken, g.target) for g in mixing.mix(nothing).collect()] == [(0, 0, 0.0)] * 2


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toArrow(), con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    assert sorted(map(repr, zip(*got.select(columns).to_pydict().values(), strict=True))) == sorted(map(repr, zip(*want.select(columns).to_pydict().values(), strict=True)))


# --- personal data ---

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans(spark):
    r = random.Random(6)
    pieces = ["a@b.c", "@", ".", "..", "x_y", "1.2.3.4", "300.1.1.1", "007", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "  ", "+1 (377) 555-0271", "+", "12", "é", "😀", "\n", "a.b@c-d.e", "%", "1", "(", ")"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(1500)] + ["1" * 40_000, "a." * 20_000 + "@b." + "c." * 20_000, "1 " * 20_000, "+1" + "2 " * 20_000, "1.1." * 9_000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for row in df.select("k", *[private.base_spans(F.col("text"), k).alias(k) for k in PLAIN]).collect():
        for kind, pattern in PLAIN.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, texts[row.k]) if good(kind, m[0])]
            assert [(s.start, s.end) for s in row[kind]] == want, (kind, texts[row.k][:80])


def test_disclosure(spark):
    filler = [f"common words are everywhere number{i % 3} here" for i in range(60)]
    secret = ["Ask Waldemarius at w@x.org about common words"] * 2 + ["Waldemarius wrote w@x.org again"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*filler, *secret, None, ""])], "doc_id long, text string, terms string")
    got = {r.doc_id: r for r in private.find(docs).collect()}
    assert len(got) == 65
    spans = {got[60].email[0].value} | {("Ask Waldemarius at w@x.org about common words")[t.start : t.end] for t in got[60].terms}
    assert "w@x.org" in spans and "Waldemarius" in spans and "common" not in spans
    assert all(not r.terms and not r.email for k, r in got.items() if k < 60 or k > 62)
    clean = {r.doc_id: r.text for r in private.sanitise(docs).collect()}
    assert "Waldemarius" not in clean[60] and "[EMAIL]" in clean[60] and clean[0] == filler[0] and clean[63] is None
    assert private.find(docs.limit(0)).count() == 0


def test_query_digest(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op3_personal_data"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, r.text or "") if good(k, m[0]))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[r.doc_id].spans.startswith(base)


# --- HTML ---


def page(body, i=0):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href='/'>Home</a></nav><div class=\"ad\">Buy {i % 2}</div>{body}<footer>&copy; us</footer>"


@pytest.mark.parametrize("most", [200_000, -1])
def test_main_text(spark, monkeypatch, most):
    monkeypatch.setattr("graphloom.llm.html_text.BROADCAST_NODES", most)
    article = "<article><h1>A &amp; B</h1><p><b>one\n two<br><p>three &lt;4&gt;</p><div class=comments><p>nice!</p></div></article>"
    rows = [(1, "http://a.example/x", page(article), "x"), (2, None, None, "x"), (3, "::bad", "", "x"), (4, "http://b.example/", "<p>plain <i>text</i><p>more", "x"), (4, "http://b.example/", "<p>plain <i>text</i><p>more", "x"), (5, "http://a.example/y", "<p>open <b", "x")]
    # a host whose boxes without telling names repeat, while contents differ
    rows += [(10 + i, "http://c.example/", f"<body><div><p>Same words on all pages</p></div><section><p>Text number {i} is its own</p></section></body>", "x") for i in range(12)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect())
    texts = dict((a, b) for a, b, _ in got)
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    assert texts[1] == "A & B\none two\nthree <4>" and texts[2] == texts[3] == "" and texts[4] == "plain text\nmore" and texts[5].startswith("open")
    assert [texts[10 + i] for i in range(12)] == [f"Text number {i} is its own" for i in range(12)]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x y'>", "</div>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<br>", "text", "&amp;", "<!--", "-->", "<script>", "</script>", "<", ">", "'", '"', "<td", "<a href=\"", "</x>", "<article>", "</article>"]), max_size=40).map("".join))
def test_any_markup_parses(source):
    parse(source, True)


# --- quotes ---


def test_reply_order(spark):
    rows = [
        (1, 0, "user", "Hello there everyone\nHow do I open a file in Python?"),
        (1, 1, "assistant", "> How do I open a file in Python?\nUse open().\nThen read the data you need"),
        (1, 2, "user", "On Monday, Ann wrote:\n> Use open().\n> Then read the data you need\n>> How do I open a file in Python?\n\nThanks, and closing?"),
        (1, 3, "user", "Unrelated question?"),
        (1, 4, "assistant", "> Unrelated   QUESTION?\nyes"),
        (1, 5, "assistant", "> thanks, and closing?\nwith statement"),
        (2, None, None, None),
        (None, 1, "user", "> x"),
        (3, 0, "user", ""),
        (3, 0, "user", ""),
    ]
    schema = "conv_id long, turn long, role string, text string"
    got = reply_ordered(spark.createDataFrame([(*r, 1) for r in rows], schema + ", parent int")).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.root, r.turn))
    assert [(r.turn, r.parent, r.depth) for r in one] == [(0, None, 0), (1, 0, 1), (2, 1, 2), (5, 2, 3), (3, None, 0), (4, 3, 1)]
    assert one[2].text == "Thanks, and closing?" and one[1].text == "Use open().\nThen read the data you need"
    assert reply_ordered(spark.createDataFrame([], schema)).count() == 0


# --- languages ---


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = got.selectExpr("sum(cast(lang_pred = lang as int))", "count(*)").first()
    assert n > 200 and right / n > 0.97
    model = language.learn(docs)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of"), (5, "漢字 仮名"), (6, "word " * 300_000)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in odd], "doc_id long, text string, score string")
    out = {r.doc_id: r for r in language.identify(frame, model).collect()}
    assert len(out) == 6 and [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and not any(out[i].accepted for i in (1, 2, 3, 5))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language.learn(docs.limit(0)) is None
    assert language.identify(frame, None).where("lang_pred = 'und'").count() == 6


def test_features_see_the_whole_text():
    a, b = language.features("ab " * 400_000), language.features("ab " * 200_000)
    assert np.allclose(a / a.sum(), b / b.sum(), atol=1e-5)
    assert language.features("12 !") is None

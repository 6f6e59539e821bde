import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators.rerank import words

TOKENS = {
    "loadRiverMap": "load river map",
    "XMLFeedReader": "xml feed read",
    "boat_count_of": "boat count of",
    "harbour_mapOld": "harbour map old",
    "tide   table low": "tid tabl low",
    "ANCHOR": "anch",
    "sails, and ropes!": "sail and rop",
    "[deck]": "deck",
    "": "",
    "über naïf œuvre": "über naïf œuvre",
    "潮 汐": "潮 汐",
    "utf8Decoder": "utf8 decod",
    "rev3_draft": "rev3 draft",
    "dock-master": "dock-mast",
}
STEMS = {
    "migrat": "migrate migration migrator migrated migrating",
    "collect": "collect collecting collected collector",
    "load": "load loading loaded loader",
    "organiz": "organize organization organizing organized",
    "navigat": "navigate navigation navigator navigated",
    "summariz": "summarize summarization summarized",
    "deploy": "deploy deployment deploying deployed",
}
SAME = "go map was their glass bus spring king wing bring über 潮".split()
PAIRS = {"cities": "city", "parties": "party", "boats": "boat", "maps": "map", "planning": "plan", "dropping": "drop"}


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "k int, x string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("x"))).collect()]


def test_tokens(spark):
    want = [v.split() for v in TOKENS.values()]
    assert column(spark, TOKENS, fn.tokens) == want
    assert [words(t) for t in TOKENS] == want


def test_tokens_are_counted_as_they_are_cut(spark):
    """Capitals, digits, marks and blanks of all kinds, and letters beyond 16 bits, in any order."""
    rng, signs = random.Random(5), "aabBC\u01c5\u00df1\u0663\u00b2\u2163\u0301__ .-\t\n\x0b\x1c\x85\u00a0\u2028\u3000\u6f6e\U00010400\U00010428\U0001d7d8\U0001f600"
    texts = [*TOKENS, None, *("".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(3000))]
    assert column(spark, texts, fn.token_count) == column(spark, texts, lambda x: F.size(fn.raw_tokens(x)))


def test_stems(spark):
    cases = [(w, s) for s, ws in STEMS.items() for w in ws.split()] + [(w, w) for w in SAME]
    assert column(spark, [w for w, _ in cases], fn.stem) == [s for _, s in cases]
    got = column(spark, [x for p in PAIRS.items() for x in p], fn.stem)
    assert got[::2] == got[1::2]


def test_preview_and_lines(spark):
    many = " ".join(["w"] * 150)
    assert column(spark, ["a  b", many, " ".join(["w"] * 100)], fn.preview) == ["a  b", " ".join(["w"] * 100) + "...", " ".join(["w"] * 100)]
    assert column(spark, ['{"line":42}', '{"level":2,"start_line":10}', "", "x", '{"line":-1}', '{"line":"7x"}'], fn.line_of) == [42, 10, None, None, None, None]


def test_references(spark):
    assert column(spark, ["`tide_at` or `sail`, not `tide_at` `", "plain"], fn.inline_code) == [["tide_at", "sail"], []]
    assert column(spark, ["Charts lie in maps/coast.rs, tides in maps/tide.py."], fn.file_references) == [["maps/coast.rs", "maps/tide.py"]]
    assert column(spark, ["---\nport: Ayr\n---\n\n# Piers", "# Piers"], fn.strip_frontmatter) == ["# Piers", "# Piers"]


@pytest.mark.parametrize(("node", "path"), [("maps/coast.rs::draw", "maps/coast.rs"), ("PIERS.md:North", "PIERS.md"), ("harbour-plan", "harbour-plan")])
def test_group_path(spark, node, path):
    assert column(spark, [node], fn.group_path) == [path]

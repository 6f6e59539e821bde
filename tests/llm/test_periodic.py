"""Runs against a scan of every period, and the query against plain Python over the given table."""

import hashlib
import random
import re
import zlib

from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.periodic import digest, find, op11_periodic_runs, periodic_runs


def brute(words, times=4, least=6):
    """Stretches of words equal to those a period on, for each period; equal intervals keep the smallest."""
    found, n = {}, len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=8), st.integers(4, 6), st.integers(1, 9))
def test_all_runs(blocks, times, least):
    words = [w for block, k in blocks for w in block * k]
    assert find(words, times, least) == brute(words, times, least)


def test_long_runs():
    r = random.Random(5)
    fib = [0], [0, 1]
    while len(fib[1]) < 900:
        fib = fib[1], fib[1] + fib[0]
    for words in ([7] * 3000, [0, 1] * 1500, fib[1], [r.randrange(2) for _ in range(900)], list(range(500)) * 5, [1] * 5, [1] * 6, [1, 2] * 4, [*range(300), *[1, 1, 2] * 200, *range(300)]):
        assert find(words) == brute(words)
    assert find([5] * 200_000) == [(0, 200_000, 1)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    short = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, short)]
    return (doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2], *sha)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    # brute force takes the square of a text's words: the longest twentieth goes by `test_long_runs`
    few = {r.doc_id for r in sorted(docs, key=lambda r: len(r.text or ""))[: len(docs) * 19 // 20]}
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(rows) == len(docs) and sum(r[1] > 0 for r in rows.values()) > len(rows) / 20
    for r in docs:
        if r.doc_id in few:
            assert rows[r.doc_id] == expected(r.doc_id, r.text)


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "a b " * 5, "no no no no no no", "x\xa0x " * 7, "a b " * 5, "é\x0bé\x0cé\ré\té\né"]
    rows = [(k if k != 3 else None, t, k, "other") for k, t in enumerate(texts)] + [(4, texts[4], 9, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = periodic_runs(docs)
    found = sorted((r.doc_id is None, r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    assert found == sorted(
        [
            (False, 0, [], ""), (False, 1, [], ""), (False, 2, [], ""), (True, 0, [(0, 10, 2)], "a b"), (False, 4, [(0, 6, 1)], "no"),
            (False, 5, [(0, 7, 1)], "x\xa0x"), (False, 6, [(0, 10, 2)], "a b"), (False, 7, [(0, 6, 1)], "é"), (False, 4, [(0, 6, 1)], "no"),
        ]
    )
    assert {(r.n_runs, r.start, r.exponent_milli) for r in digest(got).collect()} == {(0, None, None), (1, 0, 5000), (1, 0, 6000), (1, 0, 7000)}
    assert periodic_runs(docs.limit(0)).count() == 0

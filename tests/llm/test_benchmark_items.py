"""Short items, hot q-grams, repeated items and rows, and passes."""

import random
import time

import numpy as np

from graphloom.llm.decontaminate import Rules, contaminated, grams, index, index_items, normalise, search, windows

RULES = Rules()


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_shared_grams_are_the_windows_own():
    """An index of items finds what an index of their windows one by one does."""
    r = random.Random(2)
    items = [(k, normalise(words(r, n))[0]) for k, n in enumerate((1, 2, 5, 8, 20, 27, 60, 200))]
    whole = index_items(items, RULES)
    apart = index([w for k, p in items for w in windows(k, p, RULES)], RULES)
    assert sorted((w[0], w[1], len(w[2])) for k, p in items for w in windows(k, p, RULES)) == sorted(zip(whole.item.tolist(), whole.offset.tolist(), whole.sizes.tolist(), strict=True))
    for _ in range(40):
        k, p = r.choice(items)
        chars = list("".join(map(chr, p.tolist())))
        for _ in range(r.randrange(len(chars) // 12 + 1)):
            chars[r.randrange(len(chars))] = r.choice("xyz")
        text = f"{words(r, 6)} {''.join(chars)} {words(r, 6)} {''.join(chars)[5:90]}"
        assert sorted(search(text, whole)) == sorted(search(text, apart))


def test_hot_grams_take_bounded_slices(monkeypatch):
    item = normalise("-" * 256)[0]
    idx = index_items([(1, item)], RULES)
    want = search("x " + "-" * 500, idx)
    monkeypatch.setattr("graphloom.llm.decontaminate.SLICE_HITS", 5000)
    assert sorted(search("x " + "-" * 500, idx)) == sorted(want) and {h[1] for h in want} == {0}
    monkeypatch.undo()
    took = []
    for n in (1000, 4000):
        began = time.perf_counter()
        hits = search("-" * n, idx)
        took.append(time.perf_counter() - began)
        assert {(h[3], h[4]) for h in hits} == {(0, n)}
    assert took[1] < 10 * took[0] + 1


def test_grams_are_told_apart():
    points = normalise(words(random.Random(1), 300))[0]
    for q in range(1, 9):
        h = grams(points, q)
        assert len(np.unique(h)) == len({tuple(points[i : i + q]) for i in range(len(h))})


def test_short_and_repeated_items(spark, monkeypatch):
    r = random.Random(9)
    long, other = words(r, 30), words(r, 30)
    docs = spark.createDataFrame([(1, "a Lazy\n dog", 0), (2, "lazydog", 0), (3, long, 0), (3, long, 0), (None, long, 0), (None, other, 0), (3, other, 0), (4, "lazy", 0)], "doc_id long, text string, text_hash int")
    bench = spark.createDataFrame([(7, "LAZY"), (7, "LAZY"), (8, "lazy  dog"), (9, long), (9, long), (9, other), (None, other)], "item_id long, text string")
    results = []
    for most in (4_000_000, 1):
        monkeypatch.setattr("graphloom.llm.decontaminate.PASS_CHARS", most)
        results.append(sorted(map(repr, contaminated(docs, bench).collect())))
        rows = contaminated(docs, bench).collect()
        assert sorted((str(x.doc_id), x.item_id) for x in rows) == [("1", 7), ("1", 8), ("3", 9), ("3", 9), ("4", 7), ("None", 9), ("None", 9)]
    assert results[0] == results[1]

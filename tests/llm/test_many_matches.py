"""Texts with very many matches, and overlapping spans."""

import time

from pyspark.sql import functions as F

from graphloom.llm import private


def test_time_in_proportion_to_matches(spark):
    took = []
    for n in (10_000, 50_000):
        text = " ".join(f"a{i}@b.org" for i in range(n))
        df = spark.createDataFrame([(1, text)], "k int, text string").cache()
        df.count()
        began = time.perf_counter()
        spans = df.select(private.base_spans(F.col("text"), "email").alias("s")).first()["s"]
        took.append(time.perf_counter() - began)
        assert len(spans) == n and all(text[s.start : s.end] == s.value for s in spans)
    assert took[1] < 12 * took[0] + 2


def test_sanitised_spans(spark):
    """Cards hide in phones, numbers in addresses; the span that begins first counts."""
    texts = ["call +4111 1111 1111 1111 now", "x 4111111111111111@mail.org y", "😀 a@b.org, 1.2.3.4; c@d.org", "", None, "a@b.org" * 3, " ".join(f"u{i}@x.org" for i in range(700))]
    rows = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    never = private.Disclosure(generalise=9.0, remove=9.0)
    got = sorted((r.doc_id, r.text) for r in private.sanitise(rows, never).collect() if r.text is not None)
    marks = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
    want = []
    for r in private.find(rows, never).collect():
        text = next(t for i, t in enumerate(texts) if i % 4 == r.doc_id and (t or "") != "" and private_hash(spark, t) == r.text_hash) if r.email or r.ip or r.card or r.phone else None
        if text is None:
            continue
        spans, at, out = sorted((s.start, -s.end, marks[k]) for k in marks for s in r[k]), 0, ""
        for a, b, mark in spans:
            if a >= at:
                out, at = out + text[at:a] + mark, -b
        want.append((r.doc_id, out + text[at:]))
    assert sorted(x for x in got if "[" in x[1]) == sorted(want) and len(got) == 6


def private_hash(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]

"""Near-duplicates of texts and vectors against all pairs."""

import random
import threading
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphloom.llm.components import components
from graphloom.llm.minhash import Plan, near_duplicates
from graphloom.llm.vectors import near_vectors


def united(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    got = {x.id: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = united(400, [p for p in pairs if None not in p])
    assert got == {i: want[i] for p in pairs if None not in p and p[0] != p[1] for i in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n ", "Hello", "hello", "hello World", "HELLO\tworld", "a b c", "A  b\nc", "é É", "É É"]
    base = [r.choice(vocabulary) for _ in range(90)]
    for _ in range(120):  # many near copies of one text, most of them not linked with each other
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(90)] = r.choice(vocabulary)
        texts.append(" ".join(copy))
    for _ in range(60):
        one = [r.choice(vocabulary) for _ in range(r.randrange(1, 120))]
        texts.append(" ".join(one))
        for _ in range(r.randrange(3)):
            other = list(one)
            for _ in range(r.randrange(4)):
                other[r.randrange(len(one))] = r.choice(vocabulary)
            texts.append(" ".join(other))
    texts += ["long " + " ".join(r.choice(vocabulary) for _ in range(30_000))] * 2
    return texts


@pytest.mark.parametrize("plan", [Plan(words=3, num=85, den=100), Plan()])
def test_near_duplicates(spark, plan, monkeypatch):
    monkeypatch.setattr("graphloom.llm.minhash.BLOCK", 16)
    texts = corpus()
    sets = [shingle_set(t, plan.words) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and plan.den * len(sets[i] & sets[j]) >= plan.num * len(sets[i] | sets[j])]
    want = united(len(texts), links)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, bucket string, rep int"), plan).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}
    assert len(got) == len(texts)


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = near_duplicates(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "z")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, 5, True), (5, 5, True), (5, 5, True)]


def test_plan():
    p = Plan(words=3, num=85, den=100)
    assert p.bands * p.rows == p.size and (1 - 0.85**p.rows) ** p.bands <= p.band_miss
    assert all(0 <= m <= n for n, m in p.least_matches()) and p.least_matches()[-1][0] == p.size


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr("graphloom.llm.vectors.MEMBERS", 32)
    monkeypatch.setattr("graphloom.llm.vectors.QUERIES", 40)
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 16))
    x[100:160] = x[100] + 0.12 * r.normal(size=(60, 16))
    x[200:260] = x[200]
    x[300] = 3 * x[301]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    want = united(700, list(zip(*np.nonzero(hit), strict=True)))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, [1.0, 2.0]]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(700 + k, v, "a") for k, v in enumerate(odd)]
    got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")).collect()}
    assert {k: got[k] for k in range(700, 707)} == {k: (0, k, True) for k in range(700, 707)}
    exact = sum(got[i] == (int(hit[i].sum()), want[i], want[i] == i) for i in range(700))
    assert sum(got[i][0] for i in range(700)) >= 0.999 * hit.sum() and exact >= 695
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert near_vectors(empty).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).first().kept


def test_vectors_of_several_lengths(spark, monkeypatch):
    """Lengths that few vectors have are linked like the usual one, bins and parts do not matter."""
    monkeypatch.setattr("graphloom.llm.vectors.MEMBERS", 50)
    monkeypatch.setattr("graphloom.llm.vectors.QUERIES", 60)
    r = np.random.default_rng(8)
    rows, want = [], {}
    for first, dim, n in ((0, 8, 400), (1000, 3, 90), (2000, 2, 2), (3000, 5, 1)):
        x = r.normal(size=(n, dim))
        x[n // 2 :] = x[: n - n // 2] * r.uniform(0.5, 2, (n - n // 2, 1)) + 0.05 * r.normal(size=(n - n // 2, dim))
        if n == 2:
            x[1] = x[0]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        hit = unit @ unit.T >= 0.95
        np.fill_diagonal(hit, False)
        for i, c in enumerate(united(n, list(zip(*np.nonzero(hit), strict=True)))):
            want[first + i] = (int(hit[i].sum()), first + c)
        rows += [(first + i, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, rows[0][1]), (None, None)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows) and [(g.n_links, g.component_id, g.kept) for g in got if g.vec_id is None] == [(0, None, True)] * 2
    found = {g.vec_id: (g.n_links, g.component_id) for g in got if g.vec_id is not None}
    assert {k: v for k, v in found.items() if k >= 1000} == {k: v for k, v in want.items() if k >= 1000}
    assert sum(found[k] == want[k] for k in range(400)) >= 396


def test_vectors_disk(spark, tmp_path, monkeypatch):
    """Vectors that probe many lists are dealt in rounds: the folders never hold four times the input."""
    monkeypatch.setattr("graphloom.llm.vectors.ROUND_BYTES", 1, raising=False)
    monkeypatch.setattr("graphloom.llm.vectors.MEMBERS", 1024)
    r, n = np.random.default_rng(2), 20_000
    x = r.normal(size=(n, 64))
    x[:300] = x[0] + 0.13 * r.normal(size=(300, 64))
    x = x.astype(np.float32)
    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64, dtype=np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": cells}), tmp_path / "embeddings.parquet")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = sum(int((unit[a : a + 2000] @ unit.T >= 0.95).sum()) for a in range(0, n, 2000)) - n

    folders = [Path(f.getPath()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(Path(spark.sparkContext.getConf().get("spark.checkpoint.dir")))

    def held():
        out = {}
        for path in (p for folder in folders for p in folder.rglob("*")):
            try:
                out[path] = path.stat().st_size if path.is_file() else 0
            except FileNotFoundError:
                pass  # deleted meanwhile
        return out

    before, peak, done = held(), [0], threading.Event()

    def watch():
        while not done.wait(0.1):
            peak[0] = max(peak[0], sum(size for path, size in held().items() if path not in before))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = near_vectors(spark.read.parquet(str(tmp_path / "embeddings.parquet"))).selectExpr("count(*)", "sum(n_links)").first()
    finally:
        done.set()
        watcher.join()
    assert tuple(got) == (n, want)
    assert peak[0] <= 4 * (tmp_path / "embeddings.parquet").stat().st_size


def test_links_in_dense_spots(spark):
    """Lists within one cluster lie so near each other that their planes are no random directions."""
    r = np.random.default_rng(6)
    x = r.normal(size=64) + 0.14 * r.normal(size=(3000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {g.vec_id: g.n_links for g in got} == dict(enumerate(hit.sum(1).tolist()))

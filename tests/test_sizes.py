"""What a step holds or hands on stays bounded where one word, name or text is very common."""

import numpy as np
import pyarrow as pa
from conftest import SF
from pyspark.sql import functions as F

from graphloom.operators import bm25, code, dense, markdown, pending, reconcile, state, workspace
from graphloom.operators.index import TextIndex
from graphloom.plans import demo
from graphloom.plans.graph import Graph
from graphloom.plans.schema import LOG
from graphloom.sources import log as logs


def test_hits_of_a_common_word_are_no_rows():
    docs = [f"d{k:05d}" for k in range(2000)]
    post = pa.table({"field": ["name"] * 2000, "doc_id": docs[::-1], "token": ["x"] * 2000, "part": [1.5] * 1999 + [2.0]})
    asked = pa.table({"bag_id": ["a", "b"], "token": ["x", "y"], "weight": pa.array([2, 1], pa.int64())})
    got = bm25._best_of_block(post, asked, 30)
    assert got["doc_id"].to_pylist() == docs[:31] and got["score"].to_pylist() == [4.0] + [3.0] * 30 and set(got["bag_id"].to_pylist()) == {"a"}


def test_many_requests_give_what_each_gives_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_POSTINGS", 100)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 3)
    index = TextIndex(spark, str(tmp_path / "index"))
    words = ["red", "blue", "ring", "hot", "bolt"]
    rows = [(f"d{k}", f, " ".join(words[(k * m) % 5] for m in range(1, n))) for k in range(150) for f, n in (("name", 3), ("content", 2 + k % 4))]
    index.add(spark.createDataFrame(rows, "doc_id string, field string, text string"))
    texts = {1: "red ring", 2: "hot", 3: "ring red", 4: "bolts bolt blue", 5: ""}
    got = index.search_many(spark.createDataFrame(list(texts.items()), "request_id long, text string"), 7).collect()
    for k, text in texts.items():
        want = [(r.doc_id, round(r.score, 9)) for r in index.search(text, 7).collect()]
        assert [(r.doc_id, round(r.score, 9)) for r in sorted((r for r in got if r.request_id == k), key=lambda r: r.place)] == want


def test_tokens_are_not_shuffled(spark):
    texts = spark.createDataFrame([("a", "content", "one two two"), ("a", "content", "two three"), ("b", "content", "")], "doc_id string, field string, text string")
    got = {(r.doc_id, r.token): (r.tf, r.dl) for r in bm25.measured(texts).collect()}
    assert got == {("a", "one"): (1, 5), ("a", "two"): (3, 5), ("a", "thre"): (1, 5)}
    plan = bm25.postings(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_lengths_need_no_postings(spark):
    texts = spark.createDataFrame([("a", "content", "one twoThree"), ("a", "content", "four"), ("b", "content", " "), ("c", "name", None)], "doc_id string, field string, text string")
    assert [tuple(r) for r in bm25.text_lengths(texts).collect()] == [("content", "a", 4)]
    assert bm25.text_lengths(texts).exceptAll(bm25.lengths(bm25.postings(texts))).count() == 0


def test_texts_of_one_row_group_are_dealt(spark, tmp_path):
    """A file's splits are many, and the rows of its only row group all lie in one of them."""
    rows = spark.range(400).selectExpr("concat('d', id) as doc_id", "'content' as field", "repeat(sha2(string(id), 512), 20) as text")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(8).write.parquet(str(tmp_path / "even"))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        one = spark.read.parquet(str(tmp_path / "one"))
        assert one.rdd.getNumPartitions() > 4 and max(one.rdd.glom().map(len).collect()) == 400
        dealt = bm25.spread(one, "text", "field", "doc_id")
        assert max(dealt.rdd.glom().map(len).collect()) < 200 and dealt.exceptAll(one).count() == 0
        got = bm25.text_lengths(one)
        # counted once, where texts have been dealt
        assert got._jdf.queryExecution().optimizedPlan().toString().count("[^\\s") == 1
        assert got.count() == 400 and got.exceptAll(bm25.lengths(bm25.postings(one))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    even = spark.read.parquet(str(tmp_path / "even"))
    assert bm25.spread(even, "text", "doc_id") is even
    none = even.where("doc_id is null")
    assert bm25.spread(none, "text", "doc_id") is none


def test_parts_of_a_bucket_follow_its_size(spark, tmp_path, monkeypatch):
    from graphloom.operators import index as kept

    monkeypatch.setattr(kept, "PART_ROWS", 2)
    index = TextIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(f"d{k}", "name", f"same w{k % 7}") for k in range(400)], "doc_id string, field string, text string"))
    held = index._get("postings").where("token = 'sam'")
    sizes = [r.n for r in held.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) <= 200


def test_nearest_in_small_blocks(spark, monkeypatch):
    for name, size in (("BLOCK_FLOATS", 120), ("ROWS", 7), ("COLUMNS", 12)):
        monkeypatch.setattr(dense, name, size)
    # a large group of copies, which tie with each other
    vecs = np.random.default_rng(3).normal(size=(90, 4)).astype(np.float32)
    vecs[20:60] = vecs[20]
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vecs)], "id long, vec array<float>")
    got: dict = {}
    for r in dense.nearest_many(table, table.withColumnRenamed("id", "query_id"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    sims = np.round(vecs.astype(float) @ vecs.astype(float).T, 9)
    assert got == {k: set(sorted(range(90), key=lambda j: (-sims[k, j], j))[:5]) for k in range(90)}


def test_products_are_held_in_slices(monkeypatch):
    most = []
    keep = dense._kept
    monkeypatch.setattr(dense, "_kept", lambda row, *rest: most.append(len(row)) or keep(row, *rest))
    vecs = np.random.default_rng(4).normal(size=(9000, 8))
    side = {"vec": pa.array(list(vecs), pa.list_(pa.float64()))}
    got = dense._top_of_block(pa.table({"query_id": range(9000), **side}).slice(0, 600), pa.table({"id": range(9000), **side}), 3)
    assert got.num_rows == 1800 and max(most) < 512 * 40


def test_references_by_a_common_name(spark):
    """Pairs of references and targets are neither sorted nor gathered; those of shared ids come once."""
    parsed = spark.createDataFrame([(f"d{k}", ["same", "other"], ["f.py"]) for k in range(40)], "id string, inline_code_refs array<string>, file_path_refs array<string>")
    nodes = [(f"x{k}", "Entity", "Function", "same") for k in range(30)] + [("two", "Entity", "Class", "same"), ("two", "Entity", "Function", "other"), ("f.py", "Entity", "File", "f.py"), ("f.py", "Entity", "Function", "other")]
    nodes = spark.createDataFrame(nodes, "id string, label string, entity_type string, name string")
    got = markdown.resolve(parsed, nodes)
    want = {(f"d{k}", t, "inline_code", n) for k in range(40) for t, n in [(f"x{j}", "same") for j in range(30)] + [("two", "other"), ("f.py", "other")]}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_relinked_by_a_common_name(spark):
    nodes = spark.createDataFrame([(f"x{k}", "Entity", "Function", "same") for k in range(40)] + [("s", "Entity", "Section", ""), ("x0", "Entity", "Class", "also")], "id string, label string, entity_type string, name string")
    hit = spark.createDataFrame([("s", "same"), ("s", "also"), ("gone", "same"), ("s", "same")], "section string, matched_text string")
    edges = spark.createDataFrame([("s", f"x{k}", "REFERENCES") for k in range(1, 30)], "from_id string, to_id string, relationship string")
    got = markdown.relink(hit, nodes, edges)
    assert sorted((r.from_id, r.to_id) for r in got.collect()) == sorted(("s", f"x{k}") for k in [0, *range(30, 40)])
    assert "collect_set" in got._jdf.queryExecution().optimizedPlan().toString()


def test_newest_notes_before_pairs(spark):
    nodes = [(f"w{k}", "Workspace", "active" if k else "inactive", None) for k in range(30)] + [(f"n{k}", "Scratchpad", None, k // 2) for k in range(50)]
    edges = [(f"w{k}", f"n{j}", "HAS_SCRATCHPAD", 0) for k in range(30) for j in range(48) if j % 9 or not k]
    nodes = spark.createDataFrame(nodes, "id string, label string, status string, created_at long").withColumn("content", F.col("id"))
    g = Graph(nodes, spark.createDataFrame(edges, "from_id string, to_id string, relationship string, seq long"))
    got = workspace.notes(g, 3)
    assert [tuple(r)[:2] for r in got.collect()] == [(f"w{k}", "n46") for k in (1, 10, 11)]
    # pairs are met by the newest notes alone
    assert got._jdf.queryExecution().optimizedPlan().toString().count("GlobalLimit 3") >= 3


def test_references_are_dealt_once(spark, monkeypatch):
    """A batch shuffles what it tries by name alone, and a common name's declarations are no row."""
    plans = []
    keep = code.written
    monkeypatch.setattr(code, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    monkeypatch.setattr(code, "FEW", 3)
    decl = [(f"a/{k}.py:f", "f", f"a/{k}.py") for k in range(6)] + [("b/x.py:f", "f", "b/x.py"), ("b/x.py:g", "g", "b/x.py"), ("a/1.py:g", "g", "a/1.py"), ("b/x.py:h", "h", "b/x.py")]
    declared = spark.createDataFrame(decl, "id string, name string, path string")
    refs = [(p, "CALLS", n, f"{p}:run") for p in ("a/1.py", "b/y.py", "c/z.py", "a/9.py") for n in "fghi"]
    none = spark.createDataFrame([], pending.QUEUE)
    queue = spark.createDataFrame([("c/q.py", "CALLS", n, "c/q.py") for n in "ghz"] + [("a/1.py", "CALLS", "h", "a/1.py")], pending.QUEUE)
    linked = spark.createDataFrame([("c/w.py", "CALLS", "h", "c/w.py", "gone"), ("c/q.py", "CALLS", "z", "c/q.py", "gone")], f"{pending.QUEUE}, to_id string")
    changed, gone, taken = (spark.createDataFrame(r, t) for r, t in (([("f",), ("h",), ("i",)], "name string"), ([("gone",)], "id string"), ([("a/1.py",)], "path string")))
    monkeypatch.setattr(pending, "BROADCAST_ROWS", 0)
    found, left = pending.step(queue, spark.createDataFrame(refs, pending.QUEUE).unionByName(none), linked, declared, changed, gone, taken)
    tried = refs + [("c/w.py", "CALLS", "h", "c/w.py"), ("c/q.py", "CALLS", "h", "c/q.py")]
    want = {}
    for path, kind, name, sender in tried:
        of = [d for d in decl if d[1] == name]
        folder = path.rpartition("/")[0]
        near = [d for d in of if d[2] == path] or [d for d in of if d[2].rpartition("/")[0] == folder] or of
        want[path, kind, name, sender] = near[0][0] if len(near) == 1 else None
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows) == sorted((*k, v) for k, v in want.items() if v)
    asleep = [("c/q.py", "CALLS", "g", "c/q.py"), ("c/q.py", "CALLS", "z", "c/q.py")]
    assert sorted(tuple(r) for r in left.collect()) == sorted([k for k, v in want.items() if not v] + asleep)
    assert "WindowGroupLimit" in plans[0].split("Initial Plan")[-1]


def test_parts_of_texts_follow_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(bm25, "PART_BYTES", 100)
    texts = spark.createDataFrame([(f"d{k}", "content", "word " * 20) for k in range(60)], "doc_id string, field string, text string")
    post = bm25.measured(texts)
    assert post.rdd.getNumPartitions() == 60 and [tuple(r) for r in post.select("tf", "dl").distinct().collect()] == [(20, 20)]


def test_pairs_are_made_distinct_in_parts(spark, monkeypatch):
    monkeypatch.setattr(demo, "PART_LINES", 500)
    plan = demo.star_graph(spark, SF).edges._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("REPARTITION_BY_NUM") == 2


def test_lines_are_parsed_once(spark, tmp_path):
    logs.append(spark.range(5).select(*logs.event("DELETE_NODE", F.col("id"), id=F.lit("a"))), str(tmp_path / "log"))
    log = logs.read(spark, str(tmp_path / "log"))
    assert log.count() == 5 and "parse_json" not in log._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_parsed_once_on_all_cores(spark, monkeypatch):
    parts = {}
    keep = reconcile.written
    monkeypatch.setattr(reconcile, "written", lambda df, name: parts.update({name: df.rdd.getNumPartitions()}) or keep(df, name))
    files = spark.createDataFrame([(f"{k}.py", f"def f{k}():\n    return f0()\n") for k in range(9)], "path string, content string").coalesce(1)
    batch = reconcile.events(files, state.fold(spark.createDataFrame([], LOG)), 1000)
    assert parts["declarations"] == spark.sparkContext.defaultParallelism
    links = batch.where("relationship = 'CALLS'").select("from_id", "to_id").collect()
    assert sorted(map(tuple, links)) == [(f"{k}.py:f{k}", "0.py:f0") for k in range(9)]
    assert "MapInPandas" not in batch._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_worked_out_once(spark):
    texts = spark.createDataFrame([("a", "content", "things thing red"), ("b", "content", "thing"), ("c", "name", "blue")], "doc_id string, field string, text string")
    corpus, hits = bm25.of_texts(texts)({"thing": 1})
    assert sorted(tuple(r) for r in hits.select("doc_id", "token", "tf", "dl").collect()) == [("a", "thing", 2, 3), ("b", "thing", 1, 1)]
    assert "Generate" not in hits._jdf.queryExecution().optimizedPlan().toString() and corpus.count() == 2

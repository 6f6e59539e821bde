"""Mutations, syncing a source tree, kept indexes and reconciliation against a sequential walk."""

import random

from graphloom.engine import Engine
from graphloom.operators import bm25
from graphloom.operators.index import TextIndex, VectorIndex

NOW = 1_700_000_000_000


def test_mutations_and_tracking(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"))
    for k in "abc":
        e.upsert_node(k, "Function", {"name": f"name {k}", "content": "alpha beta " * (1 + ord(k) % 3)})
    e.link_nodes("a", "b", "CALLS")
    e.link_nodes("b", "c", "CALLS", {"w": 1})
    e.link_nodes("a", "f.py", "DECLARED_IN")
    e.open_workspace("ws", "a space", 5)
    e.track("f.py")
    assert {(r.from_id, r.to_id) for r in e.graph.edges.collect()} == {("a", "b"), ("b", "c"), ("a", "f.py"), ("ws", "a")}
    assert {(r.section, r.name, r.value) for r in e.report().collect()} == {("entities", "Function", "3"), ("workspaces", "ws", "a space")}
    e.delete_edges("b")
    e.delete_node("a")
    assert e.graph.edges.count() == 0 and {r.id for r in e.graph.nodes.collect()} == {"b", "c", "ws"}
    assert e.languages().count() == 3
    index = e.index(str(tmp_path / "index"))
    plain = e.search({"text": "alpha name"}).select("id", "score").collect()
    assert plain == e.search({"text": "alpha name"}, index=index).select("id", "score").collect() and len(plain) == 2


def test_sync(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    return missing()\n")
    (root / "b.md").write_text("# Head\n\nUse `f`.\n")
    e = Engine(spark, str(tmp_path / "log"))
    got = e.sync(str(root), NOW)
    assert got["upserted_nodes"] == 5 and got["edges_pending"] == 1
    assert e.sync(str(root), 1 << 50)["upserted_nodes"] >= 0
    assert e.sync(str(root), 1 << 50) == {"upserted_nodes": 0, "deleted_nodes": 0, "linked_edges": 0, "edges_pending": 0}
    (root / "a.py").unlink()
    assert e.sync(str(root), 1 << 50)["deleted_nodes"] == 3
    assert {r.id for r in e.graph.nodes.collect()} == {"b.md", "b.md:Head"}


def test_last_declaration_counts(spark, tmp_path):
    r, files, want = random.Random(3), [], {}
    for k in range(6):
        lines = []
        for c in range(r.randrange(2, 6)):
            lines += [f"class C{c}:", f"    def {r.choice(['run', 'stop', '__init__'])}(self):", f"        return {c}", ""]
        for at, line in enumerate(lines, 1):
            name = line.strip().removeprefix("class ").removeprefix("def ").split("(")[0].rstrip(":")
            if line.strip().startswith(("class", "def")):
                want[f"m{k}.py:{name}"] = at
        files.append((f"m{k}.py", "\n".join(lines)))
    e = Engine(spark, str(tmp_path / "log"))
    e.reconcile(spark.createDataFrame(files, "path string, content string"), NOW)
    got = {x.id: x.line for x in e.query({"return": ["id", "line"]}).collect() if x.line is not None}
    assert got == want
    before = sorted((x.from_id, x.to_id, x.relationship) for x in e.graph.edges.collect())
    e.reconcile(spark.createDataFrame(files, "path string, content string"), NOW + 1)
    assert sorted((x.from_id, x.to_id, x.relationship) for x in e.graph.edges.collect()) == before
    assert {x.id: x.line for x in e.query({"return": ["id", "line"]}).collect() if x.line is not None} == want


def test_kept_indexes(spark, tmp_path):
    r = random.Random(5)
    text = lambda: " ".join(r.choice("red green blue running stopped fields".split()) for _ in range(r.randrange(1, 9)))
    docs = {f"d{i}": text() for i in range(40)}
    frame = lambda d: spark.createDataFrame([(k, "content", v) for k, v in d.items()], "doc_id string, field string, text string")
    index = TextIndex(spark, str(tmp_path / "t"))

    def same():
        want = bm25.search(bm25.postings(frame(docs)), "run field", 10).collect()
        return index.search("run field", 10).collect() == want == bm25.search(bm25.of_texts(frame(docs)), "run field", 10).collect()

    index.add(frame(docs))
    assert same()
    change = {f"d{i}": text() for i in range(5)} | {"new": text(), "d7": ""}
    docs |= change
    index.add(frame(change))
    assert same()
    docs = {k: v for k, v in docs.items() if k not in ("d1", "d9")}
    index.remove(frame({"d1": "", "d9": ""}))
    assert same() and len(index.generations()) == 3
    index.compact()
    assert same() and len(index.generations()) == 1
    vectors = VectorIndex(spark, str(tmp_path / "v"))
    chunk = lambda rows: spark.createDataFrame(rows, "node_id string, chunk_idx int, vec array<float>")
    vectors.add(chunk([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 0, [0.6, 0.8])]))
    vectors.add(chunk([("a", 0, [0.8, 0.6])]))
    vectors.remove(chunk([("b", 0, [0.0, 0.0])]))
    assert [(x.node_id, x.chunk_idx) for x in vectors.nearest([0.0, 1.0], 5).collect()] == [("a", 0)]
    vectors.compact()
    assert [(x.node_id, x.chunk_idx) for x in vectors.nearest([0.0, 1.0], 5).collect()] == [("a", 0)]

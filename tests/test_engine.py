"""A log on disk, files taken in, searched, and compacted."""

from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import embed, state
from graphloom.sources import files

NOW = 1_700_000_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def edges(engine, relationship):
    return sorted((e.from_id, e.to_id) for e in engine.graph.edges.where(F.col("relationship") == relationship).collect())


def test_files_to_answers(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"))
    assert e.query({}).count() == 0
    code = "def validate_token(t):\n    return check(t)\n\ndef check(t):\n    return bool(t)\n"
    guide = "# Auth\n\nCall `validate_token`, see src/auth.py.\n"
    e.reconcile(frame(spark, [("src/auth.py", code), ("guide.md", guide), ("empty.py", "")]), NOW)
    ids = {r.id for r in e.query({"return": ["id"]}).collect()}
    assert ids == {"src/auth.py", "guide.md", "src/auth.py:validate_token", "src/auth.py:check", "guide.md:Auth"}
    assert edges(e, "CALLS") == [("src/auth.py:validate_token", "src/auth.py:check")]
    assert edges(e, "REFERENCES") == [("guide.md:Auth", "src/auth.py"), ("guide.md:Auth", "src/auth.py:validate_token")]
    # the same files again leave the same graph
    before = sorted(map(str, e.graph.edges.drop("seq").collect()))
    e.reconcile(frame(spark, [("src/auth.py", code), ("guide.md", guide)]), NOW + 1)
    assert sorted(map(str, e.graph.edges.select("from_id", "to_id", "relationship").collect())) == sorted({str(r) for r in e.graph.edges.select("from_id", "to_id", "relationship").collect()})
    assert len(before) == e.graph.edges.count()
    # code alone changes: the document's reference is restored
    e.reconcile(frame(spark, [("src/auth.py", code + "\n\ndef extra():\n    pass\n")]), NOW + 2)
    assert ("guide.md:Auth", "src/auth.py:validate_token") in edges(e, "REFERENCES")
    hits = e.search({"text": "validate", "top_k": 3, "snippet": "auto", "traverse": {"resolve_top_k": 1}, "diversity": 0.7}).collect()
    assert hits[0].id == "src/auth.py:validate_token" and hits[0].category == "module" and hits[0].neighbors and hits[0].line == 1
    # a file that is gone
    e.reconcile(frame(spark, [("src/auth.py", "")]), NOW + 3)
    assert {r.id for r in e.query({"return": ["id"]}).collect()} == {"guide.md", "guide.md:Auth"}


def test_workspaces_and_compaction(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"))
    for k in range(3):
        e.open_workspace(f"ws{k}", f"space {k}", 100 + k)
        e.note(f"note {k}", 1000 * k)
    assert [(r.id, r.closed_at) for r in e.graph.by_label("Workspace").orderBy("id").collect()] == [("ws0", 101), ("ws1", 102), ("ws2", None)]
    before = {r.id for r in e.graph.nodes.collect()}
    archived, kept = e.compact(str(tmp_path / "archive"), keep=1)
    assert {r.id for r in e.graph.nodes.collect()} == before - {"ws0", "note_0"}
    assert (archived, kept) == (3, 6)
    again = Engine(spark, str(tmp_path / "archive"))
    assert {r.id for r in again.graph.nodes.collect()} == {"ws0", "note_0"}


def test_scan_of_a_tree(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "sub/b.md": "# B", "node_modules/c.js": "no", "d.txt": "no", "big.py": "x" * 1_000_001}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    disk = files.scan(spark, str(tmp_path))
    assert sorted((r.path, r.content) for r in disk.collect()) == [("a.py", "x = 1"), ("sub/b.md", "# B")]
    known = spark.createDataFrame([("a.py", 1 << 50), ("old.py", 5)], "path string, last_modified bigint")
    assert [r.path for r in files.changed(disk, known).collect()] == ["sub/b.md"]
    assert [r.path for r in files.stale(disk, known).collect()] == ["old.py"]


def test_embedding_cache(spark):
    nodes = state.fold(spark.createDataFrame([(i, "UPSERT_NODE", f"n{i}", "Function", f'{{"name":"f{i}","content":"body {i}"}}') for i in range(5)], "seq bigint, event_type string, id string, label string, properties string").selectExpr("seq", "1 as version", "0L as timestamp", "event_type", "id", "label", "cast(null as string) from_id", "cast(null as string) to_id", "cast(null as string) relationship", "cast(null as string) direction", "properties")).nodes
    first = embed.embed(embed.to_embed(nodes, embed.hashed(nodes).limit(0)), embed.HashingEmbedder(8))
    rows = first.collect()
    assert len(rows) == 5 and all(abs(sum(x * x for x in r.embedding[0]) - 1) < 1e-5 for r in rows)
    assert embed.to_embed(nodes, embed.hashed(nodes)).count() == 0

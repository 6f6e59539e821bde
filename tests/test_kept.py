"""What is kept beside a log: nothing is lost while it is rewritten, and what follows it agrees with it."""

import time

import numpy as np
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import dense, embed, snapshot, state
from graphloom.operators.index import TextIndex, VectorIndex
from graphloom.operators.snapshot import Mark, Snapshots
from graphloom.plans.schema import CHUNKS
from graphloom.sources import log as logs
from graphloom.streaming import tail

NOW = 1_700_000_000_000


def writes(spark, *ids):
    rows = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "seq long, id string")
    return rows.select(*logs.event("UPSERT_NODE", F.col("seq"), id=F.col("id"), label=F.lit("Entity"), properties=F.lit('{"name":"x"}')))


def ids(spark, path):
    return sorted(r.id for r in state.fold(logs.read(spark, path)).nodes.collect())


def test_nothing_is_lost_in_a_rewrite(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append(writes(spark, "a", "b"), path)
    listed = logs.listing(spark, path)
    logs.archive(writes(spark, "old"), f"{path}/archive")
    assert logs.append(writes(spark, "late"), path) == 1
    logs.rewrite(writes(spark, "a"), path, listed)
    assert ids(spark, path) == ["a", "late"] and ids(spark, f"{path}/archive") == ["old"]
    assert logs.append(writes(spark, "later"), path) == 2
    # one who found the old folder before the pointer turned, and puts a batch there after it did
    first = logs.listing(spark, path)
    logs.to_json(writes(spark, "stray")).write.text(f"{path}/_draft-x")
    stray = f"{first.folder}/batch-{first.upto + 1:012d}"
    logs.rewrite(writes(spark, "a", "late", "later"), path, first)
    assert logs.moved(spark, f"{path}/_draft-x", stray.replace(first.folder, path))
    logs._claim(spark, path, stray.replace(first.folder, path), "_id-none")
    assert ids(spark, path) == ["a", "late", "later", "stray"]
    # a rewrite of what someone else rewrote leaves all as it is
    try:
        logs.rewrite(writes(spark, "none"), path, first)
        raise AssertionError
    except RuntimeError:
        pass
    assert ids(spark, path) == ["a", "late", "later", "stray"] and ids(spark, f"{path}/archive") == ["old"]


def test_numbers_are_taken_once(spark, tmp_path):
    path = str(tmp_path / "log")
    got = [logs.append(writes(spark, f"n{k}"), path) for k in range(3)]
    assert got == [0, 1, 2] and [n for n, _ in logs.listing(spark, path).batches] == got
    logs.to_json(writes(spark, "z")).write.text(f"{path}/_draft-y")
    assert not logs.moved(spark, f"{path}/_draft-y", f"{path}/batch-{1:012d}") and ids(spark, path) == ["n0", "n1", "n2"]


def test_types(spark, tmp_path):
    lines = [
        '{"version":1,"timestamp":2,"event_type":"UPSERT_NODE","payload":{"id":5,"label":"L","properties":{}}}',
        '{"version":"1","timestamp":"2","event_type":"UPSERT_NODE","payload":{"id":"b","label":"L","properties":{}}}',
        '{"version":1,"timestamp":-4,"event_type":"UPSERT_NODE","payload":{"id":"c","label":"L","properties":{}}}',
        '{"version":1,"timestamp":2,"event_type":"UPSERT_NODE","payload":{"id":"d","label":"L","properties":[1]}}',
        '{"version":1,"timestamp":2,"event_type":"UPSERT_NODE","payload":{"id":"e","label":"L","properties":{"name":"E"}},"more":1}',
        '{"version":1.5,"timestamp":2,"event_type":"DELETE_NODE","payload":{"id":"e"}}',
        '{"version":1,"timestamp":2,"event_type":"DELETE_NODE"}',
        '{"version":1,"timestamp":2,"event_type":"LINK_NODES","payload":{"from_id":"e","to_id":"f","relationship":"R"}}',
        '{"version":1,"timestamp":2,"event_type":"LINK_NODES","payload":{"from_id":"e","to_id":"g","relationship":"R","properties":null}}',
        '{"version":1,"timestamp":2,"event_type":"DELETE_EDGES","payload":{"from_id":"e","direction":3}}',
        '\t {"version":4294967295,"timestamp":2,"event_type":"LINK_NODES","payload":{"from_id":"e","to_id":"h","relationship":"R"}} \r',
        "[1]", "7", "null", "",
    ]
    (tmp_path / "events.jsonl").write_text("\n".join(lines))
    g = state.fold(logs.read(spark, str(tmp_path)))
    assert [(r.id, r.name) for r in g.nodes.collect()] == [("e", "E")]
    assert sorted((r.from_id, r.to_id) for r in g.edges.collect()) == [("e", "f"), ("e", "h")]


def test_snapshot_reads_the_tail_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"), snapshot_every=3)
    for k in range(2):
        e.upsert_node(f"n{k}", "Entity", {"name": f"v{k}"})
    e.link_nodes("n0", "n1", "R")  # the third batch: a snapshot follows
    assert [m.upto for _, m in [e.snapshots.latest(logs.listing(spark, e.path))]] == [2]
    e.delete_node("n1")
    e.upsert_node("n0", "Entity", {"name": "again"})
    files = {f.split("/log/")[1] for f in e.graph.nodes.inputFiles() + e.graph.edges.inputFiles()}
    assert {f.split("/")[0] for f in files} == {"_state", "batch-000000000003", "batch-000000000004"}
    assert [(r.id, r.name) for r in e.graph.nodes.collect()] == [("n0", "again")] and e.graph.edges.count() == 0
    # a log that was rewritten, or whose plain files grew, does not begin with the snapshot
    listed = logs.listing(spark, e.path)
    assert not Mark("elsewhere", listed.files, 2).begins(listed) and not Mark(listed.folder, (("x", 1),), 2).begins(listed)
    e.compact(str(tmp_path / "archive"))
    assert snapshot.current(spark, e.path, Snapshots(spark, f"{e.path}/_state")).nodes.count() == 1


def test_indexes_follow(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"), embedder=embed.HashingEmbedder(16))
    where = str(tmp_path / "index")
    assert e.search({"text": "zebra"}, index=e.index(where)).count() == 0
    e.reconcile(spark.createDataFrame([("a.py", "def zebra():\n    return 1\n")], "path string, content string"), NOW)
    hits = e.search({"text": "zebra"}, index=e.index(where)).collect()
    assert hits[0].id == "a.py:zebra" and [r.id for r in hits] == [r.id for r in e.search({"text": "zebra"}).collect()]
    e.reconcile(spark.createDataFrame([("a.py", "def lion():\n    return 1\n")], "path string, content string"), NOW + 1)
    index = e.index(where)
    assert index[0].search("zebra", 5).count() == 0 and index[0].search("lion", 5).count() == 1
    assert {r.node_id for r in index[1].chunks().collect()} == {r.id for r in e.graph.nodes.where("embedding is not null").collect()} != set()
    generations = index[0].generations()
    assert e.index(where)[0].generations() == generations  # nothing new, nothing written
    e.compact(str(tmp_path / "archive"))
    fresh = TextIndex(spark, str(tmp_path / "fresh"))
    index = e.index(where)[0]
    assert len(index.generations()) == len(generations) + 1 and index.search("lion", 5).count() == 1
    assert fresh.search("lion", 5).count() == 0


def test_empty_indexes_answer(spark, tmp_path):
    text, vectors = TextIndex(spark, str(tmp_path / "t")), VectorIndex(spark, str(tmp_path / "v"))
    none = spark.createDataFrame([], "doc_id string, field string, text string")
    assert text.search("a", 3).count() == 0 and vectors.nearest([1.0], 3).count() == 0
    text.add(none)
    text.remove(none)
    vectors.remove(spark.createDataFrame([("x",)], "node_id string"))
    assert text.search("a", 3).count() == 0 and vectors.chunks().count() == 0
    vectors.add(spark.createDataFrame([], CHUNKS))
    assert vectors.nearest([1.0], 3).count() == 0


def test_references_wait(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "log"))
    take = lambda k, **files: e.reconcile(spark.createDataFrame([(f"{n}.py", t) for n, t in files.items()], "path string, content string"), NOW + k)
    calls = lambda: {(r.from_id, r.to_id) for r in e.graph.edges.where("relationship = 'CALLS'").collect()}
    assert take(0, user="def run():\n    return later()\n")["edges_pending"] == 1 and calls() == set()
    take(1, maker="def later():\n    return 1\n")
    assert calls() == {("user.py:run", "maker.py:later")}
    take(2, maker=None)
    assert calls() == set() and {r.name for r in e.queue.read().collect()} == {"later"}
    take(3, one="def later():\n    return 1\n", two="def later():\n    return 2\n")
    assert calls() == set()  # two alike: it waits
    take(4, two=None)
    assert calls() == {("user.py:run", "one.py:later")} and e.queue.read().count() == 0


def test_sync_keeps_what_is_there(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "big.py").write_text("def f():\n    return 1\n")
    (root / "same.py").write_text("def g():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "log"))
    assert e.sync(str(root), NOW)["upserted_nodes"] == 4
    (root / "big.py").write_text("def f():\n    return 1\n" + "#" * 1_100_000)
    (root / "same.py").touch()
    assert e.sync(str(root), NOW + 1) == {"upserted_nodes": 0, "deleted_nodes": 0, "linked_edges": 0, "edges_pending": 0}
    assert {r.id for r in e.graph.nodes.collect()} == {"big.py", "big.py:f", "same.py", "same.py:g"}


def test_quiet_paths(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()

    def drop(name, *paths):
        (tmp_path / "x").write_text("\n".join(paths))
        (tmp_path / "x").rename(source / name)

    drop("1", "a", "b", "a")
    stream = spark.readStream.schema("path string").csv(str(source))
    query = tail.debounced(stream, lambda batch: seen.extend((r.path, r.changes) for r in batch.collect()), str(tmp_path / "c"), seconds=1.0)
    try:
        end = time.time() + 90
        while len(seen) < 2 and time.time() < end:
            time.sleep(0.5)
        assert sorted(seen) == [("a", 2), ("b", 1)]
        drop("2", "b")
        while len(seen) < 3 and time.time() < end + 60:
            time.sleep(0.5)
        assert seen[2:] == [("b", 1)]
    finally:
        query.stop()


def test_nearest_of_odd_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.5]), ("d", [0.0, 1.0, 9.0]), ("e", [])], "id string, vec array<float>")
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [2.0, None])], "query_id int, vec array<float>")
    got = {(r.query_id, r.id): r.sim for r in dense.nearest_many(vectors, queries, 9).collect()}
    assert got == {(1, "a"): 1.0, (1, "c"): 0.5, (1, "d"): 2.0, (1, "e"): 0.0, (3, "a"): 2.0, (3, "c"): 1.0, (3, "d"): 0.0, (3, "e"): 0.0}
    assert np.isclose(sum(got.values()), 6.5)

import json
import random

from pyspark.sql import functions as F

from graphloom.operators import state
from graphloom.plans.graph import Graph, reached, run
from graphloom.plans.schema import LOG, Query, RequestError
from graphloom.sources import log as logs

NAMES = [c.split()[0] for c in LOG.split(", ")]


def frame(spark, events):
    rows = [tuple(e.get(n) for n in NAMES) for e in events]
    return spark.createDataFrame(rows, LOG)


def random_log(seed, n=120):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a, b = (f"n{r.randrange(8)}" for _ in range(2))
        base = {"seq": k, "version": 1, "timestamp": k}
        out.append(
            r.choice(
                [
                    base | {"event_type": "UPSERT_NODE", "id": a, "label": r.choice(["Entity", "Workspace", "Scratchpad", "File"]), "properties": json.dumps({"name": f"x{k}", "status": "idle"})},
                    base | {"event_type": "LINK_NODES", "from_id": a, "to_id": b, "relationship": "R", "properties": "{}"},
                    base | {"event_type": "LINK_NODES", "from_id": a, "to_id": b, "relationship": "R", "properties": "{}"},
                    base | {"event_type": "DELETE_NODE", "id": a},
                    base | {"event_type": "DELETE_EDGES", "from_id": a, "direction": r.choice(["outbound", "inbound", "both", "odd"])},
                    base | {"event_type": "DELETE_NODE", "id": a, "label": "L", "properties": "{}"},
                ]
            )
        )
    return out


def replay(events):
    nodes, edges = {}, []
    for e in events:
        kind = e["event_type"]
        if kind == "UPSERT_NODE":
            nodes[e["id"]] = json.loads(e["properties"])["name"]
        elif kind == "LINK_NODES":
            edges.append((e["from_id"], e["to_id"], e["seq"]))
        elif kind == "DELETE_NODE" and "label" not in e:
            nodes.pop(e["id"], None)
            edges = [x for x in edges if e["id"] not in x[:2]]
        elif kind == "DELETE_EDGES":
            d, i = e["direction"], e["from_id"]
            edges = [x for x in edges if not (x[0] == i and d != "inbound" or x[1] == i and d != "outbound")]
    return nodes, sorted(edges)


def test_fold_is_replay(spark):
    for seed in range(4):
        events = random_log(seed)
        g = state.fold(frame(spark, events))
        nodes, edges = replay(events)
        assert {r.id: r.name for r in g.nodes.collect()} == nodes
        assert sorted((r.from_id, r.to_id, r.seq) for r in g.edges.collect()) == edges


def test_synthesize_round_trip(spark):
    g = state.fold(frame(spark, random_log(9)))
    again = state.fold(state.synthesize(g))
    assert sorted(map(str, g.nodes.drop("seq").collect())) == sorted(map(str, again.nodes.drop("seq").collect()))
    assert sorted(map(str, g.edges.drop("seq").collect())) == sorted(map(str, again.edges.drop("seq").collect()))


def test_coercion(spark):
    props = json.dumps({"name": 5, "status": ["x"], "last_modified": -1, "entity_type": "ignored", "embedding": [[0.5, 0.25]]})
    events = [{"seq": 1, "event_type": "UPSERT_NODE", "id": "a", "label": "Odd", "properties": props}, {"seq": 2, "event_type": "UPSERT_NODE", "id": "b", "label": "Workspace", "properties": '{"closed_at":"3"}'}]
    a, b = state.fold(frame(spark, events)).nodes.orderBy("id").collect()
    assert (a.label, a.entity_type, a.status, a.last_modified, a.name, a.embedding) == ("Entity", "Odd", "active", 0, "", [[0.5, 0.25]])
    assert (b.label, b.status, b.closed_at, b.description) == ("Workspace", "active", None, "")


def test_log_files(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.read(spark, path).count() == 0
    events = random_log(3, 40)
    logs.append(frame(spark, events[:20]), path + "/a")
    lines = ['{"version":1,"timestamp":5,"event_type":"DELETE_NODE","payload":{"id":"zz"}}', "", "{not json", "  "]
    (tmp_path / "log" / "broken.jsonl").write_text("\n".join(lines))
    got = logs.read(spark, str(tmp_path / "log" / "broken.jsonl"))
    assert [(r.event_type, r.id) for r in got.collect()] == [("DELETE_NODE", "zz")]
    one = spark.createDataFrame([tuple(e.get(n) for n in NAMES) for e in events], LOG)
    target = str(tmp_path / "one")
    logs.to_json(one.coalesce(1).orderBy("seq")).write.text(target)
    back = logs.read(spark, target).orderBy("seq").collect()
    assert [(r.event_type, r.id, r.from_id) for r in back] == [(e["event_type"], e.get("id"), e.get("from_id")) for e in events]
    logs.rewrite(one.where("event_type = 'LINK_NODES'"), target)


def bfs(edges, seeds, depth):
    seen, level = set(seeds), set(seeds)
    for _ in range(min(depth, 5)):
        level = {b for a, b in edges if a in level} - seen
        seen |= level
    return seen


def test_traversal(spark):
    r = random.Random(5)
    edges = [(f"v{r.randrange(30)}", f"v{r.randrange(30)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(7)]
    e = spark.createDataFrame([(a, b, "R") for a, b in edges], "from_id string, to_id string, relationship string")
    seeds = spark.createDataFrame([("v1",), ("c0",)], "id string")
    both = edges + [(b, a) for a, b in edges]
    for direction, steps in (("outbound", edges), ("inbound", [(b, a) for a, b in edges]), ("both", both), ("odd", edges)):
        for depth in (0, 1, 3, 9):
            assert {x.id for x in reached(seeds, e, "R", direction, depth).collect()} == bfs(steps, {"v1", "c0"}, depth)


def test_requests(spark):
    for bad in ({"match": {"colour": "x"}}, {"traverse": {}}, {"limit": "3"}, {"where": {"edge_to": {"id": "a"}}}, {"retrieval_mode": "half"}):
        try:
            Query.of(bad)
            raise AssertionError(bad)
        except RequestError:
            pass
    nodes = spark.createDataFrame([("a", "Entity", "File", "active", "A", "", "")], "id string, label string, entity_type string, status string, name string, content string, metadata string")
    edges = spark.createDataFrame([("a", "ghost", "R")], "from_id string, to_id string, relationship string")
    g = Graph(nodes, edges)
    assert run(g, {"traverse": {"relationship": "R"}, "return": ["id"]}).collect()[0].id == "a"
    assert run(g, {"return": []}).columns == []
    assert run(g, {"match": {"id": "a", "status": "no"}}).count() == 1
    assert run(g, {"aggregate": {"group_by": "type", "count": False}}).select(F.col("count")).first()[0] == 1

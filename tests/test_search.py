from graphloom.operators import bm25, code, dense, markdown, rerank
from graphloom.operators.rerank import chunked, diversify, path_similarity, snippet


def post(spark, rows):
    return bm25.postings(spark.createDataFrame(rows, "doc_id string, field string, text string"))


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_bm25(spark):
    p = post(spark, [("north", "content", "green boats leave before dawn with cold nets and warm bread"), ("south", "content", "boats carry salt"), ("west", "content", "cold nets dry")])
    assert ids(bm25.search(p, "cold nets", 10)) == ["west", "north"]
    # a name outweighs any number of mentions
    p = post(spark, [("m1", "name", "harbour"), ("m1", "content", "where boats lie in winter"), ("m2", "name", "tideTable"), ("m2", "content", "harbour " * 5)])
    assert ids(bm25.search(p, "harbour", 10))[0] == "m1"
    p = post(spark, [("k1", "name", "migrateBoats"), ("k2", "name", "countSails")])
    assert ids(bm25.search(p, "migrated", 5)) == ["k1"] and ids(bm25.search(p, "", 5)) == []


def test_nearest(spark):
    c = spark.createDataFrame([("east", 0, [0.0, 1.0]), ("north", 0, [1.0, 0.0]), ("between", 0, [0.8, 0.6])], "node_id string, chunk_idx int, vec array<float>")
    assert [r.node_id for r in dense.nearest(c, [1.0, 0.0], 3).collect()] == ["north", "between", "east"]


def test_diversify():
    hits = [("maps/coast.py::draw", 8.0), ("maps/coast.py::fill", 7.5), ("maps/coast.py::mark", 7.0), ("crew/roster.py::list", 6.0)]
    assert diversify(hits, 1.0) == hits
    assert "crew/roster.py::list" in [i for i, _ in diversify(hits, 0.5)[:3]]
    assert [i for i, _ in diversify(hits, 0.0)][:2] == ["maps/coast.py::draw", "crew/roster.py::list"]
    pairs = (("maps/a.py", "maps/a.py"), ("maps/a.py", "maps/b.py"), ("maps/a.py", "crew/a.py"), ("a.py", "b.py"))
    assert [path_similarity(*p) for p in pairs] == [1.0, 0.5, 0.0, 0.0]


def test_snippets_and_chunks():
    assert snippet("", "x") == "" and snippet("low tide", "") == "low tide"
    assert "mast_height" in snippet("def rig():\n    sail_area = 12\n    mast_height = 9\n", "sail_area mast_height")
    assert len(rerank.segments("bow\nbeam\nstern\nkeel")) == 4 and len(rerank.segments("Cast off. Row!\n\nWhere to?")) == 3

    def count(t):
        return len(t.split())

    assert chunked("bow stern", count) == ["bow stern"]
    text = "\n\n".join(f"day{i} " + "rowed " * 30 + "home." for i in range(30))
    parts = chunked(text, count, 100)
    assert all(f"day{i}" in " ".join(parts) for i in range(30)) and len(parts) > 5


def test_markdown(spark):
    files = [
        ("log.md", "# Voyage\n\nOut\n\n# Voyage\n\nBack by `steer`, see maps/coast.rs\n"), ("t.md", "# Deck\n\n## Bow\n\nx\n\n# Hold\n"),
        ("s.md", "Crew\n=====\n\nCook\n-----\n"), ("n.txt", "# no"), ("e.md", ""),
    ]
    got = {r.id: r for r in markdown.parse(spark.createDataFrame(files, "path string, content string")).collect()}
    assert set(got) == {"log.md:Voyage", "log.md:Voyage:2", "t.md:Deck", "t.md:Bow", "t.md:Hold", "s.md:Crew", "s.md:Cook"}
    assert got["log.md:Voyage:2"].inline_code_refs == ["steer"] and got["log.md:Voyage:2"].file_path_refs == ["maps/coast.rs"]
    assert "Bow" in got["t.md:Deck"].content and "Hold" not in got["t.md:Deck"].content
    assert (got["s.md:Crew"].level, got["s.md:Cook"].level) == (1, 2)


def test_code():
    py = code.python("class Helm:\n    def turn(self):\n        return swing(self.wheel.spin())\nimport math\n")
    assert [(d[0], d[1], d[2]) for d in py.declarations] == [("Class", "Helm", 1), ("Function", "turn", 2)]
    assert {(r[0], r[1], r[4]) for r in py.references} == {("CALLS", "swing", "turn"), ("CALLS", "spin", "turn"), ("IMPORTS", "math", None)}
    ts = code.typescript("import { rope, knot } from './deck';\nconst tie = (n: number): number => { return rope(n); };\nclass Winch {\n  haul() { return tie(2); }\n}\n")
    assert {(d[0], d[1]) for d in ts.declarations} == {("Function", "tie"), ("Class", "Winch"), ("Function", "haul")}
    assert {("CALLS", "rope"), ("CALLS", "tie"), ("IMPORTS", "rope"), ("IMPORTS", "knot")} <= {r[:2] for r in ts.references}
    rs = code.rust("use deck::rope;\npub struct Keel { length: u8 }\npub fn float(weight: &str) -> u8 {\n    weigh(weight)\n}\n")
    assert {(d[0], d[1]) for d in rs.declarations} == {("Class", "Keel"), ("Function", "float")}
    assert {("IMPORTS", "deck::rope"), ("CALLS", "weigh")} <= {r[:2] for r in rs.references}
    assert code.python("def sink(").declarations == []

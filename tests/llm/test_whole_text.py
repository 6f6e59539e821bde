"""Terms are weighed over whole texts, short ones and those of entities in one document, too."""

from graphloom.llm import private


def test_terms_of_the_whole_text(spark):
    far = "common words are everywhere here " * 20
    texts = [f"common words are everywhere number{i % 3} here" for i in range(200)]
    texts += [f"Ana {far} 李明 éa@x.org b@y.org common {far} Li", "Bo 1.2.3.4 common here", "Bo 1.2.3.4 common here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(texts[r.doc_id][t.start : t.end], t.action) for t in r.terms] for r in private.find(docs).collect()}
    assert [t for t, _ in got[200]] == ["Ana", "李明", "é", "Li"] and all(got[k] == [("Bo", "remove")] for k in (201, 202))
    assert not any(got[k] for k in range(200))
    clean = {r.doc_id: r.text for r in private.sanitise(docs).collect()}
    assert "Ana" not in clean[200] and "Li" not in clean[200] and clean[200].count("[EMAIL]") == 2 and clean[0] == texts[0]


def test_places(spark):
    texts = ["a@b.c", "x a@b.c y 1.2.3.4 zé\nq", "né 😀 d@e.fg, ok. 4111 1111 1111 1111"]
    scanned = private._scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = private._places(scanned).join(scanned.select("doc_id", "text_hash"), "text_hash").orderBy("doc_id", "start").collect()
    assert [(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in found] == [(1, "x"), (1, "y"), (1, "zé"), (1, "q"), (2, "né"), (2, "ok")]
    assert all(texts[r.doc_id][r.start : r.end].lower() == r.term for r in found)

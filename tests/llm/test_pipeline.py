import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        sizes.append(docs.count())
        assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert sizes[1] >= 0.95 * sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in out) == want


def test_clashing_columns_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'keep' as pattern", "'keep' as score", "'keep' as h", "'keep' as bucket")
    odd = spark.createDataFrame([(None, "some words are here", None, None, 0), (-1, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'keep' as pattern", "'keep' as score", "'keep' as h", "'keep' as bucket")
    docs = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        assert docs.where("pattern <> 'keep' or score <> 'keep' or h <> 'keep' or bucket <> 'keep'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Null and repeated doc_ids: of equal rows and near copies one stays, contaminated rows go."""
    r = random.Random(4)

    def prose(n):
        return " ".join("".join(r.choice("aeioubcdst") for _ in range(r.randrange(3, 9))) for _ in range(n))

    item = prose(60)
    one, two, three, four = prose(80), prose(80), prose(80), prose(80)
    near = one.rsplit(" ", 1)[0]
    rows = [(None, one), (None, one), (None, near), (None, two), (5, three), (5, three), (5, two), (6, one), (7, f"{prose(20)} {item}"), (None, f"{prose(20)} {item}"), (8, four), (8, f"{item} {prose(20)}"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    got = [(x.doc_id, x.text) for x in kept.collect()]
    assert kept.columns == docs.columns
    assert (6, one) in got and sum(t in (one, near) for _, t in got) == 1 and sum(t == two for _, t in got) == 1
    assert got.count((5, three)) == 1 and len(got) == 9
    clean = [(x.doc_id, x.text) for x in corpus_pipeline.decontaminate(spark, kept, str(tmp_path)).collect()]
    assert sorted(clean, key=repr) == sorted([x for x in got if item not in (x[1] or "")], key=repr) and len(clean) == 6


def test_run_on_nothing(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

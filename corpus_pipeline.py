"""From raw documents to token files, in five stages of the corpus operators.

Each stage takes what the one before it kept and returns the columns of `documents`; the last
returns what its files say of each document. The mix reads some documents twice: it returns these
rows twice, and the token files hold them twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table, without, written
from graphloom.llm.decontaminate import contaminated
from graphloom.llm.language import identify, learn
from graphloom.llm.minhash import Plan, near_duplicates
from graphloom.llm.mixing import Recipe, choose, plan, with_patterns
from graphloom.llm.token_output import binary_output


def _held(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns`, and whole rows as `_doc`, so that no column of `docs` meets one that a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; without labelled rows to learn from, all of them."""
    model = learn(docs)
    return docs if model is None else identify(_held(docs, "doc_id", "text"), model).where("accepted").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) the document of least id.

    Rows without doc_id and rows whose doc_ids repeat are told apart by their texts: they go by
    ids of their own here, and of those that are equal in both one row stays.
    """
    plan = Plan(words=5, num=80, den=100)
    odd = written(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "odd-ids")
    if not odd.take(1):
        groups = near_duplicates(docs, plan).where("not kept").select("doc_id")
        return docs.join(written(groups, "duplicates"), "doc_id", "left_anti").select(*docs.columns)
    # ids past all others, so that of a group a document with an id of its own stays
    own = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    told = odd.select(F.col("doc_id").alias("_odd"), F.lit(True).alias("_is_odd"))
    rows = _held(docs, "doc_id", "text").join(told, F.col("doc_id").eqNullSafe(F.col("_odd")), "left")
    plain = rows.where("_is_odd is null").select("_doc", "text", F.col("doc_id").alias("_id"))
    rest = rows.where("_is_odd").select("_doc", "text", own.alias("_id")).dropDuplicates(["_id"])
    both = written(plain.unionByName(rest), "named")
    groups = near_duplicates(both.select(F.col("_id").alias("doc_id"), "text"), plan)
    gone = written(groups.where("not kept").select(F.col("doc_id").alias("_id")), "duplicates")
    return both.join(gone, "_id", "left_anti").select("_doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; they are told by doc_id and text."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, written(found.select("doc_id", "text_hash").distinct(), "contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: not at all, once or twice."""
    recipe, members = Recipe(), F.array("source")
    sized = written(with_patterns(docs.select("doc_id", "text", "source"), members, recipe).select("doc_id", "pattern", "size", "h"), "sized")
    chosen = choose(with_patterns(_held(docs, "doc_id", "text", "source"), members, recipe), plan(sized, recipe)).where("times > 0")
    return chosen.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("_doc.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back."""
    import public_tokenizers

    return binary_output(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_output),
]

#: Signatures, alignments and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)

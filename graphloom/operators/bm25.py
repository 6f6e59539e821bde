"""Field-weighted BM25 over DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import raw_tokens, stem, token_count, tokens
from graphloom.operators.rerank import words
from graphloom.sources.folders import work_folder, written

#: Saturation, length normalisation, weights of fields.
K1, B = 1.2, 0.75
WEIGHTS = {"name": 3.0, "doc": 2.0, "content": 1.0}
#: Bytes of texts that a task takes apart, on average.
PART_BYTES = 4_000_000


def measured(texts: DataFrame) -> DataFrame:
    """(field, doc_id, token, tf, dl) of `texts` (doc_id, field, text); empty texts have none.

    Texts are dealt by document before they are taken apart, so tokens are counted where they are and never
    shuffled. They are counted before they are stemmed, so that stems are worked out once for each
    distinct token of a document; stems don't change lengths. Parts follow the texts' bytes, which are summed
    up first, as a task holds a row for each distinct token of its documents.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    dealt = texts.select("field", "doc_id", "text").repartition(parts, "field", "doc_id").select("field", "doc_id", raw_tokens(F.col("text")).alias("raw"))
    sized = dealt.withColumn("dl", F.sum(F.size("raw").cast("long")).over(Window.partitionBy("field", "doc_id")))
    counted = sized.select("field", "doc_id", "dl", F.explode("raw").alias("raw")).groupBy("field", "doc_id", "dl", "raw").agg(F.count("*").alias("n"))
    return counted.groupBy("field", "doc_id", "dl", stem(F.col("raw")).alias("token")).agg(F.sum("n").alias("tf")).select("field", "doc_id", "token", "tf", "dl")


def postings(texts: DataFrame) -> DataFrame:
    """`measured` without lengths."""
    return measured(texts).select("field", "doc_id", "token", "tf")


def text_lengths(texts: DataFrame) -> DataFrame:
    """`lengths` of `texts`, without their postings."""
    size = spread(texts.select("field", "doc_id", "text"), "text", "field", "doc_id").select("field", "doc_id", token_count(F.col("text")).cast("long").alias("n"))
    # empty ones go last: a filter before would be worked out where texts are dealt, too
    return size.groupBy("field", "doc_id").agg(F.sum("n").alias("dl")).where("dl > 0")


def lengths(post: DataFrame) -> DataFrame:
    """(field, doc_id, dl)."""
    return post.groupBy("field", "doc_id").agg(F.sum("tf").alias("dl"))


def stats(length: DataFrame) -> DataFrame:
    """(field, n, avgdl): one row a field."""
    return length.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def terms(text: str) -> dict[str, int]:
    """The query's tokens, each with how often it occurs."""
    return dict(Counter(words(text)))


#: Gives, for the terms asked for, statistics (field, n, avgdl) of a whole corpus and hits (field, doc_id, token, tf, dl).
Source = Callable[[dict[str, int]], tuple[DataFrame, DataFrame]]


def spread(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """`texts` dealt by `keys` in parts of about `PART_BYTES` of their column `text`, where one part holds well
    over a core's share: taking texts apart is what costs. Parts are judged by what they hold, which is summed up
    first, as of a file's splits only those hold rows that a row group lies in."""
    n = texts.sparkSession.sparkContext.defaultParallelism
    held = texts.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length(text)).alias("bytes"))
    most, size = (x or 0 for x in held.agg(F.max("bytes"), F.sum("bytes")).first())
    return texts.repartition(max(n, -(-size // PART_BYTES)), *keys) if most * n > 1.25 * size else texts


def of_postings(post: DataFrame) -> Source:
    length = lengths(post)
    return lambda asked: (stats(length), post.where(F.col("token").isin(*asked)).join(length, ["field", "doc_id"]))


def of_texts(texts: DataFrame) -> Source:
    """Straight from texts (doc_id, field, text), in one pass over them: stems don't change lengths,
    and no rule of stemming touches a word's first two letters, so only words that begin like a term
    are kept and stemmed. What is kept is written to the shared folder, and so are hits, which are counted and scored."""

    def source(asked: dict[str, int]) -> tuple[DataFrame, DataFrame]:
        spark, path = texts.sparkSession, work_folder(texts.sparkSession, "tokens")
        starts = sorted({t[:2] for t in asked})
        cut = spread(texts.select("field", "doc_id", "text"), "text", "field", "doc_id").select("field", "doc_id", raw_tokens(F.col("text")).alias("raw"))
        begins = F.filter("raw", lambda w: reduce(lambda x, y: x | y, [F.lit(False), *[w.startswith(t) for t in starts]]))
        cut.select("field", "doc_id", F.size("raw").cast("long").alias("n"), begins.alias("raw")).write.parquet(path)
        kept = spark.read.schema("field string, doc_id string, n bigint, raw array<string>").parquet(path).where("n > 0")
        found = kept.select("field", "doc_id", F.explode("raw").alias("raw")).groupBy("field", "doc_id", "raw").agg(F.count("*").alias("n"))
        stemmed = found.select("field", "doc_id", stem(F.col("raw")).alias("token"), "n").where(F.col("token").isin(*asked))
        length = kept.groupBy("field", "doc_id").agg(F.sum("n").alias("dl"))
        hits = stemmed.groupBy("field", "doc_id", "token").agg(F.sum("n").alias("tf")).join(length, ["field", "doc_id"])
        return stats(length), written(hits, "hits")

    return source


def field_scores(source: Source | DataFrame, text: str) -> DataFrame:
    """(field, doc_id, score) of all documents with a query token; a DataFrame is one of postings.

    Statistics cover the whole corpus; only the postings of query tokens meet them.
    Statistics are one row a field and terms one row a query token, so both are broadcast.
    """
    asked = terms(text)
    corpus, found = (of_postings(source) if isinstance(source, DataFrame) else source)(asked)
    weights = found.sparkSession.createDataFrame(sorted(asked.items()), "token string, weight int")
    hits = found.join(F.broadcast(weights), "token")
    df = hits.groupBy("field", "token").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), ["field", "token"]).join(F.broadcast(corpus), "field")
    return scored.groupBy("field", "doc_id").agg(F.sum(F.col("weight") * _part()).alias("score"))


def _part() -> Column:
    """What one occurrence of a term in a request is worth to a document."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def pool(top_k: int) -> int:
    """Candidates that each side of a search brings."""
    return max(50, 5 * top_k)


def by_score(score: str = "score") -> Column:
    """Falling scores to nine places: sums of the same parts tie, in whatever order they were added."""
    return F.round(score, 9).desc()


def search(source: Source | DataFrame, text: str, limit: int) -> DataFrame:
    """(doc_id, score), best first: of each field its best max(20, 3 limit), summed by field weight."""
    scores = field_scores(source, text)
    total = None
    for field, weight in WEIGHTS.items():
        best = scores.where(F.col("field") == field).orderBy(by_score(), "doc_id").limit(max(20, 3 * limit))
        part = best.select("doc_id", (F.col("score") * weight).alias("score"))
        total = part if total is None else total.unionAll(part)
    return total.groupBy("doc_id").agg(F.sum("score").alias("score")).orderBy(by_score(), "doc_id").limit(limit)


#: Postings that a block of documents holds about, and (request, token) rows of a block of requests.
BLOCK_POSTINGS, BLOCK_TERMS = 500_000, 50_000


def _dealt(rows: int, size: int) -> int:
    """Blocks that so many rows come to."""
    return max(1, -(-rows // size))


def search_many(post: DataFrame, corpus: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """(request_id, doc_id, score, place) of each request (request_id, text): what `search` gives it alone.

    post: postings with dl (field, doc_id, token, tf, dl). corpus: (field, n, avgdl). A request without
    tokens has no hits; requests of one id are one text. Requests of the same tokens are answered once.
    Blocks of requests meet blocks of documents, and a task adds scores up in place and hands on the best
    of each request and field, so that hits are never rows of their own.
    """
    id_type, most = requests.schema["request_id"].dataType.simpleString(), max(20, 3 * limit)
    each = requests.select("request_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("request_id", "token").agg(F.count("*").alias("weight"))
    bags = each.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("bag")).withColumn("bag_id", F.sha2(F.to_json("bag"), 256))
    bags = written(bags, "requests")
    asked = written(bags.dropDuplicates(["bag_id"]).select("bag_id", F.explode("bag").alias("t")).select("bag_id", "t.token", "t.weight"), "asked")
    found = post.where(F.col("field").isin(*WEIGHTS)).join(asked.select("token").distinct(), "token", "left_semi").select("field", "doc_id", "token", "tf", "dl")
    found = written(found, "found")
    df = found.groupBy("field", "token").agg(F.count("*").alias("df"))
    worth = found.join(df, ["field", "token"]).join(F.broadcast(corpus), "field").select("field", "doc_id", "token", _part().alias("part"))
    terms_n, docs_n = (_dealt(df_.count(), size) for df_, size in ((asked, BLOCK_TERMS), (found, BLOCK_POSTINGS)))
    docs_n = max(docs_n, found.sparkSession.sparkContext.defaultParallelism // terms_n)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    docs = worth.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(docs_n)).cast("int").alias("docs")).select("*", every(terms_n).alias("terms"))
    wanted = asked.select("*", F.pmod(F.xxhash64("bag_id"), F.lit(terms_n)).cast("int").alias("terms")).select("*", every(docs_n).alias("docs"))

    def best_of(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_of_block(left, right, most)

    scores = docs.groupBy("docs", "terms").cogroup(wanted.groupBy("docs", "terms")).applyInArrow(best_of, "bag_id string, field string, doc_id string, score double")

    def best(rows: DataFrame, most: int, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(by_score(), "doc_id"))
        return rows.withColumn("place", place).where(F.col("place") <= most)

    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("field")]
    total = best(scores, most, "bag_id", "field").groupBy("bag_id", "doc_id").agg(F.sum(F.col("score") * weight).alias("score"))
    answers = best(total, limit, "bag_id")
    return bags.select(F.col("request_id").cast(id_type).alias("request_id"), "bag_id").join(answers, "bag_id").select("request_id", "doc_id", "score", "place")


def _best_of_block(postings: pa.Table, asked: pa.Table, most: int) -> pa.Table:
    """(bag_id, field, doc_id, score) of what may be among the `most` best of each request and field: of
    documents that tie exactly, the first by id."""
    out = {"bag_id": [], "field": [], "doc_id": [], "score": []}
    types = {"bag_id": pa.string(), "field": pa.string(), "doc_id": pa.string(), "score": pa.float64()}
    if not postings.num_rows or not asked.num_rows:
        return pa.table({k: pa.array([], t) for k, t in types.items()})
    asked = asked.sort_by([("bag_id", "ascending"), ("token", "ascending")])
    bag_ids, starts = np.unique(asked["bag_id"].to_numpy(zero_copy_only=False), return_index=True)
    ends = [*starts[1:], asked.num_rows]
    words_, weights = asked["token"].to_pylist(), asked["weight"].to_numpy(zero_copy_only=False)
    for field in pc.unique(postings["field"]).to_pylist():
        rows = postings.filter(pc.equal(postings["field"], field)).sort_by([("token", "ascending"), ("doc_id", "ascending")])
        doc_ids = pc.unique(rows["doc_id"])
        doc_ids = doc_ids.take(pc.sort_indices(doc_ids))
        doc = pc.index_in(rows["doc_id"], doc_ids).to_numpy(zero_copy_only=False).astype(np.int64)
        part = rows["part"].to_numpy(zero_copy_only=False)
        tokens_, first = np.unique(rows["token"].to_numpy(zero_copy_only=False), return_index=True)
        span = {t: slice(a, b) for t, a, b in zip(tokens_, first, [*first[1:], rows.num_rows], strict=True)}
        total = np.zeros(len(doc_ids))
        for bag, a, b in zip(bag_ids, starts, ends, strict=True):
            spans = [(span[w], x) for w, x in zip(words_[a:b], weights[a:b], strict=True) if w in span]
            if not spans:
                continue
            for s, x in spans:
                total[doc[s]] += x * part[s]
            hit = np.unique(np.concatenate([doc[s] for s, _ in spans])) if len(spans) > 1 else doc[spans[0][0]]
            score = total[hit]
            total[hit] = 0.0
            if len(hit) > most:
                # what ties with the last place to nine digits stays, as places are given later
                near = score >= np.partition(score, -most)[-most] - 1e-9
                hit, score = hit[near], score[near]
            order = np.argsort(-score, kind="stable")
            hit, score = hit[order], score[order]
            new = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
            run = np.arange(len(score)) - np.repeat(new, np.diff([*new, len(score)]))
            hit, score = hit[run < most], score[run < most]
            out["bag_id"].append(pa.array([bag] * len(hit), "string"))
            out["field"].append(pa.array([field] * len(hit), "string"))
            out["doc_id"].append(doc_ids.take(pa.array(hit)))
            out["score"].append(pa.array(score))
    return pa.table({k: pa.chunked_array([x.cast(types[k]) for x in v], types[k]) for k, v in out.items()})


def node_fields(nodes: DataFrame) -> DataFrame:
    """(doc_id, field, text) of nodes by their kind; empty texts are left out.

    Sections, functions and classes: name, content, and for the latter two the metadata's comment;
    other entities: name and comment; workspaces: name, description as content; notes: both.
    """
    kind = F.when(F.col("label") == "Entity", F.col("entity_type")).otherwise(F.col("label"))
    comment = F.get_json_object("metadata", "$.docComment")
    code = kind.isin("Function", "Class")
    entity = F.col("label") == "Entity"
    content = F.when(kind == "Workspace", F.col("description")).when(code | kind.isin("Section", "Scratchpad"), F.col("content"))
    doc = F.when(entity & (kind != "Section"), comment)
    fields = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in (("name", F.col("name")), ("content", content), ("doc", doc))])
    return nodes.select(F.col("id").alias("doc_id"), F.explode(fields).alias("f")).select("doc_id", "f.field", "f.text").where("text <> ''")

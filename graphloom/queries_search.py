"""Queries of text functions, BM25, nearest neighbours and hybrid search, and the same in SQL."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import bm25, dense, rerank
from graphloom.operators import search as hybrid
from graphloom.operators.index import TextIndex
from graphloom.plans import demo
from graphloom.plans.graph import Graph
from graphloom.queries_graph import GRAPH_SQL
from graphloom.sources.folders import work_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}

ASKED = "thing reing haning erly thing"
NOW = 1706745600  # 2024-02-01T00:00:00Z

# --- tokens in SQL ---


def _step(word: str, rules: tuple) -> str:
    out = "case"
    for suffix, new, least, single, forbidden in rules:
        n = len(suffix)
        left = f"left({word}, length({word}) - {n})"
        bars = "".join(f" and not suffix({word}, '{e}')" for e in forbidden)
        value = f"{left} || '{new}'"
        if single:
            value = f"case when right({left}, 1) = substr({left}, length({left}) - 1, 1) and right({left}, 1) not in ('a', 'e', 'i', 'o', 'u') then left({left}, length({left}) - 1) else {left} end"
        out += f" when suffix({word}, '{suffix}') and length({word}) >= {least + n}{bars} then {value}"
    return f"{out} else {word} end"


def stems_sql(source: str) -> str:
    """CTEs from `source` (raw) to `stemmed` (raw, token)."""
    steps = f"s0 as (select distinct raw, raw as w from {source})"
    for k, rules in enumerate(fn.STEM_STEPS):
        steps += f", s{k + 1} as (select raw, {_step('w', rules)} as w from s{k} where regexp_full_match(raw, '[\\x00-\\x7F]{{4,}}'))"
    last = f"s{len(fn.STEM_STEPS)}"
    return f"{steps}, stemmed as (select raw, w as token from {last} union all select raw, w from s0 where not regexp_full_match(raw, '[\\x00-\\x7F]{{4,}}'))"


CAMEL_SQL = r"regexp_replace(regexp_replace(replace({}, '_', ' '), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '([\p{{Ll}}0-9])(\p{{Lu}})', '\1 \2', 'g')"


def raw_sql(source: str) -> str:
    """CTE raws (field, doc_id, raw), one row a token of `source` (field, doc_id, text)."""
    ends = r"regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}]+$', '', 'g')"
    pieces = rf"regexp_split_to_array({CAMEL_SQL.format('text')}, '[\s\p{{Z}}]+')"
    return f"raws as (select field, doc_id, lower({ends}) as raw from (select field, doc_id, unnest({pieces}) as w from {source}) where {ends} <> '')"


def postings_sql(source: str) -> str:
    return f"{raw_sql(source)}, {stems_sql('raws')}, post as (select field, doc_id, token, count(*) as tf from raws join stemmed using (raw) group by all), len as (select field, doc_id, sum(tf)::bigint as dl from post group by all), stat as (select field, count(*) as n, avg(dl) as avgdl from len group by field)"


def scores_sql(asked: str) -> str:
    terms = ", ".join(f"('{t}', {n})" for t, n in sorted(Counter(rerank.words(asked)).items()))
    return f"""terms(token, weight) as (values {terms}), hits as (select * from post join terms using (token)),
df as (select field, token, count(*) as df from hits group by all),
scores as (
  select field, doc_id, sum(weight * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as score
  from hits join df using (field, token) join len using (field, doc_id) join stat using (field) group by all
)"""


def pooled_sql(limit: int) -> str:
    parts = " union all ".join(f"(select doc_id, score * {w} as score from scores where field = '{f}' order by round(score, 9) desc, doc_id limit {max(20, 3 * limit)})" for f, w in bm25.WEIGHTS.items())
    return f"parts as ({parts}), lexical as (select doc_id as id, sum(score) as score from parts group by doc_id order by round(sum(score), 9) desc, id limit {limit})"


CORPUS_SQL = "corpus as (select 'd' || doc_id as doc_id, 'content' as field, text from documents where text <> '' union all select 'd' || p_partkey, 'name', p_name from part)"
PARTS_SQL = "parts_ as (select 'd' || p_partkey as doc_id, 'name' as field, p_name as text from part)"
DOCS_SQL = "docs_ as (select 'd' || doc_id as doc_id, 'content' as field, text from documents where text <> '')"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.corpus(spark, sf_dir).where("field = 'name'")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.corpus(spark, sf_dir).where("field = 'content'")


QUERIES["tokenize_tokens"] = lambda s, d: _parts(s, d).select("doc_id", F.explode(fn.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
SQL["tokenize_tokens"] = f"with {PARTS_SQL}, {raw_sql('parts_')}, {stems_sql('raws')} select doc_id, token, count(*) as n from raws join stemmed using (raw) group by all"
QUERIES["stem_tokens"] = lambda s, d: _docs(s, d).select(F.explode(fn.raw_tokens(F.col("text"))).alias("raw")).distinct().select("raw", fn.stem(F.col("raw")).alias("token"))
SQL["stem_tokens"] = f"with {DOCS_SQL}, {raw_sql('docs_')}, {stems_sql('raws')} select raw, token from stemmed"
QUERIES["camel_split"] = lambda s, d: demo.table(s, d, "part").select("p_partkey", fn.split_camel(F.concat_ws("_", F.regexp_replace("p_name", " ", ""), F.initcap("p_name"))).alias("parts")).select("p_partkey", F.translate("parts", "_", " ").alias("parts"))
SQL["camel_split"] = "select p_partkey, " + CAMEL_SQL.format("replace(p_name, ' ', '') || '_' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')") + " as parts from part"

QUERIES["bm25_postings"] = lambda s, d: bm25.postings(_docs(s, d)).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
SQL["bm25_postings"] = f"with {DOCS_SQL}, {postings_sql('docs_')} select token, count(*) as df, sum(tf)::bigint as cf from post group by token"
QUERIES["bm25_stats"] = lambda s, d: bm25.stats(bm25.text_lengths(demo.corpus(s, d))).select("field", "n", F.round("avgdl", 6).alias("avgdl"))
SQL["bm25_stats"] = f"with {CORPUS_SQL}, {postings_sql('corpus')} select field, n, round(avgdl, 6) as avgdl from stat"


def _topk(asked: str):
    return lambda s, d: bm25.field_scores(bm25.of_texts(_docs(s, d)), asked).orderBy(bm25.by_score(), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


def _topk_sql(asked: str) -> str:
    return f"with {DOCS_SQL}, {postings_sql('docs_')}, {scores_sql(asked)} select doc_id, round(score, 6) as score from scores order by round(scores.score, 9) desc, doc_id limit 10"


QUERIES["bm25_topk"], SQL["bm25_topk"] = _topk("thing erly"), _topk_sql("thing erly")
QUERIES["bm25_dup_query_token"], SQL["bm25_dup_query_token"] = _topk(ASKED), _topk_sql(ASKED)
_FIELDED = "red thing Reing"
QUERIES["bm25_fielded"] = lambda s, d: bm25.search(bm25.of_texts(demo.corpus(s, d)), _FIELDED, 50).select("doc_id", F.round("score", 6).alias("score"))
SQL["bm25_fielded"] = f"with {CORPUS_SQL}, {postings_sql('corpus')}, {scores_sql(_FIELDED)}, {pooled_sql(50)} select id as doc_id, round(score, 6) as score from lexical"



def _indexed(s: SparkSession, d: str) -> DataFrame:
    """A kept index: all but some documents, then these and others again, then some removed and put back."""
    index = TextIndex(s, work_folder(s, "text-index"))
    docs = demo.corpus(s, d)
    late = F.crc32("doc_id") % 10 == 0
    index.add(docs.where(~late).withColumn("text", F.when(F.crc32("doc_id") % 10 == 1, F.concat(F.lit("thing thing "), "text")).otherwise(F.col("text"))))
    index.add(docs.where(F.crc32("doc_id") % 10 < 2))
    index.remove(docs.where(F.crc32("doc_id") % 10 == 2).select("doc_id"))
    index.add(docs.where(F.crc32("doc_id") % 10 == 2))
    return index.search(_FIELDED, 50).select("doc_id", F.round("score", 6).alias("score"))


QUERIES["bm25_index_updates"], SQL["bm25_index_updates"] = _indexed, SQL["bm25_fielded"]

# --- vectors ---

_SIM = "list_sum(list_transform(list_zip(vec, q), lambda p: p[1]::double * p[2]::double))"
CHUNKS_SQL = f"""asked as (select embedding as q from embeddings where vec_id = 0),
sims as (select 'd' || (vec_id % 100) as node_id, (vec_id // 100)::int as chunk_idx, label, {_SIM.replace('vec,', 'embedding,')} as sim from embeddings, asked),
best as (select * from sims order by round(sim, 9) desc, node_id, chunk_idx limit 50)"""


def _nearest(s: SparkSession, d: str, n: int = 50) -> DataFrame:
    return dense.nearest(demo.chunks(s, d), demo.query_vector(s, d), n)


QUERIES["knn_topk"] = lambda s, d: _nearest(s, d).select("node_id", "chunk_idx", F.round("sim", 6).alias("sim"))
SQL["knn_topk"] = f"with {CHUNKS_SQL} select node_id, chunk_idx, round(sim, 6) as sim from best"
QUERIES["knn_maxsim"] = lambda s, d: dense.by_node(_nearest(s, d)).select("node_id", F.round("sim", 6).alias("sim"))
SQL["knn_maxsim"] = f"with {CHUNKS_SQL} select node_id, round(max(sim), 6) as sim from best group by node_id"


def _batch(s: SparkSession, d: str) -> DataFrame:
    """Each vector's ten nearest among all."""
    v = demo.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense.nearest_many(v, v.withColumnRenamed("id", "query_id"), 10).select("query_id", "id", F.round("sim", 6).alias("sim"))


QUERIES["knn_batch"] = _batch
SQL["knn_batch"] = f"""with pairs as (select a.vec_id as query_id, b.vec_id as id, {_SIM.replace('vec, q', 'a.embedding, b.embedding')} as sim from embeddings a, embeddings b)
select query_id, id, round(sim, 6) as sim from pairs qualify row_number() over (partition by query_id order by round(sim, 9) desc, id) <= 10"""


def _purity(s: SparkSession, d: str) -> DataFrame:
    v = demo.table(s, d, "embeddings").select(F.concat(F.lit("d"), (F.col("vec_id") % 100).cast("string")).alias("node_id"), F.floor(F.col("vec_id") / 100).cast("int").alias("chunk_idx"), "label")
    return _nearest(s, d).join(v, ["node_id", "chunk_idx"]).groupBy("label").agg(F.count("*").alias("n"))


QUERIES["knn_label_purity"] = _purity
SQL["knn_label_purity"] = f"with {CHUNKS_SQL} select label, count(*) as n from best group by label"
QUERIES["decay_scores"] = lambda s, d: demo.scratchpads(s, d).select("id", F.round(fn.decay(F.col("created_at"), NOW), 6).alias("weight"))
SQL["decay_scores"] = f"select 'note_' || event_id as id, round(exp(-0.05::double * greatest({NOW} - floor(epoch(ts))::bigint, 0) / 3600.0::double), 6) as weight from events"

# --- hybrid ---


def search_graph(s: SparkSession, d: str) -> Graph:
    """Documents as sections, functions and classes, named by parts of the same number; the star graph's
    edges between suppliers and parts carry over to them."""
    docs, parts = demo.table(s, d, "documents"), demo.table(s, d, "part")
    key = F.col("doc_id")
    kind = F.when(key % 3 == 0, "Section").when(key % 3 == 1, "Function").otherwise("Class")
    nodes = docs.join(parts, docs.doc_id == parts.p_partkey, "left").select(F.concat(F.lit("d"), key.cast("string")).alias("id"), F.lit("Entity").alias("label"), kind.alias("entity_type"), F.lit("active").alias("status"), F.coalesce("p_name", F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("content"), F.lit('{"line":1}').alias("metadata"), F.lit("").alias("description"), F.lit(None).cast("bigint").alias("created_at"))
    e = demo.table(s, d, "lineitem").select(F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("from_id"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("to_id"), F.when(F.col("l_suppkey") % 2 == 0, "MAPPED_TO").otherwise("IMPORTS").alias("relationship")).distinct()
    return Graph(nodes, e.withColumn("seq", F.lit(0).cast("bigint")))


_SEARCH_SQL = """sn as (select 'd' || doc_id as id, case doc_id % 3 when 0 then 'Section' when 1 then 'Function' else 'Class' end as type, coalesce(p_name, '') as name, coalesce(text, '') as content
  from documents left join part on p_partkey = doc_id),
sedges as (select distinct 'd' || l_partkey as from_id, 'd' || l_suppkey as to_id, case when l_suppkey % 2 = 0 then 'MAPPED_TO' else 'IMPORTS' end as relationship from lineitem),
corpus as (select id as doc_id, 'content' as field, content as text from sn where content <> '' union all select id, 'name', name from sn where name <> '')"""
_RRF_SQL = """lex as (select id, row_number() over (order by round(score, 9) desc, id) as r from lexical),
dense_ as (select node_id as id, max(sim) as sim from best group by node_id), sem as (select id, row_number() over (order by round(sim, 9) desc, id) as r from dense_),
fused as (select id, sum(1.0::double / (60 + r)) as score from (select * from lex union all select * from sem) group by id)"""


def _fusion_sql(asked: str) -> str:
    return f"with {_SEARCH_SQL}, {postings_sql('corpus')}, {scores_sql(asked)}, {pooled_sql(50)}, {CHUNKS_SQL}, {_RRF_SQL}"


def _fused(s: SparkSession, d: str) -> DataFrame:
    post = bm25.of_texts(bm25.node_fields(search_graph(s, d).nodes))
    sims = dense.by_node(_nearest(s, d))
    return hybrid.fused(hybrid.ranked(bm25.search(post, ASKED, 50), "score", "doc_id"), hybrid.ranked(sims, "sim", "node_id")).select("id", F.round("score", 9).alias("score"))


QUERIES["rrf_fusion"] = _fused
SQL["rrf_fusion"] = _fusion_sql(ASKED) + " select id, round(score, 9) as score from fused"


def _hits(request: dict, with_vector: bool = True):
    def query(s: SparkSession, d: str) -> DataFrame:
        vector = demo.query_vector(s, d) if with_vector else None
        found = hybrid.search(search_graph(s, d), {"text": ASKED, **request}, chunks=demo.chunks(s, d), vector=vector)
        return found.select("position", "id", "name", F.round("score", 9).alias("score"), "type")

    return query


def _hits_sql(where: str, source: str = "fused") -> str:
    return _fusion_sql(ASKED) + f", top as (select id, score from {source} where {where} order by round(score, 9) desc, id limit 10) select row_number() over (order by round(score, 9) desc, id)::int as position, id, name, round(score, 9) as score, type from top join sn using (id)"


QUERIES["hybrid_search_filtered"] = _hits({"entity_types": ["Section", "Class"], "include_paths": ["d1", "d2", "d3", "d4"], "exclude_paths": ["d10"]})
SQL["hybrid_search_filtered"] = _hits_sql("id in (select id from sn where type in ('Section', 'Class')) and (id like 'd1%' or id like 'd2%' or id like 'd3%' or id like 'd4%') and id not like 'd10%'")
QUERIES["hybrid_search_workspace"] = _hits({"workspace_id": "d7"})
SQL["hybrid_search_workspace"] = _hits_sql("id in (select to_id from sedges where from_id = 'd7' and relationship = 'MAPPED_TO')")
QUERIES["bm25_only_fallback"] = _hits({}, with_vector=False)
SQL["bm25_only_fallback"] = _fusion_sql(ASKED) + ", only_ as (select id, 1.0::double / (60 + r) as score from lex) select r::int as position, id, name, round(score, 9) as score, type from (select * from lex where r <= 10) join only_ using (id) join sn using (id)"

# --- paths and neighbours ---

QUERIES["category"] = lambda s, d: demo.page_paths(s, d).select("id", fn.category(F.concat(F.col("id"), F.when(F.length("id") % 3 == 0, "/build/x").when(F.length("id") % 3 == 1, "node_modules/y").otherwise(""))).alias("category"))
SQL["category"] = "with p as (select regexp_replace(url, '^[a-z]+://', '') as id from pages) select id, case when length(id) % 3 < 2 then 'library' else 'module' end as category from p"
QUERIES["hit_path"] = lambda s, d: demo.page_paths(s, d).select("id", fn.hit_path(F.concat("id", F.lit(":name:2"))).alias("path"))
SQL["hit_path"] = "with p as (select regexp_replace(url, '^[a-z]+://', '') as id from pages) select id, split_part(id || ':name:2', ':', 1) as path from p"
QUERIES["extract_path"] = lambda s, d: demo.page_paths(s, d).select("id", fn.group_path(F.concat("id", F.when(F.length("id") % 2 == 0, "::f:g").otherwise(":f:g"))).alias("path"))
SQL["extract_path"] = "with p as (select regexp_replace(url, '^[a-z]+://', '') as id from pages) select id, case when length(id) % 2 = 0 then id else id || ':f' end as path from p"


def _neighbors(s: SparkSession, d: str) -> DataFrame:
    g = demo.star_graph(s, d)
    hits = g.nodes.where("entity_type = 'Nation'").select("id").orderBy("id").limit(5).withColumn("position", F.lit(1))
    found = hybrid.neighbors(hits, g, 3, ("DECLARED_IN",), "both")
    return found.select("id", F.explode("neighbors").alias("n")).select("id", "n.neighbor", "n.relationship", "n.direction", "n.name", "n.type")


QUERIES["neighbors_topk"] = _neighbors
SQL["neighbors_topk"] = (
    GRAPH_SQL
    + """, hits as (select id from nodes where entity_type = 'Nation' order by id limit 5), e as (
  select h.id, to_id as neighbor, relationship, 'outbound' as direction from hits h join edges on from_id = h.id where relationship = 'DECLARED_IN'
  union all select h.id, from_id, relationship, 'inbound' from hits h join edges on to_id = h.id where relationship = 'DECLARED_IN')
select e.id, neighbor, relationship, direction, n.name, n.entity_type as type from e join nodes n on n.id = neighbor"""
)

# --- sequential steps: no SQL; tests hold them against small cases ---


def _mmr(s: SparkSession, d: str) -> DataFrame:
    hits = demo.page_paths(s, d).select("id", (F.length("id") / 100.0).alias("score")).distinct().orderBy(F.desc("score"), "id").limit(20)
    return rerank.mmr(hits, 0.5).select("position", "id", F.round("score", 6).alias("score"))


QUERIES["mmr_rerank"] = _mmr
QUERIES["snippet_auto"] = lambda s, d: rerank.snippets(search_graph(s, d).nodes.select("id", "content"), ASKED).select("id", "snippet")
QUERIES["chunk_text"] = lambda s, d: rerank.chunks_of(demo.table(s, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_idx", "chunk")

"""Hybrid search: BM25 and nearest neighbours fused by reciprocal rank, filtered and dressed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import category, hit_path, line_of, preview
from graphloom.operators import bm25, dense, rerank
from graphloom.plans.graph import Graph
from graphloom.plans.schema import Search

RANK_CONSTANT = 60


def ranked(hits: DataFrame, score: str, key: str) -> DataFrame:
    """(id, rrf) of a list that was cut to a pool before, so that one window holds no more than that."""
    rank = F.row_number().over(Window.orderBy(bm25.by_score(score), key))
    return hits.select(F.col(key).alias("id"), (1.0 / (RANK_CONSTANT + rank)).alias("rrf"))


def fused(*lists: DataFrame) -> DataFrame:
    """(id, score): sums of reciprocal ranks."""
    return reduce(DataFrame.unionAll, lists).groupBy("id").agg(F.sum("rrf").alias("score"))


def in_workspace(hits: DataFrame, edges: DataFrame, workspace: str) -> DataFrame:
    """Hits that the workspace points to."""
    scope = edges.where((F.col("from_id") == workspace) & F.col("relationship").isin("MAPPED_TO", "HAS_SCRATCHPAD"))
    return hits.join(scope.select(F.col("to_id").alias("id")), "id", "left_semi")


def _any_prefix(prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col("id").startswith(p) for p in prefixes], F.lit(False))


def filtered(hits: DataFrame, graph: Graph, request: Search) -> DataFrame:
    """Hits within the workspace, of the types, under and not under the paths asked for; an empty list lets nothing pass."""
    if request.workspace_id is not None:
        hits = in_workspace(hits, graph.edges, request.workspace_id)
    if request.entity_types is not None:
        kinds = graph.nodes.where(F.col("label").isin("Entity") & F.col("entity_type").isin(*request.entity_types)) if request.entity_types else graph.nodes.where(F.lit(False))
        hits = hits.join(kinds.select("id"), "id", "left_semi")
    if request.include_paths is not None:
        hits = hits.where(_any_prefix(request.include_paths))
    return hits.where(~_any_prefix(request.exclude_paths)) if request.exclude_paths else hits


def neighbors(hits: DataFrame, graph: Graph, top: int, relationships: tuple[str, ...] | None = None, direction: str = "both") -> DataFrame:
    """(id, neighbors) of the first `top` hits (id, position): what one edge joins them with, sent
    edges before received ones, each in the order of the log; ends without a node are left out."""
    e = graph.edges if relationships is None else graph.edges.where(F.col("relationship").isin(*relationships) if relationships else F.lit(False))
    out = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "relationship", F.lit("outbound").alias("direction"), "seq")
    back = e.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "relationship", F.lit("inbound").alias("direction"), "seq")
    steps = {"outbound": out, "inbound": back, "both": out.unionAll(back)}.get(direction, out.where(F.lit(False)))
    first = hits.where(F.col("position") <= top).select("id")
    named = graph.nodes.select(F.col("id").alias("other"), "name", F.when(F.col("label") == "Entity", F.col("entity_type")).otherwise(F.col("label")).alias("type"))
    found = steps.join(F.broadcast(first), "id").join(named, "other")
    row = F.struct(F.when(F.col("direction") == "outbound", 0).otherwise(1).alias("side"), "seq", F.col("other").alias("neighbor"), "relationship", "direction", "name", "type")
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("neighbors"))
    none = F.array().cast(lists.schema["neighbors"].dataType)
    return first.join(lists, "id", "left").select("id", F.coalesce("neighbors", none).alias("neighbors"))


def search(graph: Graph, request: Search | dict, postings: DataFrame | bm25.Source | None = None, chunks: DataFrame | None = None, vector: list[float] | None = None, now: int | None = None) -> DataFrame:
    """Hits, best first: position, id, name, score, line, content, type, path, category, and
    snippet and neighbors where asked for.

    Each side brings a pool of max(50, 5 top_k) (the dense one in chunks); without a query vector
    the lexical side decides alone. Filters work on the fused pool, then top_k cuts, then results
    may be diversified. Ids without a node are dropped last.
    """
    r = request if isinstance(request, Search) else Search.of(request)
    n = bm25.pool(r.top_k)
    post = bm25.of_texts(bm25.node_fields(graph.nodes)) if postings is None else postings
    lists = [ranked(bm25.search(post, r.text, n), "score", "doc_id")]
    if vector is not None:
        vectors = dense.node_chunks(graph.nodes) if chunks is None else chunks
        sims = dense.by_node(dense.nearest(vectors, vector, n))
        lists.append(ranked(sims if now is None else dense.decayed(sims, graph.nodes, now), "sim", "node_id"))
    hits = filtered(fused(*lists), graph, r).orderBy(bm25.by_score(), "id").limit(r.top_k)
    if r.diversity is not None:
        placed = rerank.mmr(hits, r.diversity)
    else:
        placed = hits.select(F.row_number().over(Window.orderBy(bm25.by_score(), "id")).alias("position"), "id", "score")
    placed = F.broadcast(placed)
    entity = F.col("label") == "Entity"
    content = {"name": F.lit(""), "preview": preview(F.col("content"))}.get(r.mode, F.col("content"))
    path = F.when(entity, hit_path(F.col("id")))
    out = graph.nodes.join(placed, "id").select("position", "id", "name", "score", line_of(F.col("metadata")).alias("line"), F.col("content").alias("whole"), content.alias("content"), F.when(entity, F.col("entity_type")).otherwise(F.col("label")).alias("type"), path.alias("path"), F.when(entity, category(path)).otherwise("workspace").alias("category"))
    if r.snippet:
        out = rerank.snippets(out.withColumnRenamed("content", "shown").withColumnRenamed("whole", "content"), r.text).withColumnRenamed("content", "whole").withColumnRenamed("shown", "content")
    if r.neighbors is not None:
        out = out.join(neighbors(placed, graph, r.neighbors, r.relationships, r.direction), "id", "left")
    return out.drop("whole").orderBy("position")

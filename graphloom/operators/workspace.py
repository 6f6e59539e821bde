"""Workspaces: what is worked on, notes about it, and files it has looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import Graph
from graphloom.sources.log import event

#: Active workspaces that are broadcast at most; more of them are joined by shuffle, dealt in PARTS.
BROADCAST_SPACES = 100_000
PARTS = 64


def active(graph: Graph) -> DataFrame:
    return graph.nodes.where("label = 'Workspace' and status = 'active'")


def initialize(graph: Graph, workspace: str, description: str, now: int, first_seq: int) -> DataFrame:
    """Events that close all active workspaces at `now` and open a new one."""
    closed = F.to_json(F.struct("name", "description", F.lit("inactive").alias("status"), F.coalesce("closed_at", F.lit(now)).alias("closed_at")))
    old = active(graph).where(F.col("id") != workspace)
    place = F.lit(first_seq) + _any_place()
    shut = old.select(*event("UPSERT_NODE", place.cast("bigint"), id=F.col("id"), label=F.lit("Workspace"), properties=closed))
    opened = F.to_json(F.struct(F.lit(workspace).alias("name"), F.lit(description).alias("description"), F.lit("active").alias("status")))
    one = graph.nodes.sparkSession.range(1)
    return shut.unionAll(one.select(*event("UPSERT_NODE", F.lit(first_seq + (1 << 20)).cast("bigint"), id=F.lit(workspace), label=F.lit("Workspace"), properties=opened)))


def _any_place():
    """A number below 2^20 - 1: such events may come in any order."""
    return F.pmod(F.xxhash64("id"), F.lit((1 << 20) - 1))


def note(graph: Graph, text: str, now_ms: int, first_seq: int) -> DataFrame:
    """Events of a note, linked to from each active workspace."""
    key = F.lit(f"note_{now_ms}")
    props = F.to_json(F.struct(F.lit(text).alias("content"), F.lit(now_ms // 1000).alias("created_at")))
    one = graph.nodes.sparkSession.range(1).select(*event("UPSERT_NODE", F.lit(first_seq).cast("bigint"), id=key, label=F.lit("Scratchpad"), properties=props))
    links = active(graph).select(*event("LINK_NODES", (F.lit(first_seq + 1) + _any_place()).cast("bigint"), from_id=F.col("id"), to_id=key, relationship=F.lit("HAS_SCRATCHPAD"), properties=F.lit("{}")))
    return one.unionAll(links)


def mapped(graph: Graph, path: str) -> DataFrame:
    """(from_id, to_id, relationship, properties): active workspaces to all that `path` declares."""
    inside = graph.edges.where((F.col("relationship") == "DECLARED_IN") & (F.col("to_id") == path)).select(F.col("from_id").alias("to_id")).distinct()
    spaces = active(graph).select(F.col("id").alias("from_id"))
    if spaces.limit(BROADCAST_SPACES + 1).count() <= BROADCAST_SPACES:
        pairs = inside.crossJoin(F.broadcast(spaces))
    else:
        dealt = inside.withColumn("part", F.pmod(F.xxhash64("to_id"), F.lit(PARTS)).cast("int"))
        pairs = dealt.join(spaces.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), "part")
    return pairs.select("from_id", "to_id", F.lit("MAPPED_TO").alias("relationship"), F.lit('{"is_stale":false}').alias("properties"))


def notes(graph: Graph, limit: int = 5) -> DataFrame:
    """(workspace, id, content, created_at): the newest notes of active workspaces."""
    links = graph.edges.where("relationship = 'HAS_SCRATCHPAD'").join(active(graph).select(F.col("id").alias("from_id")), "from_id", "left_semi")
    pads = graph.nodes.where("label = 'Scratchpad'").select(F.col("id").alias("to_id"), "content", "created_at")
    # the first pairs are of the first notes that have any, so only these meet their workspaces
    newest = F.broadcast(pads.join(links.select("to_id").distinct(), "to_id").orderBy(F.desc("created_at"), "to_id").limit(limit))
    found = links.select("from_id", "to_id").join(newest.select("to_id"), "to_id", "left_semi").distinct().join(newest, "to_id")
    return found.select(F.col("from_id").alias("workspace"), F.col("to_id").alias("id"), "content", "created_at").orderBy(F.desc("created_at"), "id", "workspace").limit(limit)


def report(graph: Graph, spaces: int = 3, pads: int = 5) -> DataFrame:
    """(section, name, value): what a memory of the graph holds, in counts of entities by type, the
    active workspaces, and their newest notes."""
    kinds = graph.nodes.where("label = 'Entity'").groupBy("entity_type").count().select(F.lit("entities").alias("section"), F.col("entity_type").alias("name"), F.col("count").cast("string").alias("value"))
    open_ = active(graph).orderBy("id").limit(spaces).select(F.lit("workspaces"), "id", "description")
    newest = notes(graph, pads).select(F.lit("notes"), "id", "content")
    return kinds.unionAll(open_).unionAll(newest)

"""The graph as two DataFrames, and steps over them that the planner composes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import line_of, preview
from graphloom.plans.schema import MAX_DEPTH, EdgeRule, Query
from graphloom.sources.folders import work_folder


@dataclass(frozen=True)
class Graph:
    """nodes (one row an id) and edges (a bag: parallel edges and dangling ends are allowed)."""

    nodes: DataFrame
    edges: DataFrame

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def by_label(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label)

    def by_type(self, entity_type: str) -> DataFrame:
        return self.nodes.where((F.col("label") == "Entity") & (F.col("entity_type") == entity_type))

    def outbound(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("from_id") == node_id)

    def inbound(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("to_id") == node_id)


def matched(nodes: DataFrame, rules) -> DataFrame:
    """Nodes that meet the match clause; an `id` rule stands alone and makes the others void."""
    if "id" in rules:
        return nodes.where(F.col("id") == rules["id"])
    entity = F.col("label") == "Entity"
    conditions = {
        "label": lambda v: F.col("label") == v,
        "entity_type": lambda v: entity & (F.col("entity_type") == v),
        "status": lambda v: (F.col("label") != "Scratchpad") & (F.col("status") == v),
        "name_contains": lambda v: F.lower("name").contains(v.lower()),
    }
    return reduce(lambda df, k: df.where(conditions[k](rules[k])), rules, nodes)


def constrained(ids: DataFrame, edges: DataFrame, to: EdgeRule | None, from_: EdgeRule | None) -> DataFrame:
    """Ids with an edge to, and an edge from, the given ends: semi-joins with filtered edges."""
    for rule, near, far in ((to, "from_id", "to_id"), (from_, "to_id", "from_id")):
        if rule is not None:
            ends = edges.where((F.col(far) == rule.id) & (F.col("relationship") == rule.relationship))
            ids = ids.join(ends.select(F.col(near).alias("id")), "id", "left_semi")
    return ids


def _steps(edges: DataFrame, relationship: str, direction: str) -> DataFrame:
    e = edges.where(F.col("relationship") == relationship)
    out = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("next"))
    back = e.select(F.col("to_id").alias("id"), F.col("from_id").alias("next"))
    return {"inbound": back, "both": out.unionAll(back)}.get(direction, out)


def reached(seeds: DataFrame, edges: DataFrame, relationship: str, direction: str = "outbound", max_depth: int = 1) -> DataFrame:
    """Ids within `max_depth` steps (5 at most) of the seeds, which are reached at depth 0.

    Each round takes one step from the ids that the round before found first, so an id is expanded
    once, and cycles end by themselves: at most five joins, no loop over rows. Dangling ends are ids,
    too. Rounds before the last are written to the shared folder, so that none is worked out twice,
    and one that finds nothing new ends the walk.
    """
    steps = _steps(edges, relationship, direction)
    spark, rounds = seeds.sparkSession, min(max_depth, MAX_DEPTH)
    seen = level = seeds.select("id").distinct()
    for depth in range(rounds):
        level = level.join(steps, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        if depth < rounds - 1:
            path = work_folder(spark, "walk")
            level.write.parquet(path)
            level = spark.read.schema("id string").parquet(path)
            if not level.take(1):
                break
        seen = seen.unionAll(level)
    return seen


def group_key(key: str) -> Column:
    """Value that a node is counted under; an unknown key puts all nodes in one group."""
    kinds = {
        "type": F.when(F.col("label") == "Entity", F.col("entity_type")).otherwise(F.col("label")),
        "label": F.col("label"),
        "status": F.when(F.col("label") == "Scratchpad", "unknown").otherwise(F.col("status")),
    }
    return kinds.get(key, F.lit("unknown"))


def projected(nodes: DataFrame, fields: tuple[str, ...], mode: str = "full") -> DataFrame:
    """The listed fields; `label` stands for the columns label, type and status, and `mode` shortens content."""
    content = {"name": F.lit(""), "preview": preview(F.col("content"))}.get(mode, F.col("content"))
    entity = F.when(F.col("label") == "Entity", F.col("entity_type"))
    columns = {
        "id": [F.col("id")],
        "name": [F.col("name")],
        "line": [line_of(F.col("metadata")).alias("line")],
        "label": [F.col("label"), entity.alias("type"), F.when(F.col("label") != "Scratchpad", F.col("status")).alias("status")],
        "content": [content.alias("content")],
        "metadata": [F.col("metadata")],
    }
    return nodes.select(*[c for f in fields for c in columns[f]])


def label_object() -> Column:
    """A node's label as JSON, with the fields of its kind; what is not set is null."""
    fields = {"Entity": (F.col("entity_type").alias("type"), "status", "last_modified"), "Workspace": ("description", "status", "closed_at"), "Scratchpad": ("created_at",)}
    out = F.lit(None).cast("string")
    for label, held in fields.items():
        out = F.when(F.col("label") == label, F.to_json(F.struct(F.lit(label).alias("label"), *held), {"ignoreNullFields": "false"})).otherwise(out)
    return out


def run(graph: Graph, request: Query | dict) -> DataFrame:
    """A query's rows.

    Without `aggregate`: at most `limit` ids in order of id, then their nodes (dangling ids use up
    the limit and give no row). With it: the group's key, named as asked, and count, largest first.
    """
    q = request if isinstance(request, Query) else Query.of(request)
    ids = constrained(matched(graph.nodes, q.match).select("id"), graph.edges, q.edge_to, q.edge_from)
    if q.relationship is not None:
        ids = reached(ids, graph.edges, q.relationship, q.direction, q.max_depth)
    if q.group_by is not None:
        nodes = graph.nodes.join(ids, "id", "left_semi")
        return nodes.groupBy(group_key(q.group_by).alias(q.group_by)).count().orderBy(F.desc("count"), q.group_by)
    # a thousand ids at most, so the broadcast has a fixed bound
    first = F.broadcast(ids.orderBy("id").limit(q.limit))
    return projected(graph.nodes.join(first, "id", "left_semi"), q.fields, q.mode)

"""Results for people: the graph as a drawing needs it, and query results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import category
from graphloom.plans.graph import Graph

#: Rows up to which a result is returned; longer ones are spooled.
INLINE_ROWS = 20
#: Nodes of a drawing that are broadcast at most.
BROADCAST_NODES = 100_000


def graph_edges(graph: Graph, limit: int = 1000) -> DataFrame:
    """(from_id, to_id, relationship) between the first `limit` nodes, once each, no loops."""
    nodes = graph.nodes.select("id").orderBy("id").limit(limit)
    nodes = F.broadcast(nodes) if limit <= BROADCAST_NODES else nodes
    ends = graph.edges.where("from_id <> to_id")
    inside = ends.join(nodes.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(nodes.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return inside.select("from_id", "to_id", "relationship").distinct()


def graph_nodes(graph: Graph, limit: int = 1000) -> DataFrame:
    """(id, name, type, category) of the first `limit` nodes."""
    kind = F.when(F.col("label") == "Entity", F.col("entity_type")).otherwise(F.col("label"))
    return graph.nodes.orderBy("id").limit(limit).select("id", "name", kind.alias("type"), category(F.col("id")).alias("category"))


def spooled(rows: DataFrame, title: str, path: str) -> DataFrame | None:
    """Rows as they are, if there are `INLINE_ROWS` or fewer; else written to `path` as text, a JSON
    object a line below a header, and None."""
    if rows.limit(INLINE_ROWS + 1).count() <= INLINE_ROWS:
        return rows
    spark = rows.sparkSession
    head = spark.createDataFrame([(f"Source DSL: {title}",), ("=" * 40,)], "value string")
    head.coalesce(1).unionAll(rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))).write.mode("overwrite").text(path)
    return None

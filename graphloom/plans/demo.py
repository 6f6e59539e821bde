"""A graph, a log and text corpora derived from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.graph import Graph

#: Users whose id the log's links wrap around.
USERS = 150
#: Line items whose pairs a task makes distinct, on average.
PART_LINES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _entities(df: DataFrame, kind: str, key: str, name: Column, status: Column | None = None) -> DataFrame:
    return df.select(
        _id(kind.lower(), key).alias("id"),
        F.lit("Entity").alias("label"),
        F.lit(kind).alias("entity_type"),
        (F.lit("active") if status is None else status).alias("status"),
        F.lit("").alias("description"),
        F.lit(0).cast("bigint").alias("last_modified"),
        F.lit(0).cast("bigint").alias("created_at"),
        F.lit(None).cast("bigint").alias("closed_at"),
        name.alias("name"),
        F.lit("").alias("content"),
        F.lit("").alias("metadata"),
        F.lit(None).cast("array<array<float>>").alias("embedding"),
        F.lit(0).cast("bigint").alias("seq"),
    )


def _edges(df: DataFrame, a: Column, b: Column, relationship: str) -> DataFrame:
    return df.select(a.alias("from_id"), b.alias("to_id"), F.lit(relationship).alias("relationship"), F.lit("{}").alias("properties"), F.lit(0).cast("bigint").alias("seq"))


def star_graph(spark: SparkSession, sf_dir: str, distinct: bool = True) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders as entities, their keys as edges.

    `distinct=False` keeps one edge for each line item.
    """
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def by_balance(column: str) -> Column:
        return F.when(F.col(column) < 0, "inactive").otherwise("active")

    nodes = [
        _entities(t["region"], "Region", "r_regionkey", F.col("r_name")),
        _entities(t["nation"], "Nation", "n_nationkey", F.col("n_name")),
        _entities(t["customer"], "Customer", "c_custkey", F.col("c_name"), by_balance("c_acctbal")),
        _entities(t["supplier"], "Supplier", "s_suppkey", F.col("s_name"), by_balance("s_acctbal")),
        _entities(t["part"], "Part", "p_partkey", F.col("p_name")),
        _entities(t["orders"], "Order", "o_orderkey", F.col("o_orderkey").cast("string")),
    ]
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey")
    calls, imports = lines.select("l_orderkey", "l_partkey"), lines.select("l_partkey", "l_suppkey")
    if distinct:
        # in parts of about the same size, however many lines there are: an adaptive plan would make them one a core
        parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // PART_LINES))
        calls, imports = (pairs.repartition(parts, *pairs.columns).distinct() for pairs in (calls, imports))
    edges = [
        _edges(t["nation"], _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "DECLARED_IN"),
        _edges(t["customer"], _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "DECLARED_IN"),
        _edges(t["supplier"], _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "DECLARED_IN"),
        _edges(t["orders"], _id("order", "o_orderkey"), _id("customer", "o_custkey"), "DECLARED_IN"),
        _edges(calls, _id("order", "l_orderkey"), _id("part", "l_partkey"), "CALLS"),
        _edges(imports, _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "IMPORTS"),
    ]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    return Graph(union(nodes), union(edges))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a log: sign-ups and views write users, clicks link them, purchases link to parts
    that no event writes, errors delete."""
    e = table(spark, sf_dir, "events")
    kind, user, n = F.col("event_type"), F.col("user_id"), F.col("event_id")
    uid = F.concat(F.lit("u"), user.cast("string"))
    upsert, link, error = kind.isin("signup", "view"), kind.isin("click", "purchase"), kind == "error"
    even = user % 2 == 0
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    scratch, workspace = n % 7 == 0, n % 7 == 1
    label = F.when(scratch, "Scratchpad").when(workspace, "Workspace").otherwise("User")
    properties = F.to_json(
        F.struct(
            F.concat(F.lit("user "), user.cast("string")).alias("name"),
            F.when(n % 3 == 0, "inactive").otherwise("active").alias("status"),
            F.when(scratch, F.concat(F.lit("note "), n.cast("string"))).alias("content"),
            F.when(scratch, seconds).alias("created_at"),
            F.when(workspace, F.concat(F.lit("space "), n.cast("string"))).alias("description"),
            F.when(workspace & (n % 3 == 0), seconds).alias("closed_at"),
            F.when(~scratch & ~workspace, seconds).alias("last_modified"),
        )
    )
    target = F.when(kind == "click", F.concat(F.lit("u"), ((user * 7 + n) % USERS).cast("string"))).otherwise(F.concat(F.lit("p"), (n % 50).cast("string")))
    return e.select(
        n.alias("seq"),
        F.lit(1).alias("version"),
        seconds.alias("timestamp"),
        F.when(upsert, "UPSERT_NODE").when(link, "LINK_NODES").when(error & even, "DELETE_NODE").otherwise("DELETE_EDGES").alias("event_type"),
        F.when(upsert | (error & even), uid).alias("id"),
        F.when(upsert, label).alias("label"),
        F.when(link | (error & ~even), uid).alias("from_id"),
        F.when(link, target).alias("to_id"),
        F.when(kind == "click", "CALLS").when(kind == "purchase", "MAPPED_TO").alias("relationship"),
        F.when(error & ~even, F.when(n % 3 == 0, "outbound").when(n % 3 == 1, "inbound").otherwise("both")).alias("direction"),
        F.when(upsert, properties).when(link, F.lit("{}")).alias("properties"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, field, text) of documents and, under the same ids, part names."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("content").alias("field"), "text")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doc_id"), F.lit("name").alias("field"), F.col("p_name").alias("text"))
    return docs.unionAll(parts)


def chunks(spark: SparkSession, sf_dir: str, nodes: int = 100) -> DataFrame:
    """(node_id, chunk_idx, vec): vectors dealt to `nodes` nodes in order of vec_id."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), (v % nodes).cast("string")).alias("node_id"), F.floor(v / nodes).cast("int").alias("chunk_idx"), F.col("embedding").alias("vec"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def scratchpads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, created_at) of one note an event."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("note_"), F.col("event_id").cast("string")).alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each conversation as a document, a heading for each turn's role."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sections = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("# "), "role", F.lit("\n\n"), "text", F.lit("\n")).alias("part"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(sections, lambda s: s["part"]), "\n").alias("content")).select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "content")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id) path-like ids of pages: their urls without the scheme."""
    return table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("id"))

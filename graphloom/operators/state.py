"""State as a pure function of the log: folding, compaction and pruning without replaying in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import Graph

#: Inactive workspaces that compaction keeps.
KEEP_WORKSPACES = 20
LONG_TEXT = r"^[0-9]{1,18}$"


def effective(log: DataFrame) -> DataFrame:
    """Events whose payload has the shape of their type.

    A payload counts as the first of upsert (id, label, properties), link (from_id, to_id,
    relationship), node deletion (id) and edge deletion (from_id) whose fields it has; an event of
    another type than that is void.
    """
    has = {c: F.col(c).isNotNull() for c in ("id", "label", "properties", "from_id", "to_id", "relationship")}
    upsert = has["id"] & has["label"] & has["properties"]
    link = has["from_id"] & has["to_id"] & has["relationship"]
    shape = F.when(upsert, "UPSERT_NODE").when(link, "LINK_NODES").when(has["id"], "DELETE_NODE").when(has["from_id"], "DELETE_EDGES")
    return log.where(F.col("event_type") == shape)


def _text(props: Column, key: str, default: str = "") -> Column:
    v = F.try_variant_get(props, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(props, f"$.{key}", "string")).otherwise(F.lit(default))


def _number(props: Column, key: str, default: int | None = 0) -> Column:
    v = F.try_variant_get(props, f"$.{key}", "variant")
    raw = F.try_variant_get(props, f"$.{key}", "string")
    fits = (F.schema_of_variant(v) == "BIGINT") & raw.rlike(LONG_TEXT)
    return F.when(fits, raw.cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def nodes(log: DataFrame) -> DataFrame:
    """Nodes of an effective log: the last write of each id whose last event is no deletion.

    A write replaces the node whole: absent properties, and those of a wrong kind, have their
    defaults. One shuffle by id, combined before it.
    """
    touched = log.where(F.col("event_type").isin("UPSERT_NODE", "DELETE_NODE")).select("id", "seq", "event_type", "label", "properties")
    last = touched.groupBy("id").agg(F.max(F.struct("seq", "event_type", "label", "properties")).alias("e"))
    alive = last.where(F.col("e.event_type") == "UPSERT_NODE").select("id", "e.seq", "e.label", F.try_parse_json("e.properties").alias("p"))
    p, label = F.col("p"), F.col("label")
    known = label.isin("Workspace", "Scratchpad")
    entity, workspace, pad = ~known, label == "Workspace", label == "Scratchpad"
    return alive.select(
        "id",
        F.when(known, label).otherwise("Entity").alias("label"),
        F.when(label == "Entity", _text(p, "entity_type")).when(entity, label).alias("entity_type"),
        F.when(~pad, _text(p, "status", "active")).alias("status"),
        F.when(workspace, _text(p, "description")).alias("description"),
        F.when(entity, _number(p, "last_modified")).alias("last_modified"),
        F.when(pad, _number(p, "created_at")).alias("created_at"),
        F.when(workspace, _number(p, "closed_at", None)).alias("closed_at"),
        _text(p, "name").alias("name"),
        _text(p, "content").alias("content"),
        _text(p, "metadata").alias("metadata"),
        F.try_variant_get(p, "$.embedding", "array<array<float>>").alias("embedding"),
        "seq",
    )


def kills(log: DataFrame) -> DataFrame:
    """(id, out, in): of each id the last deletion, in an effective log, of what it sent and of what it got."""
    node_gone = log.where(F.col("event_type") == "DELETE_NODE").select("id", "seq", F.lit("both").alias("direction"))
    edges_gone = log.where(F.col("event_type") == "DELETE_EDGES").select(F.col("from_id").alias("id"), "seq", F.coalesce("direction", F.lit("outbound")).alias("direction"))
    return node_gone.unionAll(edges_gone).groupBy("id").agg(F.max(F.when(F.col("direction") != "inbound", F.col("seq"))).alias("out"), F.max(F.when(F.col("direction") != "outbound", F.col("seq"))).alias("in"))


def edges(log: DataFrame) -> DataFrame:
    """Edges of an effective log: links that no later deletion kills.

    A deletion of a node, or of its edges in a direction, kills what its id sent, or received,
    before it. So for each id the last such deletion decides, and two equi-joins do.
    """
    links = log.where(F.col("event_type") == "LINK_NODES").select("from_id", "to_id", "relationship", F.coalesce("properties", F.lit("{}")).alias("properties"), "seq")
    return _outlived(links, kills(log))


def _outlived(links: DataFrame, killed: DataFrame) -> DataFrame:
    sent = killed.select(F.col("id").alias("from_id"), F.col("out").alias("sent_gone"))
    got = killed.select(F.col("id").alias("to_id"), F.col("in").alias("got_gone"))
    joined = links.join(sent, "from_id", "left").join(got, "to_id", "left")
    alive = (F.col("seq") > F.coalesce("sent_gone", F.lit(-1))) & (F.col("seq") > F.coalesce("got_gone", F.lit(-1)))
    return joined.where(alive).select("from_id", "to_id", "relationship", "properties", "seq")


def touched(log: DataFrame) -> DataFrame:
    """(id) of nodes that an effective log writes or deletes."""
    return log.where(F.col("event_type").isin("UPSERT_NODE", "DELETE_NODE")).select("id").distinct()


def fold(log: DataFrame) -> Graph:
    """The graph that a log describes."""
    log = effective(log)
    return Graph(nodes(log), edges(log))


def extend(base: Graph, tail: DataFrame) -> Graph:
    """The graph of a log of which `base` is the graph of the beginning, and `tail` is the rest.

    Nodes that the tail touches are as it leaves them; edges of `base` go where the tail has a
    deletion for either end, as all its deletions come later. Only the tail is folded.
    """
    tail = effective(tail)
    kept = base.nodes.join(touched(tail), "id", "left_anti")
    links = tail.where(F.col("event_type") == "LINK_NODES").select("from_id", "to_id", "relationship", F.coalesce("properties", F.lit("{}")).alias("properties"), "seq")
    return Graph(kept.unionByName(nodes(tail)), _outlived(base.edges.select(*links.columns).unionByName(links), kills(tail)))


def _properties() -> Column:
    """Properties that write a node again; empty texts are left out."""
    entity, workspace = F.col("label") == "Entity", F.col("label") == "Workspace"

    def full(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c)).alias(c)

    return F.to_json(
        F.struct(
            full("name"),
            full("content"),
            full("metadata"),
            F.when(entity, F.col("entity_type")).alias("entity_type"),
            F.when(F.col("label") != "Scratchpad", F.col("status")).alias("status"),
            F.when(workspace, F.col("description")).alias("description"),
            F.when(entity, F.col("last_modified")).alias("last_modified"),
            F.when(F.col("label") == "Scratchpad", F.col("created_at")).alias("created_at"),
            F.when(workspace, F.col("closed_at")).alias("closed_at"),
            "embedding",
        )
    )


def synthesize(graph: Graph, timestamp: Column | None = None) -> DataFrame:
    """The least log that folds to the same graph: a write for each node, then a link for each edge.

    seq keeps the order of the originals, nodes and edges apart, and is unique.
    """
    now = F.unix_timestamp() if timestamp is None else timestamp
    none = F.lit(None).cast("string")
    writes = graph.nodes.select(F.col("seq").alias("old"), F.lit("UPSERT_NODE").alias("event_type"), "id", F.col("label"), none.alias("from_id"), none.alias("to_id"), none.alias("relationship"), none.alias("direction"), _properties().alias("properties"))
    links = graph.edges.select(F.col("seq").alias("old"), F.lit("LINK_NODES").alias("event_type"), none.alias("id"), none.alias("label"), "from_id", "to_id", "relationship", none.alias("direction"), "properties")
    # twice the old place, so that what a node and an edge write never meets
    seq = F.col("old") * 2 + F.when(F.col("event_type") == "LINK_NODES", 1).otherwise(0)
    return writes.unionAll(links).select(seq.alias("seq"), F.lit(1).alias("version"), now.alias("timestamp"), "event_type", "id", "label", "from_id", "to_id", "relationship", "direction", "properties")


def pruned(graph: Graph, keep: int = KEEP_WORKSPACES) -> tuple[Graph, Graph]:
    """(what stays, what goes): all but the `keep` inactive workspaces closed last, and the notes they
    point to, go; ties by id. With a gone node go all its edges; the archive has those it sent.

    Inactive workspaces are ranked without a global sort of nodes: a limit of `keep` finds what stays.
    """
    idle = graph.nodes.where((F.col("label") == "Workspace") & (F.col("status") == "inactive"))
    kept = idle.orderBy(F.coalesce("closed_at", F.lit(0)).desc(), "id").limit(keep).select("id")
    gone = idle.select("id").join(kept, "id", "left_anti")
    notes = graph.edges.where(F.col("relationship") == "HAS_SCRATCHPAD").join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    all_gone = gone.unionAll(notes).distinct()
    sent, got = all_gone.withColumnRenamed("id", "from_id"), all_gone.withColumnRenamed("id", "to_id")
    stays = Graph(graph.nodes.join(all_gone, "id", "left_anti"), graph.edges.join(sent, "from_id", "left_anti").join(got, "to_id", "left_anti").select(*graph.edges.columns))
    goes = Graph(graph.nodes.join(all_gone, "id", "left_semi"), graph.edges.join(sent, "from_id", "left_semi").select(*graph.edges.columns))
    return stays, goes


def compacted(log: DataFrame, keep: int = KEEP_WORKSPACES) -> tuple[DataFrame, DataFrame]:
    """(new log, archive) of a log."""
    stays, goes = pruned(fold(log), keep)
    return synthesize(stays), synthesize(goes)

"""Queries of the graph operators over the derived graph and log, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import line_of
from graphloom.operators import state
from graphloom.plans.demo import event_log, star_graph, table
from graphloom.plans.graph import Graph, run

QUERIES: dict = {}
SQL: dict[str, str] = {}

NODES_SQL = """
nodes as (
  select 'region:' || r_regionkey as id, 'Region' as entity_type, 'active' as status, r_name as name from region
  union all select 'nation:' || n_nationkey, 'Nation', 'active', n_name from nation
  union all select 'customer:' || c_custkey, 'Customer', case when c_acctbal < 0 then 'inactive' else 'active' end, c_name from customer
  union all select 'supplier:' || s_suppkey, 'Supplier', case when s_acctbal < 0 then 'inactive' else 'active' end, s_name from supplier
  union all select 'part:' || p_partkey, 'Part', 'active', p_name from part
  union all select 'order:' || o_orderkey, 'Order', 'active', o_orderkey::varchar from orders
)"""
EDGES_SQL = """
edges as (
  select 'nation:' || n_nationkey as from_id, 'region:' || n_regionkey as to_id, 'DECLARED_IN' as relationship from nation
  union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'DECLARED_IN' from customer
  union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'DECLARED_IN' from supplier
  union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'DECLARED_IN' from orders
  union all select distinct 'order:' || l_orderkey, 'part:' || l_partkey, 'CALLS' from lineitem
  union all select distinct 'part:' || l_partkey, 'supplier:' || l_suppkey, 'IMPORTS' from lineitem
)"""
GRAPH_SQL = f"with recursive {NODES_SQL}, {EDGES_SQL}"
_COLUMNS = "id, name, 'Entity' as label, entity_type as type, status"


def _dsl(name: str, request: dict, sql: str) -> None:
    request = {"return": ["id", "name", "label"], **request} if "aggregate" not in request else request

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(star_graph(spark, sf_dir), request)

    QUERIES[name], SQL[name] = query, GRAPH_SQL + sql


def _select(where: str, limit: int = 1000) -> str:
    return f" select {_COLUMNS} from nodes where {where} order by id limit {limit}"


_dsl("match_all", {}, _select("true"))
_dsl("match_label", {"match": {"label": "Entity"}}, _select("true"))
_dsl("match_entity_type", {"match": {"entity_type": "Supplier"}}, _select("entity_type = 'Supplier'"))
_dsl("match_status", {"match": {"status": "inactive"}}, _select("status = 'inactive'"))
_dsl("match_name_contains", {"match": {"name_contains": "RED"}}, _select("contains(lower(name), 'red')"))
_dsl("match_id_short_circuit", {"match": {"id": "nation:3", "status": "inactive"}}, _select("id = 'nation:3'"))
_TO = "id in (select from_id from edges where to_id = 'nation:3' and relationship = 'DECLARED_IN')"
_FROM = "id in (select to_id from edges where from_id = 'order:1' and relationship = 'CALLS')"
_dsl("where_edge_to", {"where": {"edge_to": {"id": "nation:3", "relationship": "DECLARED_IN"}}}, _select(_TO))
_dsl("where_edge_from", {"where": {"edge_from": {"id": "order:1", "relationship": "CALLS"}}}, _select(_FROM))
_BOTH = "id in (select from_id from edges where to_id = 'region:1' and relationship = 'DECLARED_IN') and id in (select to_id from edges where from_id = 'customer:5' and relationship = 'DECLARED_IN')"
_dsl("where_both", {"where": {"edge_to": {"id": "region:1", "relationship": "DECLARED_IN"}, "edge_from": {"id": "customer:5", "relationship": "DECLARED_IN"}}}, _select(_BOTH))


def _walk(seed: str, relationship: str, direction: str, depth: int) -> str:
    steps = {"outbound": "select from_id as a, to_id as b from rel", "inbound": "select to_id as a, from_id as b from rel"}
    step = steps.get(direction) or f"{steps['outbound']} union all {steps['inbound']}"
    return f""", rel as (select * from edges where relationship = '{relationship}'), steps as ({step}),
walk(id, depth) as (
  select id, 0 from nodes where {seed}
  union select s.b, w.depth + 1 from walk w join steps s on s.a = w.id where w.depth < {min(depth, 5)}
), ids as (select distinct id from walk)"""


def _traverse(name: str, match: dict, seed: str, relationship: str, direction: str, depth: int) -> None:
    walk = {"relationship": relationship, "direction": direction, "max_depth": depth}
    _dsl(name, {"match": match, "traverse": walk}, _walk(seed, relationship, direction, depth) + f" select {_COLUMNS} from (select id from ids order by id limit 1000) join nodes using (id)")


_traverse("traverse_out_1", {"id": "order:1"}, "id = 'order:1'", "CALLS", "outbound", 1)
_traverse("traverse_in_2", {"id": "region:1"}, "id = 'region:1'", "DECLARED_IN", "inbound", 2)
_traverse("traverse_both_3", {"id": "supplier:1"}, "id = 'supplier:1'", "DECLARED_IN", "both", 3)
_traverse("traverse_depth_cap", {"entity_type": "Region"}, "entity_type = 'Region'", "DECLARED_IN", "inbound", 9)
_traverse("traverse_depth_zero", {"entity_type": "Region"}, "entity_type = 'Region'", "DECLARED_IN", "inbound", 0)
_dsl(
    "flagship_reachable_types",
    {"match": {"id": "region:1"}, "traverse": {"relationship": "DECLARED_IN", "direction": "inbound", "max_depth": 2}, "aggregate": {"group_by": "type", "count": True}},
    _walk("id = 'region:1'", "DECLARED_IN", "inbound", 2) + " select entity_type as type, count(*) as count from nodes join ids using (id) group by 1",
)
_dsl("agg_type", {"aggregate": {"group_by": "type"}}, " select entity_type as type, count(*) as count from nodes group by 1")
_dsl("agg_label", {"aggregate": {"group_by": "label"}}, " select 'Entity' as label, count(*) as count from nodes group by 1")
_dsl("agg_status", {"aggregate": {"group_by": "status"}}, " select status, count(*) as count from nodes group by 1")
_dsl("agg_unknown_key", {"aggregate": {"group_by": "colour"}}, " select 'unknown' as colour, count(*) as count from nodes")
_dsl("project_fields", {"match": {"entity_type": "Nation"}, "return": ["id", "name"]}, " select id, name from nodes where entity_type = 'Nation'")
_dsl("limit_cap", {"match": {"entity_type": "Order"}, "limit": 5000, "return": ["id"]}, " select id from nodes where entity_type = 'Order' order by id limit 1000")

# --- documents as nodes: retrieval modes, lines ---


def _document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    metadata = F.when(key % 2 == 0, F.concat(F.lit('{"line":'), key.cast("string"), F.lit("}"))).when(key % 5 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{"level":2,"start_line":'), (key + 10).cast("string"), F.lit("}")))
    return d.select(F.concat(F.lit("doc:"), key.cast("string")).alias("id"), F.lit("Entity").alias("label"), F.lit("Section").alias("entity_type"), F.lit("active").alias("status"), F.col("source").alias("name"), F.coalesce("text", F.lit("")).alias("content"), metadata.alias("metadata"))


def _over_documents(request: dict):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = _document_nodes(spark, sf_dir)
        return run(Graph(nodes, star_graph(spark, sf_dir).edges), request)

    return query


_WORDS = r"list_filter(regexp_split_to_array(content, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_DOCS_SQL = """with d as (
  select 'doc:' || doc_id as id, coalesce(text, '') as content, doc_id,
         case when doc_id % 2 = 0 then doc_id when doc_id % 5 = 0 then null else doc_id + 10 end as line
  from documents
) """
QUERIES["retrieval_preview"] = _over_documents({"return": ["id", "content"], "retrieval_mode": "preview"})
SQL["retrieval_preview"] = _DOCS_SQL + f"select id, case when len({_WORDS}) <= 100 then content else array_to_string(({_WORDS})[1:100], ' ') || '...' end as content from d order by id limit 1000"
QUERIES["retrieval_name"] = _over_documents({"return": ["id", "content"], "retrieval_mode": "name"})
SQL["retrieval_name"] = _DOCS_SQL + "select id, '' as content from d order by id limit 1000"
QUERIES["line_from_metadata"] = lambda spark, sf_dir: _document_nodes(spark, sf_dir).select("id", line_of(F.col("metadata")).alias("line"))
SQL["line_from_metadata"] = _DOCS_SQL + "select id, line from d"

# --- point lookups and degrees ---

QUERIES["get_node"] = lambda s, d: star_graph(s, d).node("supplier:7").select("id", "entity_type", "status", "name")
SQL["get_node"] = GRAPH_SQL + " select * from nodes where id = 'supplier:7'"
QUERIES["nodes_by_type"] = lambda s, d: star_graph(s, d).by_type("Part").select("id", "name")
SQL["nodes_by_type"] = GRAPH_SQL + " select id, name from nodes where entity_type = 'Part'"
QUERIES["node_count"] = lambda s, d: star_graph(s, d).nodes.agg(F.count("*").alias("n"))
SQL["node_count"] = GRAPH_SQL + " select count(*) as n from nodes"
QUERIES["out_edges"] = lambda s, d: star_graph(s, d).outbound("order:3").select("from_id", "to_id", "relationship")
SQL["out_edges"] = GRAPH_SQL + " select * from edges where from_id = 'order:3'"
QUERIES["in_edges"] = lambda s, d: star_graph(s, d).inbound("part:5").select("from_id", "to_id", "relationship")
SQL["in_edges"] = GRAPH_SQL + " select * from edges where to_id = 'part:5'"
QUERIES["parallel_edges"] = lambda s, d: star_graph(s, d, distinct=False).edges.where("relationship = 'IMPORTS'").groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
SQL["parallel_edges"] = "select 'part:' || l_partkey as from_id, 'supplier:' || l_suppkey as to_id, count(*) as n from lineitem group by 1, 2"


def degrees(graph: Graph) -> DataFrame:
    """(id, relationship, n_out, n_in) of every end of an edge."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"), "relationship")
    return ends.groupBy("e.id", "relationship").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


QUERIES["degree_by_relationship"] = lambda s, d: degrees(star_graph(s, d))
SQL["degree_by_relationship"] = GRAPH_SQL + " select id, relationship, sum(o)::bigint as n_out, sum(i)::bigint as n_in from (select from_id as id, relationship, 1 as o, 0 as i from edges union all select to_id, relationship, 0, 1 from edges) group by 1, 2"

# --- the log ---

LOG_SQL = """
log as (
  select event_id as seq, event_type as kind, user_id, event_id as n, floor(epoch(ts))::bigint as secs, 'u' || user_id as uid,
         case when event_type = 'click' then 'u' || ((user_id * 7 + event_id) % 150) else 'p' || (event_id % 50) end as target
  from events
), touched as (
  select seq, uid as id, kind, n, secs, user_id from log where kind in ('signup', 'view') or (kind = 'error' and user_id % 2 = 0)
), last as (
  select * from touched t where seq = (select max(seq) from touched x where x.id = t.id)
), nodes as (
  select id, seq,
         case when n % 7 = 0 then 'Scratchpad' when n % 7 = 1 then 'Workspace' else 'Entity' end as label,
         case when n % 7 > 1 then 'User' end as entity_type,
         case when n % 7 = 0 then null when n % 3 = 0 then 'inactive' else 'active' end as status,
         case when n % 7 = 1 then 'space ' || n end as description,
         case when n % 7 > 1 then secs end as last_modified,
         case when n % 7 = 0 then secs end as created_at,
         case when n % 7 = 1 and n % 3 = 0 then secs end as closed_at,
         'user ' || user_id as name,
         case when n % 7 = 0 then 'note ' || n else '' end as content
  from last where kind <> 'error'
), gone as (
  select uid as id, seq, case when user_id % 2 = 0 then 'both' when n % 3 = 0 then 'outbound' when n % 3 = 1 then 'inbound' else 'both' end as direction
  from log where kind = 'error'
), kill as (
  select id, max(case when direction <> 'inbound' then seq end) as o, max(case when direction <> 'outbound' then seq end) as i from gone group by id
), edges as (
  select l.uid as from_id, l.target as to_id, case when l.kind = 'click' then 'CALLS' else 'MAPPED_TO' end as relationship, l.seq
  from log l left join kill a on a.id = l.uid left join kill b on b.id = l.target
  where l.kind in ('click', 'purchase') and l.seq > coalesce(a.o, -1) and l.seq > coalesce(b.i, -1)
)"""
_NODE_COLUMNS = ["id", "label", "entity_type", "status", "description", "last_modified", "created_at", "closed_at", "name", "content", "seq"]
_EDGE_COLUMNS = ["from_id", "to_id", "relationship", "seq"]

QUERIES["log_replay_nodes"] = lambda s, d: state.fold(event_log(s, d)).nodes.select(*_NODE_COLUMNS)
SQL["log_replay_nodes"] = f"with {LOG_SQL} select {', '.join(_NODE_COLUMNS)} from nodes"
QUERIES["log_replay_edges"] = lambda s, d: state.fold(event_log(s, d)).edges.select(*_EDGE_COLUMNS)
SQL["log_replay_edges"] = f"with {LOG_SQL} select {', '.join(_EDGE_COLUMNS)} from edges"
QUERIES["log_event_counts"] = lambda s, d: event_log(s, d).groupBy("event_type").agg(F.count("*").alias("n"))
SQL["log_event_counts"] = "select case when event_type in ('signup', 'view') then 'UPSERT_NODE' when event_type in ('click', 'purchase') then 'LINK_NODES' when user_id % 2 = 0 then 'DELETE_NODE' else 'DELETE_EDGES' end as event_type, count(*) as n from events group by 1"


def _synthesized(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = state.synthesize(state.fold(event_log(spark, sf_dir)), F.lit(0).cast("bigint"))
    again = state.fold(new)
    return again.edges.select("from_id", "to_id", "relationship").withColumn("what", F.lit("edge")).unionAll(again.nodes.select("id", "label", "name", F.lit("node")))


QUERIES["log_synthesize"] = _synthesized
SQL["log_synthesize"] = f"with {LOG_SQL} select from_id, to_id, relationship, 'edge' as what from edges union all select id, label, name, 'node' from nodes"
_PRUNE_SQL = f"""with {LOG_SQL}, idle as (select id, coalesce(closed_at, 0) as closed from nodes where label = 'Workspace' and status = 'inactive'),
gone as (select id from idle where id not in (select id from idle order by closed desc, id limit 2))"""
QUERIES["log_prune_workspaces"] = lambda s, d: state.pruned(state.fold(event_log(s, d)), keep=2)[1].nodes.select("id", "closed_at")
SQL["log_prune_workspaces"] = _PRUNE_SQL.replace("gone as (\n  select uid", "gone_ as (\n  select uid").replace("from gone group by id", "from gone_ group by id") + " select n.id, n.closed_at from nodes n join gone using (id)"


def _compact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = state.compacted(event_log(spark, sf_dir), keep=2)
    return new.agg(F.count("*").alias("compacted")).crossJoin(old.agg(F.count("*").alias("archived")))


QUERIES["log_compact_counts"] = _compact_counts
SQL["log_compact_counts"] = (
    SQL["log_prune_workspaces"].rsplit(" select n.id", 1)[0]
    + """ select (select count(*) from nodes where id not in (select id from gone)) + (select count(*) from edges where from_id not in (select id from gone) and to_id not in (select id from gone)) as compacted,
 (select count(*) from gone) + (select count(*) from edges where from_id in (select id from gone)) as archived"""
)


def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the parts they map to, which no event writes: ids of the walk, then nodes of them."""
    from graphloom.plans.graph import reached

    g = state.fold(event_log(spark, sf_dir))
    ids = reached(g.nodes.where("status = 'active'"), g.edges, "MAPPED_TO")
    return ids.join(g.nodes.select("id", F.lit(1).alias("there")), "id", "left").agg(F.count("*").alias("n_ids"), F.count("there").alias("n_nodes"))


QUERIES["traverse_dangling"] = _dangling
SQL["traverse_dangling"] = f"""with {LOG_SQL}, ids as (
  select id from nodes where status = 'active' union select to_id from edges where relationship = 'MAPPED_TO' and from_id in (select id from nodes where status = 'active'))
select count(*) as n_ids, count(n.id) as n_nodes from ids left join nodes n using (id)"""

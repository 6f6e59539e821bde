"""Queries of documents, files, embeddings, workspaces and streams, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import content_hash, file_references, inline_code
from graphloom.operators import code, embed, export, markdown, reconcile, state, workspace
from graphloom.plans import demo
from graphloom.plans.graph import Graph
from graphloom.plans.schema import LOG
from graphloom.queries_graph import GRAPH_SQL, LOG_SQL
from graphloom.sources import files
from graphloom.sources import log as logs
from graphloom.sources.folders import work_folder
from graphloom.streaming import tail

QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- markdown ---

QUERIES["md_sections"] = lambda s, d: markdown.parse(demo.markdown(s, d)).select("id", "name", "level", "start_line")
SQL["md_sections"] = """with t as (select *, row_number() over (partition by conv_id order by turn, text) as k,
  row_number() over (partition by conv_id, role order by turn, text) as r,
  1 + coalesce(sum(len(text) - len(replace(text, chr(10), '')) + 4) over (partition by conv_id order by turn, text rows between unbounded preceding and 1 preceding), 0) as line from conversations)
select 'conv/' || conv_id || '.md:' || role || case when r > 1 then ':' || r else '' end as id, role as name, 1 as level, line::int as start_line from t"""


#: Name of a part's function: a few parts share each.
_NAME = "concat(p_name, '_', cast(p_partkey % 500 as string))"
_NAME_SQL = "{0}.p_name || '_' || {0}.p_partkey % 500"


def _marked(s: SparkSession, d: str) -> DataFrame:
    """Part names as code and brands as files in a text."""
    p = demo.table(s, d, "part").withColumn("p_name", F.expr(_NAME))
    key = F.col("p_partkey")
    text = F.concat(F.lit("Use `"), "p_name", F.lit("` and `"), "p_brand", F.lit("`, or `"), "p_name", F.lit("`; see src/"), "p_brand", F.lit(".rs, (lib/m"), key.cast("string"), F.lit(".py) and notes"), (key % 7).cast("string"), F.lit(".md. Not v1.5 or `open"))
    return p.select(key.alias("p_partkey"), text.alias("text"))


QUERIES["md_inline_refs"] = lambda s, d: _marked(s, d).select("p_partkey", F.explode(inline_code(F.col("text"))).alias("ref"))
SQL["md_inline_refs"] = f"select p_partkey, {_NAME_SQL.format('part')} as ref from part union select p_partkey, p_brand from part"
QUERIES["md_path_refs"] = lambda s, d: _marked(s, d).select("p_partkey", F.explode(file_references(F.col("text"))).alias("ref"))
SQL["md_path_refs"] = "select p_partkey, case k when 1 then 'src/' || p_brand || '.rs' when 2 then 'lib/m' || p_partkey || '.py' else 'notes' || p_partkey % 7 || '.md' end as ref from part, (values (1), (2), (3)) v(k)"


def _code_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(parsed sections, nodes): a section for each part, functions named by part names, files by brand."""
    parsed = _marked(s, d).select(F.concat(F.lit("doc.md:"), F.col("p_partkey").cast("string")).alias("id"), inline_code(F.col("text")).alias("inline_code_refs"), file_references(F.col("text")).alias("file_path_refs"))
    p = demo.table(s, d, "part")
    functions = p.select(F.concat(F.lit("src/a.py:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Entity").alias("label"), F.lit("Function").alias("entity_type"), F.expr(_NAME).alias("name"))
    sources = p.select(F.concat(F.lit("src/"), "p_brand", F.lit(".rs")).alias("id"), F.lit("Entity").alias("label"), F.lit("File").alias("entity_type"), F.col("p_brand").alias("name")).distinct()
    return parsed, functions.unionAll(sources)


QUERIES["md_resolve_refs"] = lambda s, d: markdown.resolve(*_code_graph(s, d))
_SAME_NAME = f"part a join part b on {_NAME_SQL.format('a')} = {_NAME_SQL.format('b')}"
SQL["md_resolve_refs"] = f"""select 'doc.md:' || a.p_partkey as from_id, 'src/a.py:' || b.p_partkey as to_id, 'inline_code' as match_type, {_NAME_SQL.format('a')} as matched_text from {_SAME_NAME}
union all select 'doc.md:' || p_partkey, 'src/' || p_brand || '.rs', 'file_path', 'src/' || p_brand || '.rs' from part"""


def _relink(s: SparkSession, d: str) -> DataFrame:
    parsed, nodes = _code_graph(s, d)
    refs = markdown.resolve(parsed, nodes).where("match_type = 'inline_code'")
    edges = refs.select("from_id", "to_id", F.lit("REFERENCES").alias("relationship"), F.to_json(F.struct("match_type", "matched_text")).alias("properties"))
    deleted = nodes.where("entity_type = 'Function' and cast(substring_index(id, ':', -1) as int) % 2 = 0").select("id")
    sections = parsed.select("id", F.lit("Entity").alias("label"), F.lit("Section").alias("entity_type"), F.lit("").alias("name"))
    hit = markdown.affected(edges, deleted)
    left = edges.join(deleted.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return markdown.relink(hit, nodes.unionAll(sections), left).select("from_id", "to_id", F.get_json_object("properties", "$.matched_text").alias("matched_text"))


QUERIES["md_relink"] = _relink
SQL["md_relink"] = f"""select 'doc.md:' || a.p_partkey as from_id, 'src/a.py:' || b.p_partkey as to_id, {_NAME_SQL.format('a')} as matched_text
from {_SAME_NAME} where b.p_partkey % 2 = 0"""

# --- files: pages as files on disk, some of them known ---


def _disk(s: SparkSession, d: str) -> DataFrame:
    return demo.table(s, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), (F.col("page_id") % 100).alias("mtime"), F.col("html").alias("content"), "page_id")


def _known(s: SparkSession, d: str) -> DataFrame:
    disk = _disk(s, d).where("page_id % 3 <> 0")
    gone = s.range(5).select(F.concat(F.lit("gone/"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("bigint").alias("last_modified"))
    return disk.groupBy("path").agg(F.min(F.col("page_id") % 50).alias("last_modified")).unionAll(gone)


_FILES_SQL = "with disk as (select regexp_replace(url, '^[a-z]+://', '') as path, page_id % 100 as mtime, html as content, page_id from pages), known as (select path, min(page_id % 50) as last_modified from disk where page_id % 3 <> 0 group by path union all select 'gone/' || range, 1 from range(5))"
QUERIES["file_diff_changed"] = lambda s, d: files.changed(_disk(s, d), _known(s, d))
SQL["file_diff_changed"] = _FILES_SQL + " select path from disk left join known using (path) where mtime > coalesce(last_modified, 0)"
QUERIES["file_diff_stale"] = lambda s, d: files.stale(_disk(s, d), _known(s, d))
SQL["file_diff_stale"] = _FILES_SQL + " select path from known where path not in (select path from disk)"


def _rehashed(s: SparkSession, d: str) -> DataFrame:
    known = _disk(s, d).where("page_id % 3 <> 0").groupBy("path").agg(F.min(F.when(F.col("page_id") % 4 == 0, content_hash(F.lit("old"))).otherwise(content_hash(F.coalesce("content", F.lit(""))))).alias("hash"))
    return files.rehashed(_disk(s, d), known)


QUERIES["file_diff_hash"] = _rehashed
SQL["file_diff_hash"] = (
    _FILES_SQL
    + """, hashed as (select *, left(sha256(coalesce(content, '')), 16) as hash from disk),
newest as (select path, hash from (select *, row_number() over (partition by path order by mtime desc, hash) as k from hashed) where k = 1),
old as (select path, min(case when page_id % 4 = 0 then left(sha256('old'), 16) else hash end) as old from hashed where page_id % 3 <> 0 group by path)
select path, hash from newest left join old using (path) where hash is distinct from old"""
)


def _embed_skip(s: SparkSession, d: str) -> DataFrame:
    nodes = demo.star_graph(s, d).nodes.where("entity_type = 'Part'")
    cache = embed.hashed(nodes).where("cast(substring_index(id, ':', -1) as int) % 20 <> 0").select("id", "emb_hash")
    return embed.to_embed(nodes, cache).select("id", F.col("emb_hash").alias("hash"))


QUERIES["embed_skip_hash"] = _embed_skip
SQL["embed_skip_hash"] = "select 'part:' || p_partkey as id, sha256(p_name) as hash from part where p_partkey % 20 = 0"
QUERIES["embed_nodes"] = lambda s, d: embed.embed(embed.hashed(demo.star_graph(s, d).nodes.where("entity_type = 'Part'")), embed.HashingEmbedder()).select("id", F.size("embedding").alias("n_chunks"), F.size(F.col("embedding")[0]).alias("dim"))
SQL["embed_nodes"] = "select 'part:' || p_partkey as id, 1 as n_chunks, 64 as dim from part"

# --- code ---

_PYTHON = "import os\nfrom a.b import c, d as e\n\nclass K:\n    def m(self):\n        return helper(os.path.join('x'))\n\ndef helper(x):\n    return len(x)\n"


def _sources(s: SparkSession, d: str) -> DataFrame:
    return demo.table(s, d, "nation").select(F.concat(F.lit("src/n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit(_PYTHON), F.lit("def f_"), F.lower("n_name"), F.lit("():\n    return helper(K())\n")).alias("content"))


QUERIES["languages_list"] = lambda s, d: code.languages(s).select("name", F.explode("extensions").alias("extension"))
SQL["languages_list"] = "select * from (values ('TypeScript', 'ts'), ('TypeScript', 'tsx'), ('TypeScript', 'js'), ('TypeScript', 'jsx'), ('Python', 'py'), ('Rust', 'rs')) v(name, extension)"
QUERIES["py_declarations"] = lambda s, d: code.declarations(_sources(s, d)).select("id", "entity_type", "name", "line")
QUERIES["pending_refs"] = lambda s, d: code.references(_sources(s, d))
QUERIES["resolved_refs"] = lambda s, d: code.resolve(code.references(_sources(s, d)), code.declarations(_sources(s, d)))

# --- files taken in: names that repeat within a file, and files that come again changed ---


def _modules(s: SparkSession, d: str, version: int) -> DataFrame:
    """A module for each supplier; every third changes in version 2."""
    n = F.col("s_suppkey").cast("string")
    extra = F.when((F.col("s_suppkey") % 3 == 0) & F.lit(version == 2), F.concat(F.lit("\n\ndef late_"), n, F.lit("():\n    return helper_"), n, F.lit("()\n"))).otherwise("")
    text = F.concat(F.lit("class A:\n    def run(self):\n        return 1\n\nclass B:\n    def run(self):\n        return helper_"), n, F.lit("()\n\ndef helper_"), n, F.lit("():\n    return 2\n"), extra)
    return demo.table(s, d, "supplier").select(F.concat(F.lit("src/s"), n, F.lit(".py")).alias("path"), text.alias("content"))


def _reconciled(s: SparkSession, d: str) -> Graph:
    """All modules taken in, then those that changed; each batch is written, as a log's are."""
    path = work_folder(s, "reconciled")
    reconcile.events(_modules(s, d, 1), state.fold(s.createDataFrame([], LOG)), 1000).write.parquet(f"{path}/1")
    changed = _modules(s, d, 2).where(F.regexp_extract("path", "([0-9]+)", 1).cast("int") % 3 == 0)
    reconcile.events(changed, state.fold(s.read.schema(LOG).parquet(f"{path}/1")), 2000, 1 << 60).write.parquet(f"{path}/2")
    return state.fold(s.read.schema(LOG).parquet(f"{path}/1", f"{path}/2"))


_MODULES_SQL = """with m as (select 'src/s' || s_suppkey || '.py' as path, s_suppkey as n, s_suppkey % 3 = 0 as again from supplier),
nodes as (
  select path as id, 'File' as type, 's' || n || '.py' as name, null as line, again from m
  union all select path || ':A', 'Class', 'A', 1, again from m union all select path || ':B', 'Class', 'B', 5, again from m
  union all select path || ':run', 'Function', 'run', 6, again from m
  union all select path || ':helper_' || n, 'Function', 'helper_' || n, 9, again from m
  union all select path || ':late_' || n, 'Function', 'late_' || n, 13, again from m where again
), edges as (
  select path || ':' || x as from_id, path as to_id, 'DECLARED_IN' as relationship from m, (values ('A'), ('B'), ('run'), ('run')) v(x)
  union all select path || ':helper_' || n, path, 'DECLARED_IN' from m
  union all select path || ':late_' || n, path, 'DECLARED_IN' from m where again
  union all select path || ':run', path || ':helper_' || n, 'CALLS' from m
  union all select path || ':late_' || n, path || ':helper_' || n, 'CALLS' from m where again
)"""
QUERIES["reconcile_nodes"] = lambda s, d: _reconciled(s, d).nodes.select("id", F.col("entity_type").alias("type"), "name", F.get_json_object("metadata", "$.line").cast("int").alias("line"), "last_modified")
SQL["reconcile_nodes"] = _MODULES_SQL + " select id, type, name, line::int as line, case when again then 2000 else 1000 end::bigint as last_modified from nodes"
QUERIES["reconcile_edges"] = lambda s, d: _reconciled(s, d).edges.select("from_id", "to_id", "relationship")
SQL["reconcile_edges"] = _MODULES_SQL + " select * from edges"


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    """A log rewritten while more is appended, with an archive below it."""
    path, log = work_folder(s, "rewritten"), demo.event_log(s, d)
    half = F.col("seq") < log.agg(F.max("seq")).first()[0] // 2
    logs.append(log.where(half), path)
    listed = logs.listing(s, path)
    logs.archive(log.where(half), f"{path}/archive")
    logs.append(log.where(~half), path)
    logs.rewrite(logs.read(s, path, listed), path, listed)
    logs.append(log.where(F.lit(False)), path)
    return state.fold(logs.read(s, path)).edges.groupBy("from_id", "to_id", "relationship").agg(F.count("*").alias("n"))


QUERIES["log_rewrite_round_trip"] = _round_trip
SQL["log_rewrite_round_trip"] = f"with {LOG_SQL} select from_id, to_id, relationship, count(*) as n from edges group by all"

# --- workspaces ---


def _space(s: SparkSession, d: str) -> Graph:
    """The log's graph, its active workspaces linked to notes and its users declared in files."""
    g = state.fold(demo.event_log(s, d))
    spaces = g.nodes.where("label = 'Workspace'").select("id", F.expr("cast(substring(id, 2) as int)").alias("k"))
    pads = g.nodes.where("label = 'Scratchpad'").select(F.col("id").alias("to_id"), F.expr("cast(substring(id, 2) as int)").alias("p"))
    none = [F.lit("{}").alias("properties"), F.lit(0).cast("bigint").alias("seq")]
    # all pairs of three classes: notes are dealt in parts that each workspace meets, so that no task holds a class
    dealt, met = pads.withColumn("part", F.pmod(F.xxhash64("to_id"), F.lit(workspace.PARTS)).cast("int")), spaces.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(workspace.PARTS - 1))))
    to_notes = met.join(dealt, (met["k"] % 3 == dealt["p"] % 3) & (met["part"] == dealt["part"])).select(F.col("id").alias("from_id"), "to_id", F.lit("HAS_SCRATCHPAD").alias("relationship"), *none)
    inside = g.nodes.where("entity_type = 'User'").select(F.col("id").alias("from_id"), F.lit("src/users.py").alias("to_id"), F.lit("DECLARED_IN").alias("relationship"), *none)
    return Graph(g.nodes, to_notes.unionAll(inside))


_SPACE_SQL = f"with {LOG_SQL}, act as (select id, substr(id, 2)::int as k from nodes where label = 'Workspace' and status = 'active')"
QUERIES["workspace_active"] = lambda s, d: workspace.active(_space(s, d)).select("id", "description")
SQL["workspace_active"] = _SPACE_SQL + " select id, description from nodes where label = 'Workspace' and status = 'active'"
QUERIES["workspace_notes"] = lambda s, d: workspace.notes(_space(s, d)).select("workspace", "id", "created_at")
SQL["workspace_notes"] = _SPACE_SQL + " select a.id as workspace, n.id, n.created_at from act a join nodes n on n.label = 'Scratchpad' and substr(n.id, 2)::int % 3 = a.k % 3 order by n.created_at desc, n.id, a.id limit 5"
QUERIES["workspace_map_file"] = lambda s, d: workspace.mapped(_space(s, d), "src/users.py").select("from_id", "to_id", "relationship")
SQL["workspace_map_file"] = _SPACE_SQL + " select act.id as from_id, n.id as to_id, 'MAPPED_TO' as relationship from act, nodes n where n.entity_type = 'User'"
QUERIES["workspace_report"] = lambda s, d: workspace.report(_space(s, d))
SQL["workspace_report"] = (
    _SPACE_SQL
    + """ select 'entities' as section, entity_type as name, count(*)::varchar as value from nodes where label = 'Entity' group by entity_type
union all (select 'workspaces', id, description from nodes where label = 'Workspace' and status = 'active' order by id limit 3)
union all (select 'notes', id, content from (select a.id as space, n.* from act a join nodes n on n.label = 'Scratchpad' and substr(n.id, 2)::int % 3 = a.k % 3) order by created_at desc, id, space limit 5)"""
)
QUERIES["graph_export_edges"] = lambda s, d: export.graph_edges(demo.star_graph(s, d, distinct=False), 5000)
SQL["graph_export_edges"] = GRAPH_SQL + ", first_ as (select id from nodes order by id limit 5000) select distinct from_id, to_id, relationship from edges where from_id in (select id from first_) and to_id in (select id from first_)"
QUERIES["graph_export_nodes"] = lambda s, d: export.graph_nodes(demo.star_graph(s, d))
SQL["graph_export_nodes"] = GRAPH_SQL + " select id, name, entity_type as type, 'module' as category from nodes order by id limit 1000"

# --- the log as files and as a stream ---


def _malformed(s: SparkSession, d: str) -> DataFrame:
    """The log as JSON lines, each seventh broken and blank ones between, scanned again."""
    log = demo.event_log(s, d)
    lines = logs.to_json(log.withColumn("timestamp", F.col("seq"))).select("value", F.get_json_object("value", "$.timestamp").cast("bigint").alias("seq"))
    broken = lines.select("seq", F.when(F.col("seq") % 7 == 0, F.substring("value", 1, 30)).when(F.col("seq") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "value")).alias("value"))
    path = work_folder(s, "log")
    broken.select("value").write.text(path)
    return logs.read(s, path).select(F.col("timestamp").alias("seq"), "event_type", "id", "from_id", "to_id")


QUERIES["log_malformed_scan"] = _malformed
SQL["log_malformed_scan"] = f"""with {LOG_SQL} select seq,
  case when kind in ('signup', 'view') then 'UPSERT_NODE' when kind in ('click', 'purchase') then 'LINK_NODES' when user_id % 2 = 0 then 'DELETE_NODE' else 'DELETE_EDGES' end as event_type,
  case when kind in ('signup', 'view') or kind = 'error' and user_id % 2 = 0 then uid end as id,
  case when kind in ('click', 'purchase') or kind = 'error' and user_id % 2 = 1 then uid end as from_id,
  case when kind in ('click', 'purchase') then target end as to_id
from log where seq % 7 <> 0 and seq % 11 <> 0"""


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The log written as files, followed as a stream into a table, then folded."""
    base = work_folder(s, "stream")
    log = demo.event_log(s, d)
    logs.append(log, f"{base}/in")
    tail.follow(s, f"{base}/in", f"{base}/log", f"{base}/state").awaitTermination()
    g = state.fold(tail.read_followed(s, f"{base}/log"))
    return g.nodes.select("id", "label", "name", "content", "last_modified")


QUERIES["stream_replay_equals_batch"] = _streamed
SQL["stream_replay_equals_batch"] = f"with {LOG_SQL} select id, label, name, content, last_modified from nodes"

"""Queries of what is kept beside a log: snapshots, indexes, the queue of references, vectors; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions.text import uri_to_path
from graphloom.operators import bm25, embed, pending, snapshot, state
from graphloom.operators.index import TextIndex
from graphloom.operators.snapshot import Snapshots
from graphloom.plans import demo
from graphloom.plans.graph import Graph, label_object
from graphloom.queries_graph import LOG_SQL
from graphloom.queries_search import CHUNKS_SQL, CORPUS_SQL, pooled_sql, postings_sql, scores_sql
from graphloom.sources import files
from graphloom.sources import log as logs
from graphloom.sources.folders import work_folder, written
from graphloom.streaming import tail

QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- snapshots ---

_NODES = ("id", "label", "entity_type", "status", "description", "last_modified", "created_at", "closed_at", "name", "content")
_EDGES = ("from_id", "to_id", "relationship")


def _quarters(log: DataFrame) -> list[DataFrame]:
    """A log in four parts, one after the other."""
    last = log.agg(F.max("seq")).first()[0] or 0
    return [log.where((F.col("seq") * 4 >= k * (last + 1)) & (F.col("seq") * 4 < (k + 1) * (last + 1))) for k in range(4)]


def _snapshotted(s: SparkSession, d: str) -> Graph:
    """A log written in four batches, with a snapshot after each of the first three; each extends the one before."""
    path = work_folder(s, "snapshots")
    kept = Snapshots(s, f"{path}/_state")
    for k, part in enumerate(_quarters(demo.event_log(s, d))):
        logs.append(part, path)
        listed = logs.listing(s, path)
        if k < 3:
            kept.write(snapshot.at(s, path, kept, listed, often=True), listed)
    return snapshot.current(s, path, kept)


QUERIES["log_snapshot_nodes"] = lambda s, d: _snapshotted(s, d).nodes.select(*_NODES)
SQL["log_snapshot_nodes"] = f"with {LOG_SQL} select {', '.join(_NODES)} from nodes"
QUERIES["log_snapshot_edges"] = lambda s, d: _snapshotted(s, d).edges.select(*_EDGES)
SQL["log_snapshot_edges"] = f"with {LOG_SQL} select {', '.join(_EDGES)} from edges"

# --- fields of wrong types ---


def _typed(s: SparkSession, d: str) -> DataFrame:
    """The log with a field of a wrong type in about half its lines, scanned and folded."""
    log = demo.event_log(s, d)
    n, value = F.col("at") - 1, F.col("value")
    lines = logs.to_json(log.withColumn("timestamp", F.col("seq") + 1)).select("value", F.get_json_object("value", "$.timestamp").cast("bigint").alias("at"))
    wrong = {
        1: (r'"version":1', '"version":"1"'), 2: (r'"timestamp":', '"timestamp":-'), 3: (r'([{,])"id":"[^"]*"', '$1"id":5'),
        4: (r'"properties":\{.*$', '"properties":[1]}}'), 5: (r'"event_type":"[A-Z_]*"', '"event_type":"upsert_node"'),
        6: (r'"direction":"[a-z]*"', '"direction":5'), 7: (r'"to_id":"[^"]*"', '"to_id":7'),
    }
    both = value
    for k, (old, new) in wrong.items():
        both = F.when(n % 13 == k, F.regexp_replace("value", old, new)).otherwise(both)
    path = work_folder(s, "typed")
    lines.select(both.alias("value"), "at").orderBy("at").select("value").write.text(path)
    g = state.fold(logs.read(s, path))
    return g.nodes.select("id", "label", "name", F.lit("node").alias("what")).unionAll(g.edges.select("from_id", "to_id", "relationship", F.lit("edge")))


QUERIES["log_typed_scan"] = _typed
_SOUND = """select * from events where not (event_id % 13 in (1, 2, 5)
  or event_id % 13 = 3 and (event_type in ('signup', 'view') or event_type = 'error' and user_id % 2 = 0)
  or event_id % 13 = 4 and event_type <> 'error' or event_id % 13 = 6 and event_type = 'error' and user_id % 2 = 1
  or event_id % 13 = 7 and event_type in ('click', 'purchase'))"""
SQL["log_typed_scan"] = f"with sound as ({_SOUND}), {LOG_SQL.replace('from events', 'from sound')} select id, label, name, 'node' as what from nodes union all select from_id, to_id, relationship, 'edge' from edges"

# --- streams of many files ---


def _many_files(s: SparkSession, d: str) -> DataFrame:
    """A log as a small file, a large one and a middling one, followed as one micro-batch."""
    base, log = work_folder(s, "files"), demo.event_log(s, d)
    last = log.agg(F.max("seq")).first()[0] or 0
    for low, high in ((0, last // 10), (last // 10, last // 10 * 8), (last // 10 * 8, last + 1)):
        logs.append(log.where((F.col("seq") >= low) & (F.col("seq") < high)), f"{base}/in")
    tail.follow(s, f"{base}/in", f"{base}/log", f"{base}/state").awaitTermination()
    g = state.fold(tail.read_followed(s, f"{base}/log"))
    return g.nodes.select("id", "label", "name", F.lit("node").alias("what")).unionAll(g.edges.select("from_id", "to_id", "relationship", F.lit("edge")))


QUERIES["stream_many_files"] = _many_files
SQL["stream_many_files"] = f"with {LOG_SQL} select id, label, name, 'node' as what from nodes union all select from_id, to_id, relationship, 'edge' from edges"

# --- indexes that follow ---

_ASKED = "red thing Reing"


def _upserts(rows: DataFrame, **properties: Column) -> DataFrame:
    held = F.to_json(F.struct(*[c.alias(k) for k, c in properties.items()]))
    return rows.select(*logs.event("UPSERT_NODE", F.monotonically_increasing_id(), id=F.col("id"), label=F.lit("Section"), properties=held))


def _texts(s: SparkSession, d: str) -> DataFrame:
    """(id, n, name, content): documents, named by parts of the same number."""
    docs = demo.table(s, d, "documents").select(F.col("doc_id").alias("n"), F.col("text").alias("content"))
    parts = demo.table(s, d, "part").select(F.col("p_partkey").cast("bigint").alias("n"), F.col("p_name").alias("name"))
    return docs.join(parts, "n", "full").select(F.concat(F.lit("d"), F.col("n").cast("string")).alias("id"), "n", "name", "content")


def _follow_text(s: SparkSession, d: str) -> DataFrame:
    """An index built, then brought up to a log in which nodes were replaced, deleted and added."""
    e, rows = Engine(s, work_folder(s, "follow-text")), _texts(s, d)
    k = F.col("n") % 10
    e.append(_upserts(rows.where(k > 0), name=F.col("name"), content=F.when(k == 1, F.concat(F.lit("thing red "), "content")).otherwise(F.col("content"))))
    e.index(f"{e.path}/_index")
    e.append(_upserts(rows.where(k < 2), name=F.col("name"), content=F.col("content")))
    e.append(rows.where(k == 2).select(*logs.event("DELETE_NODE", F.monotonically_increasing_id(), id=F.col("id"))))
    return e.index(f"{e.path}/_index")[0].search(_ASKED, 50).select("doc_id", F.round("score", 6).alias("score"))


QUERIES["index_follow_text"] = _follow_text
SQL["index_follow_text"] = f"""with {CORPUS_SQL}, left_ as (select * from corpus where substr(doc_id, 2)::bigint % 10 <> 2),
{postings_sql('left_')}, {scores_sql(_ASKED)}, {pooled_sql(50)} select id as doc_id, round(score, 6) as score from lexical"""


def _follow_vectors(s: SparkSession, d: str) -> DataFrame:
    """Nearest chunks in an index that followed a log: nodes whose vectors came later, shrank to one, and went."""
    e = Engine(s, work_folder(s, "follow-vectors"))
    lists = demo.chunks(s, d).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "vec"))).alias("all"))
    rows = lists.select(F.col("node_id").alias("id"), F.expr("cast(substring(node_id, 2) as int)").alias("n"), F.transform("all", lambda c: c["vec"]).alias("vecs"))
    k = F.col("n") % 10
    e.append(_upserts(rows.where(k > 0), name=F.col("id"), embedding=F.col("vecs")))
    e.index(f"{e.path}/_index")
    e.append(_upserts(rows.where(k == 0), name=F.col("id"), embedding=F.col("vecs")))
    e.append(_upserts(rows.where(k == 1), name=F.col("id"), embedding=F.slice("vecs", 1, 1)))
    e.append(rows.where(k == 2).select(*logs.event("DELETE_NODE", F.monotonically_increasing_id(), id=F.col("id"))))
    found = e.index(f"{e.path}/_index")[1].nearest(demo.query_vector(s, d), 50)
    return found.select("node_id", "chunk_idx", F.round("sim", 6).alias("sim"))


QUERIES["index_follow_vectors"] = _follow_vectors
_SIMS_SQL = CHUNKS_SQL.split("best as")[0].rstrip().rstrip(",")
SQL["index_follow_vectors"] = f"""with {_SIMS_SQL}, kept as (select * from sims where substr(node_id, 2)::int % 10 <> 2 and (substr(node_id, 2)::int % 10 <> 1 or chunk_idx = 0))
select node_id, chunk_idx, round(sim, 6) as sim from kept order by round(kept.sim, 9) desc, node_id, chunk_idx limit 50"""

# --- many requests at once ---


def _search_batch(s: SparkSession, d: str) -> DataFrame:
    """A request for each document whose id is divisible by 100, by the name of the part of that number, against all."""
    index = TextIndex(s, work_folder(s, "batch-index"))
    index.add(demo.corpus(s, d))
    parts = demo.table(s, d, "part").select(F.col("p_partkey").cast("bigint").alias("doc_id"), F.col("p_name").alias("text"))
    asked = demo.table(s, d, "documents").where("doc_id % 100 = 0").select("doc_id").distinct().join(parts, "doc_id")
    return index.search_many(asked.select(F.col("doc_id").alias("request_id"), "text"), 10).select("request_id", "doc_id", F.round("score", 6).alias("score"), "place")


QUERIES["search_batch"] = _search_batch
_FIELD_WEIGHTS = " ".join(f"when '{f}' then {w}" for f, w in bm25.WEIGHTS.items())
SQL["search_batch"] = f"""with {CORPUS_SQL}, {postings_sql('corpus')},
asked as (select substr(p.doc_id, 2)::bigint as request_id, token, tf as weight from post p where field = 'name' and substr(p.doc_id, 2)::bigint in (select doc_id from documents where doc_id % 100 = 0)),
df as (select field, token, count(*) as df from post where token in (select token from asked) group by all),
worth as (select field, doc_id, token, ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)) as part
  from post join df using (field, token) join len using (field, doc_id) join stat using (field)),
scores as (select request_id, field, doc_id, sum(weight * part) as score from worth join asked using (token) group by all),
pooled as (select * from (select *, row_number() over (partition by request_id, field order by round(score, 9) desc, doc_id) as k from scores) where k <= 30),
total as (select request_id, doc_id, sum(score * case field {_FIELD_WEIGHTS} end) as score from pooled group by all)
select request_id, doc_id, round(score, 6) as score, place::int as place
from (select *, row_number() over (partition by request_id order by round(score, 9) desc, doc_id) as place from total) where place <= 10"""

# --- labels and paths ---

QUERIES["label_objects"] = lambda s, d: state.fold(demo.event_log(s, d)).nodes.select("id", label_object().alias("object"))
SQL["label_objects"] = f"""with {LOG_SQL} select id, case label when 'Entity' then json_object('label', label, 'type', entity_type, 'status', status, 'last_modified', last_modified)
  when 'Workspace' then json_object('label', label, 'description', description, 'status', status, 'closed_at', closed_at) else json_object('label', label, 'created_at', created_at) end::varchar as object from nodes"""
_URI = "case when page_id % 3 = 0 then 'file:///' when page_id % 3 = 1 then 'file://' else '' end || url"
QUERIES["uri_paths"] = lambda s, d: demo.table(s, d, "pages").select("page_id", uri_to_path(F.expr(_URI)).alias("path"))
SQL["uri_paths"] = "select page_id, case when page_id % 3 = 0 then '/' else '' end || url as path from pages"

# --- trees on disk ---


def _sync_diff(s: SparkSession, d: str) -> DataFrame:
    """Pages as files: some grew past what is read, some were touched and not changed, some are gone or new."""
    n, path = F.col("page_id"), F.concat(F.lit("f"), F.col("page_id").cast("string"))
    pages = demo.table(s, d, "pages").where("html is not null").select("page_id", path.alias("path"), F.col("html").alias("content"))
    present = pages.where(n % 7 != 0)
    contents = present.where(n % 5 != 0).withColumn("mtime", F.when(n % 3 == 0, 5).otherwise(1))
    old = F.when(n % 4 == 0, F.concat("content", F.lit("old"))).otherwise(F.col("content"))
    hashed = F.substring(F.sha2(old, 256), 1, 16)
    known = pages.where(n % 11 != 0).select("path", F.lit(2).cast("bigint").alias("last_modified"), F.when(n % 13 != 0, hashed).alias("hash"))
    return files.plan(present, contents, known)


QUERIES["sync_diff"] = _sync_diff
SQL["sync_diff"] = """with p as (select page_id as n, 'f' || page_id as path from pages where html is not null)
select path, 'take' as action from p where n % 7 <> 0 and n % 5 <> 0 and (n % 11 = 0 or n % 3 = 0 and (n % 4 = 0 or n % 13 = 0))
union all select path, 'drop' from p where n % 7 = 0 and n % 11 <> 0"""

# --- references that wait ---


def _across_batches(s: SparkSession, d: str) -> DataFrame:
    """Orders refer to parts by name; suppliers declare them. A third of the suppliers come with the orders,
    a third later, and the last third as the first goes. What each reference is linked to, null where it waits."""
    lines = demo.table(s, d, "lineitem")
    name = F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))
    maker, asker = (F.concat(F.lit(p), F.col(c).cast("string"), F.lit(".py")) for p, c in (("made/s", "l_suppkey"), ("used/o", "l_orderkey")))
    made, used = lines.select("l_suppkey", "l_partkey").distinct(), lines.select("l_orderkey", "l_partkey").distinct()
    declared = written(made.select((F.col("l_suppkey") % 3).alias("third"), F.concat(maker, F.lit(":"), name).alias("id"), name.alias("name"), maker.alias("path")), "declared")
    refs = written(used.select(asker.alias("path"), F.lit("CALLS").alias("kind"), name.alias("name"), F.concat(asker, F.lit(":run")).alias("from_id")), "refs")
    none = s.createDataFrame([], pending.QUEUE)
    queue, links = none, none.withColumn("to_id", F.lit(None).cast("string"))
    for batch in range(3):
        come = declared.where(F.col("third") == batch)
        gone = declared.where((F.col("third") == 0) & F.lit(batch == 2))
        known = declared.where((F.col("third") <= batch) & ((F.col("third") > 0) | F.lit(batch < 2)))
        changed, taken = come.select("name").unionAll(gone.select("name")), come.select("path").distinct()
        asked = refs if batch == 0 else none
        found, queue = pending.step(queue, asked, links, known, changed, gone.select("id"), taken)
        kept = links.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti")
        links = kept.unionByName(found)
    return links.select("from_id", "name", "to_id").unionAll(queue.select("from_id", "name", F.lit(None).cast("string")))


QUERIES["pending_across_batches"] = _across_batches
SQL["pending_across_batches"] = """with made as (select distinct l_partkey as p, l_suppkey as s, l_suppkey % 3 as third from lineitem),
n as (select p, count(*) filter (third = 0) as c0, count(*) filter (third = 1) as c1, count(*) filter (third = 2) as c2, min(s) filter (third = 1) as s1, min(s) filter (third = 2) as s2 from made group by p)
select 'used/o' || o || '.py:run' as from_id, 'part_' || p as name,
  case when c0 = 0 and c1 = 1 or c1 = 1 and c2 = 0 then 'made/s' || s1 || '.py:part_' || p when c1 = 0 and c2 = 1 then 'made/s' || s2 || '.py:part_' || p end as to_id
from (select distinct l_orderkey as o, l_partkey as p from lineitem) join n using (p)"""

# --- vectors by content ---


def _embedded(s: SparkSession, d: str) -> DataFrame:
    """Hashes of texts that each of two batches of nodes computed: parts of even number, then all with some renamed."""
    store, nodes = embed.VectorStore(s, work_folder(s, "vectors")), demo.star_graph(s, d).nodes.where("entity_type = 'Part'")
    n = F.expr("cast(substring_index(id, ':', -1) as int)")
    later = nodes.withColumn("name", F.when(n % 10 == 0, F.concat("name", F.lit(" new"))).otherwise(F.col("name")))
    parts = [store.fill(batch, embed.HashingEmbedder(8)) for batch in (nodes.where(n % 2 == 0), later)]
    held = later.select("id").join(store.vectors(later), "id").count()
    rows = [store.known([part]).select(F.lit(k + 1).alias("batch"), F.col("emb_hash").alias("hash")) for k, part in enumerate(parts)]
    return rows[0].unionAll(rows[1]).unionAll(s.range(1).select(F.lit(0), F.lit(str(held))))


QUERIES["reconcile_embeddings"] = _embedded
SQL["reconcile_embeddings"] = """with one as (select distinct sha256(p_name) as hash from part where p_partkey % 2 = 0 and p_name <> ''),
two as (select distinct sha256(p_name || case when p_partkey % 10 = 0 then ' new' else '' end) as hash from part where p_name <> '')
select 1 as batch, hash from one union all select 2, hash from two where hash not in (select hash from one)
union all select 0, count(*)::varchar from part where p_name <> ''"""

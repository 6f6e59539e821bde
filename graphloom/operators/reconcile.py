"""Files taken into the graph: events that make it agree with what files now hold."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import content_hash
from graphloom.operators import bm25, code, markdown, pending
from graphloom.plans.graph import Graph
from graphloom.sources.folders import written

#: Ranks of event kinds within a batch: what is removed goes first, links come after all nodes.
_ORDER = {"delete": 0, "file": 1, "node": 2, "declared": 3, "reference": 4}
#: Bits of seq below the rank, and of those below the place in the file.
SEQ_BITS, HASH_BITS = 56, 34
_COLUMNS = ("event_type", "id", "label", "from_id", "to_id", "relationship", "properties")


def _event(df: DataFrame, rank: str, kind: str, place: Column | None = None, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    at = F.lit(0) if place is None else place
    return df.select(F.lit(_ORDER[rank]).alias("rank"), at.alias("place"), F.lit(kind).alias("event_type"), *[columns.get(c, none).alias(c) for c in _COLUMNS[1:]])


def deletions(files: DataFrame, graph: Graph) -> DataFrame:
    """(id, path): nodes declared in the files, and the files themselves where they are empty now."""
    declared = graph.edges.where("relationship = 'DECLARED_IN'").select(F.col("from_id").alias("id"), F.col("to_id").alias("path")).join(files.select("path"), "path", "left_semi")
    empty = files.where("content is null or trim(content) = ''").select(F.col("path").alias("id"), "path")
    return declared.select("id", "path").unionAll(empty).distinct()


@dataclass(frozen=True)
class Work:
    """What a batch of files comes to: log rows, the queue of open references after it, and those of them that the batch asked."""

    events: DataFrame
    queue: DataFrame
    pending: DataFrame


def events(files: DataFrame, graph: Graph, now_ms: int, first_seq: int = 0) -> DataFrame:
    """Log rows of `work` without a queue."""
    return work(files, graph, now_ms, files.sparkSession.createDataFrame([], pending.QUEUE), first_seq).events


def work(files: DataFrame, graph: Graph, now_ms: int, queue: DataFrame, first_seq: int = 0) -> Work:
    """What brings `graph` up to `files` (path, content), where the references in `queue` wait.

    All that the files declared goes; each file that isn't empty is written with its functions,
    classes and sections, and these are linked to it. A file keeps the hash of its content in its
    metadata. Calls and imports are resolved by name against the graph and the batch, or wait (see
    `pending.step`); section references are resolved against the same, so that documents find code
    that comes with them. References of other documents to what was deleted are restored by name.
    Of declarations of one file that share a name the last counts. seq starts at `first_seq` and has gaps; rows that are equal share one.
    """
    full = bm25.spread(files.where("content is not null and trim(content) <> ''"), "content", "path")
    names = graph.nodes.select("id", "name")
    gone = written(deletions(files, graph).join(names, "id", "left"), "gone")
    # files are parsed once, on all cores
    decl, parsed = written(code.declarations(full), "declarations"), written(markdown.parse(full), "sections")
    stamp = F.lit(now_ms)
    file_props = F.to_json(F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("File").alias("entity_type"), F.lit("active").alias("status"), stamp.alias("last_modified"), F.to_json(F.struct(content_hash(F.col("content")).alias("hash"))).alias("metadata")))
    decl_props = F.to_json(F.struct("name", "entity_type", F.lit("active").alias("status"), stamp.alias("last_modified"), F.col("source_text").alias("content"), F.to_json(F.struct("line")).alias("metadata")))
    sect_props = F.to_json(F.struct("name", F.lit("Section").alias("entity_type"), F.lit("active").alias("status"), stamp.alias("last_modified"), "content", F.to_json(F.struct("level", "start_line", "end_line")).alias("metadata")))
    entity = F.lit("Entity")
    # the graph as it will be once nodes are written, for names to be looked up in
    kept = graph.nodes.join(gone.select("id").distinct(), "id", "left_anti").select("id", "label", "entity_type", "name")
    new = decl.select("id", entity.alias("label"), "entity_type", "name", "place").unionAll(full.select(F.col("path").alias("id"), entity.alias("label"), F.lit("File").alias("entity_type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(-1)))
    # of one id the last declaration, as the log's fold will have it
    every = kept.withColumn("place", F.lit(-2)).unionAll(new)
    nodes = every.groupBy("id").agg(F.max(F.struct("place", "label", "entity_type", "name")).alias("n")).select("id", "n.label", "n.entity_type", "n.name")
    nodes = written(nodes, "names")
    known = nodes.where("entity_type in ('Function', 'Class')").select("id", "name", F.substring_index("id", ":", 1).alias("path"))
    refs_asked = written(code.asked(code.references(full)), "references")
    changed = gone.where("name is not null").select("name").unionAll(decl.select("name"))
    found, waiting = pending.step(queue, refs_asked, pending.linked(graph, gone), known, changed, gone, files)
    calls = code.links(found)
    refs = markdown.resolve(parsed, nodes)
    sections = graph.nodes.where("entity_type = 'Section'").select("id", "entity_type").join(gone.select("id"), "id", "left_anti")
    restored = _restored(graph, gone, sections, nodes)
    parts = [
        _event(gone, "delete", "DELETE_NODE", id=F.col("id")),
        _event(full, "file", "UPSERT_NODE", id=F.col("path"), label=entity, properties=file_props),
        _event(decl, "node", "UPSERT_NODE", F.col("place"), id=F.col("id"), label=entity, properties=decl_props),
        _event(parsed, "node", "UPSERT_NODE", id=F.col("id"), label=entity, properties=sect_props),
        _event(decl, "declared", "LINK_NODES", from_id=F.col("id"), to_id=F.col("path"), relationship=F.lit("DECLARED_IN"), properties=F.lit("{}")),
        _event(parsed, "declared", "LINK_NODES", from_id=F.col("id"), to_id=F.col("path"), relationship=F.lit("DECLARED_IN"), properties=F.lit("{}")),
        _event(calls, "reference", "LINK_NODES", from_id=F.col("from_id"), to_id=F.col("to_id"), relationship=F.col("relationship"), properties=F.col("properties")),
        _event(refs, "reference", "LINK_NODES", from_id=F.col("from_id"), to_id=F.col("to_id"), relationship=F.lit("REFERENCES"), properties=F.to_json(F.struct("match_type", "matched_text"))),
        _event(restored, "reference", "LINK_NODES", from_id=F.col("from_id"), to_id=F.col("to_id"), relationship=F.col("relationship"), properties=F.col("properties")),
    ]
    rows = reduce(DataFrame.unionAll, parts)
    # seq within a batch: one rank after another, inside a rank by place in the file, then by a hash of
    # the row, which needs no shuffle and is the same when a task runs again
    ranked = F.shiftleft(F.col("rank").cast("bigint"), SEQ_BITS) + F.shiftleft(F.col("place").cast("bigint"), HASH_BITS)
    seq = F.lit(first_seq) + ranked + F.pmod(F.xxhash64(*_COLUMNS), F.lit(1 << HASH_BITS))
    batch = rows.select(seq.cast("bigint").alias("seq"), F.lit(1).alias("version"), (stamp / 1000).cast("bigint").alias("timestamp"), "event_type", "id", "label", "from_id", "to_id", "relationship", F.lit(None).cast("string").alias("direction"), "properties")
    return Work(batch, waiting, refs_asked.join(found, ["path", "kind", "name", "from_id"], "left_anti"))


def _restored(graph: Graph, gone: DataFrame, sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """References of sections that stay to what was deleted, by name."""
    hit = markdown.affected(graph.edges, gone.select("id")).join(sections.select(F.col("id").alias("section")), "section", "left_semi")
    code_nodes = nodes.where("entity_type in ('Function', 'Class')")
    stay = graph.edges.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    both = code_nodes.select("id", "label", "entity_type", "name").unionAll(sections.select("id", F.lit("Entity"), "entity_type", F.lit(None).cast("string")))
    return markdown.relink(hit, both, stay)


def counts(batch: DataFrame, waiting: DataFrame) -> dict[str, int]:
    """What a reconciliation did: nodes written, nodes deleted, edges written, references of its files
    that wait, as what they name is declared nowhere or at several places alike."""
    kinds = {r[0]: r[1] for r in batch.groupBy("event_type").agg(F.countDistinct(F.coalesce("id", F.xxhash64(*_COLUMNS).cast("string")))).collect()}
    return {"upserted_nodes": kinds.get("UPSERT_NODE", 0), "deleted_nodes": kinds.get("DELETE_NODE", 0), "linked_edges": kinds.get("LINK_NODES", 0), "edges_pending": waiting.count()}

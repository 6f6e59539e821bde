"""The engine as one object: a log, the graph it folds to, and requests against it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import bm25, code, dense, embed, pending, reconcile, snapshot, state, workspace
from graphloom.operators import search as hybrid
from graphloom.operators.index import TextIndex, VectorIndex
from graphloom.operators.snapshot import Mark, Snapshots
from graphloom.plans import graph as plans
from graphloom.sources import files as sources
from graphloom.sources import log as logs
from graphloom.sources.folders import written


class Engine:
    """A log at `path` (JSONL files below it), and what is kept beside it.

    The graph is worked out on demand, from the last snapshot and the batches since. With an
    `embedder` files taken in bring vectors, and searches have a dense side of their own.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: embed.Embedder | None = None, snapshot_every: int = 32):
        self.spark, self.path, self.embedder, self.every = spark, path.rstrip("/"), embedder, snapshot_every
        self.snapshots = Snapshots(spark, f"{self.path}/_state")
        self.queue = pending.Queue(spark, f"{self.path}/_pending")
        self.store = embed.VectorStore(spark, f"{self.path}/_vectors")

    @property
    def log(self) -> DataFrame:
        return logs.read(self.spark, self.path)

    @property
    def graph(self) -> plans.Graph:
        return snapshot.current(self.spark, self.path, self.snapshots)

    def _worked(self) -> plans.Graph:
        return snapshot.at(self.spark, self.path, self.snapshots, logs.listing(self.spark, self.path), often=True)

    def snapshot(self) -> None:
        """Keeps the graph as it is now, for later requests to begin with."""
        listed = logs.listing(self.spark, self.path)
        self.snapshots.write(snapshot.at(self.spark, self.path, self.snapshots, listed, often=True), listed)

    def query(self, request: dict) -> DataFrame:
        return plans.run(self.graph, request)

    def search(self, request: dict, vector: list[float] | None = None, now: int | None = None, index: tuple[TextIndex, VectorIndex] | None = None) -> DataFrame:
        """Hits of a request; with kept indexes only what they hold of its terms is read. Without a
        `vector` the engine's embedder makes one of the request's text."""
        if vector is None and self.embedder is not None:
            vector = [float(x) for x in self.embedder.embed([request["text"]])[0]] if request.get("text") else None
        text, chunks = (index[0].source(), index[1].chunks()) if index else (None, None)
        return hybrid.search(self.graph, request, text, chunks, vector=vector, now=now)

    def append(self, events: DataFrame) -> None:
        n = logs.append(events, self.path)
        if self.every and n % self.every == self.every - 1:
            self.snapshot()

    def _event(self, kind: str, **payload: str | None) -> None:
        columns = {k: F.lit(v) for k, v in payload.items() if v is not None}
        self.append(self.spark.range(1).select(*logs.event(kind, F.lit(0).cast("bigint"), **columns)))

    def upsert_node(self, node_id: str, label: str, properties: dict) -> None:
        """Writes a node whole."""
        self._event("UPSERT_NODE", id=node_id, label=label, properties=json.dumps(properties))

    def link_nodes(self, from_id: str, to_id: str, relationship: str, properties: dict | None = None) -> None:
        self._event("LINK_NODES", from_id=from_id, to_id=to_id, relationship=relationship, properties=json.dumps(properties or {}))

    def delete_node(self, node_id: str) -> None:
        """Deletes a node and all its edges."""
        self._event("DELETE_NODE", id=node_id)

    def delete_edges(self, node_id: str, direction: str = "outbound") -> None:
        self._event("DELETE_EDGES", from_id=node_id, direction=direction)

    def languages(self) -> DataFrame:
        return code.languages(self.spark)

    def reconcile(self, files: DataFrame, now_ms: int) -> dict[str, int]:
        """Takes in `files` (path, content); returns what that did. References that nothing answers
        wait, and are linked by the batch that declares what they name."""
        work = reconcile.work(files, self._worked(), now_ms, self.queue.read())
        batch = written(work.events, "batch")  # worked out once, for the log and the counts
        if self.embedder is not None:
            nodes = state.nodes(state.effective(batch))
            self.store.fill(nodes, self.embedder)
            batch = embed.with_vectors(batch, self.store.vectors(nodes))
        waiting = written(work.pending, "pending")
        queue = written(work.queue, "queue")
        self.append(batch)
        self.queue.write(queue)
        return reconcile.counts(batch, waiting)

    def sync(self, root: str, now_ms: int) -> dict[str, int]:
        """Makes the graph agree with the source tree below `root`: files that are newer than the graph
        has them and differ are taken in, and those that are gone are taken out. Files too large to be read
        are there all the same."""
        disk = sources.scan(self.spark, root)
        known = self.graph.by_type("File").select(F.col("id").alias("path"), "last_modified", F.get_json_object("metadata", "$.hash").alias("hash"))
        actions = written(sources.plan(sources.listed(self.spark, root), disk, known), "sync")
        new = disk.join(actions.where("action = 'take'"), "path", "left_semi").select("path", "content")
        gone = actions.where("action = 'drop'").select("path", F.lit(None).cast("string").alias("content"))
        return self.reconcile(written(new.unionByName(gone), "files"), now_ms)

    def track(self, path: str) -> None:
        """Maps all that a file declares to the active workspaces."""
        pairs = workspace.mapped(self.graph, path)
        place = F.pmod(F.xxhash64("from_id", "to_id"), F.lit(1 << 40))
        self.append(pairs.select(*logs.event("LINK_NODES", place, from_id=F.col("from_id"), to_id=F.col("to_id"), relationship=F.col("relationship"), properties=F.col("properties"))))

    def report(self) -> DataFrame:
        return workspace.report(self.graph)

    def index(self, path: str) -> tuple[TextIndex, VectorIndex]:
        """Kept indexes below `path`, brought up to the log.

        An index says how far it goes into the log. Nodes that later batches write or delete make its
        next generation; where there is none yet, or the log was rewritten, that is all of them.
        """
        listed = logs.listing(self.spark, self.path)
        mark, graph = Mark.of(listed), snapshot.at(self.spark, self.path, self.snapshots, listed, often=True)
        text, vectors = TextIndex(self.spark, f"{path}/text"), VectorIndex(self.spark, f"{path}/vectors")
        for kept, make, key in ((text, bm25.node_fields, "doc_id"), (vectors, dense.node_chunks, "node_id")):
            old = kept.mark()
            if old is not None and old.begins(listed):
                if old.upto == listed.upto:
                    continue
                ids = state.touched(state.effective(snapshot.since(self.spark, self.path, listed, old)))
                nodes = graph.nodes.join(ids, "id", "left_semi")
            else:
                nodes, ids = graph.nodes, graph.nodes.select("id").unionAll(kept.held().toDF("id")).distinct()
            kept.change(written(make(nodes), "indexed"), ids.select(F.col("id").alias(key)), mark)
        return text, vectors

    def open_workspace(self, name: str, description: str, now: int) -> None:
        self.append(workspace.initialize(self.graph, name, description, now, 0))

    def note(self, text: str, now_ms: int) -> None:
        self.append(workspace.note(self.graph, text, now_ms, 0))

    def compact(self, archive: str, keep: int = state.KEEP_WORKSPACES) -> tuple[int, int]:
        """Rewrites the log as the least one that folds to the same graph without old workspaces,
        which go to the archive; returns (rows archived, rows kept). What is appended meanwhile stays."""
        listed = logs.listing(self.spark, self.path)
        stays, goes = state.pruned(snapshot.at(self.spark, self.path, self.snapshots, listed, often=True), keep)
        new, old = written(state.synthesize(stays), "compacted"), written(state.synthesize(goes), "archived")
        archived, kept = logs.archive(old, archive), new.count()
        logs.rewrite(new, self.path, listed)
        return archived, kept

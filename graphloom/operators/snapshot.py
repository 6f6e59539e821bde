"""Snapshots of the graph: what a log folded to at some time, so that only its tail is folded after that."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import state
from graphloom.plans.graph import Graph
from graphloom.plans.schema import EDGES, LOG, NODES
from graphloom.sources import log as logs
from graphloom.sources.folders import delete, file_system, read_text, write_text, written

#: Snapshots that are kept: a request planned on the last but one may still run.
KEPT = 2


@dataclass(frozen=True)
class Mark:
    """How far into a log something goes: its folder, its plain files, the last batch, and the next rank of a split."""

    folder: str
    files: tuple[tuple[str, int], ...]
    upto: int
    first: int = 0

    @classmethod
    def of(cls, listed: logs.Listing, first: int = 0) -> Mark:
        return cls(listed.folder, listed.files, listed.upto, first)

    @classmethod
    def parse(cls, text: str) -> Mark:
        raw = json.loads(text)
        return cls(raw["folder"], tuple((n, size) for n, size in raw["files"]), raw["upto"], raw["first"])

    def text(self) -> str:
        return json.dumps(asdict(self))

    def begins(self, listed: logs.Listing) -> bool:
        """Whether the log has only had batches appended since: it was not rewritten, and its plain files are as they were."""
        return (self.folder, self.files) == (listed.folder, listed.files) and self.upto <= listed.upto


class Snapshots:
    """Generations of nodes and edges below `path`, each with its mark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generations(self) -> list[int]:
        fs, at = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[4:]) for n in names if n.startswith("gen-"))

    def latest(self, listed: logs.Listing) -> tuple[Graph, Mark] | None:
        """The last snapshot of the beginning of a log, and how far it goes; None where there is none."""
        for n in reversed(self._generations()):
            folder = f"{self.path}/gen-{n}"
            text = read_text(self.spark, f"{folder}/mark.json")
            if text and (mark := Mark.parse(text)).begins(listed):
                read = self.spark.read
                return Graph(read.schema(NODES).parquet(f"{folder}/nodes"), self.spark.read.schema(EDGES).parquet(f"{folder}/edges")), mark
        return None

    def write(self, graph: Graph, listed: logs.Listing) -> None:
        """Keeps `graph` as what `listed` folds to. It counts once it is whole: one rename puts it in place."""
        generations = self._generations()
        draft, target = f"{self.path}/_draft-{uuid.uuid4().hex}", f"{self.path}/gen-{max(generations, default=-1) + 1}"
        names = [[c.split()[0] for c in schema.split(", ")] for schema in (NODES, EDGES)]
        graph.nodes.select(*names[0]).write.parquet(f"{draft}/nodes")
        graph.edges.select(*names[1]).write.parquet(f"{draft}/edges")
        ends = [self.spark.read.schema(schema).parquet(f"{draft}/{name}").agg(F.max("seq")).first()[0] for schema, name in ((NODES, "nodes"), (EDGES, "edges"))]
        last = max([e for e in ends if e is not None], default=-1)
        write_text(self.spark, f"{draft}/mark.json", Mark.of(listed, (last >> logs.LINE_BITS) + 1).text())
        if not logs.moved(self.spark, draft, target):
            delete(self.spark, draft)  # another one came first
        for n in generations[: 1 - KEPT]:
            delete(self.spark, f"{self.path}/gen-{n}")


def current(spark: SparkSession, path: str, snapshots: Snapshots) -> Graph:
    """The graph of the log at `path`: the last snapshot and what came since."""
    return at(spark, path, snapshots, logs.listing(spark, path))


def at(spark: SparkSession, path: str, snapshots: Snapshots, listed: logs.Listing, often: bool = False) -> Graph:
    """The graph of what is listed of a log. For those who use it `often`, events that no snapshot
    holds yet are parsed once and written to the work folder."""
    found = snapshots.latest(listed)
    if found is not None and found[1].upto == listed.upto:
        return found[0]
    tail = logs.read(spark, path, listed) if found is None else since(spark, path, listed, found[1])
    if often:
        tail = written(tail, "tail")
    return state.fold(tail) if found is None else state.extend(found[0], tail)


def since(spark: SparkSession, path: str, listed: logs.Listing, mark: Mark) -> DataFrame:
    """Events of the batches after a mark."""
    return logs.read(spark, path, listed, mark.upto, mark.first) if mark.upto < listed.upto else spark.createDataFrame([], LOG)

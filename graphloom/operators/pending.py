"""References that wait until something is declared that answers them.

The queue holds open references (path, kind, name, from_id). Each batch of files is a step of a
symmetric join: its references meet all declarations, its declarations meet what waits under their
names, and what was linked to something that goes comes back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import code
from graphloom.plans.graph import Graph
from graphloom.sources.folders import delete, file_system
from graphloom.sources.log import moved

QUEUE = "path string, kind string, name string, from_id string"
_KEY = ("path", "kind", "name", "from_id")
#: Files of a batch that are broadcast to what waits; more meet it by shuffle.
BROADCAST_ROWS = 200_000


def step(queue: DataFrame, refs: DataFrame, linked: DataFrame, declared: DataFrame, changed: DataFrame, gone: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, queue after) of a batch, both of one table that is written.

    queue: what waits, each once. refs: references of the files taken in, as `code.asked` has them. linked: `QUEUE`
    and to_id of references that are linked. declared: (id, name, path) of all there is after the
    batch. changed: (name) of what the batch declares or removes. gone: (id) of what it removes. taken:
    (path) of its files, whose earlier references are void. answered: `QUEUE` and to_id.

    Only references under a changed name are tried again: any other's answer is what it was. All are dealt
    by name once, to meet their names' declarations and changes there.
    """
    files = taken.select("path").distinct()
    files = F.broadcast(files) if files.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else files
    waiting = queue.select(*_KEY).join(files, "path", "left_anti")
    back = linked.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*_KEY).distinct().join(files, "path", "left_anti")
    asking = refs.select(*_KEY).unionByName(back.join(waiting, [*_KEY], "left_anti"))
    every = asking.withColumn("waits", F.lit(False)).unionByName(waiting.withColumn("waits", F.lit(True)))
    names = changed.select("name").distinct().withColumn("changed", F.lit(True))
    tried = every.join(names, "name", "left")
    out = code.answered(tried, declared, asleep=F.col("waits") & F.col("changed").isNull())
    found = F.col("to_id").isNotNull() & ~F.col("asleep")
    return out.where(found).select(*_KEY, "to_id"), out.where(~found).select(*_KEY)


def linked(graph: Graph, ends: DataFrame) -> DataFrame:
    """References of a graph that were linked by name to `ends` (id, name), for `step`."""
    by_name = graph.edges.where(F.get_json_object("properties", "$.resolver") == "name")
    names = ends.select(F.col("id").alias("to_id"), "name").distinct()
    return by_name.join(names, "to_id").select(F.substring_index("from_id", ":", 1).alias("path"), F.col("relationship").alias("kind"), "name", "from_id", "to_id")


class Queue:
    """The queue kept at `path`, a folder a generation; the last one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generations(self) -> list[int]:
        fs, at = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[4:]) for n in names if n.startswith("gen-"))

    def read(self) -> DataFrame:
        found = self._generations()
        return self.spark.read.schema(QUEUE).parquet(f"{self.path}/gen-{found[-1]}") if found else self.spark.createDataFrame([], QUEUE)

    def write(self, queue: DataFrame) -> None:
        """Puts the next generation in place by one rename; the one before stays for those who read it."""
        found = self._generations()
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        queue.write.parquet(draft)
        if not moved(self.spark, draft, f"{self.path}/gen-{max(found, default=-1) + 1}"):
            delete(self.spark, draft)
            raise RuntimeError(f"the queue at {self.path} was written by another")
        for n in found[:-1]:
            delete(self.spark, f"{self.path}/gen-{n}")

"""The log and source trees as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.plans.schema import LOG
from graphloom.sources.folders import read_text, write_text
from graphloom.sources.log import LINE_BITS, parse, placed



def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL files below `path` as they arrive: (value, file, block)."""
    return spark.readStream.format("text").option("recursiveFileLookup", True).load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def follow(spark: SparkSession, path: str, table_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends events to the Parquet log at `table_path`, exactly once.

    A micro-batch is written under its own number and replaced if it is run again. Within it seq has
    the order of files, splits and lines, so its events fold as a log read at once does, whatever task
    reads which file. Splits are ranked on from where the batch before ended, which a small file beside it says.
    """

    def store(batch: DataFrame, number: int) -> None:
        first = int(read_text(spark, f"{table_path}/_ends/{number - 1}") or 0)
        target = f"{table_path}/batch={number}"
        parse(placed(batch, first)).write.mode("overwrite").parquet(target)
        last = spark.read.schema(LOG).parquet(target).agg(F.max("seq")).first()[0]
        write_text(spark, f"{table_path}/_ends/{number}", str(first if last is None else (last >> LINE_BITS) + 1))

    return log_stream(spark, path).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_followed(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.schema(f"{LOG}, batch int").parquet(table_path).drop("batch")


def quiet(paths: DataFrame, seconds: float = 1.0) -> DataFrame:
    """(path, changes) of each path of the stream `paths` (path) once it has not changed for `seconds`.

    State is a count a path, kept by a processing-time timer that each change sets anew; a path
    that went out starts again from nothing. Null paths are left out.
    """
    wait = max(1, round(1000 * seconds))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (seen,) = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "changes": [seen]})
            return
        seen = state.get[0] if state.exists else 0
        state.update((seen + sum(len(b) for b in batches),))
        state.setTimeoutDuration(wait)

    return paths.where("path is not null").groupBy("path").applyInPandasWithState(step, "path string, changes long", "changes long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def debounced(paths: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, seconds: float = 1.0) -> StreamingQuery:
    """Calls `handle` with paths (path, changes) of the stream `paths` (path) that have been quiet for `seconds`."""

    def some(batch: DataFrame, _: int) -> None:
        if batch.take(1):
            handle(batch)

    return quiet(paths, seconds).writeStream.foreachBatch(some).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, round(500 * seconds))} milliseconds").start()

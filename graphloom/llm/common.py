"""Shared plumbing of the corpus operators: shared folders, written stages, text helpers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word definition `[^\x20\x09-\x0D]+` has it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where it is unset (tests on a local master) a temporary folder is set; on a
    cluster an unset folder is an error, as a machine-local one would be unsafe.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(folder)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the application's own part of the shared folder, which goes when the driver's JVM ends."""
    sc = spark.sparkContext
    base = f"{shared_folder(spark)}/graphloom/{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a `written` table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, what an execution has shuffled is deleted as soon as it ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def released(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """`f`, a task's function, giving free memory back when it ends: workers live on and would hold
    what their largest task took."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        try:
            yield from f(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # not this C library

    return run


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, tasks that are run get Arrow batches of at most so many rows: for rows of much data."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Words of a text column by `WORD_PATTERN`; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


#: Rows of two long columns that are broadcast at most (32 MB); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def text_hash() -> Column:
    """What tells texts of one doc_id apart; null texts have a hash of their own."""
    return F.xxhash64(F.col("text").isNull(), F.col("text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id and text are not in `gone` (doc_id, text_hash; written already).

    Null doc_ids meet null doc_ids, so rows without doc_id go like any others.
    """
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    meets = docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(docs["text"].isNull(), docs["text"]) == F.col("_gone_hash"))
    return docs.join(F.broadcast(gone) if small else gone, meets, "left_anti").select(*[f"`{c}`" for c in docs.columns])

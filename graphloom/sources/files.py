"""Source trees as DataFrames, and which of their files a graph must take in again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import content_hash

#: Extensions that are read, folders that are not, largest size in bytes.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "rs", "md")
SKIPPED = (
    "node_modules", "dist", ".git", "target", ".chunks", ".local", ".cache", ".npm", ".cargo", ".docker", ".rustup",
    ".nvm", ".pyenv", "venv", ".venv", "__pycache__", "build", "out", ".pi", ".pi-web",
)
MAX_BYTES = 1_000_000


def listed(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path relative to root, mtime in ms, length, raw) of all files below `root` of the extensions that
    are read, large ones too; raw is their content, which is not read where it is not asked for."""
    pattern = "*.{" + ",".join(EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    found = files.withColumn("rel", F.expr(f"substring(path, {len(whole) + 2})"))
    folders = F.split("rel", "/")
    inside = F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*[F.lit(s) for s in skipped]))
    return found.where(~inside).select(F.col("rel").alias("path"), F.unix_millis("modificationTime").alias("mtime"), "length", F.col("content").alias("raw"))


def scan(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, mtime, length, content) of the files below `root` that are read.

    Path and size filters come before content is decoded; missing and broken files are passed over.
    """
    kept = listed(spark, root, skipped).where(F.col("length") <= MAX_BYTES)
    return kept.select("path", "mtime", "length", F.decode("raw", "UTF-8").alias("content"))


def changed(disk: DataFrame, known: DataFrame) -> DataFrame:
    """Paths of `disk` (path, mtime) that are newer than `known` (path, last_modified) has them, or new."""
    return disk.join(known.select("path", "last_modified"), "path", "left").where(F.col("mtime") > F.coalesce("last_modified", F.lit(0))).select("path")


def stale(disk: DataFrame, known: DataFrame) -> DataFrame:
    """Paths that are known but no longer there."""
    return known.select("path").join(disk.select("path"), "path", "left_anti")


def rehashed(disk: DataFrame, known: DataFrame) -> DataFrame:
    """(path, hash) of files (path, content, and mtime where there is one) whose content differs from
    `known` (path, hash). Of a path that repeats the newest content counts, of those the one of the least hash."""
    age = F.col("mtime") if "mtime" in disk.columns else F.lit(0)
    new = disk.groupBy("path").agg(F.min_by(content_hash(F.coalesce("content", F.lit(""))), F.struct(-age, content_hash(F.coalesce("content", F.lit(""))))).alias("hash"))
    old = known.groupBy("path").agg(F.min("hash").alias("old"))
    return new.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("path", "hash")


def plan(present: DataFrame, contents: DataFrame, known: DataFrame) -> DataFrame:
    """(path, action) of what brings a graph up to a tree: `take` files that are newer than it has them
    and whose content differs, `drop` files that are gone.

    present: (path) of all files, whatever their size. contents: (path, mtime, content) of those that are
    read. known: (path, last_modified, hash) in the graph. A file that grew too large to be read stays as
    it was known; a file that was touched and not changed stays, too. A known file without hash differs.
    """
    newer = contents.join(changed(contents, known), "path", "left_semi")
    take = rehashed(newer, known.where("hash is not null")).select("path", F.lit("take").alias("action"))
    return take.unionAll(stale(present, known).select("path", F.lit("drop").alias("action")).distinct())

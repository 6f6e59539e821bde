"""Indexes that are kept: BM25 postings and vectors, built once, then added to and removed from.

An index is a folder of generations. Each change writes one: what it brings, then a row for each
key it touches, whose file makes the generation count. Of each key the latest generation holds, so
nothing is rewritten until `compact`, and a change that broke off is as if it had not begun.
A generation may carry a mark: how far into a log the index goes with it.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import bm25, dense
from graphloom.operators.snapshot import Mark
from graphloom.plans.schema import CHUNKS
from graphloom.sources.folders import delete, file_system, read_text, work_folder, write_text

#: Folders that postings are dealt to by token; a request reads those of its tokens.
BUCKETS = 64
#: Postings that a task sorts, on average.
PART_ROWS = 250_000


class Kept:
    """Generations below `path`: tables by name, `keys` the last one written."""

    #: columns of each table
    tables: dict[str, str]
    key: str

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        fs, at = file_system(self.spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _there(self, path: str) -> bool:
        fs, at = file_system(self.spark, f"{self.path}/{path}")
        return fs.exists(at)

    def generations(self) -> list[int]:
        """Complete generations, oldest first."""
        found = [n for n in self._names("keys") if n.startswith("gen=") and self._there(f"keys/{n}/_SUCCESS")]
        return sorted(int(n.split("=")[1]) for n in found)

    def _next(self) -> int:
        """A number that no generation has, broken ones included."""
        names = [n for t in self.tables for n in self._names(t)]
        return 1 + max([int(n.split("=")[1]) for n in names if n.startswith("gen=")], default=-1)

    def _put(self, gen: int, name: str, rows: DataFrame, *by: str) -> None:
        rows.write.partitionBy(*by).parquet(f"{self.path}/{name}/gen={gen}")

    def _get(self, name: str, generations: list[int] | None = None) -> DataFrame:
        """Rows of complete generations, with gen: one relation, however many there are."""
        gens = self.generations() if generations is None else generations
        paths = [f"{self.path}/{name}/gen={g}" for g in gens if self._there(f"{name}/gen={g}")]
        schema = f"{self.tables[name]}, gen int"
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows of the latest generation of their key."""
        if len(self.generations()) <= 1:
            return rows.drop("gen")
        live = self._get("keys").groupBy(self.key).agg(F.max("gen").alias("gen"))
        return rows.join(live, [self.key, "gen"], "left_semi").drop("gen")

    def mark(self) -> Mark | None:
        """How far into its log the index goes; None for an index that follows none."""
        gens = self.generations()
        text = read_text(self.spark, f"{self.path}/marks/{gens[-1]}") if gens else None
        return Mark.parse(text) if text else None

    def _close(self, gen: int, keys: DataFrame, mark: Mark | None) -> None:
        """Makes a generation count."""
        if mark:
            write_text(self.spark, f"{self.path}/marks/{gen}", mark.text())
        self._put(gen, "keys", keys.select(self.key).distinct())

    def held(self) -> DataFrame:
        """Keys of all generations."""
        return self._get("keys").select(self.key).distinct()

    def remove(self, ids: DataFrame) -> None:
        """Forgets what belongs to keys."""
        self.change(None, ids.select(self.key))

    def _forget(self, before: int) -> None:
        for g in range(before):
            for t in self.tables:
                delete(self.spark, f"{self.path}/{t}/gen={g}")
            delete(self.spark, f"{self.path}/marks/{g}")


class TextIndex(Kept):
    """BM25 over texts (doc_id, field, text). A document is replaced as a whole.

    A posting holds its document's length in the field. Each generation holds what it changes in
    the number of documents and their lengths, a row a field, so that a request reads the postings of
    its tokens and these rows alone.
    """

    tables = {
        "postings": "field string, doc_id string, token string, tf bigint, dl bigint, bucket int",
        "lengths": "field string, doc_id string, dl bigint",
        "stats": "field string, n bigint, total bigint",
        "keys": "doc_id string",
    }
    key = "doc_id"

    def add(self, texts: DataFrame) -> None:
        """Takes in documents; those that are there already are replaced."""
        self.change(texts, texts.select("doc_id"))

    def change(self, texts: DataFrame | None, keys: DataFrame, mark: Mark | None = None) -> None:
        """Forgets the documents of `keys` (doc_id), then takes in `texts`, all of which `keys` names."""
        none = self.spark.createDataFrame([], "field string, doc_id string, token string, tf bigint, dl bigint")
        self._write(none if texts is None else bm25.measured(texts), keys.distinct(), mark)

    def _write(self, post: DataFrame, keys: DataFrame, mark: Mark | None, anew: bool = False) -> int:
        """post: (field, doc_id, token, tf, dl). They are worked out once, and a bucket is dealt in parts whose
        size does not depend on how many there are."""
        gen, path = self._next(), work_folder(self.spark, "postings")
        before = self._alive(self._get("lengths")).join(keys, "doc_id", "left_semi")
        post.withColumn("bucket", _bucket()).write.option("compression", "zstd").parquet(path)
        held = self.spark.read.schema(self.tables["postings"]).parquet(path)
        parts = 1 + held.count() // (BUCKETS * PART_ROWS)
        part = F.col("bucket") * parts + F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
        self._put(gen, "postings", held.repartitionById(BUCKETS * parts, part).sortWithinPartitions("token"), "bucket")
        self._put(gen, "lengths", held.select("field", "doc_id", "dl").distinct())
        delete(self.spark, path)
        brought = self._get("lengths", [gen])
        changes = [brought.select("field", F.lit(1).alias("n"), "dl")] + ([] if anew else [before.select("field", F.lit(-1).alias("n"), (-F.col("dl")).alias("dl"))])
        self._put(gen, "stats", reduce(DataFrame.unionAll, changes).groupBy("field").agg(F.sum("n").alias("n"), F.sum("dl").alias("total")))
        self._close(gen, keys, mark)
        return gen

    def postings(self) -> DataFrame:
        """(field, doc_id, token, tf, dl, bucket) of what is there now."""
        return self._alive(self._get("postings"))

    def source(self) -> bm25.Source:
        """For `bm25.search`: a request reads the folders of its terms, and a row a field and generation."""

        def source(asked: dict[str, int]) -> tuple[DataFrame, DataFrame]:
            buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in asked})
            found = self._get("postings").where(F.col("bucket").isin(*buckets) & F.col("token").isin(*asked))
            return self.stats(), self._alive(found).drop("bucket")

        return source

    def stats(self) -> DataFrame:
        """(field, n, avgdl) of what is there now."""
        sums = self._get("stats").groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
        return sums.select("field", "n", (F.col("total") / F.col("n")).alias("avgdl"))

    def search(self, text: str, limit: int) -> DataFrame:
        return bm25.search(self.source(), text, limit)

    def search_many(self, requests: DataFrame, limit: int) -> DataFrame:
        """(request_id, doc_id, score, place) of requests (request_id, text), all at once."""
        return bm25.search_many(self.postings(), self.stats(), requests, limit)

    def compact(self) -> None:
        """One generation of all that is there."""
        post, mark = self.postings().drop("bucket"), self.mark()
        self._forget(self._write(post, post.select("doc_id").distinct(), mark, anew=True))


def _bucket():
    return (F.crc32("token") % BUCKETS).cast("int")


class VectorIndex(Kept):
    """Chunk vectors (node_id, chunk_idx, vec). A node is replaced as a whole."""

    tables = {"vectors": CHUNKS, "keys": "node_id string"}
    key = "node_id"

    def add(self, chunks: DataFrame) -> None:
        self.change(chunks, chunks.select("node_id"))

    def change(self, chunks: DataFrame | None, keys: DataFrame, mark: Mark | None = None) -> None:
        """Forgets the nodes of `keys` (node_id), then takes in `chunks`, all of which `keys` names."""
        gen = self._next()
        rows = self.spark.createDataFrame([], CHUNKS) if chunks is None else chunks.select("node_id", "chunk_idx", "vec")
        self._put(gen, "vectors", rows)
        self._close(gen, keys, mark)

    def chunks(self) -> DataFrame:
        return self._alive(self._get("vectors"))

    def nearest(self, query: list[float], limit: int) -> DataFrame:
        return dense.nearest(self.chunks(), query, limit)

    def compact(self) -> None:
        """One generation of all that is there."""
        rows, gen, mark = self.chunks(), self._next(), self.mark()
        self._put(gen, "vectors", rows)
        self._close(gen, self._get("vectors", [gen]), mark)
        self._forget(gen)

"""Embedding of nodes: what text stands for a node, and which vectors can be kept."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.rerank import chunked, word_pieces, words
from graphloom.sources.folders import file_system
from graphloom.sources.log import moved

VECTORS = "emb_hash string, embedding array<array<float>>"


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Unit vectors of hashed, stemmed tokens: the same text has the same vector everywhere. It stands
    in where no model is at hand."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float64)
        for i, text in enumerate(texts):
            for w in words(text):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def embedding_text() -> Column:
    """Text that a node is embedded by: name and description, content or comment, by its kind; empty for none."""
    kind = F.when(F.col("label") == "Entity", F.col("entity_type")).otherwise(F.col("label"))
    comment = F.get_json_object("metadata", "$.docComment")

    def with_name(second: Column) -> Column:
        return F.when(F.coalesce(second, F.lit("")) == "", F.col("name")).when(F.col("name") == "", second).otherwise(F.concat("name", F.lit(" "), second))

    return F.when(kind == "Scratchpad", F.col("content")).when(kind == "Workspace", with_name(F.col("description"))).when(kind.isin("Section", "Function", "Class"), with_name(F.col("content"))).otherwise(with_name(comment))


def hashed(nodes: DataFrame) -> DataFrame:
    """`nodes` with emb_text and emb_hash."""
    return nodes.withColumn("emb_text", F.coalesce(embedding_text(), F.lit(""))).withColumn("emb_hash", F.sha2("emb_text", 256))


def to_embed(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, emb_text, emb_hash) of nodes with a text whose hash `cache` (id, emb_hash) doesn't have: the others keep their vectors."""
    return hashed(nodes).where("emb_text <> ''").select("id", "emb_text", "emb_hash").join(cache.select("id", "emb_hash"), ["id", "emb_hash"], "left_anti")


def embed(texts: DataFrame, embedder: Embedder, most: int = 400) -> DataFrame:
    """(id, emb_hash, embedding): a unit vector for each chunk of emb_text; the model is loaded once a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [chunked(t, word_pieces, most) for t in pdf["emb_text"]]
            vectors = embedder.embed([c for p in parts for c in p])
            ends = np.cumsum([len(p) for p in parts])
            yield pd.DataFrame({"id": pdf["id"], "emb_hash": pdf["emb_hash"], "embedding": [[v.tolist() for v in vectors[e - len(p) : e]] for p, e in zip(parts, ends, strict=True)]})

    return texts.select("id", "emb_text", "emb_hash").mapInPandas(run, "id string, emb_hash string, embedding array<array<float>>")


class VectorStore:
    """Vectors by the hash of their text, kept at `path`: a text is embedded once, whatever node it stands for.

    Each filling adds a folder of what was missing, put in place by one rename.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self) -> list[str]:
        fs, at = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.startswith("part-"))

    def known(self, folders: list[str] | None = None) -> DataFrame:
        """(emb_hash, embedding) of all texts, or of those that fillings brought."""
        names = self._folders() if folders is None else folders
        return self.spark.read.schema(VECTORS).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], VECTORS)

    def fill(self, nodes: DataFrame, embedder: Embedder, most: int = 400) -> str:
        """Embeds what texts of `nodes` the store lacks, each once; returns the folder that holds them."""
        texts = hashed(nodes).where("emb_text <> ''").select(F.col("emb_hash").alias("id"), "emb_text", "emb_hash").dropDuplicates(["emb_hash"])
        missing = texts.join(self.known().select("emb_hash"), "emb_hash", "left_anti")
        draft, name = f"{self.path}/_draft-{uuid.uuid4().hex}", f"part-{len(self._folders()):08d}-{uuid.uuid4().hex[:8]}"
        embed(missing, embedder, most).select("emb_hash", "embedding").write.parquet(draft)
        if not moved(self.spark, draft, f"{self.path}/{name}"):
            raise RuntimeError(f"{self.path}/{name} is there already")
        return name

    def vectors(self, nodes: DataFrame) -> DataFrame:
        """(id, embedding) of nodes whose texts the store knows. Two fillings at once may both bring a text; one counts."""
        once = self.known().groupBy("emb_hash").agg(F.first("embedding").alias("embedding"))
        return hashed(nodes).where("emb_text <> ''").select("id", "emb_hash").join(once, "emb_hash").select("id", "embedding")


def with_vectors(batch: DataFrame, vectors: DataFrame) -> DataFrame:
    """Log rows whose writes of nodes hold `vectors` (id, embedding), where they have none yet."""
    given = F.get_json_object("properties", "$.embedding").isNull() & F.col("embedding").isNotNull() & (F.col("event_type") == "UPSERT_NODE")
    rest = F.regexp_replace("properties", r"\}\s*$", "")
    comma = F.when(F.regexp_like("properties", F.lit(r"^\s*\{\s*\}\s*$")), "").otherwise(",")
    whole = F.concat(rest, comma, F.lit('"embedding":'), F.to_json("embedding"), F.lit("}"))
    return batch.join(vectors.select("id", "embedding"), "id", "left").withColumn("properties", F.when(given, whole).otherwise(F.col("properties"))).select(*batch.columns)

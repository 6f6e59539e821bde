"""Token counts: a separator scan over flat token files without an index.

A flat token store is a stream of ids, cut into blocks of equal length with no regard to
documents: rows (shard, block, ids) of Parquet files. Each document ends with the end-of-document
id. The scan searches each block for that id with numpy, tells of each block only its totals, and
stitches documents that run over block ends by a prefix scan over those totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import new_path, released, table
from graphloom.llm.token_output import tokenised

BLOCK_IDS = 1 << 19
STORE = "shard int, block int, ids binary, order binary"


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of `docs` (doc_id, text) as a flat store at `path`, a shard for each task.

    `order` lists, for people who check the scan, the doc_ids whose end lies in the block.
    """

    @released
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("order", pa.binary())])
        rest, names = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def rows(ids: np.ndarray, names: np.ndarray, last: bool) -> tuple[list[dict], np.ndarray, np.ndarray]:
            nonlocal block
            out = []
            while len(ids) >= block_ids or last and len(ids):
                part, ids = ids[:block_ids], ids[block_ids:]
                n = int(np.count_nonzero(part == end_id))
                out.append({"shard": shard, "block": block, "ids": part.astype("<u4").tobytes() if wide else part.astype("<u2").tobytes(), "order": names[:n].astype("<i8").tobytes()})
                names, block = names[n:], block + 1
            return out, ids, names

        for batch, ids, _ in tokenised(batches, tokenizer, end_id):
            got = batch.column(batch.schema.get_field_index("doc_id")).fill_null(-1).to_numpy(zero_copy_only=False)
            out, rest, names = rows(np.concatenate([rest, ids]), np.concatenate([names, got]), False)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        out, _, _ = rows(rest, names, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    wide = id_bytes(tokenizer, end_id) == 4
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts.mapInArrow(flat, STORE).write.option("compression", "zstd").parquet(path)


def id_bytes(tokenizer: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def scan(store: DataFrame, end_id: int, width: int) -> DataFrame:
    """Documents of a flat store: shard, ordinal (from 0 in the shard), start (ids before it in
    the shard), n_tokens (its end id counted), ended (false for ids after the last end id) and
    doc_id (what the store's `order` calls it; no part of the search, null where there is none).

    Blocks give their number of ids and the places of end ids. A prefix scan by shard over these
    rows, one a block, tells each block how many ids and documents come before it and where the
    document that is open at its beginning began. An empty store gives no rows; an empty text
    has one token, its end id.
    """
    kind = "<u2" if width == 2 else "<u4"

    @released
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, blocks, cells, names = (batch.column(batch.schema.get_field_index(x)) for x in ("shard", "block", "ids", "order"))
            sizes, at, labels = [], [], []
            for cell, name in zip(cells, names, strict=True):
                ids = np.frombuffer(cell.as_buffer(), kind)
                sizes.append(len(ids))
                at.append(np.flatnonzero(ids == end_id).astype(np.int64))
                labels.append(np.frombuffer(name.as_buffer(), "<i8"))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([shards, blocks, pa.array(sizes, pa.int64()), pa.array(at, longs), pa.array(labels, longs)], names=["shard", "block", "n_ids", "ends", "labels"])

    found = store.select("shard", "block", "ids", "order").mapInArrow(look, "shard int, block int, n_ids long, ends array<long>, labels array<long>")
    shard = Window.partitionBy("shard")
    earlier = shard.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = found.withColumns(
        {
            "is_last": F.col("block") == F.max("block").over(shard),
            "base": F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)),
            "first": F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)),
        }
    ).withColumn("ends", F.transform("ends", lambda e: e + F.col("base")))
    last_end = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    placed = based.withColumn("open_from", F.coalesce(F.max(last_end).over(earlier) + 1, F.lit(0)))
    starts = F.concat(F.array("open_from"), F.transform("ends", lambda e: e + 1))
    total = F.col("base") + F.col("n_ids")
    tail = F.when(F.col("is_last") & (F.element_at(starts, -1) < total), F.array(total - 1)).otherwise(F.array().cast("array<bigint>"))
    zipped = F.arrays_zip(
        F.slice(starts, 1, F.size("ends") + F.size(tail)).alias("start"),
        F.concat("ends", tail).alias("end"),
        F.col("labels").alias("label"),
    )
    rows = placed.select("shard", "first", F.size("ends").alias("n_ends"), F.posexplode(zipped).alias("k", "doc"))
    return rows.select(
        F.col("doc.label").alias("doc_id"),
        "shard",
        (F.col("first") + F.col("k")).alias("ordinal"),
        F.col("doc.start").alias("start"),
        (F.col("doc.end") - F.col("doc.start") + 1).alias("n_tokens"),
        (F.col("k") < F.col("n_ends")).alias("ended"),
    )


def count_tokens(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token counts of `docs` (doc_id, text) by way of a flat store in the shared folder.

    Null text counts as empty. A null doc_id comes back as -1. Repeated rows are counted each.
    A text that spells out a special token's literal is encoded as the library does it, so the
    end-of-document id in it parts the document; pick an `end_id` the tokenizer never gives
    where that is not wanted.
    """
    spark = docs.sparkSession
    path = new_path(spark, "flat-tokens")
    write_flat(docs, path, tokenizer, end_id, block_ids)
    return scan(spark.read.schema(STORE).parquet(path), end_id, id_bytes(tokenizer, end_id))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of byte_bpe_50k end at 50256; 50257 is free, so no text can hold the separator."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=50257)

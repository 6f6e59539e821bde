"""Token-ID / binary output: frequency-ranked ids in byte-aligned variable-length coding.

File format (rows of Parquet files, so any store Spark reads will do, and a lost task is
simply written again): one row per block of whole documents in ascending doc_id order.

    part, block      place in the order; blocks of a part follow one another
    ids_before       ids of the part's earlier blocks
    doc_ids          little-endian int64 of each document
    counts           little-endian uint32: ids of each document, end id included
    ranks            little-endian uint32: the block's ids by falling frequency, ties by id
    control          2 bits an id, four to a byte, low bits first: bytes of its rank less one
    data             each rank's little-endian bytes, 1 to 4

Rank tables belong to blocks, so a block decodes alone, and no pass over the corpus comes
before writing. Decoding looks the lengths of four ranks up by control byte in a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import encoder, forget
from graphloom.llm.common import batches_of, new_path, released, table, written

BLOCK_IDS = 1 << 18
#: Texts in an Arrow batch.
TEXTS = 500
#: Stands for a null doc_id in files.
NO_ID = -(1 << 63)
BLOCKS = "part int, block int, ids_before long, n_docs long, n_ids long, doc_ids binary, counts binary, ranks binary, control binary, data binary"
#: Bytes of the four values that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranks, control, data) of ids; empty for no ids."""
    if not len(ids):
        return b"", b"", b""
    counts = np.bincount(ids)
    seen = np.flatnonzero(counts)
    order = seen[np.argsort(-counts[seen], kind="stable")]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    values = rank_of[ids]
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    as_bytes = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = as_bytes[np.arange(4, dtype=np.uint8) <= extra[:, None]]
    return order.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack(n: int, ranks: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The n ids (uint32) that `pack` was given."""
    if not n:
        return np.zeros(0, np.uint32)
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    at = ends - lengths
    values = raw[at].astype(np.uint32)
    for k in range(1, int(lengths.max())):
        more = np.flatnonzero(lengths > k)
        values[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranks, "<u4")[values]


def _block(part: int, block: int, before: int, doc_ids: list[int], counts: list[int], ids: np.ndarray) -> dict:
    ranks, control, data = pack(ids)
    return {
        "part": part,
        "block": block,
        "ids_before": before,
        "n_docs": len(doc_ids),
        "n_ids": len(ids),
        "doc_ids": np.array(doc_ids, "<i8").tobytes(),
        "counts": np.array(counts, "<u4").tobytes(),
        "ranks": ranks,
        "control": control,
        "data": data,
    }


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def tokenised(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with their ids (end id appended to each text) and the ids' number for each text."""
    enc = encoder(path)
    for batch in batches:
        # texts of a batch are taken in slices, so that very long ones don't add up
        text = batch.column(batch.schema.get_field_index("text"))
        at = 0
        while at < batch.num_rows:
            size, to = 0, at
            while to < batch.num_rows and (size < 4_000_000 or to == at):
                size += len(text[to].as_buffer() or b"") if text[to].is_valid else 0
                to += 1
            ids, counts = enc.encode(text.slice(at, to - at).to_pylist())
            ends = np.cumsum(counts)
            yield batch.slice(at, to - at), np.insert(ids, ends, enc.dtype(end_id)), counts + 1
            at = to


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encodes `docs` (doc_id, text) and writes blocks to `path`.

    Parts are ranges of doc_id and, within equal or null doc_ids, of a hash of the text, so that
    one doc_id with many texts is dealt over parts, too. Rows of equal doc_id keep no particular
    order. Null doc_id counts as the least; a null text is an empty one.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("h"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    @released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema, part = _schema(BLOCKS), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        doc_ids: list[int] = []
        counts: list[int] = []
        block, before, held = 0, 0, 0
        for batch, new, each in tokenised(batches, tokenizer, end_id):
            ids.append(new)
            doc_ids += [NO_ID if x is None else x for x in batch.column(batch.schema.get_field_index("doc_id")).to_pylist()]
            counts += each.tolist()
            held += len(new)
            if held >= block_ids:
                yield pa.RecordBatch.from_pylist([_block(part, block, before, doc_ids, counts, np.concatenate(ids))], schema)
                ids, doc_ids, counts, before, held, block = [], [], [], before + held, 0, block + 1
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_block(part, block, before, doc_ids, counts, np.concatenate(ids))], schema)

    # a zstd context a column and task stays outside the heap until it is collected: too much for many small parts
    with batches_of(spark, TEXTS):
        # a page a block, so that neither side holds more of a column than a block's share
        dealt.mapInArrow(encode, BLOCKS).write.options(**{"compression": "snappy", "parquet.page.row.count.limit": "1"}).parquet(path)


def read_blocks(spark, path: str) -> DataFrame:
    """Documents of the blocks at `path`: doc_id, start, n_tokens, ids_crc32, decoded block by block.

    A block carries the number of ids before it in its part; what precedes the part is a
    prefix sum over part totals, as many numbers as the writer had partitions. The result is
    written here, as a block, of some megabytes, is to be an Arrow batch of its own.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # totals of parts: as many rows as write_blocks had partitions
    parts = {r[0]: r[1] for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()}
    before, total = {}, 0
    for k in sorted(parts):
        before[k], total = total, total + parts[k]

    @released
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the worker may be one that encoded
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["n_ids"], row["ranks"], row["control"], row["data"]).astype("<u4", copy=False)
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, mask=doc_ids == NO_ID),
                        pa.array(before[row["part"]] + row["ids_before"] + ends - counts),
                        pa.array(counts),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    with batches_of(spark, 1):
        return written(blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long"), "token-documents", "snappy")


def binary_output(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes `docs` (doc_id, text; further columns are left out) as token files in the shared
    folder and returns what the files say of each document: doc_id, start (ids of all documents
    before it), n_tokens (with the end id) and ids_crc32 (of the ids as little-endian uint32).

    Null text: as empty, so the end id alone. Repeated rows are encoded as often as they occur.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_blocks(docs, path, tokenizer, end_id, block_ids)
    return read_blocks(spark, path)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as token files of byte_bpe_50k with end id 2, read back: a row per document; see `binary_output`."""
    import public_tokenizers

    return binary_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)

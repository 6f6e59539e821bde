"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form a class. Signatures of classes are cut into bands; in
each band's buckets every class is a candidate with the bucket's least one (a star, never all
pairs). A candidate pair's signatures are compared batch by batch, and the pair is given up when
the posterior probability that its similarity reaches the threshold falls below the chosen miss
probability; survivors are held against each other on their full sets. Links join classes to
components. Where a bucket still holds more than one component, its pairs of different components
are compared the same way, so that no link between candidates is lost: in grids of bounded blocks,
each pair in the first bucket it shares, and a block gives a spanning forest of its links, never
its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import batches_of, released, table, written
from graphloom.llm.components import components

BATCH = 24
#: Rows of a bucket's block, on average.
BLOCK = 256
#: Buckets of more than one block that are broadcast at most.
BROADCAST_BUCKETS = 500_000
#: Rows of signatures or sets in an Arrow batch.
PAIRS = 1000
#: Bits of the filter that picks documents for full comparison; a fixed size, whatever the corpus.
FILTER_BITS = 1 << 23
_WORDS_KEPT = 1 << 18
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Plan:
    """Shingle words, threshold num/den, rows of a band, and what links may be missed."""

    words: int = 5
    num: int = 80
    den: int = 100
    rows: int = 5
    band_miss: float = 1e-6
    posterior_miss: float = 1e-7

    @property
    def bands(self) -> int:
        """Bands at which a pair just at the threshold shares none with probability `band_miss` at most."""
        return math.ceil(math.log(self.band_miss) / math.log(1 - (self.num / self.den) ** self.rows))

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(n, m) for each batch end: with fewer than m equal values of n the pair is given up.

        With a uniform prior the posterior is Beta(m + 1, n - m + 1), so the probability of a
        similarity of t or more is that of at most m hits in n + 1 trials of chance t.
        """
        t, out = self.num / self.den, []
        for n in [*range(BATCH, self.size, BATCH), self.size]:
            tail, m = 0.0, -1
            while tail < self.posterior_miss and m <= n:
                m += 1
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


class _Words(dict):
    """64-bit hashes of words, kept for the words met most recently."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; see `near_duplicates`."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(n, k)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * _K1 + h[i : n - width + 1 + i]
    out ^= out >> np.uint64(32)
    out *= _K2
    out ^= out >> np.uint64(29)
    return np.unique(out)


class Signer:
    def __init__(self, size: int):
        rng = np.random.default_rng(20240229)
        self.xor = rng.integers(0, 1 << 32, (size, 1), dtype=np.uint32)
        self.mul = rng.integers(0, 1 << 31, (size, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def sign(self, shingle: np.ndarray) -> np.ndarray:
        low = (shingle >> np.uint64(20)).astype(np.uint32)
        best = None
        for at in range(0, len(low), 1024):
            x = (low[None, at : at + 1024] ^ self.xor) * self.mul
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            part = x.min(axis=1)
            best = part if best is None else np.minimum(best, part)
        return best


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _signed(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set; null if empty), signature."""
    size, k = plan.size, plan.words

    @released
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size)
        for batch in batches:
            counts, keys, signatures = [], [], []
            for cell in _column(batch, "text"):
                s = shingles(cell.as_py(), k)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signer.sign(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature"])
        _WORDS.clear()  # the worker lives on

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, signature binary")


def bucket_hashes(signatures: np.ndarray, plan: Plan) -> np.ndarray:
    """(documents, bands) hash of each band of each signature."""
    x = signatures.reshape(-1, plan.bands, plan.rows).astype(np.uint64)
    h = np.broadcast_to((np.arange(plan.bands, dtype=np.uint64) + np.uint64(1)) * _K2, x.shape[:2]).copy()
    for i in range(plan.rows):
        h = (h ^ (h >> np.uint64(29))) * _K1 + x[:, :, i]
    h ^= h >> np.uint64(32)
    h *= _K2
    return h.view(np.int64)


def _banded(classes: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, rep) for each band of each class."""

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = bucket_hashes(np.frombuffer(b"".join(_column(batch, "signature").to_pylist()), np.uint32), plan)
                yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1)), pa.array(np.repeat(_column(batch, "rep").to_numpy(), plan.bands))], names=["bucket", "rep"])

    return classes.select("rep", "signature").mapInArrow(cut, "bucket long, rep long")


def _posterior(pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that no batch of their signatures rules out."""
    steps = plan.least_matches()

    @released
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = np.arange(batch.num_rows)
            if len(alive):
                x, y = (np.frombuffer(b"".join(_column(batch, c).to_pylist()), np.uint32).reshape(len(alive), -1) for c in ("sig_a", "sig_b"))
                at, equal = 0, np.zeros(len(alive), np.int64)
                for n, m in steps:
                    equal = equal + (x[alive, at:n] == y[alive, at:n]).sum(1)
                    alive, equal, at = alive[equal >= m], equal[equal >= m], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    signatures = classes.select("rep", "signature")
    both = pairs.join(signatures.toDF("a", "sig_a"), "a").join(signatures.toDF("b", "sig_b"), "b")
    return both.mapInArrow(prune, "a long, b long")


def _sets(involved: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """(rep, shingle_set) of the documents in `involved` (rep) and some more.

    Sets are made again from the texts. A filter of fixed size tells the scan which are wanted, so
    texts are never shuffled; what it lets through besides is dropped by a later join.
    """
    spark, k = docs.sparkSession, plan.words
    bit = f"pmod(xxhash64(rep), {FILTER_BITS})"
    words = involved.selectExpr(f"cast({bit} / 32 as int) as word", f"shiftleft(1L, cast({bit} % 32 as int)) as bits").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    got = words.toArrow()  # at most FILTER_BITS / 32 rows
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(bits)

    @released
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _column(batch, "bit").to_numpy()
            hit = np.flatnonzero((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1))
            texts = _column(batch, "text")
            for lo in range(0, len(hit), 256):
                part = hit[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([_column(batch, "doc_id").take(pa.array(part)), pa.array([shingles(texts[int(i)].as_py(), k).tobytes() for i in part], pa.binary())], names=["rep", "shingle_set"])

    scanned = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    return written(scanned.mapInArrow(sets, "rep long, shingle_set binary"), "shingle-sets")


def _exact(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    num, den = plan.num, plan.den
    full = _sets(pairs.select("a").union(pairs.select("b")).toDF("rep"), docs, plan)

    @released
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(_column(batch, c)[i].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
                low, high = sorted((len(x), len(y)))
                if den * low < num * high:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (low + high - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    pieces = pairs.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b")
    return pieces.mapInArrow(verify, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """`rows` (bucket, rep, ...) in cells of a grid over each bucket's blocks of about `BLOCK` rows.

    A row of block i goes to the cells (i, k) and (k, i): every two rows of a bucket meet in one
    cell, and no cell holds more than two blocks.
    """
    # only buckets of more than one block are told: few, so rows need not meet by bucket
    sizes = written(rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "bucket-blocks")
    few = sizes.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    own = F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int")
    placed = rows.join(F.broadcast(sizes) if few else sizes, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.withColumns({"x": F.least("own", "k"), "y": F.greatest("own", "k")}).drop("k", "blocks")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "own", "rep")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one cell after another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([_column(batch, c).to_numpy().astype(np.int64) for c in ("bucket", "x", "y")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _candidates(cell: pa.Table, plan: Plan) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): a row of the cell and the later ones that it may be linked with.

    Pairs of one component, of one block in a cell of two, and those that share an earlier band
    are left out; the others must survive every batch of their signatures.
    """
    component, own = cell["component"].to_numpy(), cell["own"].to_numpy()
    x, y, bucket = cell["x"][0].as_py(), cell["y"][0].as_py(), cell["bucket"][0].as_py()
    signature = np.frombuffer(b"".join(cell["signature"].to_pylist()), np.uint32).reshape(len(own), -1)
    hashes = bucket_hashes(signature, plan)
    steps = plan.least_matches()
    for i in np.flatnonzero(own == x).tolist():
        j = np.arange(i + 1, len(own)) if x == y else np.flatnonzero(own == y)
        j = j[component[j] != component[i]]
        at, equal = 0, np.zeros(len(j), np.int64)
        for n, m in steps:
            if not len(j):
                break
            equal = equal + (signature[j, at:n] == signature[i, at:n]).sum(1)
            j, equal, at = j[equal >= m], equal[equal >= m], n
        if len(j):
            shared = hashes[j] == hashes[i]
            j = j[hashes[i][shared.argmax(1)] == bucket]
        if len(j):
            yield i, j


def _open_links(rows: DataFrame, docs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): links that join what links between different components of a bucket join.

    `rows`: bucket, rep, component. First signatures alone tell which rows have a candidate left;
    only these are met again with their sets.
    """
    num, den = plan.num, plan.den

    @released
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            hit = np.zeros(cell.num_rows, bool)
            for i, j in _candidates(cell, plan):
                hit[i] = True
                hit[j] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([cell[c].combine_chunks().filter(pa.array(hit)) for c in ("bucket", "rep", "component")], names=["bucket", "rep", "component"])

    schema = "bucket long, rep long, component long"
    signed = rows.join(classes.select("rep", "signature"), "rep")
    flagged = _dealt(signed).select("bucket", "x", "y", "own", "rep", "component", "signature").mapInArrow(flag, schema)
    flagged = written(flagged.distinct(), "flagged")
    full = _sets(flagged.select("rep").distinct(), docs, plan)

    @released
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            rep, label, sets, edges = cell["rep"].to_numpy(), None, None, []
            for i, j in _candidates(cell, plan):
                if label is None:
                    label = np.unique(cell["component"].to_numpy(), return_inverse=True)[1]
                    sets = [np.frombuffer(c.as_buffer(), np.uint64) for c in cell["shingle_set"]]
                    sizes = np.array([len(x) for x in sets])
                    values = np.concatenate(sets)
                    order = np.argsort(values, kind="stable")
                    values, owner = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
                j = j[label[j] != label[i]]
                if not len(j):
                    continue
                lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
                n = hi - lo
                both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))[j]
                for k in j[den * both >= num * (sizes[i] + sizes[j] - both)].tolist():
                    if label[k] != label[i]:
                        edges.append((rep[i], rep[k]))
                        label[label == label[k]] = label[i]
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    whole = flagged.join(classes.select("rep", "signature"), "rep").join(full, "rep")
    return _dealt(whole).select("bucket", "x", "y", "own", "rep", "component", "signature", "shingle_set").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, a document's set has its distinct
    shingles of `plan.words` words; with fewer words, the whole sequence as one. Documents without
    words (null, empty or blank text) have no shingles and link with nothing. Documents are linked
    if their sets' Jaccard similarity is num/den or more; component_id is the smallest doc_id
    reachable by links, kept is doc_id = component_id. Rows of the same doc_id are one document
    if their texts' sets agree. A row without doc_id takes part only through rows that equal it;
    its component_id is null where there is none. An empty table gives no rows. Further columns
    of `docs` play no part.
    """
    signed = written(_signed(docs, plan), "signatures")
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "signature")).alias("least"))
    classes = written(classes.select("set_key", F.col("least.doc_id").alias("rep"), F.col("least.signature").alias("signature")), "classes")
    banded = _banded(classes, plan)
    hubs = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("bucket", "hub")
    members = written(banded.join(hubs, "bucket"), "buckets")
    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    spark = docs.sparkSession
    with batches_of(spark, PAIRS):
        links = written(_exact(written(_posterior(stars, classes, plan), "survivors"), docs, plan), "links")
    found = components(links)
    # buckets that still hold different components: their pairs of different components
    labelled = members.select("bucket", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("bucket")
    rest = written(labelled.join(open_, "bucket"), "open-buckets")
    with batches_of(spark, PAIRS):
        more = written(_open_links(rest, docs, classes, plan), "links")
    if more.take(1):
        found = components(found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))
    groups = classes.select("set_key", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(groups, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


OP7 = Plan(words=3, num=85, den=100)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of `documents` by 3-word shingles and a similarity of 0.85; see `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"), OP7)

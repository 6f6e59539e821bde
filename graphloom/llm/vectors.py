"""Embedding near-duplicates by product quantisation.

Vectors are cut to unit length and equal ones form a class. A coarse quantiser, fitted on a
bounded sample, puts every class into an inverted list; its residual is coded by subspaces. Of two
linked vectors on both sides of a plane that bisects two lists, one at least is within half the
margin of it: that one probes the other's list. Asymmetric distances are those of the probing
vector to what the members' codes stand for, by one matrix product; as each member's quantisation
error is known, only members that are certainly too far are dropped, and the rest are held against
the exact cosine. Neighbouring lists are packed into bins of bounded size, so that a probing vector
is sent to each bin once, however many of its lists it probes; lists too large for a bin are dealt
out as grids of bounded blocks. A block gives sums and a spanning forest of its links, never its
pairs. Blocks are dealt in rounds of bounded size, each of which leaves only what it found.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, new_path, released, shuffles_dropped, table, written
from graphloom.llm.components import components

#: Vectors, and bytes of them, that the quantisers are fitted on, at most.
SAMPLE, SAMPLE_BYTES = 32_768, 64 << 20
#: Vectors a list should hold, and most lists; beyond that lists grow and are split into blocks.
PER_LIST, MAX_LISTS = 50, 4096
SUBSPACES, CODES = 8, 256
#: Margin of probes in standard deviations of a random direction's part along a plane's normal.
PROBE_SIGMAS = 4.0
#: Lists so many link distances apart, or less, lie in one dense spot, where links are no random
#: directions: their margin is the whole link distance, beyond which no link goes.
NEAR = 2.0
#: Members (and bytes of them) and probing vectors of a block, how many of the latter are looked at
#: together, and how many distances are at once.
MEMBERS, MEMBER_BYTES, QUERIES, STEP, CELLS = 8192, 16 << 20, 32768, 4096, 1 << 19
#: What blocks give: weight that a vector is linked with, or an edge.
LINKS = "rep long, n long, other long"
#: Bytes that a round deals at least; beyond that it deals half of what the classes have, as the
#: round before may still be being deleted.
ROUND_BYTES = 128 << 20


@dataclass(frozen=True)
class Quantiser:
    coarse: np.ndarray
    reach: float
    cuts: np.ndarray
    books: list[np.ndarray]
    #: lists in an order that keeps neighbours together
    order: np.ndarray

    @functools.cached_property
    def walls(self) -> np.ndarray:
        """How much farther (in squared distance) another list may be than the own one, to be probed:
        worked out once by each worker, as it is much larger than the lists."""
        square, most = (self.coarse**2).sum(1), PROBE_SIGMAS * self.reach / np.sqrt(self.coarse.shape[1])
        gaps = np.sqrt(np.maximum(square[:, None] + square - 2 * self.coarse @ self.coarse.T, 0))
        return (np.where(gaps <= NEAR * self.reach, self.reach, min(self.reach, most)) * gaps + 1e-6).astype(np.float32)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own list of each, row and list of other lists to probe) of unit vectors: those whose
        bisecting plane with its own list is within half the margin."""
        own, rows, lists = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
        for lo in range(0, len(x), 1024):
            near = (self.coarse**2).sum(1) - 2 * x[lo : lo + 1024] @ self.coarse.T
            mine = near.argmin(1)
            hit = near - near[np.arange(len(near)), mine][:, None] <= self.walls[mine]
            hit[np.arange(len(near)), mine] = False
            row, list_ = np.nonzero(hit)
            own.append(mine)
            rows.append(row + lo)
            lists.append(list_)
        return np.concatenate(own), np.concatenate(rows), np.concatenate(lists)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, quantisation error) of residuals."""
        codes, error = np.zeros((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for s, book in enumerate(self.books):
            part = residual[:, self.cuts[s] : self.cuts[s + 1]]
            codes[:, s] = c = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            error += ((part - book[c]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([((c**2).sum(1) - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        full, first = np.unique(own[order], return_index=True)
        c[full] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return c


def fit(sample: np.ndarray, n: int, reach: float) -> Quantiser:
    """Quantisers for n vectors, linked up to a distance of `reach`, from a sample of unit vectors."""
    rng, x = np.random.default_rng(11), sample.astype(np.float32)
    coarse = _kmeans(x, max(1, min(MAX_LISTS, n // PER_LIST, len(x) // 8)), 6, rng)
    own = np.concatenate([((coarse**2).sum(1) - 2 * x[i : i + 4096] @ coarse.T).argmin(1) for i in range(0, len(x), 4096)])
    residual = x - coarse[own]
    cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    books = [_kmeans(residual[:, a:b], CODES, 5, rng) for a, b in zip(cuts, cuts[1:], strict=False)]
    centres = _kmeans(coarse, int(np.sqrt(len(coarse))), 4, rng)
    order = np.argsort(((centres**2).sum(1) - 2 * coarse @ centres.T).argmin(1), kind="stable")
    return Quantiser(coarse, float(reach), cuts, books, order)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows cut to unit length, in double precision."""
    x = np.ascontiguousarray(x, float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True)) + 0.0


def _kind(vectors: DataFrame) -> type:
    """Components are kept as they came: of four bytes, or of eight."""
    return np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def _prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, key (of the unit vector; null where it links with nothing), x (bytes of the vector as it came)."""
    kind = _kind(vectors)

    @released
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cells = [None] * batch.num_rows, [None] * batch.num_rows
            column = _column(batch, "embedding")
            flat = column.flatten().to_numpy(zero_copy_only=False)  # nulls come as NaN
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
            begin = np.cumsum(sizes) - sizes
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                x = flat[begin[at][:, None] + np.arange(size)].astype(kind, copy=False)
                good = np.isfinite(x).all(1) & x.any(1)
                at, x = at[good], x[good]
                for row, unit, raw in zip(at.tolist(), _unit(x), x, strict=True):
                    keys[row], cells[row] = xxhash.xxh3_128_digest(unit.tobytes()), raw.tobytes()
            yield pa.RecordBatch.from_arrays([_column(batch, "vec_id"), pa.array(keys, pa.binary()), pa.array(cells, pa.binary())], names=["vec_id", "key", "x"])

    embedding = F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding")).mapInArrow(prepare, "vec_id long, key binary, x binary")


def _bins(members: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each list, parts of each bin): lists in order, packed up to `most` vectors; a list
    that has more is a bin of its own, in several parts."""
    bin_of, parts, held = np.zeros(len(order), np.int64), [1], 0
    for k in order.tolist():
        if held and held + members[k] > most:
            parts.append(1)
            held = 0
        bin_of[k] = len(parts) - 1
        held += int(members[k])
        parts[-1] = max(1, -(-held // most))
    return bin_of, np.array(parts)


def _rounds(rows: np.ndarray, most: int) -> np.ndarray:
    """Round of each part of a bin, in order: up to `most` rows, or one part that has more."""
    out, held = np.zeros(len(rows), np.int64), 0
    for k, n in enumerate(rows.tolist()):
        fresh = held and held + n > most
        out[k] = out[k - 1] + bool(fresh) if k else 0
        held = n if fresh else held + n
    return out


def links(classes: DataFrame, n: int, dim: int, kind: type, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(rep, n_links) and edges (a, b) that join what links join, for `classes` (rep, weight, x of `kind`)."""
    spark = classes.sparkSession
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    chance = F.pmod(F.xxhash64(F.lit(5), "x"), F.lit(1 << 30))  # classes differ in x, so about `most` are drawn
    drawn = classes.where(chance < int(min(1.0, most / n) * (1 << 30))).select("x", chance.alias("chance"), "rep").toArrow().sort_by([("chance", "ascending"), ("rep", "ascending")])
    sample = drawn["x"].to_pylist() or [r[0] for r in classes.select("x").limit(most).collect()]

    def units(cells: list[bytes]) -> np.ndarray:
        return _unit(np.frombuffer(b"".join(cells), kind).reshape(-1, dim))

    shared = spark.sparkContext.broadcast(fit(units(sample), n, reach))

    @released
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, rows, lists = shared.value.assign(units(_column(batch, "x").to_pylist()).astype(np.float32))
                upto = np.searchsorted(rows, np.arange(len(own) + 1)).astype(np.int32)
                probes = pa.ListArray.from_arrays(pa.array(upto), pa.array(lists.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(_column(batch, c) for c in ("rep", "weight", "x")), pa.array(own.astype(np.int32)), probes], names=["rep", "weight", "x", "list", "probes"])

    assigned = written(classes.mapInArrow(assign, "rep long, weight long, x binary, list int, probes array<int>"), "assigned")
    members = np.zeros(len(shared.value.coarse), int)  # as many numbers as there are lists
    for row in assigned.groupBy("list").count().collect():
        members[row[0]] = row[1]
    lists = len(members)
    bin_of, wide = _bins(members, shared.value.order, max(1, min(MEMBERS, MEMBER_BYTES // (8 * dim))))

    def asked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, bin): the bins that each row's own list and probed lists lie in, each once."""
        probes, own = _column(batch, "probes"), _column(batch, "list").to_numpy()
        rows = np.append(np.repeat(np.arange(len(own)), probes.value_lengths().to_numpy()), np.arange(len(own)))
        key = np.unique(rows * len(wide) + bin_of[np.append(probes.flatten().to_numpy(zero_copy_only=False), own)])
        return key // len(wide), key % len(wide)

    @released
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_ = np.bincount(asked(batch)[1], minlength=len(wide))
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n_).astype(np.int32)), pa.array(n_[n_ > 0])], names=["bin", "n"])

    queries = np.zeros(len(wide), int)
    for row in assigned.select("list", "probes").mapInArrow(tally, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect():
        queries[row[0]] = row[1]
    tall = np.maximum(1, -(-queries // QUERIES))
    # what each part of a bin is dealt, and the round in which that is done
    dealt_rows = np.repeat(queries + np.ceil(np.bincount(bin_of, members, len(wide)) / wide * tall).astype(int), wide)
    bytes_ = np.dtype(kind).itemsize * dim + 48
    first, round_of = np.cumsum(wide) - wide, _rounds(dealt_rows, max(n // 2, ROUND_BYTES // bytes_))

    def deal(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bin", "across", "down", "role", "rep", "weight", "x", "list", "probes"]
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, own = _column(batch, "rep").to_numpy(), _column(batch, "list").to_numpy()
            h = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            home = bin_of[own]
            # members: to every block down their own part; probing vectors: to every part across the bins they ask
            part = h % wide[home]
            mine = np.flatnonzero(round_of[first[home] + part] == turn)
            a = np.repeat(mine, tall[home[mine]])
            down = np.arange(len(a)) - np.repeat(np.cumsum(tall[home[mine]]) - tall[home[mine]], tall[home[mine]])
            row, to = asked(batch)
            b, c = np.repeat(row, wide[to]), np.repeat(to, wide[to])
            across = np.arange(len(b)) - np.repeat(np.cumsum(wide[to]) - wide[to], wide[to])
            now = round_of[first[c] + across] == turn
            b, c, across = b[now], c[now], across[now]
            cells = np.concatenate([np.stack([home[a], part[a], down, np.zeros(len(a), int)], 1), np.stack([c, across, h[b] % tall[c], np.ones(len(b), int)], 1)])
            at = np.append(a, b)
            for lo in range(0, len(at), 20_000):
                some = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays([*(pa.array(cells[some, i].astype(np.int32)) for i in range(4)), *(_column(batch, x).take(pa.array(at[some])) for x in names[4:])], names=names)

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple] = []
        block: Block | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([_column(batch, c).to_numpy() for c in ("bin", "across", "down", "role")], 1)
            rep, weight, own = (_column(batch, c).to_numpy() for c in ("rep", "weight", "list"))
            x, probes = _column(batch, "x"), _column(batch, "probes")
            flat, sizes = probes.flatten().to_numpy(zero_copy_only=False), probes.value_lengths().to_numpy()
            upto = np.append(0, np.cumsum(sizes))
            edges = np.append(0, np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)))
            for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                here = tuple(keys[lo, :3])
                if here != at:
                    if block is not None:
                        yield block.left()
                    at, held, block = here, [], None
                for a in range(lo, hi, STEP):
                    b = min(hi, a + STEP)
                    some = rep[a:b], weight[a:b], units(x.slice(a, b - a).to_pylist()), own[a:b], flat[upto[a] : upto[b]], sizes[a:b]
                    if keys[lo, 3] == 0:
                        held.append(some)
                    elif held:
                        block = block or Block(shared.value, lists, reach, cosine, [np.concatenate(c) for c in zip(*held, strict=True)])
                        yield block.meet(*some)
        if block is not None:
            yield block.left()

    path, parts = new_path(spark, "vector-links"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(int(round_of[-1]) + 1):
        blocks = int((np.bincount(np.repeat(np.arange(len(wide)), wide)[round_of == turn], minlength=len(wide)) * tall).sum())
        dealt = assigned.mapInArrow(released(functools.partial(deal, turn)), "bin int, across int, down int, role int, rep long, weight long, x binary, list int, probes array<int>")
        dealt = dealt.repartition(max(parts, min(blocks, 2000) // 8), "bin", "across", "down").sortWithinPartitions("bin", "across", "down", "role", "rep")
        dealt.mapInArrow(compare, LINKS).write.mode("append").option("compression", "zstd").parquet(path)
    dropped(assigned)
    found = spark.read.schema(LINKS).parquet(path)
    return found.groupBy("rep").agg(F.sum("n").alias("n_links")), found.where("other <> rep").select(F.col("rep").alias("a"), F.col("other").alias("b"))


class Block:
    """Members of some lists, which probing vectors are held against.

    A pair whose ends probe each other's lists is met from both sides, and each meeting counts for
    the one that probes; a pair that is met once counts for both. Within a list all pairs are met
    from both sides. Labels of vectors that are found linked become one, and each label that goes
    gives an edge to the one that takes its place.
    """

    def __init__(self, q: Quantiser, lists: int, reach: float, cosine: float, members: list[np.ndarray]):
        rep, weight, x, own, flat, sizes = members
        order = np.argsort(own, kind="stable")
        self.rep, self.weight, self.x, own = rep[order], weight[order], x[order], own[order]
        self.lists, self.cosine = lists, cosine
        self.begin = np.searchsorted(own, np.arange(lists + 1))
        codes, error = q.encode((self.x - q.coarse[own]).astype(np.float32))
        self.stands = q.coarse[own] + q.decode(codes)
        # 2 * product >= 1 + square - limit, where the distance to what a code stands for is within the limit
        self.least = ((1 + (self.stands**2).sum(1) - (reach + error) ** 2 - 1e-4) / 2).astype(np.float32)
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        self.probes = np.sort(np.repeat(place, sizes) * lists + flat)
        self.n, self.label = np.zeros(len(rep)), self.rep.copy()

    def meet(self, rep: np.ndarray, weight: np.ndarray, x: np.ndarray, own: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        """Links of probing vectors: (rep, weight linked, itself) and edges (rep, 0, another)."""
        rows, asked = np.append(np.repeat(np.arange(len(rep)), sizes), np.arange(len(rep))), np.append(flat, own)
        here = np.flatnonzero(self.begin[asked] < self.begin[asked + 1])
        here = here[np.argsort(asked[here], kind="stable")]
        rows, asked = rows[here], asked[here]
        n, label, edges, single = np.zeros(len(rep)), rep.copy(), [], x.astype(np.float32)
        cuts = np.append(np.flatnonzero(np.diff(asked, prepend=-1)), len(asked))
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            begin, end = self.begin[asked[lo]], self.begin[asked[lo] + 1]
            step = max(16, CELLS // (end - begin))
            for a in range(lo, hi, step):
                some = rows[a : min(hi, a + step)]
                i, j = np.nonzero(single[some] @ self.stands[begin:end].T >= self.least[begin:end])
                if not len(i):
                    continue
                i, j = some[i], j + begin
                keep = np.concatenate([(x[i[s : s + 65536]] * self.x[j[s : s + 65536]]).sum(1) >= self.cosine for s in range(0, len(i), 65536)])
                keep &= rep[i] != self.rep[j]
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                n += np.bincount(i, self.weight[j], len(n))
                once = own[i] != asked[lo]
                if once.any():
                    o, p = i[once], j[once]
                    back = p * self.lists + own[o]
                    found = np.searchsorted(self.probes, back)
                    once = np.append(self.probes, -1)[found] != back
                    self.n += np.bincount(p[once], weight[o[once]], len(self.n))
                edges += self._join(i, j, label)
        mine = np.flatnonzero(n)
        return _found([(rep[mine], n[mine].astype(np.int64), rep[mine]), *((old, np.zeros(len(old), np.int64), new) for old, new in edges)])

    def _join(self, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Makes labels of linked vectors one; (old, new) of those that went, each once."""
        was, had = label.copy(), self.label.copy()
        while (apart := np.flatnonzero(label[i] != self.label[j])).size:
            a, b = i[apart], j[apart]
            low = np.minimum(label[a], self.label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(self.label, b, low)
        gone = np.concatenate([np.stack([old, new], 1)[old != new] for old, new in ((was, label), (had, self.label))])
        gone = np.unique(gone, axis=0)
        return [(gone[:, 0], gone[:, 1])]

    def left(self) -> pa.RecordBatch:
        """What members are still to be given: (rep, weight linked, itself)."""
        at = np.flatnonzero(self.n)
        return _found([(self.rep[at], self.n[at].astype(np.int64), self.rep[at])])


def _found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["rep", "n", "other"])


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links (rows linked with it
    directly), component_id (smallest vec_id reachable by links, itself included), kept (vec_id =
    component_id).

    Vectors of one length are linked if their cosine in double precision is `cosine` or more;
    each length has quantisers of its own. A vector that is null, empty, zero or holds null or
    non-finite components links with nothing, nor does a row without vec_id, whose component_id is
    null. Equal vectors are linked like any others, through their class. An empty table gives no
    rows; further columns play no part. A link whose ends lie on both sides of a plane between
    lists more than `NEAR` link distances apart is lost only if it crosses it by more than
    `PROBE_SIGMAS` standard deviations of a random direction; others are not lost. Whatever the number of probes, the folders hold the vectors twice, and two
    rounds' shuffles of half as much (see `ROUND_BYTES`), besides ids and keys.
    """
    kind = _kind(vectors)
    good = (F.col("key").isNotNull()) & F.col("vec_id").isNotNull()
    with shuffles_dropped(vectors.sparkSession):
        whole = written(_prepared(vectors), "vectors")
        rows = written(whole.select("vec_id", "key"), "keys")
        grouped = whole.where(good).groupBy("key").agg(F.min(F.struct("vec_id", "x")).alias("least"), F.count("*").alias("weight"))
        classes = written(grouped.select("key", F.col("least.vec_id").alias("rep"), "weight", F.col("least.x").alias("x")), "classes")
        dropped(whole)
        joined = written(classes.select("key", "rep", "weight"), "reps")
        counts = edges = None
        for size, n in classes.groupBy(F.octet_length("x")).count().where("count > 1").orderBy("count").collect():
            some, joins = links(classes.where(F.octet_length("x") == size).select("rep", "weight", "x"), n, size // np.dtype(kind).itemsize, kind, cosine)
            counts, edges = (some, joins) if counts is None else (counts.unionAll(some), edges.unionAll(joins))
        dropped(classes)
        if counts is None:
            joined = joined.withColumns({"n_links": F.lit(0), "component": F.col("rep")})
        else:
            joined = joined.join(counts, "rep", "left").join(components(edges).withColumnRenamed("id", "rep"), "rep", "left")
    total = F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1
    by_key = joined.select(F.col("key").alias("k"), total.alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("vec_id", F.when(good, F.col("key")).alias("key")).join(by_key, F.col("key") == F.col("k"), "left")
    component = F.coalesce("c", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all `embeddings` at a cosine of 0.95; see `near_vectors`."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.95)

"""Exact nearest neighbours by dot product over chunk vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.functions.text import decay

#: Numbers of the vectors in a block (16 MB), and queries and vectors multiplied at once (16 MB of products).
BLOCK_FLOATS, ROWS, COLUMNS = 2_000_000, 512, 4096


def dot(vec: Column, query: list[float]) -> Column:
    """Dot product in double precision over the shorter length; vectors are taken to be of unit length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    n = F.least(F.size(vec), F.lit(len(query)))
    parts = F.zip_with(F.slice(vec, 1, n), F.slice(q, 1, n), lambda a, b: a.cast("double") * b)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def nearest(chunks: DataFrame, query: list[float], limit: int) -> DataFrame:
    """(node_id, chunk_idx, sim) of the `limit` chunks nearest to the query; ties by node and chunk.

    One scan and a top-k whose state is `limit` rows a task.
    """
    return chunks.select("node_id", "chunk_idx", dot(F.col("vec"), query).alias("sim")).orderBy(F.round("sim", 9).desc(), "node_id", "chunk_idx").limit(limit)


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """A row for each vector, cut to `width` or filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width))
    kept = column < width
    out[row[kept], column[kept]] = flat[kept]
    return out


def nearest_many(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, sim): of each query (query_id, vec) the `limit` nearest of `vectors` (id, vec),
    ties by id. Null vectors are left out; of two lengths the shorter counts, and null components are zero.

    Blocks of queries meet blocks of vectors, each of about `BLOCK_FLOATS` numbers. A task multiplies
    slices of both and holds a slice's products and `limit` a query.
    """
    query_type, id_type = queries.schema["query_id"].dataType, vectors.schema["id"].dataType
    q, v = queries.where("vec is not null").select("query_id", "vec"), vectors.where("vec is not null").select("id", "vec")
    (n_q, size_q), (n_v, size_v) = (df.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first() for df in (q, v))
    blocks_v = max(1, -(-size_v // BLOCK_FLOATS))
    # small tables are dealt to all cores
    blocks_q = max(1, -(-size_q // BLOCK_FLOATS), min(vectors.sparkSession.sparkContext.defaultParallelism // blocks_v, n_q // 64))

    def dealt(key: str, n: int, other: int) -> list:
        return [F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))]

    of_q, of_v = dealt("query_id", blocks_q, blocks_v), dealt("id", blocks_v, blocks_q)
    left = q.select(of_q[0].alias("of_q"), of_q[1].alias("of_v"), F.lit(True).alias("asks"), "query_id", F.lit(None).cast(id_type).alias("id"), "vec")
    right = v.select(of_v[1].alias("of_q"), of_v[0].alias("of_v"), F.lit(False), F.lit(None).cast(query_type), "id", "vec")
    kinds = {"query_id": to_arrow_type(query_type), "id": to_arrow_type(id_type), "sim": pa.float64()}

    def top(block: pa.Table) -> pa.Table:
        asked, held = block.filter(block["asks"]), block.filter(pc.invert(block["asks"]))
        if not asked.num_rows or not held.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        return _top_of_block(asked, held, limit)

    schema = f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, sim double"
    out = left.unionAll(right).groupBy("of_q", "of_v").applyInArrow(top, schema)
    best = Window.partitionBy("query_id").orderBy(F.round("sim", 9).desc(), "id")
    return out.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).drop("place")


def _list(table: pa.Table, name: str) -> pa.ListArray:
    return table[name].combine_chunks()


def _top_of_block(asked: pa.Table, held: pa.Table, limit: int) -> pa.Table:
    """(query_id, id, sim) of what may be among the `limit` nearest; of those that tie exactly, the first by id."""
    held = held.sort_by([("id", "ascending")])
    q_list, v_list = _list(asked, "vec"), _list(held, "vec")
    width = max(int(np.diff(q_list.offsets.to_numpy()).max()), 1)
    q, v = _matrix(q_list, width), _matrix(v_list, width)
    found = [_top_of_slices(q[at : at + ROWS], v, limit, at) for at in range(0, len(q), ROWS)]
    row, col, sim = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"query_id": asked["query_id"].take(pa.array(row)), "id": held["id"].take(pa.array(col)), "sim": sim})


def _top_of_slices(q: np.ndarray, v: np.ndarray, limit: int, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, product), rows from `begin` on."""
    row, col, sim, least = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(q), -np.inf)
    for at in range(0, len(v), COLUMNS):
        product = q @ v[at : at + COLUMNS].T
        if product.shape[1] > limit:
            least = np.maximum(least, np.partition(product, -limit, axis=1)[:, -limit] - 1e-9) if at == 0 else least
        i, j = np.nonzero(product >= least[:, None])
        row, col, sim = np.r_[row, i], np.r_[col, j + at], np.r_[sim, product[i, j]]
        row, col, sim = _kept(row, col, sim, limit, least)
    return row + begin, col, sim


def _kept(row: np.ndarray, col: np.ndarray, sim: np.ndarray, limit: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What may be among the `limit` best of a row: all within 1e-9 of its last place, as ties are broken later to nine
    places, but of equal products the first `limit` only. Sets the rows' `least`."""
    order = np.lexsort((col, -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    new_row = np.r_[True, row[1:] != row[:-1]]
    first = np.flatnonzero(new_row)
    place = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)]))
    last = place == limit - 1
    least[row[last]] = sim[last] - 1e-9
    new = np.flatnonzero(new_row | np.r_[True, sim[1:] != sim[:-1]])
    run = np.arange(len(row)) - np.repeat(new, np.diff([*new, len(row)]))
    kept = (sim >= least[row]) & (run < limit)
    return row[kept], col[kept], sim[kept]


def by_node(hits: DataFrame) -> DataFrame:
    """(node_id, sim): each node's best chunk."""
    return hits.groupBy("node_id").agg(F.max("sim").alias("sim"))


def decayed(sims: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """(node_id, sim): notes lose value with age."""
    ages = nodes.where("label = 'Scratchpad'").select(F.col("id").alias("node_id"), decay(F.col("created_at"), now).alias("factor"))
    return sims.join(ages, "node_id", "left").select("node_id", (F.col("sim") * F.coalesce("factor", F.lit(1.0))).alias("sim"))


def node_chunks(nodes: DataFrame) -> DataFrame:
    """(node_id, chunk_idx, vec) of nodes with embeddings."""
    return nodes.select(F.col("id").alias("node_id"), F.posexplode("embedding").alias("chunk_idx", "vec"))

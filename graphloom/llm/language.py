"""Language ID: nearest centroid over normalised TF-IDF character n-grams.

Each language has several centroids, found by spherical k-means among its sampled documents. A
text goes to the language of its nearest centroid by cosine; a text whose distance from it is
larger than the sampled documents' own distances allow is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import released, table

#: Length of feature vectors; n-grams are hashed into it.
DIM = 4096
GRAMS = (1, 2, 3)
#: Most labelled rows that the model is fitted on, in all and for each language.
SAMPLE_ROWS, SAMPLE_EACH = 20_000, 600
CENTROIDS = 3
#: A text is rejected below this share of the least cosine (0.1 % quantile) of its language's sample.
REJECT_SHARE = 0.35
_POINTS = 0x3400
_SLICE = 1 << 20


def _letters() -> np.ndarray:
    """Lower case of each letter below `_POINTS`, 0 for all else; further letters keep their code."""
    out = np.zeros(_POINTS, np.uint32)
    for c in range(_POINTS):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS = _letters()


def features(text: str | None) -> np.ndarray | None:
    """Hashed counts of the whole text's letter n-grams, a blank standing for all between words; None without letters."""
    if not text:
        return None
    counts, letters = np.zeros(DIM, np.int64), False
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), _SLICE):
        x = points[max(0, at - 2) : at + _SLICE]
        low = _LETTERS[np.minimum(x, _POINTS - 1)]
        far = np.flatnonzero(x >= _POINTS)
        if len(far):
            low[far] = [c if chr(c).isalpha() else 0 for c in x[far].tolist()]
        keep = np.append(True, (low[1:] != 0) | (low[:-1] != 0)) if len(low) else np.zeros(0, bool)
        low = low[keep].astype(np.uint64)
        letters = letters or bool(low.any())
        low = np.concatenate([[np.uint64(0)], low, [np.uint64(0)]])
        h = np.zeros(len(low), np.uint64)
        for n in GRAMS:
            h = (h[: len(low) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + low[n - 1 :] + np.uint64(n)) if n > 1 else low * np.uint64(0xD1342543DE82EF95)
            counts += np.bincount(((h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(52)).astype(np.int64), minlength=DIM)
    return counts if letters else None


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = (np.sqrt(counts) * self.idf).astype(np.float32)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, cosine, accepted) of each row of counts."""
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(1)
        score, owner = cos[np.arange(len(cos)), best], self.owner[best]
        return owner, np.clip(score, 0, 1), score >= self.least[owner]


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means: at most k unit centroids."""
    k = min(k, len(x))
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < k:  # the point least like any centroid so far
        c = np.concatenate([c, x[[int((x @ c.T).max(1).argmin())]]])
    for _ in range(12):
        nearest = (x @ c.T).argmax(1)
        sums = np.stack([x[nearest == j].sum(0) for j in range(len(c))])
        sums = sums[np.linalg.norm(sums, axis=1) > 0]
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return c


def fit(labelled: DataFrame) -> Model | None:
    """Fits on at most `SAMPLE_EACH` rows of each language and `SAMPLE_ROWS` in all, chosen by a
    hash of doc_id among `labelled` (doc_id, text, lang); None where there is nothing to learn.

    Rows without lang are left out. Features are made on the executors; only the sample's counts
    come to the driver.
    """
    labelled = labelled.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    if len(sizes) > SAMPLE_ROWS // 2:
        raise ValueError(f"{len(sizes)} languages; at most {SAMPLE_ROWS // 2} can be learned from {SAMPLE_ROWS} rows")
    each = min(SAMPLE_EACH, SAMPLE_ROWS // len(sizes))
    chance = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    rate = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, (1.3 * each + 20) / n))])[F.col("lang")]
    sample = labelled.select("doc_id", "text", "lang", chance.alias("chance")).where(F.col("chance") < rate)

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = features(batch.column(batch.schema.get_field_index("text"))[i].as_py())
                if f is not None:
                    yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in ("lang", "chance", "doc_id")), pa.array([np.minimum(f, 1 << 30).astype("<u4").tobytes()])], names=["lang", "chance", "doc_id", "counts"])

    got = sample.mapInArrow(count, "lang string, chance double, doc_id long, counts binary").toArrow().sort_by([("lang", "ascending"), ("chance", "ascending"), ("doc_id", "ascending"), ("counts", "ascending")])
    langs = np.array(got["lang"].to_pylist(), object)
    if not len(langs):
        return None
    names = tuple(sorted(set(langs)))
    rows = np.concatenate([np.flatnonzero(langs == x)[:each] for x in names])
    counts = np.stack([np.frombuffer(got["counts"][int(i)].as_buffer(), "<u4") for i in rows]).astype(np.float32)
    y = np.array([names.index(langs[i]) for i in rows])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    empty = Model(names, idf, np.zeros((0, DIM)), np.zeros(0, int), np.zeros(len(names)))
    x, rng = empty.vectors(counts), np.random.default_rng(7)
    centroids = [_means(x[y == j], CENTROIDS, rng) for j in range(len(names))]
    least = np.array([REJECT_SHARE * np.quantile((x[y == j] @ c.T).max(1), 0.001) for j, c in enumerate(centroids)])
    return Model(names, idf, np.concatenate(centroids).astype(np.float32), np.repeat(np.arange(len(names)), [len(c) for c in centroids]), least)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred (a learned language; `und` where text is null or has no letter, or no
    model could be learned), score (cosine, 0 to 1; 0 for `und`) and accepted (false for `und` and
    for texts too far from every centroid). Whole texts count, whatever their length. `docs` has
    columns doc_id and text and any others; columns of these three names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    kept = docs.select(*rest)

    @released
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            langs, scores, accepted = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows if m else 0, 512):
                found = [(at + i, f) for i, t in enumerate(texts.slice(at, 512)) if (f := features(t.as_py())) is not None]
                if found:
                    owner, score, ok = m.predict(np.stack([f for _, f in found]))
                    for (i, _), o, s, a in zip(found, owner, score, ok, strict=True):
                        langs[i], scores[i], accepted[i] = m.languages[o], s, a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores), pa.array(accepted)], names=[*batch.schema.names, "lang_pred", "score", "accepted"])

    out = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return kept.mapInArrow(predict, out)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def learn(docs: DataFrame) -> Model | None:
    """The model of the rows that are not held out."""
    return fit(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("doc_id", "text", "lang"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of `documents`, learned from rows that are not held out; see `identify`."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")

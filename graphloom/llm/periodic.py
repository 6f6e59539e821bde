"""Periodic run detection: Main-Lorentz divide and conquer over interned words of each text.

A run is a longest stretch of consecutive words in which words one period apart are equal. A
text's words become small integers, and pieces of the text are halved: a run that holds both
words beside the midpoint is found there by Z-functions, any other lies in one half. With at
least four periods in a run, two of them stand on one side of the midpoint; that side's
Z-function names the periods, and one Z-function across the midpoint says how far each goes to
the other side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WORD_PATTERN, released, table

RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Bytes of collapsed texts in an Arrow batch of results, beyond its last text.
_BATCH = 4_000_000


def z_function(x: list[int], upto: int) -> list[int]:
    """For each place up to `upto`, how many items from there on equal those at the beginning."""
    n, z = len(x), [0] * (upto + 1)
    left = right = 0
    for i in range(1, upto + 1):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _one_side(back: list[int], front: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, words in `back`, words in `front`) of repetitions that hold the first word of both
    sides, going outward from the midpoint, and two periods of `front`."""
    half = len(front) // 2
    if front[0] not in front[1 : half + 1]:
        return
    z = z_function(front, half)
    periods = [p for p in range(1, half + 1) if z[p] >= p]
    if not periods:
        return
    most = periods[-1]
    across = z_function([*back, -1, *front[:most][::-1], *back], len(back) + most)
    for p in periods:
        behind = across[len(back) + 1 + most - p]
        if behind:
            yield p, behind, p + z[p]


def find(words: list[int], times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least `least` words and `times` periods (four or more), by start."""
    if times < 4:
        raise ValueError("runs of fewer than four periods need not hold two on one side of a midpoint")
    n, found, pieces = len(words), {}, [(0, len(words))]
    while pieces:
        begin, end = pieces.pop()
        # a run holds each of its words `times` times, so rarer words of a piece part its runs
        count = Counter(words[begin:end])
        cuts = [begin - 1, *(i for i in range(begin, end) if count[words[i]] < times), end]
        for a, b in zip(cuts, cuts[1:], strict=False):
            a += 1
            if b - a < max(least, times):
                continue
            mid = (a + b) // 2
            back, front = words[a:mid][::-1], words[mid:b]
            sides = [(p, mid - k, mid + m) for p, k, m in _one_side(back, front)] + [(p, mid - m, mid + k) for p, k, m in _one_side(front, back)]
            for p, s, e in sides:
                # what goes on beyond the piece is part of a run found whole where it crosses an earlier midpoint
                goes_on = s > 0 and words[s - 1] == words[s - 1 + p] or e < n and words[e] == words[e - p]
                if e - s >= max(least, times * p) and not goes_on:
                    found[s, e] = min(p, found.get((s, e), p))
            pieces += [(a, mid), (mid, b)]
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = [0] * (len(words) + 1)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept, depth = [], 0
    for word, step in zip(words, change, strict=False):
        depth += step
        if not depth:
            kept.append(word)
    return b" ".join(kept)


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """Runs of `docs` (doc_id, text; further columns are left out), a row for each row: doc_id, runs
    (start and length in words, smallest period; by start) and collapsed, the text's words less
    those that a run repeats, joined by one space.

    Words part at ASCII white space. A text that is null, empty or without words has no runs and an
    empty collapsed text. Repeated rows are answered each, null doc_ids stay. An empty table gives no
    rows. A text is one task's work, in time n log n of its words; nothing is shuffled.
    """

    @released
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "text"))
            runs, short, size, at = [], [], 0, 0
            for k, text in enumerate(texts):
                # exactly the ASCII white space parts bytes
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                names: dict[bytes, int] = {}
                found = find([names.setdefault(w, len(names)) for w in words], times, least)
                runs.append([{"start": s, "length": m, "period": p} for s, m, p in found])
                short.append(_collapsed(words, found).decode())
                size += len(short[-1])
                if size >= _BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, k + 1 - at), pa.array(runs, _RUN), pa.array(short, pa.string())], names=["doc_id", "runs", "collapsed"])
                    runs, short, size, at = [], [], 0, k + 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with a repetition in about a tenth of the texts, told by doc_id alone.

    With h the crc32 of the decimal doc_id and g = floor(h / 10): where h ends in 0 and the text has n
    words, each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumns({"g": F.floor(F.col("h") / 10), "n": F.coalesce(F.size("words"), F.lit(0))})
    n, g = F.col("n"), F.col("g")
    a = F.when(n > 0, g % n).cast("int")
    rows = rows.withColumn("a", a).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), n - F.col("a"))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return rows.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """What `periodic_runs` found, as numbers and hashes: a row for each document."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]))
    each = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("top"), each.alias("lines"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods and six words in all `documents`, a tenth of which are given one; see `planted`."""
    return digest(periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))

"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents with the same set of sources form a pattern. A flow routes each pattern's words to its
sources' quotas; the first reading of a pattern's words is free, each further one costs more, so
repeats are only used where quotas ask for them. As costs stand on the patterns' arcs alone and
rise with each reading, the flow is found one reading at a time: each time the arcs open by one
reading more. Patterns of one source fill what its quota lacks first, as they have no other; the
rest comes along blocking flows of shortest paths. Last, documents are chosen within
each pattern: all of them as often as the flow covers whole readings, and for the rest those that
come first by a seeded hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table, word_count, written

#: Patterns whose totals the driver holds at most; each is a few numbers. Sources are of that order at most.
MAX_PATTERNS = 1_000_000
_HEX = 3
_EPS = 1e-6


@dataclass(frozen=True)
class Recipe:
    """Weights by the sources' rank (code points, null last), repeating; words in all as a share
    of all words; most readings of a document; seed."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    readings: int = 2
    seed: int = 2024


def targets(sizes: dict[str | None, int], recipe: Recipe) -> dict[str | None, float]:
    """Target of each source: its weight's part of the share, at most `readings` times its size;
    what exceeds that goes to the others by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: recipe.weights[i % len(recipe.weights)] for i, s in enumerate(names)}
    cap = {s: recipe.readings * sizes[s] for s in names}
    left, open_, out = recipe.share * sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > cap[s]]
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = float(cap[s])
            left -= cap[s]
        open_ = [s for s in open_ if s not in out]
    return out


def flow(sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[float], readings: int) -> list[float]:
    """Words each pattern gives: a min-cost flow from patterns (size a reading) to their sources' quotas."""
    room, sent = list(quotas), [{s: 0.0 for s in m} for m in members]
    givers: dict[int, list[int]] = {}  # patterns that could take what they give to a source elsewhere
    for p, m in enumerate(members):
        for s in m if len(m) > 1 else ():
            givers.setdefault(s, []).append(p)
    left = [0.0] * len(sizes)
    for _ in range(readings):
        for p, m in enumerate(members):
            left[p] += sizes[p]
            if len(m) == 1 and (amount := min(left[p], room[m[0]])) > _EPS:
                sent[p][m[0]] += amount
                left[p] -= amount
                room[m[0]] -= amount
        while _blocking(members, givers, sent, left, room):
            pass
    return [sum(x.values()) for x in sent]


def _blocking(members: Sequence[Sequence[int]], givers: dict[int, list[int]], sent: list[dict[int, float]], left: list[float], room: list[float]) -> bool:
    """One round of shortest augmenting paths: from patterns with words left to sources with room,
    through sources to patterns that could give them less. False if there is none."""
    starts = [p for p in range(len(members)) if left[p] > _EPS]
    level: dict[tuple[bool, int], int] = {(True, p): 0 for p in starts}
    now, depth, reached = list(level), 0, False
    while now and not reached:
        depth, after = depth + 1, []
        for is_pattern, i in now:
            nexts = ((False, s) for s in members[i]) if is_pattern else ((True, p) for p in givers.get(i, ()) if sent[p][i] > _EPS)
            for x in nexts:
                if x not in level:
                    level[x] = depth
                    after.append(x)
                    reached = reached or not x[0] and room[x[1]] > _EPS
        now = after
    if not reached:
        return False
    arcs: dict[tuple[bool, int], Iterator] = {}
    for start in starts:
        path = [(True, start)]
        while path and left[start] > _EPS:
            at = path[-1]
            is_pattern, i = at
            if not is_pattern and room[i] > _EPS and level[at] == depth:
                taken = [sent[b[1]][a[1]] for a, b in zip(path[1:], path[2:], strict=False) if not a[0]]
                amount = min(left[start], room[i], *taken)
                for a, b in zip(path, path[1:], strict=False):
                    if a[0]:
                        sent[a[1]][b[1]] += amount
                    else:
                        sent[b[1]][a[1]] -= amount
                left[start] -= amount
                room[i] -= amount
                path = [(True, start)]
                continue
            if at not in arcs:
                arcs[at] = iter([(False, s) for s in members[i]] if is_pattern else [(True, p) for p in givers.get(i, ())])
            for x in arcs[at]:
                if level.get(x, -1) == level[at] + 1 and (is_pattern or sent[x[1]][i] > _EPS):
                    # the arc may serve again, so it stays at the head
                    arcs[at] = itertools.chain([x], arcs[at])
                    path.append(x)
                    break
            else:
                path.pop()
                if path:
                    next(arcs[path[-1]])
    return True


def _order(seed: int) -> Column:
    """A document's place in its pattern: by doc_id, where it has none by its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def plan(sized: DataFrame, recipe: Recipe) -> DataFrame:
    """For each pattern of `sized` (pattern array<string>, size long, h string): pattern,
    source_size and target (summed over its sources), whole (readings of every document) and cut
    (documents up to this hash are read once more; null: none).

    Patterns come to the driver as totals, at most `MAX_PATTERNS`. The cut is found in two steps
    of hexadecimal digits, each a sum by pattern and bucket, so that only a sixteen-millionth of a
    pattern is ever put in order.
    """
    spark = sized.sparkSession
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    patterns = [tuple(r["pattern"]) for r in rows]
    words = [r["size"] for r in rows]
    sources: dict[str | None, int] = {}
    for p, n in zip(patterns, words, strict=True):
        for s in p:
            sources[s] = sources.get(s, 0) + n
    goal, names = targets(sources, recipe), list(sources)
    at = {s: i for i, s in enumerate(names)}
    given = flow(words, [[at[s] for s in p] for p in patterns], [goal[s] for s in names], recipe.readings)
    whole = [min(recipe.readings, int(g / n + 1e-9)) if n else 0 for g, n in zip(given, words, strict=True)]
    need = [max(0.0, g - k * n) if k < recipe.readings else 0.0 for g, k, n in zip(given, whole, words, strict=True)]
    columns = "pattern array<string>, source_size long, target double, whole int, need double"
    data = [(list(p), sum(sources[s] for s in p), sum(goal[s] for s in p), k, x) for p, k, x in zip(patterns, whole, need, strict=True)]
    base = spark.createDataFrame(data, columns)
    open_ = base.where("need > 0").select("pattern", "need", F.lit("").alias("prefix"))
    for step in (1, 2):
        digits = F.substring("h", 1, _HEX * step)
        inside = _within(sized, open_)
        sums = inside.groupBy("pattern", digits.alias("prefix")).agg(F.sum("size").alias("size"), F.first("need").alias("need"))
        open_ = _crossing(sums, "prefix").select("pattern", (F.col("need") - F.col("before")).alias("need"), "prefix")
        open_ = spark.createDataFrame(open_.collect(), open_.schema)  # one row a pattern
    last = _within(sized, open_).groupBy("pattern", "h").agg(F.sum("size").alias("size"), F.first("need").alias("need"), F.first("prefix").alias("prefix"))
    upto = _crossing(last, "h")
    nearer = F.col("before") + F.col("size") - F.col("need") < F.col("need") - F.col("before")
    cut = upto.select("pattern", F.when(nearer, F.col("h")).otherwise(F.coalesce("previous", "prefix")).alias("cut"))
    got = {tuple(r["pattern"]): r["cut"] for r in cut.collect()}
    return spark.createDataFrame([(*r[:4], got.get(tuple(r[0]))) for r in data], "pattern array<string>, source_size long, target double, whole int, cut string")


def _within(sized: DataFrame, open_: DataFrame) -> DataFrame:
    """Documents of each pattern whose hash begins with the pattern's prefix; `open_` has one row a pattern."""
    o = F.broadcast(open_.select(F.col("pattern").alias("p"), "need", "prefix"))
    return sized.join(o, (F.col("pattern") == F.col("p")) & F.col("h").startswith(F.col("prefix"))).drop("p")


def _crossing(sums: DataFrame, by: str) -> DataFrame:
    """Of each pattern the row at which the running size reaches `need`, with the size before it."""
    w = Window.partitionBy("pattern").orderBy(by)
    upto = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ran = sums.withColumns({"upto": upto, "previous": F.lag(by).over(w)}).withColumn("before", F.col("upto") - F.col("size"))
    return ran.where("before < need and upto >= need")


def choose(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """`sized` with source_size, target and `times`: how often the mix reads each row."""
    p = F.broadcast(planned.withColumnRenamed("pattern", "p"))
    extra = F.coalesce((F.col("h") <= F.col("cut")).cast("int"), F.lit(0))
    return sized.join(p, F.col("pattern") == F.col("p")).drop("p").withColumn("times", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.col("whole")))


def with_patterns(docs: DataFrame, members: Column, recipe: Recipe) -> DataFrame:
    """`docs` with pattern (the sorted set of its sources), size in words and hash."""
    return docs.withColumns({"pattern": F.array_sort(F.array_distinct(members)), "size": word_count(F.col("text")), "h": _order(recipe.seed)})


def mix(docs: DataFrame, members: Column | None = None, recipe: Recipe = Recipe()) -> DataFrame:  # noqa: B008
    """One row per row of `docs` (doc_id, text, source): doc_id, size (words; null text: 0),
    source_size, target (of its source; summed where it has several), taken (words that the mix
    reads, repeats counted) and times.

    `members`: array of each document's sources, by default its one source; null is a source of
    its own. Rows of the same doc_id are chosen together, those without doc_id if their texts are
    equal. Where sizes are all 0, targets are 0 and
    nothing is taken. Further columns play no part. The same rows and recipe give the same mix.
    """
    members = F.array("source") if members is None else members
    sized = written(with_patterns(docs, members, recipe).select("doc_id", "pattern", "size", "h"), "sized")
    out = choose(sized, plan(sized, recipe))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all of `documents` by the default recipe; see `mix`."""
    return mix(table(spark, sf_dir, "documents")).drop("times")


OP2_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('2024:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))) as h
  from documents
), sources as (
  select source, sum(size)::bigint as source_size, 2 * sum(size)::bigint as cap,
         (array[5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from sized group by source
), ordered as (
  select *, row_number() over (order by cap::double / w, source nulls last) as k from sources
), levels as (
  select *, (1.5::double * sum(source_size) over () - (sum(cap) over (order by k) - cap)::double)
            / (sum(w) over () - (sum(w) over (order by k) - w))::double as level
  from ordered
), first_open as (
  select min(k) as k from levels where not (w * level > cap)
), goals as (
  select l.source, l.source_size,
         case when l.k < f.k then l.cap::double else l.w * (select level from levels x where x.k = f.k) end as target
  from levels l, first_open f
), whole as (
  select *, case when source_size = 0 then 0 else least(2, floor(target / source_size + 1e-9)) end::bigint as whole from goals
), ran as (
  select s.doc_id, s.size, g.source_size, g.target, g.whole, s.h,
         case when g.whole < 2 then greatest(0, g.target - g.whole * g.source_size) else 0 end as need,
         sum(s.size) over (partition by s.source order by s.h) as upto
  from sized s join whole g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target,
       (size * (whole + case when need > 0 and (upto < need or upto - size < need and upto - need < need - (upto - size)) then 1 else 0 end))::bigint as taken
from ran
"""

"""Chat formatting by quotation linking.

A message's quoted lines are parsed by level. Each quoted line, each unbroken run of one level with
its paragraphs, and each level's whole passage is normalised, hashed and joined to the lines,
paragraphs and bodies that messages of the same conversation wrote themselves; the latest earlier
writer of a passage counts. The lowest level at which a writer is found names the message that is
answered. Replies then belong to the thread of the message they answer, and quotes are left out of
what is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table, written

#: `>` marks before a line, spaces between them allowed.
_MARKS = r"^[\x20\t]*(?:>[\x20\t]?)+"
#: A line that announces a quote ("On ... wrote:") and stands right before one.
_INTRO = r"(?i)^[\x20\t]*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió).{0,3}$"
#: Code points from which a normalised passage says more of its writer than any number of shorter ones.
LONG = 12
#: Turns that are put in order together: a passage's writers and askers, or a thread's messages.
SPAN = 4096
_RUN, _BODY = "\u0001", "\u0002"


def _lines(text: Column) -> Column:
    """Lines with level (number of `>` marks) and body."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1), line)


def _normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[\s\p{Z}]+", " "))


def _hashed(unit: Column) -> Column:
    """A passage's hash, odd for `LONG` ones."""
    return F.xxhash64(unit).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(unit) >= LONG).cast("bigint"))


def parsed(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with lines, own (text of level 0 without quotes and their announcements)."""
    lines = turns.select("conv_id", "turn", "role", "text", _lines(F.col("text")).alias("lines"))

    def kept(x: Column, i: Column) -> Column:
        nxt = F.try_element_at("lines", i + 2)["level"]
        return (x["level"] == 0) & ~(F.coalesce(nxt > 0, F.lit(False)) & x["body"].rlike(_INTRO))

    own = F.array_join(F.transform(F.filter("lines", kept), lambda x: x["body"]), "\n")
    return lines.withColumn("own", F.when(F.exists("lines", lambda x: x["level"] > 0), F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")).otherwise(F.coalesce("text", F.lit(""))))


def _quoted(p: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h) of quoted passages: lines, unbroken runs of lines of one level, their
    paragraphs, and all of a level."""
    quoting = p.where(F.exists("lines", lambda x: x["level"] > 0))

    def marked(x: Column, i: Column) -> Column:
        same = (i > 0) & F.coalesce(F.try_element_at("lines", i)["level"] == x["level"], F.lit(False))
        return F.concat(F.when(same, "\n").otherwise(F.concat(F.lit(_RUN), x["level"].cast("string"), F.lit(_BODY))), F.translate(x["body"], _RUN + _BODY, ""))

    text = F.array_join(F.transform("lines", marked), "")
    run = F.explode(F.filter(F.split(text, _RUN), lambda x: (x != "") & ~x.startswith("0" + _BODY)))
    runs = quoting.select("conv_id", "turn", "lines", run.alias("run"))
    runs = runs.select("conv_id", "turn", F.substring_index("run", _BODY, 1).cast("int").alias("level"), F.substring_index("run", _BODY, -1).alias("body"))
    lines = F.transform(F.split("body", "\n"), _normal)
    blocks = F.transform(F.concat(F.split("body", r"(?:\n[\x20\t]*){2,}"), F.array("body")), _normal)
    units = runs.select("conv_id", "turn", "level", F.explode(F.concat(lines, blocks)).alias("unit"))
    levels = F.array_distinct(F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: x["level"]))
    whole = quoting.select("conv_id", "turn", "lines", F.explode(levels).alias("level"))
    whole = whole.select("conv_id", "turn", "level", _normal(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == F.col("level")), lambda x: x["body"]), " ")).alias("unit"))
    return units.unionAll(whole).where("unit <> ''").select("conv_id", "turn", "level", _hashed(F.col("unit")).alias("h")).distinct()


def _written(p: DataFrame) -> DataFrame:
    """(conv_id, turn, h) of the lines, paragraphs and bodies that messages wrote themselves."""
    own = F.col("own")
    units = F.concat(F.split(own, r"\r\n|\r|\n", -1), F.split(own, r"(?:\r?\n[\x20\t]*){2,}", -1), F.array(own))
    return p.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, _normal))).alias("unit")).where("unit <> ''").select("conv_id", "turn", _hashed(F.col("unit")).alias("h"))


def _latest(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """`asked` (conv_id, turn, level, h) with parent: the latest turn of `sources` (conv_id, turn, h)
    before it that wrote h; rows without one go.

    Turns are cut into spans of `SPAN`. The last writer of each earlier span is found over one row
    a span, the last within the span over its own rows, so no passage that a whole conversation
    repeats is put in order in one place.
    """
    span = F.floor(F.col("turn") / SPAN)
    none = F.lit(None).cast("long")
    sources = sources.select("conv_id", "h", "turn", span.alias("span")).distinct()
    asked = asked.withColumn("span", span)
    key = ["conv_id", "h"]
    spans = sources.groupBy(*key, "span").agg(F.max("turn").alias("last")).unionByName(asked.select(*key, "span").distinct().withColumn("last", none))
    spans = spans.groupBy(*key, "span").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.max("last").over(earlier)).select(*key, "span", "before").where("before is not null")
    both = asked.select(*key, "span", "turn", "level", none.alias("writer")).unionByName(sources.select(*key, "span", "turn", F.lit(None).cast("int").alias("level"), F.col("turn").alias("writer")))
    upto = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("writer").over(upto)).where("level is not null")
    return near.join(spans, [*key, "span"], "left").select("conv_id", "turn", "level", "h", F.coalesce("near", "before").alias("parent")).where("parent is not null")


def links(p: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the message that each quoting message answers.

    Each quoted passage stands for the latest message before that wrote it. Of the messages named
    at the lowest level at which any is found, the one with most long passages, of these the one with
    most passages, of these the latest.
    Only messages of conversations that quote at all are hashed.
    """
    quoted = written(_quoted(p.where("conv_id is not null and turn is not null")), "quoted")
    convs = quoted.select("conv_id").distinct()
    sources = _written(p.where("turn is not null").join(convs, "conv_id", "left_semi"))
    sources = sources.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    votes = _latest(quoted, sources).groupBy("conv_id", "turn", "level", "parent").agg(F.sum(F.col("h").bitwiseAND(F.lit(1))).alias("n_long"), F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("nearest"), "n_long", "n", "parent"))
    return votes.groupBy("conv_id", "turn").agg(best["parent"].alias("parent"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of linked messages: their thread's first message and the number of
    answers from it to them.

    Steps double in length each round, so their number is the logarithm of the deepest thread.
    """
    steps = written(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        up = steps.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        joined = steps.join(up, ["conv_id", "root"], "left")
        if not joined.where("above is not null").take(1):
            return steps
        steps = written(joined.select("conv_id", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")


def reply_ordered(turns: DataFrame) -> DataFrame:
    """One row per row of `turns` (conv_id, turn, role, text): conv_id, turn, role, text (without
    quotes), parent (turn it answers by its quotes, or null), root (first turn of its thread) and
    depth (answers from there). In order of root and turn each reply follows what it answers.

    Messages without quotes, or whose quotes no earlier message of the conversation wrote, begin
    threads of their own. Null text is an empty one; rows with null conv_id or turn quote and
    answer nothing. Rows that repeat stay; of equal turns each is answered as one. An empty table
    gives no rows; further columns play no part. No conversation is gathered anywhere: rows carry
    their place in it.
    """
    p = parsed(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    parents = written(links(p), "parents")
    base = p.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.col("own").alias("text"))
    found = parents.join(threads(parents), ["conv_id", "turn"]).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "parent", "root", "depth")
    joined = base.join(found, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return joined.select("conv_id", "turn", "role", "text", "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def conversations(ordered: DataFrame) -> DataFrame:
    """(conv_id, root, part, messages) of `reply_ordered` rows: each thread as a list of (role, content)
    in reply order. Turns of a thread that are `SPAN` apart go to further parts, so a list is
    bounded however long a thread is; parts follow one another. Messages without text of their own are left out.
    """
    spoken = ordered.where("trim(text) <> ''").withColumn("part", F.floor((F.col("turn") - F.col("root")) / SPAN))
    said = F.array_sort(F.collect_list(F.struct("turn", "depth", "role", F.col("text").alias("content"))))
    lists = spoken.groupBy("conv_id", "root", "part").agg(said.alias("said"))
    return lists.select("conv_id", "root", "part", F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def op9_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of `conversations` without quotes, each with its place in its thread; see `reply_ordered`."""
    return reply_ordered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))

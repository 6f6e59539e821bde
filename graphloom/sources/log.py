"""The event log as files: scanning, appending, rewriting, archiving, and event constructors."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.schema import LOG
from graphloom.sources.folders import file_system, read_text, write_text, written

VERSION = 1
_PAYLOAD = ("id", "label", "from_id", "to_id", "relationship", "direction")
#: File beside the log's files that names their folder, once the log was rewritten.
POINTER = "_CURRENT"
#: File in the folder of an archive.
ARCHIVE = "_ARCHIVE"
_BATCH, _REWRITTEN = re.compile(r"batch-(\d{12})(-|$)"), re.compile(r"log-[0-9a-f]{32}$")
#: Bits of seq that number the lines of a split.
LINE_BITS = 33
KINDS = ("UPSERT_NODE", "LINK_NODES", "DELETE_NODE", "DELETE_EDGES")


def parse(lines: DataFrame) -> DataFrame:
    """Events of JSON lines (seq, value), typed: what is no event goes.

    An event needs an integer version (32 bits, unsigned), an integer timestamp from 0, one of four
    types and a payload object. Payload fields count only as texts, and properties only as an object;
    a link whose properties are something else is no link, nor is a deletion of edges whose
    direction is no text a deletion. Blank and broken lines go, too.
    """
    # rows of one-row arrays: filters stay above them, so that no line is parsed once a condition
    trimmed = F.regexp_replace("value", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    raw = lines.select("seq", F.inline(F.array(F.struct(F.try_parse_json(trimmed).alias("v"))))).where("v is not null")

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", path, "variant"))

    def text(path: str) -> Column:
        return F.when(kind(path) == "STRING", F.try_variant_get("v", path, "string"))

    def whole(path: str, most: int) -> Column:
        value = F.when(kind(path) == "BIGINT", F.try_variant_get("v", path, "bigint"))
        return F.when(value.between(0, most), value)

    held, direction = "$.payload.properties", "$.payload.direction"
    is_object = F.coalesce(kind(held).startswith("OBJECT"), F.lit(False))
    fields = F.struct(
        whole("$.version", (1 << 32) - 1).alias("version"),
        whole("$.timestamp", (1 << 63) - 1).alias("timestamp"),
        text("$.event_type").alias("event_type"),
        *[text(f"$.payload.{c}").alias(c) for c in _PAYLOAD],
        F.when(is_object, F.to_json(F.try_variant_get("v", held, "variant"))).alias("properties"),
        (is_object | kind(held).isNull()).alias("is_link"),
        (kind(direction).isNull() | (kind(direction) == "STRING")).alias("is_deletion"),
    )
    events = raw.select("seq", F.inline(F.array(fields))).where(F.col("event_type").isin(*KINDS) & F.col("version").isNotNull() & F.col("timestamp").isNotNull())
    link = F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & F.col("relationship").isNotNull() & F.col("is_link")
    relationship = F.when(F.col("is_link"), F.col("relationship")).alias("relationship")
    from_id = F.when(link | F.col("is_deletion"), F.col("from_id")).alias("from_id")
    properties = F.when(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & F.col("is_link"), F.coalesce("properties", F.lit("{}"))).otherwise(F.col("properties")).alias("properties")
    typed = F.struct(F.col("version").try_cast("int").alias("version"), "timestamp", "event_type", "id", "label", from_id, "to_id", relationship, "direction", properties)
    return events.select("seq", F.inline(F.array(typed)))


def placed(lines: DataFrame, first: int = 0) -> DataFrame:
    """(value, seq) of lines (value, file, block) as they are read: by file, by the split's start, and by
    the line's place in the split. Files that are no batches come first; ranks of splits begin at `first`.
    """
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    # splits, one row each: their rank gives the leading part of seq
    batch = F.col("file").rlike("/batch-[0-9]{12}[^/]*/")
    splits = numbered.select(batch.alias("is_batch"), "file", "block").distinct()
    ranked = splits.groupBy().agg(F.array_sort(F.collect_list(F.struct("is_batch", "file", "block"))).alias("all")).select(F.posexplode("all").alias("rank", "s"))
    ranks = ranked.select((F.col("rank") + F.lit(first)).cast("bigint").alias("rank"), "s.file", "s.block")
    return numbered.join(ranks, ["file", "block"]).select("value", (F.shiftleft("rank", LINE_BITS) + F.col("line") % F.lit(1 << LINE_BITS)).alias("seq"))


@dataclass(frozen=True)
class Listing:
    """What a log consists of at one time: plain files or folders below its folder (name, bytes), and numbers of its batches."""

    folder: str
    files: tuple[tuple[str, int], ...] = ()
    batches: tuple[tuple[int, str], ...] = ()

    @property
    def upto(self) -> int:
        return max((n for n, _ in self.batches), default=-1)

    def paths(self, after: int = -1) -> list[str]:
        plain = [f"{self.folder}/{name}" if name else self.folder for name, _ in self.files] if after < 0 else []
        return plain + [f"{self.folder}/{name}" for n, name in self.batches if n > after]


def listing(spark: SparkSession, path: str) -> Listing:
    """The log at `path`, a folder or one file. Hidden names, rewritten logs and archives below it are no part of it."""
    folder = current(spark, path)
    fs, at = file_system(spark, folder)
    if not fs.exists(at):
        return Listing(folder)
    if fs.getFileStatus(at).isFile():
        return Listing(folder, (("", fs.getFileStatus(at).getLen()),))
    files, batches = [], []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        numbered = _BATCH.match(name)
        if name[0] in "_." or status.isDirectory() and _REWRITTEN.match(name):
            continue
        if numbered:
            batches.append((int(numbered[1]), name))
        elif status.isFile():
            files.append((name, status.getLen()))
        elif not fs.exists(file_system(spark, f"{folder}/{name}/{ARCHIVE}")[1]):
            files.append((name, fs.getContentSummary(status.getPath()).getLength()))
    return Listing(folder, tuple(sorted(files)), tuple(sorted(batches)))


def read(spark: SparkSession, path: str, listed: Listing | None = None, after: int = -1, first: int = 0) -> DataFrame:
    """The log in JSONL files below `path`; with `listed`, what was there then; of that the batches
    after number `after` only, ranked from `first` on.

    seq is by file name and then by place in the file, batches behind other files. A missing path is
    an empty log. Lines are parsed at once and written as events, as a fold reads them several times.
    """
    paths = (listed or listing(spark, path)).paths(after)
    if not paths:
        return spark.createDataFrame([], LOG)
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return written(parse(placed(lines, first)), "events")


def to_json(log: DataFrame) -> DataFrame:
    """(value) one JSON object an event, absent payload fields left out."""
    inner = F.to_json(F.struct(*_PAYLOAD))
    whole = F.when(F.col("properties").isNull(), inner).when(inner == "{}", F.concat(F.lit('{"properties":'), "properties", F.lit("}"))).otherwise(F.concat(F.regexp_replace(inner, r"\}$", ""), F.lit(',"properties":'), F.col("properties"), F.lit("}")))
    head = F.regexp_replace(F.to_json(F.struct("version", "timestamp", "event_type")), r"\}$", "")
    return log.select(F.concat(head, F.lit(',"payload":'), whole, F.lit("}")).alias("value"))


def append(log: DataFrame, path: str) -> int:
    """Adds events, in order of seq, as a batch behind those there are; returns its number.

    Only names are listed, and no line is read. The batch is written aside and put in place by one
    rename that fails where another took the number first; if the log was rewritten meanwhile, it moves on.
    """
    spark, path = log.sparkSession, path.rstrip("/")
    name = uuid.uuid4().hex
    draft = f"{path}/_draft-{name}"
    to_json(log.orderBy("seq")).write.text(draft)
    fs, mark = file_system(spark, f"{draft}/_id-{name}")
    fs.create(mark, True).close()
    return _claim(spark, path, draft, mark.getName())


def _claim(spark: SparkSession, path: str, draft: str, mark: str) -> int:
    while True:
        folder = current(spark, path)
        n = listing(spark, path).upto + 1
        target = f"{folder}/batch-{n:012d}"
        if not moved(spark, draft, target):
            fs, at = file_system(spark, draft)
            if not fs.exists(at):
                raise FileNotFoundError(draft)
            continue
        now = current(spark, path)
        fs, copy = file_system(spark, f"{now}/batch-{n:012d}/{mark}")
        if now == folder or fs.exists(copy):  # who rewrote the log may have copied it
            return n
        draft, again = f"{path}/_draft-{uuid.uuid4().hex}", target
        if not moved(spark, again, draft):  # who rewrote the log has taken it along
            return n


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames to what must not be there yet; false where it is, or where the source is gone."""
    jvm = spark.sparkContext._jvm
    fs, at = file_system(spark, source)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at, file_system(spark, target)[1], options)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "FileNotFoundException"):
            return False
        raise
    return True


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the log's files: `path` itself, or the one its pointer names."""
    name = read_text(spark, f"{path.rstrip('/')}/{POINTER}")
    return path.rstrip("/") if name is None else f"{path.rstrip('/')}/{name}"


def rewrite(log: DataFrame, path: str, folded: Listing | None = None) -> None:
    """Replaces what `folded` lists of the log at `path` (all that is there now) with `log`.

    The new log is written whole to a folder of its own. Batches that came meanwhile are copied into
    it, where they follow, then a pointer to the folder
    is put in place by one rename that overwrites: readers see the old log or the new one, whenever
    a crash comes. What was folded is deleted last, and nothing else is. A log that someone else
    rewrote meanwhile is left alone, with an error.
    """
    spark, path = log.sparkSession, path.rstrip("/")
    folded = folded or listing(spark, path)
    old, name = folded.folder, f"log-{uuid.uuid4().hex}"
    to_json(log.orderBy("seq")).write.text(f"{path}/{name}/folded")
    late = _late(spark, old, folded)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = file_system(spark, f"{path}/{POINTER}")
    for batch in late:
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, file_system(spark, f"{old}/{batch}")[1], fs, file_system(spark, f"{path}/{name}/{batch}")[1], False, conf)
    if current(spark, path) != old:
        fs.delete(file_system(spark, f"{path}/{name}")[1], True)
        raise RuntimeError(f"the log at {path} was rewritten by another")
    _, draft = file_system(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    write_text(spark, draft.toString(), name)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, target, options)
    for batch in _late(spark, old, folded):
        if batch not in late:
            moved(spark, f"{old}/{batch}", f"{path}/{name}/{batch}")  # or its writer moves it
    gone = [x for x, _ in folded.files if x] + [x for _, x in folded.batches] + late
    for child in gone:
        fs.delete(file_system(spark, f"{old}/{child}")[1], True)
    if old != path and not len(fs.listStatus(file_system(spark, old)[1])):
        fs.delete(file_system(spark, old)[1], True)


def _late(spark: SparkSession, folder: str, folded: Listing) -> list[str]:
    fs, at = file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return [x for x in names if _BATCH.match(x) and x not in {b for _, b in folded.batches}]


def archive(log: DataFrame, path: str) -> int:
    """Appends events to the archive; nothing is written for none. Returns their number.

    A mark in its folder says that it is no part of a log that it may lie below.
    """
    n = log.count()
    if n:
        append(log, path)
        fs, mark = file_system(log.sparkSession, f"{path.rstrip('/')}/{ARCHIVE}")
        fs.create(mark, True).close()
    return n


def event(kind: str, seq: Column, **payload: Column) -> list[Column]:
    """Columns of a log row of `kind`, stamped with the version and the time in seconds."""
    if kind not in KINDS:
        raise ValueError(f"unknown event type {kind}")
    columns = [F.lit(VERSION).alias("version"), F.unix_timestamp().alias("timestamp"), F.lit(kind).alias("event_type")]
    return [seq.alias("seq"), *columns, *[payload.get(c, F.lit(None).cast("string")).alias(c) for c in (*_PAYLOAD, "properties")]]

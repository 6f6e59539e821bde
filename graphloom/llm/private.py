"""Personal data: exact patterns, and information-theoretic sanitisation of what betrays them.

Patterns find the protected entities (e-mail and IP addresses, card and phone numbers). Terms of an
entity's documents are then weighed by what they tell of it: with document counts n over the corpus
of N, pmi = log2(p(entity | term) / p(entity)) of the entity's own log2(N / n(entity)) bits. The
chance of the entity where the term stands is smoothed: (n(term, entity) + a p(entity)) / (n(term) + a).
A term that gives away a large share of them is removed, one that gives away less but much is
generalised. All of it runs as DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns, leftmost and longest, but in time linear in the text and
#: without recursion: starts inside a run that was tried are skipped, and repeated groups are runs
#: of characters that end before a doubled or dangling separator.
#: email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card   [0-9]([\x20-]?[0-9])+
#: phone  \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?=[\x20-][\x20-]|[\x20-]?(?![0-9\x20-]))",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}[0-9]", "phone": "\\+[0-9]"}
TERM = r"[\p{L}\p{M}]+"
#: Terms whose corpus counts are looked up through a broadcast; more of them are joined by shuffle.
BROADCAST_TERMS = 500_000
#: Rows of an array that are folded together.
BLOCK = 128
_SPAN = "array<struct<start:int,end:int,value:string>>"


@dataclass(frozen=True)
class Disclosure:
    """Documents by which each term is smoothed, and the shares of the entity's information from
    which a term is generalised and removed."""

    prior: float = 1.0
    generalise: float = 0.5
    remove: float = 0.8


def _folded(rows: Column, start: Column, step, kind: str) -> Column:
    """Results of `step(at, x)`, which gives (the next `at`, an array with x's results), over `rows`
    in order. Arrays are copied as they grow, so rows are taken in blocks of `BLOCK`: only a
    block's results and the list of blocks are, and time stays about in proportion to the rows."""
    empty = F.array().cast(kind)

    def inner(acc: Column, x: Column) -> Column:
        at, new = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], new).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        first = F.struct(F.element_at(acc, -1)["at"].alias("at"), empty.alias("out"))
        return F.concat(acc, F.array(F.aggregate(block, first, inner)))

    def cut(held: Column) -> Column:
        n = F.floor((F.size(held) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: F.slice(held, k * BLOCK + 1, F.lit(BLOCK)))

    # by way of a variable, as a slice of an expression would work it out again for each block
    blocks = F.flatten(F.transform(F.array(rows), cut))
    done = F.aggregate(blocks, F.array(F.struct(start.alias("at"), empty.alias("out"))), outer)
    return F.flatten(F.transform(done, lambda d: d["out"]))


def matches(text: Column, pattern: str) -> Column:
    """Spans of the pattern's matches, from the pieces between them and their own lengths."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + x["gap"]
        b = a + F.coalesce(F.length(x["value"]), F.lit(0))
        return b, F.when(x["value"].isNull(), F.array().cast(_SPAN)).otherwise(F.array(F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value"))))

    return _folded(pieces, F.lit(0), step, _SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["odd"], 1).otherwise(2)
        return F.struct((~acc["odd"]).alias("odd"), (acc["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"))

    # from the last digit on: it counts once, the one before twice, and so on
    return F.aggregate(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), F.struct(F.lit(True).alias("odd"), F.lit(0).alias("sum")), add, lambda acc: acc["sum"] % 10) == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind in a text column without nulls."""
    hint = text.contains(_HINTS[kind]) if kind == "email" else text.rlike(_HINTS[kind])
    return F.when(hint, F.filter(matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(_SPAN))


def _told(spans: Column, kind: Column | str) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(spans, lambda s: F.concat_ws(":", name, s["start"], s["end"]))


def _entities(kind: str) -> Column:
    value = (lambda v: F.lower(v)) if kind == "email" else (lambda v: v) if kind == "ip" else _digits
    return F.transform(kind, lambda s: F.struct(F.concat(F.lit(kind + ":"), value(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end")))


def _pieces(text: Column) -> Column:
    """The text between e-mail addresses: no other kind of entity holds letters."""
    return F.when(text.contains("@"), F.split(text, PATTERNS["email"], -1)).otherwise(F.array(text))


def _tokens(text: Column) -> Column:
    """The text cut at its terms and e-mail addresses: (gap before, length, term or null), in order."""
    mails = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def cut(piece: Column, mail: Column) -> Column:
        terms = F.zip_with(F.split(piece, TERM, -1), F.regexp_extract_all(piece, F.lit(TERM), F.lit(0)), lambda g, t: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(t), F.lit(0)).alias("size"), F.lower(t).alias("term")))
        return F.concat(terms, F.array(F.struct(F.lit(0).alias("gap"), F.coalesce(F.length(mail), F.lit(0)).alias("size"), F.lit(None).cast("string").alias("term"))))

    return F.flatten(F.zip_with(_pieces(text), mails, cut))


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the four kinds' spans, `entities`, and `words`: tokens of texts with entities."""
    # a hash of the text tells rows of one doc_id apart
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = base.select("doc_id", "text", "text_hash", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    entities = found.withColumn("entities", F.array_distinct(F.transform(F.concat(*[_entities(k) for k in KINDS]), lambda e: e["entity"])))
    return entities.select("doc_id", "text_hash", *KINDS, "entities", F.when(F.size("entities") > 0, _tokens(F.col("text"))).alias("words"))


def disclosures(docs: DataFrame, scanned: DataFrame, rules: Disclosure) -> DataFrame:
    """(text_hash, term, share): terms of texts with entities that give away `rules.generalise` or more of one.

    Entities that stand in the same documents have the same shares and are weighed as one kin.
    """
    rows = scanned.where("words is not null")
    texts = rows.groupBy("text_hash").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    texts = written(texts.select("text_hash", "copies", "entities", F.array_distinct(F.filter(F.transform("words", lambda x: x["term"]), lambda t: t.isNotNull())).alias("terms")), "texts")
    each = texts.select("text_hash", "copies", F.explode("entities").alias("entity"))
    kin = each.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.sum(F.xxhash64("text_hash", F.lit(1)).cast("decimal(20,0)")).alias("where_"), F.sum(F.xxhash64("text_hash", F.lit(2)).cast("decimal(20,0)")).alias("where2"))
    kin = each.join(kin, "entity").select("text_hash", "copies", "n_entity", F.xxhash64("n_entity", "where_", "where2").alias("kin")).distinct()
    stands = texts.select("text_hash", F.explode("terms").alias("term"))
    terms = written(stands.select("term").distinct(), "terms")
    words = F.array_distinct(F.flatten(F.transform(_pieces(F.col("text")), lambda p: F.transform(F.regexp_extract_all(p, F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))))
    corpus = docs.where("text is not null").select(F.explode(words).alias("term"))
    corpus = corpus.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term", "left_semi")
    n_term = corpus.groupBy("term").agg(F.count("*").alias("n_term"))
    both = kin.join(stands, "text_hash").groupBy("kin", "n_entity", "term").agg(F.sum("copies").alias("n_both"))
    n = F.lit(float(scanned.count()))
    prior = F.col("n_entity") / n
    told = (F.col("n_both") + rules.prior * prior) / (F.col("n_term") + rules.prior)
    share = F.when(prior < 1, -F.log2(told / prior) / F.log2(prior)).otherwise(F.lit(0.0))
    told = both.join(n_term, "term").select("kin", "term", share.alias("share")).where(F.col("share") >= rules.generalise)
    return kin.select("text_hash", "kin").join(stands, "text_hash").join(told, ["kin", "term"]).groupBy("text_hash", "term").agg(F.max("share").alias("share"))


def _places(scanned: DataFrame) -> DataFrame:
    """(text_hash, term, start, end) of each term of texts with entities."""
    one = scanned.where("words is not null").groupBy("text_hash").agg(F.first("words").alias("words"))
    each = one.select("text_hash", F.posexplode("words").alias("at", "x")).select("text_hash", "at", "x.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("text_hash").orderBy("at")).cast("int")
    return each.withColumn("end", end).where("term is not null").select("text_hash", "term", (F.col("end") - F.col("size")).alias("start"), "end")


def find(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:  # noqa: B008
    """One row per row of `docs` (doc_id, text): doc_id, text_hash, spans of the four kinds and
    `terms`: spans (start, end, action) of terms to remove or generalise; empty arrays for none.

    Null text is an empty one. Rows that repeat count as documents of their own in the corpus
    counts. An empty table gives no rows. Further columns play no part.
    """
    scanned = written(_scanned(docs), "personal")
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    told = disclosures(docs, scanned, rules)
    action = F.when(F.col("share") >= rules.remove, "remove").otherwise("generalise")
    spans = _places(scanned).join(told, ["text_hash", "term"]).select("text_hash", F.struct("start", "end", action.alias("action")).alias("x"))
    spans = spans.groupBy(F.col("text_hash").alias("h")).agg(F.array_sort(F.collect_list("x")).alias("terms"))
    joined = scanned.join(spans, F.col("text_hash") == F.col("h"), "left")
    return joined.select("doc_id", "text_hash", *KINDS, F.coalesce("terms", none).alias("terms"))


def sanitise(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:  # noqa: B008
    """doc_id and text with entities as [EMAIL], [IP], [CARD], [PHONE], terms to generalise as
    [TERM] and terms to remove gone; a row per row. Of overlapping spans the one that begins first
    counts, of those the longest. Null text stays null."""
    found = find(docs, rules).dropDuplicates(["doc_id", "text_hash"]).withColumnRenamed("doc_id", "d")
    keyed = docs.select("doc_id", "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("text_hash")))

    def marked(spans: Column | str, mark: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), F.lit(mark).alias("mark")))

    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("mark")))
    every = F.array_sort(F.concat(*[marked(k, f"[{k.upper()}]") for k in KINDS], terms))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.substring(F.col("text"), at + 1, s["start"] - at)
        taken = s["start"] >= at
        return F.when(taken, -s["neg_end"]).otherwise(at), F.when(taken, F.array(F.struct(gap.alias("gap"), s["mark"].alias("mark"), (-s["neg_end"]).alias("end")))).otherwise(F.array().cast(kind))

    kind = "array<struct<gap:string,mark:string,end:int>>"
    kept = _folded(every, F.lit(0), step, kind)
    rest = F.substring(F.col("text"), F.coalesce(F.array_max(F.transform("kept", lambda k: k["end"])), F.lit(0)) + 1, F.length("text"))
    joined = joined.select("doc_id", "text", kept.alias("kept"))
    text = F.when(F.col("text").isNotNull(), F.concat(F.array_join(F.transform("kept", lambda k: F.concat(k["gap"], k["mark"])), ""), rest))
    return joined.select("doc_id", text.alias("text"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the four kinds in each row of `documents`, the digest of their spans, and all spans
    with those of the terms that betray them; see `find`."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[_told(F.col(k), k) for k in KINDS])
    spans = F.concat(base, _told(F.col("terms"), "term"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"), F.size("terms").cast("long").alias("n_term"))

"""Cross-tokenizer alignment of two vocabularies by way of distinct segments.

Space and text are cut before runs of white space that begin with a space, where neither
vocabulary has a token that could reach across (`cut_pattern` looks through both). Each distinct
segment is tokenised and aligned once, for the whole corpus; so are the counts of linked ids and
what they make each segment score. Documents are then composed of their segments' alignments.

Frequent segments, up to a fixed number of bytes, are broadcast; all others are joined back by
shuffle. So no key of that join is a frequent one, and a document gathers only its own segments.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import batches_of, dropped, new_path, released, shuffles_dropped, table, written
from graphloom.llm.trie_bpe import byte_letters

#: Bytes of frequent segments, their alignments and 64 more each, that are broadcast at most.
HELD_BYTES = 32_000_000
#: Bytes of a segment that may be among them.
HELD_SEGMENT = 1_000
#: Distinct segments that a task counts before it lets their counts go.
_COUNTED = 200_000
#: Parts of a frequent pair's rows.
_SALTS = 8
#: Texts in an Arrow batch.
_TEXTS = 1_000
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Those that are summed; the others follow from the groups: each has one link less than it has tokens.
_SUMS = ("n_a", "n_best", "count_sum")
_ALIGNED = "segment string, n long, n_a long, n_b long, n_groups long, groups string, links array<long>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _byte_level(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cutter = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or cutter.get("type") != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"]:
        raise ValueError(f"{path} does not cut and encode texts byte by byte")
    return spec


def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def cut_pattern(a_path: str, b_path: str) -> str:
    """A pattern of the empty places where texts may be cut: between what is no white space and a space.

    The first tokenizer's own rule always parts words there. In both vocabularies all characters are
    looked for that some token has before a space; after these no cut is made, nor before one space
    that ends a text, as the second tokenizer would get nothing of it.
    """
    letters = byte_letters()
    held = [bytes(letters[c] for c in s if c in letters).decode("utf-8", "replace") for s in _byte_level(a_path)["model"]["vocab"]]
    b = _pieces(b_path)
    if not all(b.is_byte(b.piece_to_id(f"<0x{k:02X}>")) for k in range(256)):
        raise ValueError(f"{b_path} does not fall back to bytes")
    held += [b.id_to_piece(i).replace("▁", " ") for i in range(b.get_piece_size())]
    before = {x for s in held for x in re.findall(r"(\S) ", s)}
    if "�" in before:  # a token that begins or ends within a character
        raise ValueError(f"{a_path} has tokens that reach from a part of a character over a space")
    return rf"(?<=[^\s{''.join(map(re.escape, sorted(before)))}])(?= [\s\S])"


#: What `cut_pattern` gives where no token has a character before a space, and the segments it leaves.
_PLAIN, _SEGMENT = r"(?<=[^\s])(?= [\s\S])", r" \s*\S*(?:[^\S ]\s*\S*)*(?: \Z)?"
#: White space other than the space itself.
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a space and a text at the places of a pattern. With the plain one, a text without white space
    before a space or at its end is cut at every space, which is faster than any pattern."""
    if pattern != _PLAIN:
        return re.compile(pattern).split
    segments = re.compile(_SEGMENT).findall

    def cut(whole: str) -> list[str]:
        if whole[-1] == " " or "\0" in whole or "  " in whole or any([f"{c} " in whole for c in _SPACES if c in whole]):
            return segments(whole)
        return whole.replace(" ", "\0 ").split("\0")[1:]

    return cut


class Aligner:
    """Both tokenizers, in a task."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        from tokenizers import Tokenizer

        letters = byte_letters()
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = _pieces(b_path)
        self.cut, self.ends = re.compile(pattern), {}
        own = {i: bytes(letters[c] for c in s) for s, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in s)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(own.get(i, b"")) for i in range(max(own) + 1)])
        self.b_sizes = np.array([len(b) for b in self.b_bytes])

    def whole(self, text: str | None) -> bool:
        """Whether the second tokenizer keeps a text's bytes, after a space."""
        return bool(text) and self.b.normalize(text).replace("▁", " ") == f" {text}"

    def align(self, segments: list[str]) -> Iterator[tuple[list[int], np.ndarray, list[str], np.ndarray, np.ndarray]]:
        """Of segments that begin with a space, in runs: their places in the list, a row of n_a, n_b and
        n_groups each, texts of their groups, links as first id * 2^32 + second id, and how many each has.

        Segments after which a text may be cut are tokenised one behind the other, as if in one text.
        """
        ends = self.ends
        for last in {s[-1] for s in segments}.difference(ends):
            ends[last] = self.cut.search(f"{last} .") is not None
        run = [k for k, s in enumerate(segments) if ends[s[-1]]]
        alone = set(range(len(segments))).difference(run)
        for places in ([run] if run else []) + [[k] for k in sorted(alone)]:
            yield places, *self._run([segments[k] for k in places])

    def _run(self, segments: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        text = "".join(segments)
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if b"".join([self.b_bytes[i] for i in b]) != text.encode():
            raise ValueError(f"tokens of {len(text)} characters do not spell them")
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        ends = np.cumsum([len(s.encode()) for s in segments])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not np.isin(ends, both).all():
            raise ValueError(f"a token reaches over a cut in {len(text)} characters")
        # tokens that share bytes: a pair for each stretch between neighbouring ends of either
        any_end = np.union1d(a_ends, b_ends)
        links = a_ids[np.searchsorted(a_ends, any_end)] << 32 | b_ids[np.searchsorted(b_ends, any_end)]
        upto = [np.searchsorted(x, ends, "right") for x in (a_ends, b_ends, both, any_end)]
        a_text, b_text = list(map(str, a)), list(map(str, b))
        a_cut, b_cut = ([0, *np.searchsorted(x, both, "right").tolist()] for x in (a_ends, b_ends))
        groups = [f"{a_text[i]}|{b_text[k]}" if j - i == m - k == 1 else f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip(a_cut, a_cut[1:], b_cut, b_cut[1:], strict=False)]
        at = [0, *upto[2].tolist()]
        numbers = np.stack([np.diff(x, prepend=0) for x in upto])
        return numbers[:3].T, [";".join(groups[i:j]) for i, j in zip(at, at[1:], strict=False)], links, numbers[3]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path, pattern)
    return _ALIGNERS[a_path, b_path]


def _numbered(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Rows with a number each (rid), and text null where it has no tokens."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path, pattern)
        for batch in batches:
            rid, doc_id, texts = (batch.column(batch.schema.get_field_index(x)) for x in ("rid", "doc_id", "text"))
            held = pa.array([t if aligner.whole(t) else None for t in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([rid, doc_id, held], names=["rid", "doc_id", "text"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, text string")


def _segments(rows: DataFrame, pattern: str) -> DataFrame:
    """Distinct segments of all texts: segment, n (how often it occurs)."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = cutter(pattern), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["segment", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(cut(" " + text))
                if len(counts) >= _COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return rows.where("text is not null").select("text").mapInArrow(count, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def _aligned(segments: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path, pattern)
        for batch in batches:
            held, n = (batch.column(batch.schema.get_field_index(x)) for x in ("segment", "n"))
            for places, numbers, groups, links, sizes in aligner.align(held.to_pylist()):
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(links))
                columns = [held.take(pa.array(places)), n.take(pa.array(places)), *(pa.array(c) for c in numbers.T), pa.array(groups, pa.string()), listed]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "n", "n_a", "n_b", "n_groups", "groups", "links"])

    return segments.mapInArrow(run, _ALIGNED).withColumn("sid", F.monotonically_increasing_id())


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Linked ids of aligned segments: pair (first id * 2^32 + second id), count (links that hold it), is_best (none of the second id has more)."""
    counts = written(aligned.select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # a row for each id of the second vocabulary at most
    most = counts.groupBy(second.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), second == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def _scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Aligned segments with n_best and count_sum, and held: the frequency class it has, -1 where it is too long to be held."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    links = aligned.select("sid", F.explode("links").alias("pair"), (F.col("sid") % _SALTS).cast("int").alias("salt"))
    sums = links.join(counts.select("*", salts), ["pair", "salt"]).groupBy("sid").agg(F.sum("count").alias("count_sum"), F.sum(F.col("is_best").cast("long")).alias("n_best"))
    whole = aligned.select("sid", "segment", "n", "n_a", "groups")
    rank = F.when(F.octet_length("segment") <= HELD_SEGMENT, F.floor(F.log2("n") * 4)).otherwise(-1).cast("int")
    return whole.join(sums, "sid").select("segment", "n", *_SUMS, "groups", rank.alias("held"))


def _least_held(scored: DataFrame, room: int) -> int:
    """The least frequency class that is broadcast: all from there on have room."""
    size = F.octet_length("segment") + F.octet_length("groups") + 64
    # classes of frequency are quarters of powers of two: some 250 rows
    classes = scored.where("held >= 0").groupBy("held").agg(F.sum(size).alias("size")).collect()
    least = 1 << 30
    for row in sorted(classes, reverse=True):
        room -= row["size"]
        if room < 0:
            break
        least = row["held"]
    return least


def align(docs: DataFrame, a_path: str, b_path: str, held_bytes: int = HELD_BYTES) -> DataFrame:
    """How two tokenizers cut the texts of `docs` (doc_id, text; further columns are left out), a row
    for each row: doc_id, n_a, n_b (tokens), n_groups (stretches between places where tokens of both
    end), n_links (pairs of tokens that share bytes), n_best (links whose pair of ids is linked as often
    as any with the second id, over all rows), count_sum (of all links, how often their ids are linked
    over all rows), and groups as `a1,a2|b1;a3|b2,b3`, ids in order.

    `a_path` is a byte-level file of the tokenizers library, which gets a space and the text; special
    tokens in it are plain text. `b_path` is a sentencepiece model with bytes to fall back to, which adds
    the space itself. Texts that are null or empty, or whose bytes the second one does not keep, have no
    tokens: zeros and empty groups, and their links count nowhere. Repeated rows count each. An empty
    table gives no rows. A text without spaces is one segment. `held_bytes` bounds what is broadcast;
    the result is the same whatever it is.
    """
    spark = docs.sparkSession
    pattern = cut_pattern(a_path, b_path)
    with batches_of(spark, _TEXTS), shuffles_dropped(spark):
        rows = _by_row(_numbered(docs, a_path, b_path, pattern))
        segments = written(_segments(rows, pattern), "segments")
        aligned = written(_aligned(segments, a_path, b_path, pattern), "aligned")
        scored = written(_scored(aligned, pair_counts(aligned)), "scored")
        for used in (segments, aligned):
            dropped(used)
        least = _least_held(scored, held_bytes)
        held = scored.where(F.col("held") >= least).select("segment", "groups", *_SUMS).toArrow()
        kept = spark.sparkContext.broadcast((held.column("segment").to_pylist(), held.column("groups").to_pylist(), np.array([held.column(x).to_numpy() for x in _SUMS], np.int64).T.reshape(-1, len(_SUMS))))
        wanted = rows.where("text is not null").select("rid", "text").mapInArrow(_unheld(kept, pattern), "rid long, k int, segment string")
        # numbers and groups as one text: short, as they are shuffled once more
        packed = scored.where(F.col("held") < least).select("segment", F.concat_ws(":", *_SUMS, "groups").alias("pack"))
        rare = written(wanted.join(packed, "segment").select("rid", "k", "pack"), "rare")
        dropped(scored)
    # dealt as the rows are kept, so neither is dealt again to be grouped or joined
    lists = rare.repartition(_parts(spark), "rid").groupBy("rid").agg(F.collect_list(F.struct("k", "pack")).alias("rare"))
    return rows.join(lists, "rid", "left").select("doc_id", "text", "rare").mapInArrow(_composed(kept, pattern), _OUT)


def _parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _by_row(rows: DataFrame) -> DataFrame:
    """`rows` as a table in buckets of rid, so that what is known of a row comes to it where it lies."""
    spark, n = rows.sparkSession, _parts(rows.sparkSession)
    name = f"graphloom_rows_{uuid.uuid4().hex}"
    kept = rows.repartition(n, "rid").write.bucketBy(n, "rid").sortBy("rid").option("path", new_path(spark, "rows"))
    kept.option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def _unheld(kept, pattern: str):
    """Segments of each row that are not broadcast, once each, numbered in their order (k)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = cutter(pattern), frozenset(kept.value[0])
        for batch in batches:
            rids, ks, found = [], [], []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(set(cut(" " + text)) - held)
                rids += [rid] * len(own)
                ks += range(len(own))
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ks, pa.int32()), pa.array(found, pa.string())], names=["rid", "k", "segment"])

    return run


def _composed(kept, pattern: str):
    """Documents of their segments' alignments: those that are held, and those that came with the row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(pattern)
        names, texts, numbers = kept.value
        find, texts = {s: k for k, s in enumerate(names)}.get, [*texts, ""]
        for batch in batches:
            ids, docs, rare = (batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "text", "rare"))
            totals, groups = np.zeros((batch.num_rows, len(NUMBERS)), np.int64), []
            for row, (text, own) in enumerate(zip(docs.to_pylist(), rare, strict=True)):
                if text is None:
                    groups.append("")
                    continue
                segments, cells = cut(" " + text), own.values
                at = [find(s, -1) for s in segments]
                parts = [texts[i] for i in at]
                where = np.array(at)
                sums = numbers[where[where >= 0]].sum(0)
                if cells is not None:
                    others = [k for k, i in enumerate(at) if i < 0]
                    packs = dict(zip(cells.field("k").to_pylist(), cells.field("pack").to_pylist(), strict=True))
                    of = {s: packs[k].split(":", len(_SUMS)) for k, s in enumerate(sorted({segments[k] for k in others}))}
                    counts = Counter()
                    for k in others:
                        parts[k] = of[segments[k]][-1]
                        counts[segments[k]] += 1
                    for s, n in counts.items():
                        sums += [n * int(x) for x in of[s][:-1]]
                whole = ";".join(parts)
                n_groups = whole.count(";") + 1
                n_links = n_groups + whole.count(",")
                totals[row] = sums[0], n_links + n_groups - sums[0], n_groups, n_links, sums[1], sums[2]
                groups.append(whole)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in totals.T), pa.array(groups, pa.string())], names=["doc_id", *NUMBERS, "groups"])

    return run


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """byte_bpe_50k and piece_bpe_32k aligned over all `documents`; groups by their hash."""
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", *NUMBERS, F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256"))

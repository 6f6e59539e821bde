"""BPE encoding by traversal of a trie of words, and decoding by table lookup.

The BPE encoding of a word is the only way to cut it into tokens of which each two neighbours,
encoded together, stay these two tokens. So the last token of each prefix is the one token that
ends there and fits the last token of the prefix before it, and the encoding of a word can be
read backward from these. Distinct words go into a trie; one depth-first walk works the last
token out at each place of it, once for all words that share the prefix.

A task keeps a memo of the words it has met (`bpe.Encoder`), so tries hold what is new to it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import Encoder
from graphloom.llm.common import released, table

#: Bytes of texts that are encoded together, beyond the last of them.
_SLICE = 4_000_000
#: Code points that the memo's words hold at most, beyond those of one group of texts.
_HELD = 1 << 23
#: Pairs of tokens of which a task remembers whether they fit.
_PAIRS = 1 << 19


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones themselves, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(slots=True)
class Node:
    """Bytes that lead here from the node above, what follows by first byte, and the word that ends here."""

    label: bytes
    below: dict[int, Node] = field(default_factory=dict)
    word: int = -1


def trie(words: list[bytes]) -> Node:
    """A trie of distinct words, in which stretches without branches are one node."""
    root = Node(b"")
    for k, word in enumerate(words):
        node, at = root, 0
        while at < len(word):
            child = node.below.get(word[at])
            if child is None:
                child = node.below[word[at]] = Node(word[at:])
                at = len(word)
            else:
                label = child.label
                if word.startswith(label, at):
                    at += len(label)
                else:
                    same = next(i for i in range(min(len(label), len(word) - at) + 1) if i == len(word) - at or label[i] != word[at + i])
                    upper = Node(label[:same], {label[same]: child})
                    child.label = label[same:]
                    node.below[word[at]] = child = upper
                    at += same
            node = child
        node.word = k
    return root


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: `encode(words)` of words, `decode(ids)` of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cutter = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or cutter.get("type") != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters, vocab = byte_letters(), model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take more than their literal")
        self.of = {bytes(letters[c] for c in s): i for s, i in vocab.items() if s not in self.added and all(c in letters for c in s)}
        self.bytes_of = {i: b for b, i in self.of.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        #: bytes of the longest token that ends in each byte
        self.longest = [0] * 256
        for b in self.of:
            self.longest[b[-1]] = max(self.longest[b[-1]], len(b))
        self.sizes = {i: len(b) for i, b in self.bytes_of.items()}
        self.fitting: dict[int, bool] = {}
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word by the definition: the first of the best-ranked neighbours merge until none do."""
        ids, merge = [self.of[word[i : i + 1]] for i in range(len(word))], self.merges.get
        while True:
            best = None
            for i in range(len(ids) - 1):
                found = merge((ids[i], ids[i + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]

    def fits(self, before: int, token: int) -> bool:
        """Whether `token` stays as it is after `before` (-1: at the beginning)."""
        pair = before << 32 | token
        known = self.fitting.get(pair)
        if known is None:
            if len(self.fitting) >= _PAIRS:
                self.fitting.clear()
            want = [token] if before < 0 else [before, token]
            known = self.fitting[pair] = self.merged(b"".join(self.bytes_of[i] for i in want)) == want
        return known

    def _extend(self, path: bytes, last: list[int]) -> None:
        """Last tokens of the prefixes of `path` beyond those that `last` holds, each from those of shorter ones."""
        token_of, longest, fitting = self.of.get, self.longest, self.fitting.get
        for end in range(len(last) + 1, len(path) + 1):
            most = longest[path[end - 1]]
            for at in range(end - most if most < end else 0, end):
                token = token_of(path[at:end])
                if token is not None:
                    before = last[at - 1] if at else -1
                    known = fitting(before << 32 | token)
                    if known or known is None and self.fits(before, token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"the vocabulary does not cover {path[:end]!r}")

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words."""
        out: list[list[int]] = [[]] * len(words)
        last: list[int] = []
        sizes = self.sizes
        todo = [(trie(words), b"")]
        while todo:
            node, before = todo.pop()
            path = before + node.label
            del last[len(before) :]
            self._extend(path, last)
            if node.word >= 0:
                ids, at = [], len(path)
                while at:
                    token = last[at - 1]
                    ids.append(token)
                    at -= sizes[token]
                ids.reverse()
                out[node.word] = ids
            todo += [(child, path) for child in node.below.values()]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, those of added tokens included; ids beyond the vocabulary stand for nothing."""
        if self._table is None:
            known = {**self.bytes_of, **{i: s.encode() for s, i in self.added.items()}}
            lengths = np.zeros(max(known) + 2, np.int64)
            for i, b in known.items():
                lengths[i] = len(b)
            self._table = lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(known[i] for i in sorted(known)), np.uint8)
        lengths, offset, letters = self._table
        ids = np.minimum(ids, len(lengths) - 1).astype(np.int64)
        each = lengths[ids]
        upto = np.cumsum(each)
        return letters[np.repeat(offset[ids] - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)].tobytes()


class TrieEncoder(Encoder):
    """The encoder with its memo and its cutting of plain texts, in which words are encoded by trie."""

    def __init__(self, path: str, slots_log2: int = 20, fill: float = 0.75):
        super().__init__(path, slots_log2, fill)
        self.vocabulary = Vocabulary(path)
        self._odd = OddTexts(self.vocabulary, self._library)

    def _full(self, entries: int, points: int) -> bool:
        # more than the encoder itself holds: a word that was forgotten is walked again
        return self.n > 0 and (self.n + entries > self.fill * (1 << self.slots_log2) or self.n_held + points > _HELD)

    def _library(self, texts: list[str]) -> list[list[int]]:
        place: dict[bytes, int] = {}
        at = [place.setdefault(t.encode(), len(place)) for t in texts]
        ids = self.vocabulary.encode(list(place))
        return [ids[k] for k in at]

    @property
    def library(self) -> OddTexts:
        return self._odd


class OddTexts:
    """Texts that numpy can't cut: the library's own rule cuts them into words, between the literals of added tokens."""

    def __init__(self, vocabulary: Vocabulary, encode):
        from tokenizers import pre_tokenizers

        self.added, self.words = vocabulary.added, encode
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.literals = re.compile("|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) or "(?!)")

    def encode(self, text: str, add_special_tokens: bool = False) -> SimpleNamespace:
        ids, at = [], 0
        for found in self.literals.finditer(text):
            ids += [*self._plain(text[at : found.start()]), self.added[found.group()]]
            at = found.end()
        return SimpleNamespace(ids=ids + self._plain(text[at:]))

    def _plain(self, text: str) -> list[int]:
        words = [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)] if text else []
        return [i for ids in self.words(words) for i in ids]


_ENCODERS: dict[str, TrieEncoder] = {}
_VOCABULARIES: dict[str, Vocabulary] = {}


def _slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches in slices, so that long values of column `name` don't add up."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        at = 0
        while at < batch.num_rows:
            size, to = 0, at
            while to < batch.num_rows and (size < _SLICE or to == at):
                size += len(column[to].as_buffer()) if column[to].is_valid else 0
                to += 1
            yield batch.slice(at, to - at), column.slice(at, to - at)
            at = to


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token ids of `docs` (doc_id, text; further columns are left out), a row for each row: doc_id,
    n_tokens and ids (little-endian uint32).

    Ids are those of the library without its special tokens; a literal of an added token in a text is
    that token. Null and empty texts have no ids. Null and repeated doc_ids stay. An empty table gives
    no rows. Nothing is shuffled; a task holds one memo, one trie of new words and one slice of texts.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = TrieEncoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        for batch, texts in _slices(batches, "text"):
            ids, counts = encoder.encode(texts.to_pylist())
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
            cells = [bytes(raw[4 * (b - n) : 4 * b]) for n, b in zip(counts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(counts), pa.array(cells, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Texts of `encoded` (doc_id, n_tokens, ids as `encode` has them): doc_id, n_tokens, ids, text.

    Added tokens are spelled out; ids that the vocabulary lacks are passed over, and bytes that are no
    UTF-8 become U+FFFD. Null ids give an empty text.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _VOCABULARIES:
            _VOCABULARIES[tokenizer] = Vocabulary(tokenizer)
        vocabulary = _VOCABULARIES[tokenizer]
        for batch, cells in _slices(batches, "ids"):
            texts = [vocabulary.decode(np.frombuffer(c.as_buffer(), "<u4")).decode("utf-8", "replace") if c.is_valid else "" for c in cells]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "n_tokens", "ids")), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` encoded with byte_bpe_50k and decoded again: ids and texts by their hashes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    back = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

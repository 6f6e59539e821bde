"""Encoding by trie against the library itself, and decoding against its decoder."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.trie_bpe import TrieEncoder, Vocabulary, decode, encode, op12_bpe_round_trip, trie

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = TrieEncoder(PATH)
PIECES = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "²", ".", "!", "\x85", "　", "Ж", "中", "😀", "<|endoftext|>", "́", "\r", " '", "_", "\x1c", "ß", "\xa0", "ing", "tion", "----"]
TEXTS = ["", None, "one two", "don't  stop\n\n now", "x" * 5000, "word " * 70_000, "<|endoftext|> in a <|endoftext|><|endo", "中文 😀", "one two", "\x00\x85", " ", "�"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def sha(x):
    return hashlib.sha256(x).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=4))
def test_encoder_is_the_library(texts):
    got, counts = ENCODER.encode(texts)
    want = [ids(t) for t in texts]
    assert got.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    assert [ENCODER.vocabulary.decode(np.array(w, np.uint32)).decode() for w in want] == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]


def test_words_of_letters_and_of_tokens():
    r = random.Random(3)
    tokens = list(ENCODER.vocabulary.of)
    words = {"".join(r.choice("aeinrstxö") for _ in range(r.randrange(1, 14))) for _ in range(4000)}
    for _ in range(20_000):
        word = b"".join(r.choice(tokens) for _ in range(r.randrange(1, 4))).decode("utf-8", "ignore")
        words |= {word} if word else set()
    whole = [w.encode() for w in words if LIBRARY.pre_tokenizer.pre_tokenize_str(w)[0][1] == (0, len(w))]
    got = ENCODER.vocabulary.encode(whole)
    assert len(whole) > 8000 and got == [ids(w.decode()) for w in whole]


def test_trie_shares_prefixes():
    words = [b"car", b"cart", b"care", b"dog", b"ca", b"c", b""]
    nodes, todo = [], [(trie(words), b"")]
    while todo:
        node, before = todo.pop()
        nodes.append((before + node.label, node.word))
        todo += [(child, before + node.label) for child in node.below.values()]
    assert {p: w for p, w in nodes} == {w: k for k, w in enumerate(words)} and len(nodes) == len(words)
    asked = []

    class Counted(Vocabulary):
        def _extend(self, path, last):
            asked.extend(path[:end] for end in range(len(last) + 1, len(path) + 1))
            super()._extend(path, last)

    vocabulary = Counted(PATH)
    assert vocabulary.encode(words[:4]) == [ids(w.decode()) for w in words[:4]]
    assert sorted(asked) == [b"c", b"ca", b"car", b"care", b"cart", b"d", b"do", b"dog"]


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr("graphloom.llm.trie_bpe._PAIRS", 50)
    small = TrieEncoder(PATH, slots_log2=6)
    r = random.Random(2)
    for _ in range(20):
        t = " ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(60))
        assert small.encode([t])[0].tolist() == ids(t) and len(small.vocabulary.fitting) <= 50


def test_round_trip_of_rows(spark):
    rows = [(k if k != 4 else None, t, 5, "x") for k, t in enumerate(TEXTS)] + [(0, "again", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = decode(encode(docs, PATH), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    want = [(d, len(ids(t)), np.array(ids(t), "<u4").tobytes(), LIBRARY.decode(ids(t), skip_special_tokens=False)) for d, t, *_ in rows]
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in got), key=key) == sorted(want, key=key)
    assert encode(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(1, 2, bytearray(np.array([99999, 50256, 94], "<u4").tobytes())), (2, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert {r.doc_id: r.text for r in decode(odd, PATH).collect()} == {1: "<|endoftext|>�", 2: ""}


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = set()
    for r in docs:
        i = ids(r.text)
        want.add((r.doc_id, len(i), sha(np.array(i, "<u4").tobytes()), sha(LIBRARY.decode(i, skip_special_tokens=False).encode())))
    got = op12_bpe_round_trip(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and {tuple(r) for r in got.collect()} == want


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))

"""Token files and separator scan against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.bpe import Encoder
from graphloom.llm.token_counts import count_tokens
from graphloom.llm.token_output import binary_output, pack, unpack

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)
PIECES = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "é", "1", "²", ".", "!", "\x85", "　", "Ж", "中", "😀", "<|endoftext|>", "́", "\r", " '", "_", "\x1c", "ß"]
TEXTS = ["", None, "one two", "don't  stop\n\n now", "x" * 5000, "word " * 70_000, "<|endoftext|> in a text", "中文 😀", "one two", "\x00\x85"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=4))
def test_encoder_is_the_library(texts):
    got, counts = ENCODER.encode(texts)
    want = [ids(t) for t in texts]
    assert got.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_encoder_forgets_and_goes_on():
    small = Encoder(PATH, slots_log2=6)
    r = random.Random(2)
    for _ in range(20):
        t = " ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(60))
        assert small.encode([t])[0].tolist() == ids(t)


def test_words_whose_hashes_meet():
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2^64, whatever the base."""
    for bits in (10, 11, 12):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
        other = word.translate(str.maketrans("ab", "ba"))
        for texts in ([word, other], [other, word], [f"{word} {other} {word}", other], [word + " x", other + " x y " + word]):
            enc = Encoder(PATH)
            for _ in range(2):
                got, counts = enc.encode(texts)
                assert got.tolist() == [i for t in texts for i in ids(t)] and counts.tolist() == [len(ids(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300))
def test_packing_round_trip(values):
    ranks, control, data = pack(np.array(values, np.uint32))
    assert unpack(len(values), ranks, control, data).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_token_files(spark):
    rows = [(7 * k % 31 if k != 4 else None, t, "extra") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    got = binary_output(docs, PATH, end_id=2, block_ids=500).collect()
    want, at = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        i = [*ids(text), 2]
        want.append((doc_id, at, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        at += len(i)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert binary_output(docs.limit(0), PATH, end_id=2).count() == 0


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_separator_scan(spark, block):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, shard string").repartition(3)
    got = count_tokens(docs, PATH, end_id=50257, block_ids=block).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(ids(t)) + 1 for k, t in enumerate(TEXTS)}
    assert all(r.ended for r in got)
    for shard in {r.shard for r in got}:
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.ordinal)
        assert [r.ordinal for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == [sum(x.n_tokens for x in mine[:i]) for i in range(len(mine))]
    assert count_tokens(docs.limit(0), PATH, end_id=50257).count() == 0

"""Alignment against both libraries over whole texts, whatever is broadcast."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.alignment import NUMBERS, Aligner, align, cut_pattern, cutter, op13_token_alignment
from graphloom.llm.trie_bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST = Tokenizer.from_file(A)
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=B)
PATTERN = cut_pattern(A, B)
ALIGNER = Aligner(A, B, PATTERN)
PIECES = ["'", "s", "re", " ", "  ", "\n", "\t", "a", "é", "1", ".", "\x85", "　", "Ж", "中", "😀", "<|endoftext|>", "<s>", "<0x41>", "́", "\r", "\x1c", "\xa0", "ing", "▁", "\x00", "�"]


def spans(text):
    """(id, begin, end) of both, by bytes of a space and the text; None without tokens."""
    letters, whole = byte_letters(), f" {text}".encode()
    a = [(i, bytes(letters[c] for c in FIRST.id_to_token(i))) for i in FIRST.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, bytes([int(SECOND.id_to_piece(i)[3:5], 16)]) if SECOND.is_byte(i) else SECOND.id_to_piece(i).replace("▁", " ").encode()) for i in SECOND.encode(text)]
    if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    out = []
    for tokens in (a, b):
        at, one = 0, []
        for i, x in tokens:
            one.append((i, at, at + len(x)))
            at += len(x)
        out.append(one)
    return out


def expected(rows):
    both = [spans(t or "") for _, t in rows]
    links = [[(x[0], y[0]) for x in s[0] for y in s[1] if x[1] < y[2] and y[1] < x[2]] if s else [] for s in both]
    count = Counter(p for one in links for p in one)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), s, one in zip(rows, both, links, strict=True):
        if s is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for *_, e in s[0]} & {e for *_, e in s[1]})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, x, y in side if begin <= x and y <= end) for side in s))
            begin = end
        out.append((doc_id, len(s[0]), len(s[1]), len(ends), len(one), sum(count[p] == most[p[1]] for p in one), sum(count[p] for p in one), ";".join(groups)))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_segments_are_tokenised_as_in_the_text(text):
    whole = spans(text)
    assert ALIGNER.whole(text) == (whole is not None)
    if whole:
        segments = re.split(PATTERN, f" {text}")
        assert cutter(PATTERN)(f" {text}") == segments
        assert "".join(segments) == f" {text}" and all(s[0] == " " for s in segments)
        numbers, groups = {}, {}
        for places, counts, texts, links, sizes in ALIGNER.align(segments):
            numbers |= dict(zip(places, counts.tolist(), strict=True))
            groups |= dict(zip(places, texts, strict=True))
            assert len(links) == sizes.sum() and len(sizes) == len(places)
        assert [sum(x[k] for x in numbers.values()) for k in (0, 1)] == [len(side) for side in whole]
        assert ";".join(groups[k] for k in range(len(segments))) == expected([(1, text)])[0][-1]


def key(row):
    return row[0] is None, row[0] or 0, row[-1]


@pytest.mark.parametrize("held", [0, 2_000, 16_000_000])
def test_rows(spark, held):
    texts = [None, "", " ", "one two", "one  two\n\n three ", "a▁b", "x" * 3000, "the the the cat", "<|endoftext|> and <s>", "中文 中文", "one two", "né \x00", "\n a\r\nb c"]
    rows = [(k if k != 3 else None, t) for k, t in enumerate(texts)] + [(4, "again one"), (4, "one two")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_a int, segment string").repartition(3)
    got = align(docs, A, B, held_bytes=held)
    assert got.columns == ["doc_id", *NUMBERS, "groups"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows), key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align(docs, A, B).count() == 0 and align(spark.createDataFrame([(1, None)], docs.schema), A, B).collect()[0].n_a == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(*r[:-1], r[-1] and hashlib.sha256(r[-1].encode()).hexdigest()) for r in _quick(docs)]
    got = op13_token_alignment(spark, SF)
    assert got.columns == ["doc_id", *NUMBERS, "groups_sha256"] and sorted(map(tuple, got.collect())) == sorted(want)


def _quick(docs):
    """`expected` for long texts: links by two pointers over whole texts instead of all pairs."""
    both, links = [spans(r.text or "") for r in docs], []
    for s in both:
        one, j = [], 0
        for i, begin, end in s[0] if s else []:
            while s[1][j][2] <= begin:
                j += 1
            k = j
            while k < len(s[1]) and s[1][k][1] < end:
                one.append((i, s[1][k][0]))
                k += 1
        links.append(one)
    count, most = Counter(p for one in links for p in one), Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for r, s, one in zip(docs, both, links, strict=True):
        if s is None:
            yield (r.doc_id, 0, 0, 0, 0, 0, 0, "")
            continue
        cuts, text, at = sorted({e for *_, e in s[0]} & {e for *_, e in s[1]}), [], [0, 0]
        for end in cuts:
            sides = []
            for k in (0, 1):
                ids = []
                while at[k] < len(s[k]) and s[k][at[k]][2] <= end:
                    ids.append(str(s[k][at[k]][0]))
                    at[k] += 1
                sides.append(",".join(ids))
            text.append("|".join(sides))
        yield (r.doc_id, len(s[0]), len(s[1]), len(cuts), len(one), sum(count[p] == most[p[1]] for p in one), sum(count[p] for p in one), ";".join(text))


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte by byte"):
        cut_pattern(public_tokenizers.path("word_bpe_49k.json"), B)

"""Excerpts of benchmark items are found wherever they start."""

import random

from graphloom.llm.decontaminate import Rules, index, normalise, search, windows

R = random.Random(5)


def sentence(n):
    return " ".join("".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 9))) for _ in range(n))


def test_excerpts_are_found():
    rules = Rules()
    for n in (45, 14):  # items of two long windows or more, and of less than one
        item = sentence(n)
        idx = index(windows(7, normalise(item)[0], rules), rules)
        for length in (50, 60, 75):
            for start in range(0, len(item) - length, 3):
                text = f"{sentence(30)} {item[start : start + length].strip()} {sentence(30)}"
                if len(item[start : start + length].strip()) >= 49:
                    assert {hit[0] for hit in search(text, idx)} == {7}, (n, start, length)
        assert not search(sentence(400), idx)

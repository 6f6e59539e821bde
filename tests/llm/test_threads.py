"""Quotation linking on generated mail threads, against a walk over each conversation."""

import random
import re

import pytest

from graphloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def parts(text):
    """[(level, body)] of a message's lines."""
    out = []
    for line in re.split(r"\r\n|\r|\n", text or ""):
        m = re.match(r"[ \t]*(?:>[ \t]?)+", line)
        out.append((m[0].count(">") if m else 0, line[m.end() :] if m else line))
    return out


def normal(x):
    return " ".join(x.lower().split())


def said(text):
    lines = parts(text)
    if not any(k for k, _ in lines):
        return text or ""
    kept = [b for i, (k, b) in enumerate(lines) if k == 0 and not (i + 1 < len(lines) and lines[i + 1][0] and re.match(r"(?i)[ \t]*on\b.*\bwrote.{0,3}$", b))]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def asked(text):
    """{level: passages}"""
    runs, out = [], {}
    for level, body in parts(text):
        if runs and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    for level, lines in runs:
        if level:
            mine = out.setdefault(level, set())
            mine |= {normal(x) for x in lines}
            mine |= {normal(x) for x in [*re.split(r"(?:\n[ \t]*){2,}", "\n".join(lines)), "\n".join(lines)]}
    for level in out:
        out[level].add(normal(" ".join(b for k, b in parts(text) if k == level)))
    return {k: v - {""} for k, v in out.items()}


def walk(messages):
    """{turn: (parent, root, depth)} of one conversation [(turn, text)]."""
    wrote, place = [], {}
    for turn, text in sorted(messages, key=lambda m: m[0]):
        own = said(text)
        units = {normal(x) for x in [*own.split("\n"), *re.split(r"(?:\n[ \t]*){2,}", own), own]} - {""}
        parent = None
        for _, passages in sorted(asked(text).items()):
            votes = {}
            for x in passages:
                writer = max((t for t, u in wrote if t < turn and x in u), default=None)
                if writer is not None:
                    long, n = votes.get(writer, (0, 0))
                    votes[writer] = long + (len(x) >= quotes.LONG), n + 1
            if votes:
                parent = max(votes, key=lambda t: (*votes[t], t))
                break
        wrote.append((turn, units))
        root, depth = (turn, 0) if parent is None else (place[parent][1], place[parent][2] + 1)
        place[turn] = parent, root, depth
    return place


def mail(r, n):
    """Messages that quote earlier ones: whole, by paragraph, wrapped anew, nested, or not at all."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    bodies, out = [], []
    for turn in range(n):
        own = "\n\n".join("\n".join(" ".join(word() for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4)))
        text, kind = own, r.randrange(7)
        if bodies and kind:
            source = r.choice(bodies)
            block = source.split("\n\n")[0] if kind in (2, 5) else source
            if kind == 3:
                block = block.replace("\n", " ")
            if kind == 6:
                block = "nobody wrote " + word() + word()
            quoted = "\n".join("> " + x for x in block.split("\n"))
            if kind in (4, 6):  # a deeper level, too
                quoted += "\n" + "\n".join(">> " + x for x in r.choice(bodies).split("\n"))
            if kind == 5:  # a second passage, answered apart
                quoted += "\nyes\n" + "\n".join("> " + x for x in source.split("\n\n")[-1].split("\n"))
            text = f"On Monday, Ann wrote:\n{quoted}\n\n{own}"
        bodies.append(own)
        out.append((3 * turn, text))
    return out


@pytest.mark.parametrize("span", [4096, 5])
def test_mail_threads(spark, monkeypatch, span):
    monkeypatch.setattr(quotes, "SPAN", span)
    r = random.Random(12)
    convs = {c: mail(r, r.randrange(1, 25)) for c in range(25)}
    rows = [(c, t, "user", x) for c, messages in convs.items() for t, x in messages]
    got = quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {(c, t): v for c, messages in convs.items() for t, v in walk(messages).items()}
    assert {(x.conv_id, x.turn): (x.parent, x.root, x.depth) for x in got} == want
    assert {(x.conv_id, x.turn): x.text for x in got} == {(c, t): said(x) for c, messages in convs.items() for t, x in messages}
    assert sum(v[0] is not None for v in want.values()) > 100


def test_many_quotes_of_one_line_and_long_chains(spark):
    line = "This one line is quoted by all"
    rows = [(1, 0, "user", line)] + [(1, t, "user", f"> {line}\nanswer number {t} of many") for t in range(1, 4000)]
    rows += [(2, 0, "user", "chain link number 0")] + [(2, t, "user", f"> chain link number {t - 1}\nchain link number {t}") for t in range(1, 600)]
    got = {(x.conv_id, x.turn): (x.parent, x.root, x.depth) for x in quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[1, t] == (0, 0, 1) for t in range(1, 4000)) and all(got[2, t] == (t - 1, 0, t) for t in range(1, 600))


def test_conversations(spark, monkeypatch):
    rows = [(1, 0, "user", "What is the time now?"), (1, 1, "assistant", "> What is the time now?\nNoon."), (1, 2, "user", "Something else entirely"), (1, 3, None, "> What is the time now?\nLate."), (1, 4, "user", "> Something else entirely\n"), (1, 4, "user", "> Something else entirely\n"), (None, 1, "user", "> x"), (2, None, "user", "y")]
    ordered = quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA))
    lists = {(x.conv_id, x.root): [(m.role, m.content) for m in x.messages] for x in quotes.conversations(ordered).collect()}
    assert lists == {(1, 0): [("user", "What is the time now?"), ("assistant", "Noon."), ("user", "Late.")], (1, 2): [("user", "Something else entirely")], (2, None): [("user", "y")]}
    monkeypatch.setattr(quotes, "SPAN", 2)
    assert sorted(x.part for x in quotes.conversations(ordered).where("root = 0").collect()) == [0, 1]


def test_short_lines_are_looked_for(spark):
    """Short lines link where nothing longer does, and do not outweigh a longer one."""
    turns = [(0, "At noon?"), (1, "In Rome?"), (2, "> At noon?\n> In Rome?\nYes."), (3, "A long line about the harbour.\nThanks"), (4, "Other news.\nThanks"), (5, "> A long line about the harbour.\n> Thanks\nSure.")]
    rows = spark.createDataFrame([(1, k, "user", t) for k, t in turns], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.parent for r in quotes.reply_ordered(rows).collect()}
    assert got == {0: None, 1: None, 2: 1, 3: None, 4: None, 5: 3}

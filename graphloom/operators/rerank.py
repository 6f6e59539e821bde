"""Steps that are sequential by nature, over the few rows that search returns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import STEM_STEPS

SNIPPET_TOKENS = 64
PREVIEW_WORDS = 256
_CAMEL = regex.compile(r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
_ENDS = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}]+$")


def stem_word(w: str) -> str:
    """The same stem as `functions.text.stem`, for code that runs in Python."""
    if len(w) < 4 or not w.isascii():
        return w
    for step in STEM_STEPS:
        for suffix, new, least, single, forbidden in step:
            left = w[: -len(suffix)]
            if w.endswith(suffix) and len(left) >= least and not w.endswith(forbidden):
                w = left + new
                if single and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiou":
                    w = w[:-1]
                break
    return w


def words(text: str) -> list[str]:
    """The same tokens as `functions.text.tokens`."""
    bare = (_ENDS.sub("", w) for w in _CAMEL.sub(" ", text.replace("_", " ")).split())
    return [stem_word(w.lower()) for w in bare if w]


def path_of(node_id: str) -> str:
    """What stands before the last `::`, else before the last `:`."""
    head, mark, _ = node_id.rpartition("::" if "::" in node_id else ":")
    return head if mark else node_id


def path_similarity(a: str, b: str) -> float:
    """1 for one path, 0.5 for one directory that has a name, else 0."""
    if a == b:
        return 1.0
    left, right = (p.rpartition("/")[0] for p in (a, b))
    return 0.5 if left and left == right else 0.0


def diversify(hits: Sequence[tuple[str, float]], weight: float) -> list[tuple[str, float]]:
    """Maximal marginal relevance by path: scores divided by the largest, then greedily the best of
    weight * score - (1 - weight) * likeness to what was chosen, the earliest of equals.

    A weight outside [0, 1), or fewer than two hits, changes nothing.
    """
    if not 0 <= weight < 1 or len(hits) < 2:
        return list(hits)
    top = max(max(s for _, s in hits), 1e-9)
    left = [(i, s / top, path_of(i)) for i, s in hits]
    chosen: list[tuple[str, float, str]] = []
    while left:
        gain = [weight * s - (1 - weight) * max((path_similarity(p, c[2]) for c in chosen), default=0.0) for _, s, p in left]
        chosen.append(left.pop(gain.index(max(gain))))
    return [(i, s) for i, s, _ in chosen]


def segments(text: str) -> list[str]:
    """Sentences within paragraphs, if there are paragraphs; else lines that aren't blank."""
    if "\n\n" not in text:
        return [s for s in (line.strip() for line in text.split("\n")) if s]
    found = (s.strip() for paragraph in text.split("\n\n") for s in re.findall(r"[^.!?]*[.!?]|[^.!?]+", paragraph))
    return [s for s in found if s]


def shortened(text: str, most: int = PREVIEW_WORDS) -> str:
    parts = text.split()
    return text if len(parts) <= most else " ".join(parts[:most]) + "..."


def snippet(text: str, query: str, budget: int = SNIPPET_TOKENS) -> str:
    """The segment with most query tokens, grown right and left by turns while added tokens fit."""
    if not text:
        return ""
    wanted, parts = set(words(query)), segments(text)
    if not wanted or not parts:
        return shortened(text)
    counts = [words(p) for p in parts]
    overlap = [len(wanted & set(c)) for c in counts]
    low = high = overlap.index(max(overlap))
    used, grown = 0, True
    while grown and used < budget:
        grown = False
        for step in (1, -1):
            at = high + 1 if step > 0 else low - 1
            if 0 <= at < len(parts) and used + len(counts[at]) <= budget:
                used, grown = used + len(counts[at]), True
                low, high = min(low, at), max(high, at)
    return " ".join(parts[low : high + 1]) or shortened(text)


def chunked(text: str, count: Callable[[str], int], most: int = 400, carried: int = 7) -> list[str]:
    """Paragraphs packed up to `most` tokens; each chunk after the first begins with the last
    `carried` sentences of the one before. A paragraph that is too long alone is packed by sentence
    when it begins a chunk; sentences are never cut."""
    if count(text) <= most:
        return [text]

    def split(t: str) -> list[str]:
        return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])", t)) if s]

    out: list[str] = []
    now, size = "", 0

    def begin() -> None:
        nonlocal now, size
        now = " ".join(split(out[-1])[-carried:])
        size = count(now)

    for paragraph in text.split("\n\n"):
        n = count(paragraph)
        if n > most and not now:
            for sentence in split(paragraph):
                k = count(sentence)
                if size + k > most and now:
                    out.append(now)
                    begin()
                now, size = f"{now} {sentence}" if now else sentence, size + k
            if now:
                out.append(now)
                begin()
            continue
        if size + n > most and now:
            out.append(now)
            begin()
        now, size = f"{now}\n\n{paragraph}" if now else paragraph, size + n
    return [*out, now] if now else out


def word_pieces(text: str) -> int:
    """Tokens of a text where no model's tokenizer is at hand: words and marks, long words by fours."""
    return sum(max(1, -(-len(w) // 6)) if w.isalnum() else 1 for w in re.findall(r"\w+|[^\w\s]", text))


def mmr(hits: DataFrame, weight: float) -> DataFrame:
    """`hits` (id, score) of one search, at most its top_k, in new order: (position, id, score)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.assign(rank=pdf["score"].round(9)).sort_values(["rank", "id"], ascending=[False, True])
        new = diversify(list(zip(ordered["id"], ordered["score"], strict=True)), weight)
        return pd.DataFrame({"position": range(1, len(new) + 1), "id": [i for i, _ in new], "score": [s for _, s in new]})

    return hits.withColumn("search", F.lit(0)).groupBy("search").applyInPandas(run, "position int, id string, score double")


def snippets(df: DataFrame, query: str) -> DataFrame:
    """`df` (content, ...) with snippet."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t or "", query))

    return df.withColumn("snippet", cut("content"))


def chunks_of(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with chunk_idx and chunk, a row for each chunk of its text."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunked(t or "", word_pieces))

    return df.select("*", F.posexplode(cut(text)).alias("chunk_idx", "chunk"))

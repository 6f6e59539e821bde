"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping windows of two lengths: long ones, within which edits may
stand unevenly, and short, dense ones, so that an excerpt is found wherever it starts. A passage within k edits of a window of w
characters shares at least w - q + 1 - k q of its q-grams, all of them on diagonals (text place
less window place) that differ by k at most. Windows that share fewer with the whole text are left
out first. For the others, shared q-grams are counted in diagonal bands of width 2 (k + 1) that
overlap by half, so some band holds them all; bands with fewer are left out, and the rest are
verified by an alignment of the window with the text that stays within the band and k beyond it.
Texts are gone through in slices of bounded numbers of shared q-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import released, table, text_hash

#: Characters of benchmark items that are searched for in one pass over the texts (an index of
#: about 100 MB); a larger benchmark takes several passes, so what is broadcast never grows with it.
PASS_CHARS = 4_000_000
#: Shared q-grams of windows that are looked at together.
SLICE_HITS = 1 << 20
_NONE = np.uint32(0xFFFFFFFF)
_POINTS = 0x3400
_MUL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """q of the q-grams, windows and steps in characters, edits a character of a window may cost.

    A verbatim excerpt of `short + short_step - 1` characters holds a short window wherever it starts.
    """

    q: int = 8
    window: int = 128
    step: int = 64
    short: int = 40
    short_step: int = 10
    rate: float = 0.08
    #: Windows shorter than this must be found without an edit; items shorter than q characters, too,
    #: and these only where no letter or digit stands right before or after.
    shortest: int = 24

    def edits(self, w: int) -> int:
        return int(self.rate * w) if w >= self.shortest else 0

    def least_shared(self, w: int) -> int:
        return w - self.q + 1 - self.edits(w) * self.q


def _lower() -> np.ndarray:
    """Lower case of code points, white space and control characters as a blank."""
    out = np.arange(_POINTS, dtype=np.uint32)
    for c in range(_POINTS):
        low = chr(c).lower()
        out[c] = 32 if chr(c).isspace() or c < 32 else ord(low) if len(low) == 1 else c
    return out


_LOWER = _lower()


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points in lower case with runs of white space as one blank and none around; their places in `text`)."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(x < _POINTS, _LOWER[np.minimum(x, _POINTS - 1)], x)
    if not len(low):
        return low, np.zeros(0, np.int64)
    blank = low == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    if len(at) and low[at[0]] == 32:
        at = at[1:]
    if len(at) and low[at[-1]] == 32:
        at = at[:-1]
    return low[at], at


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q-gram at each place."""
    h = (points.astype(np.uint64) + np.uint64(1)) * _MUL
    h ^= h >> np.uint64(32)
    done = 1
    while done < q:  # doubling, then what is left
        more = min(done, q - done)
        n = len(h) - more
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = (h[:n] * np.uint64(0xD1342543DE82EF95)) ^ (h[more : more + n] + np.uint64(more))
        h *= _MUL
        h ^= h >> np.uint64(29)
        done += more
    return h


def spans(n: int, rules: Rules) -> tuple[list[int], list[int]]:
    """Starts of the long and of the short windows that cover an item of n characters; an item no
    longer than a window is one, and counts as a long one where it would be both."""
    both = []
    for w, step in ((rules.window, rules.step), (rules.short, rules.short_step)):
        both.append([0] if n <= w else [*range(0, n - w, step), n - w])
    return (both[0], both[1]) if n > rules.short else ([0], [])


def windows(item: int, points: np.ndarray, rules: Rules) -> list[tuple[int, int, np.ndarray]]:
    """(item, offset, code points) of the windows of both lengths that cover an item."""
    long, short = spans(len(points), rules) if len(points) else ([], [])
    return [(item, s, points[s : s + w]) for starts, w in ((long, rules.window), (short, rules.short)) for s in starts]


@dataclass(frozen=True)
class Index:
    """Windows of some items, and the items' q-grams in order with the windows each lies in.

    A window is `points[begin : begin + size]`. A q-gram at `place` lies in the windows
    `first[c] .. first[c] + count[c] - 1` for both lengths c. `small` has, for each length below
    q, hashes of whole items of that length and their windows.
    """

    rules: Rules
    points: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    begin: np.ndarray
    sizes: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    place: np.ndarray
    first: np.ndarray
    count: np.ndarray
    mask: np.ndarray
    small: dict[int, tuple[np.ndarray, np.ndarray]]

    def window(self, w: int) -> np.ndarray:
        return self.points[self.begin[w] : self.begin[w] + self.sizes[w]]

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places in h of hashes that may be indexed."""
        return np.flatnonzero(self.mask[(h >> np.uint64(64 - len(self.mask).bit_length() + 1)).astype(np.int64)])

    def owners(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `distinct`, window, place in the window) of each shared q-gram."""
        lo = np.searchsorted(self.keys, distinct, "left")
        n = np.searchsorted(self.keys, distinct, "right") - lo
        at, hit = np.repeat(np.arange(len(distinct)), n), _ranges(lo, n)
        parts = []
        for c in (0, 1):
            k = self.count[c][hit].astype(np.int64)
            who = _ranges(self.first[c][hit].astype(np.int64), k)
            parts.append((np.repeat(at, k), who, np.repeat(self.place[hit].astype(np.int64), k) - self.begin[who]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (n[0] numbers), then lo[1], ..."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _index(texts: list[np.ndarray], cut: list[tuple[list[tuple[int, int, int]], int]], rules: Rules) -> Index:
    """Index of `texts`; `cut` gives of each text its windows (item, offset, start in the text), long
    ones first, and how many are long."""
    sizes, starts, items, offsets, first, count = [], [], [], [], [], []
    small: dict[int, tuple[list, list]] = {}
    at = n_windows = 0
    for points, (wins, n_long) in zip(texts, cut, strict=True):
        n = len(points)
        begins = np.array([w[2] for w in wins], np.int64)
        size = np.array([min(rules.window if i < n_long else rules.short, n - b) for i, b in enumerate(begins.tolist())], np.int64)
        places = np.arange(max(0, n - rules.q + 1))
        for c, (a, b) in enumerate(((0, n_long), (n_long, len(wins)))):
            lo = np.searchsorted(begins[a:b] + size[a:b], places + rules.q, "left")
            hi = np.searchsorted(begins[a:b], places, "right")
            (first if c == 0 else count).append(np.stack([lo + n_windows + a, np.maximum(hi - lo, 0)]))
        if n < rules.q:
            hashes, owners = small.setdefault(n, ([], []))
            hashes.append(grams(points, n)[0])
            owners.append(n_windows)
        items += [w[0] for w in wins]
        offsets += [w[1] for w in wins]
        starts.append(begins + at)
        sizes.append(size)
        at, n_windows = at + n, n_windows + len(wins)
    hashes = [grams(p, rules.q) for p in texts]
    where = np.concatenate([np.zeros(0, np.int32), *[np.arange(len(h), dtype=np.int32) + o for h, o in zip(hashes, np.cumsum([0, *map(len, texts)]).tolist(), strict=False)]]).astype(np.int32)
    keys = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(keys, kind="stable")
    bits = min(26, max(16, int(32 * len(keys)).bit_length()))
    mask = np.zeros(1 << bits, bool)
    mask[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    wide = [np.concatenate([np.zeros((2, 0), np.int64), *x], 1)[:, order] for x in (first, count)]
    size = np.concatenate([np.zeros(0, np.int64), *sizes])
    edits = np.array([rules.edits(int(w)) for w in size], np.int64)
    need = np.array([max(1, rules.least_shared(int(w))) for w in size], np.int64)
    whole = {n: (np.array(h, np.uint64)[o := np.argsort(np.array(h, np.uint64))], np.array(w)[o]) for n, (h, w) in small.items()}
    return Index(
        rules,
        np.concatenate([np.zeros(0, np.uint32), *texts]),
        np.array(items),
        np.array(offsets),
        np.concatenate([np.zeros(0, np.int64), *starts]),
        size,
        edits,
        need,
        keys[order],
        where[order],
        np.stack([w[0] for w in wide]).astype(np.int32),
        np.stack([w[1] for w in wide]).astype(np.uint16),
        mask,
        whole,
    )


def index(cut: list[tuple[int, int, np.ndarray]], rules: Rules) -> Index:
    """Index of windows that are given one by one."""
    return _index([p for _, _, p in cut], [([(item, offset, 0)], 1) for item, offset, _ in cut], rules)


def index_items(items: list[tuple[int, np.ndarray]], rules: Rules) -> Index:
    """Index of all windows of items (id, code points); an item's q-grams are held once."""
    cut = []
    for item, points in items:
        long, short = spans(len(points), rules)
        cut.append(([(item, s, s) for s in (*long, *short)], len(long)))
    return _index([p for _, p in items], cut, rules)


def _align(pairs: list[tuple[int, int]], points: np.ndarray, idx: Index) -> list[tuple[int, int, int, int]]:
    """(window, edits, start, end) of each pair (window, first diagonal of its band) that is within
    the window's edits; ends free in the text.

    Row i of the table stands for i characters of the window, column c for the text place i + c
    beyond the band's beginning, so a table is as wide as the band and k on both sides. Pairs of
    equal k advance together; start places ride along.
    """
    out = []
    pairs = sorted(pairs, key=lambda x: (idx.edits[x[0]], idx.sizes[x[0]]))
    at = 0
    while at < len(pairs):
        k = int(idx.edits[pairs[at][0]])
        group = [x for x in pairs[at : at + 256] if idx.edits[x[0]] == k]
        at += len(group)
        width = 2 * (k + 1) + 2 * k
        lengths = np.array([idx.sizes[w] for w, _ in group])
        m = int(lengths.max())
        a = np.zeros((len(group), m), np.uint32)
        for r, (w, _) in enumerate(group):
            a[r, : lengths[r]] = idx.window(w)
        base = np.array([d - k for _, d in group])
        x = base[:, None] + np.arange(m + width + 1)
        fits = (x >= 0) & (x <= len(points))
        chars = np.where((x >= 0) & (x < len(points)), points[np.clip(x, 0, len(points) - 1)], _NONE)
        # cost * big + start in one number, so that the least carries its start along
        big, far = width + 1, np.int64(1) << 40
        row = np.where(fits[:, :width], np.arange(width), far)
        steps = np.arange(width) * big
        for i in range(m):
            new = row + np.where(chars[:, i : i + width] == a[:, i : i + 1], 0, big)
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + big)
            new = np.minimum.accumulate(new - steps, axis=1) + steps
            new = np.where(fits[:, i + 1 : i + 1 + width], new, far)
            row = np.where((i < lengths)[:, None], new, row)
        cost = row // big
        best = cost.argmin(1)
        for r, (w, _) in enumerate(group):
            e, c = int(best[r]), int(cost[r, best[r]])
            start, end = int(base[r] + row[r, e] % big), int(base[r] + lengths[r] + e)
            if c <= k and end > start:
                out.append((w, c, start, end))
    return out


def _counted(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below `most` and how often each occurs; without a sort where keys are dense."""
    if most > 8 * len(keys):
        return np.unique(keys, return_counts=True)
    n = np.bincount(keys, minlength=most)
    found = np.flatnonzero(n)
    return found, n[found]


def _bands(at: np.ndarray, who: np.ndarray, where: np.ndarray, idx: Index) -> list[tuple[int, int]]:
    """(window, first diagonal) of the bands that hold enough of a window's q-grams."""
    wins, _ = _counted(who, len(idx.need))
    local = np.searchsorted(wins, who) if len(wins) < len(idx.need) else who
    half, need = idx.edits[wins] + 1, idx.need[wins]
    wide = idx.rules.window + 1
    diagonal = at - where + wide
    found = set()
    for shift in (0, 1):  # bands of width 2 (k + 1), then those that begin half a band later
        band = (diagonal + (shift * half)[local]) // (2 * half)[local]
        low = int(band.min())
        band -= low
        most = int(band.max()) + 1
        key = local * most + band
        keys, n = _counted(key, most * len(wins))
        full = keys[n >= need[keys // most]]
        if not len(full):
            continue
        # a window's q-gram counts once a place, however often it is met in the band
        slot = np.minimum(np.searchsorted(full, key), len(full) - 1)
        kept = full[slot] == key
        once, _ = _counted(slot[kept] * wide + where[kept], len(full) * wide)
        slots, n = _counted(once // wide, len(full))
        enough = full[slots[n >= need[full[slots] // most]]]
        w = enough // most
        found |= set(zip(wins[w].tolist(), ((enough % most + low) * 2 * half[w] - shift * half[w] - wide).tolist(), strict=True))
    return sorted(found)


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _verified(bands: list[tuple[int, int]], points: np.ndarray, idx: Index) -> list[tuple[int, int, int, int]]:
    """(window, edits, start, end) of the bands in which the window is found."""
    hits, todo, names = [], [], {}
    spots = []
    for w, first in bands:
        if w not in names:
            names[w] = _text(idx.window(w))
        spots.append((max(0, first), first + 2 * (int(idx.edits[w]) + 1) + len(names[w])))
    begin = min((lo for lo, _ in spots), default=0)
    text = _text(points[begin : max((hi for _, hi in spots), default=0)])
    for (w, first), (lo, hi) in zip(bands, spots, strict=True):
        at = text.find(names[w], lo - begin, hi - begin)
        if at < 0:
            todo.append((w, first))
        else:
            hits.append((w, 0, begin + at, begin + text.rfind(names[w], lo - begin, hi - begin) + len(names[w])))
    return hits + _align(todo, points, idx)


def _small(points: np.ndarray, idx: Index) -> list[tuple[int, int, int, int]]:
    """Places of whole items of fewer than q characters, as words of their own."""

    def joined(i: int) -> bool:
        return 0 <= i < len(points) and chr(points[i]).isalnum()

    hits = []
    for n, (keys, who) in idx.small.items():
        h = grams(points, n) if len(points) >= n else np.zeros(0, np.uint64)
        lo = np.searchsorted(keys, h, "left")
        count = np.searchsorted(keys, h, "right") - lo
        for at, w in zip(np.repeat(np.arange(len(h)), count).tolist(), who[_ranges(lo, count)].tolist(), strict=True):
            if np.array_equal(points[at : at + n], idx.window(w)) and not joined(at - 1) and not joined(at + n):
                hits.append((w, 0, at, at + n))
    return hits


def search(text: str, idx: Index) -> list[tuple[int, int, int, int, int]]:
    """(item, edits, window's offset, start, end) of each window found: fewest edits, and first start
    and last end of its passages; places are code points of `text`."""
    points, places = normalise(text)
    rules = idx.rules
    best: dict[int, tuple[int, int, int]] = {}

    def note(hits: list[tuple[int, int, int, int]]) -> None:
        for w, c, s, e in hits:
            old = best.get(w, (c, s, e))
            best[w] = min(c, old[0]), min(s, old[1]), max(e, old[2])

    note(_small(points, idx))
    h = grams(points, rules.q)
    at = idx.known(h)
    distinct, which = np.unique(h[at], return_inverse=True)
    key, who, where = idx.owners(distinct)
    # a passage's window shares enough of its places with the text as a whole
    enough = (np.bincount(who, minlength=len(idx.need)) >= idx.need)[who]
    key, who, where = key[enough], who[enough], where[enough]
    if len(key):
        order = np.argsort(key, kind="stable")
        key, who, where = key[order], who[order], where[order]
        lo = np.searchsorted(key, which, "left")
        n = np.searchsorted(key, which, "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        upto = np.cumsum(n)
        # q-grams of one band lie within so many places, so each band is whole in the slice that its first one begins
        reach = rules.window + 2 * (int(idx.edits.max()) + 1)
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLICE_HITS, "right")))
            past = int(np.searchsorted(at, at[end - 1] + reach, "right"))
            part = _ranges(lo[begin:past], n[begin:past])
            bands = _bands(np.repeat(at[begin:past], n[begin:past]), who[part], where[part], idx)
            note(_verified(bands, points, idx))
            begin = end
    return [(int(idx.item[w]), c, int(idx.offset[w]), int(places[s]), int(places[e - 1]) + 1) for w, (c, s, e) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row for each document of `docs` (doc_id, text) and item of `benchmark` (item_id, text) of
    which it holds a passage: doc_id, text_hash, item_id, edits (fewest of any window), windows
    (how many of the item's windows are found), start, end (of all of them; code points, end exclusive).

    A passage is a window of an item, of either length, or the whole of a shorter one, within
    `rules.rate` edits a character; case and white space don't count. Items of fewer than q
    characters must stand there as they are, with no letter or digit right before or after. Null
    or blank texts and items, and items without item_id, hold and are nothing. Rows of equal
    doc_id (null or not) and equal text are one document. Rows of one item_id are windows of one
    item, rows that repeat count once. Results don't depend on how many passes the benchmark takes.
    Empty tables give no rows. Further columns play no part.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", text_hash())
    schema = "doc_id long, text_hash long, item_id long, edits long, windows long, start long, end long"
    found = None
    for idx in _passes(items, rules):
        shared = spark.sparkContext.broadcast(idx)

        @released
        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                texts, ids, hashes = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "doc_id", "text_hash"))
                for i in range(batch.num_rows):
                    by: dict[int, list] = {}
                    for item, *hit in search(texts[i].as_py() or "", shared.value):
                        by.setdefault(item, []).append(hit)
                    out += [(ids[i].as_py(), hashes[i].as_py(), item, min(h[0] for h in hits), len(hits), min(h[2] for h in hits), max(h[3] for h in hits)) for item, hits in by.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "text_hash", "item_id", "edits", "windows", "start", "end"])

        # rows that repeat within a pass say the same; passes have different windows
        part = rows.mapInArrow(look, schema).distinct()
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], schema)
    merged = found.groupBy("doc_id", "text_hash", "item_id").agg(F.min("edits").alias("edits"), F.sum("windows").alias("windows"), F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(*[c.split()[0] for c in schema.split(", ")])


def _passes(items: DataFrame, rules: Rules) -> Iterator[Index]:
    """Indexes of about `PASS_CHARS` characters of items, which are streamed to the driver one part at a time."""
    cut: list = []
    size = 0
    for row in items.toLocalIterator():
        points, _ = normalise(row["text"])
        if not len(points):
            continue
        cut.append((row["item_id"], points))
        size += len(points)
        if size >= PASS_CHARS:
            yield index_items(cut, rules)
            cut, size = [], 0
    if cut:
        yield index_items(cut, rules)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of `documents` with the items of `benchmark` of which they hold a passage; see `contaminated`."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")

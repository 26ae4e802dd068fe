"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too is removed. Sorting all suffixes would
move hundreds of times the text, so one suffix stands for many: each window of ``LENGTH`` bytes names the least of its
``GRAM``-byte hashes as its anchor, equal windows have the same anchor at the same place, and an anchor stands for the
windows ``low..high`` that name it, about one in 170 places.

1. Anchors are sorted by gram hash; those of a hash that occurs once are done: none of their windows repeats.
2. Anchors whose whole context (all bytes of their windows) occurs twice are done: all their windows repeat.
3. The other distinct contexts are sorted twice, by the bytes after the anchor and by the bytes before it, backwards.
   Each task sorts a run, cuts it at splitters and front-codes it (shared prefix length and rest); each range merges its
   runs with a loser tree that compares strings only beyond the prefix they are known to share. Neighbours give the
   longest match of each anchor either way, thus the outermost windows that can repeat; the neighbour often proves them.
4. Contexts whose outermost windows no neighbour proves compare fingerprints of the windows between them.

Neighbours of different texts also tell of shorter passages: what the two share around the anchor, if it has ``PASSAGE``
words, is a passage that repeats across documents. Such a passage is found where both texts anchor the same gram of it; it
is reported, never removed.

Documents of equal bytes are one class: with ``LENGTH`` bytes or more, all of it goes. Bytes are UTF-8. All steps hold
a run, a range or one document in memory; hot strings are front-coded, collapsed to one context, or split over ranges.

A task combines equal grams and equal contexts before it sends them, so that a hot one sends a row a block of ``COMBINED``.

Edge cases: null and empty texts have no bytes. Texts shorter than ``LENGTH`` are never cut. Rows with a null doc_id are
searched and cut like others with ``nameless``, as the query does; without it they are kept whole and are no one's
repetition. Rows that share a doc_id are documents of their own: a text is found by 64 bits
of its id and itself. Extra columns are not looked at. Grams compare by 64 bits, contexts and windows by 128 bits of
xxHash.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import SALTS, salted, stored
from .shingles import mixed

LENGTH, GRAM = 400, 64
SPAN = LENGTH - GRAM + 1
#: Places hashed together; a text is gone through in pieces that overlap by a window.
PIECE = 1 << 19
#: Contexts of a sorted run, of a range, and in the sample that splitters are drawn from.
RUN, RANGE, SPLITTER_SAMPLE = 40_000, 8_000, 4_000
BLOCK_BYTES = 1 << 16
#: Anchors or contexts that a task combines before they are sent.
COMBINED = 200_000
#: Words of a passage that is reported.
PASSAGE = 51

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size, inverse = max(n, 1 << 16), pow(_BASE, -1, 1 << 64)
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, _BASE, np.uint64))])
        _INVERSE = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, inverse, np.uint64))])
    return _POWERS[:n], _INVERSE[:n]


def _substring_hashes(b: np.ndarray, size: int) -> np.ndarray:
    up, down = _powers(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up)])
    return mixed((sums[size:] - sums[:-size]) * down[: len(b) - size + 1])


def anchors(text: bytes) -> np.ndarray:
    """Rows (place, first window, last window, gram hash) of a text; each window of LENGTH bytes is in one row."""
    found = []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        h = _substring_hashes(data[at : at + PIECE + LENGTH - 1], GRAM)
        # the least hash, then the first place: both in one word
        keys = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        padded = np.concatenate([keys, np.full(-len(keys) % SPAN, np.iinfo(np.uint64).max)]).reshape(-1, SPAN)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(keys) - SPAN + 1
        least = (np.minimum(behind[:n], ahead[SPAN - 1 : SPAN - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        place = least[first]
        found.append(np.stack([place + at, first + at, last + at, h[place].view(np.int64)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _class_of(raw: bytes) -> int:
    return xxh3_64_intdigest(raw) >> 1


# --- sorted streams: rows of which a key occurs more than once


def _repeated(keys: int, given: str):
    """Of rows sorted by all columns, those whose first ``keys`` columns another, different row shares; only the last row is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, alone, names, kinds = None, True, None, None
        for frame in frames:
            if not len(frame):
                continue
            names, kinds = list(frame.columns), frame.dtypes
            if last is not None:
                frame = pd.concat([last, frame], ignore_index=True)
            old = last is not None and not alone
            same = np.ones(len(frame) - 1, bool)
            equal = np.ones(len(frame) - 1, bool)
            for i, c in enumerate(names):
                v = frame[c].to_numpy()
                agrees = v[1:] == v[:-1]
                equal &= agrees
                if i < keys:
                    same &= agrees
            kept = np.concatenate([[True], ~equal])
            frame = frame[kept].reset_index(drop=True)
            follows = np.concatenate([[False], same])[kept]
            shared = follows | np.concatenate([follows[1:], [False]])
            if len(frame) > 1 or not old:
                alone = not shared[-1] and not (len(frame) == 1 and old)
            shared[: int(old)] = False
            last = frame.iloc[-1:]
            if shared.any():
                yield frame[shared].astype(kinds)

    return run


# --- front-coded runs and the loser tree


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """The length of the shared prefix of ``a`` and ``b``, which is at least ``start``."""
    n, step = min(len(a), len(b)), 32
    while start < n:
        if a[start : start + step] == b[start : start + step]:
            start = min(n, start + step)
        elif step == 1:
            return start
        else:
            step = max(1, step // 4) if step > 2 else 1
    return min(start, n)


_HEAD = struct.Struct("<HHHHqqqqq")


def front_coded(run: list[tuple]) -> Iterator[bytes]:
    """Blocks of a sorted run of (string, other string, numbers): each string as shared prefix length and rest."""
    out, size, before = [], 0, b""
    for string, other, numbers in run:
        shared = common_prefix(before, string, 0)
        piece = _HEAD.pack(shared, len(string) - shared, len(other), 0, *numbers) + string[shared:] + other
        out.append(piece)
        size += len(piece)
        before = string
        if size >= BLOCK_BYTES:
            yield b"".join(out)
            out, size, before = [], 0, b""
    if out:
        yield b"".join(out)


def decoded(blocks: list[bytes]) -> Iterator[tuple[int, bytes, bytes, tuple]]:
    """(prefix shared with the row before, string, other string, numbers)."""
    for block in blocks:
        at, before = 0, b""
        while at < len(block):
            shared, rest, other, _, *numbers = _HEAD.unpack_from(block, at)
            at += _HEAD.size
            before = before[:shared] + block[at : at + rest]
            at += rest
            yield shared, before, block[at : at + other], tuple(numbers)
            at += other


class LoserTree:
    """Merges sorted runs. A run's head keeps the prefix it shares with the row given out last; of two heads the one
    that shares more comes first, and only equally long shared prefixes are compared, from their end on."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, bytes, tuple]]]) -> None:
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.shared = [0] * k
        self.size = 1
        while self.size < k:
            self.size *= 2
        self.losers = [-1] * self.size
        self.top = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            i = node - self.size
            return i if i < len(self.heads) else -1
        first, loser = self._meet(self._play(2 * node), self._play(2 * node + 1))
        self.losers[node] = loser
        return first

    def _meet(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes the one with the winner."""
        if i < 0 or self.heads[i] is None:
            return j, i
        if j < 0 or self.heads[j] is None:
            return i, j
        if self.shared[i] != self.shared[j]:
            return (i, j) if self.shared[i] > self.shared[j] else (j, i)
        a, b = self.heads[i], self.heads[j]
        h = common_prefix(a[1], b[1], self.shared[i])
        x, y = a[1][h : h + 1], b[1][h : h + 1]
        if x < y or (x == y and (a[2], a[3]) <= (b[2], b[3])):
            self.shared[j] = h
            return i, j
        self.shared[i] = h
        return j, i

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, tuple]]:
        """(prefix shared with the row given before, string, other string, numbers) in order."""
        while self.top >= 0 and (head := self.heads[self.top]) is not None:
            i = self.top
            yield self.shared[i], *head[1:]
            after = next(self.runs[i], None)
            self.heads[i] = after
            if after is not None:
                # blocks start anew, so a stored 0 may understate what is shared
                self.shared[i] = after[0] if after[0] else common_prefix(head[1], after[1], 0)
            node, first = (self.size + i) // 2, i
            while node:
                first, self.losers[node] = self._meet(first, self.losers[node])
                node //= 2
            self.top = first


# --- steps

ROWS = "doc_id bigint, row bigint, n_bytes bigint, cls bigint, whole string"
ANCHORS = "known boolean, gram bigint, cls bigint, place bigint"
NUMBERS = "cls bigint, place bigint, low bigint, high bigint, gram bigint"
CONTEXTS = f"{NUMBERS}, before binary, after binary"


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        raw = [_bytes_of(t) for t in frame["text"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "row": frame["row"], "n_bytes": list(map(len, raw)), "cls": list(map(_class_of, raw)), "whole": [hashlib.sha256(r).hexdigest() for r in raw]})


def _combined(rows: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """known, rows: of rows that share their first ``keys`` columns, one that is not known and stands for them elsewhere,
    then all of them as known, if they are several."""
    rows = rows[np.lexsort(rows[:, :keys].T[::-1])]
    start = np.concatenate([[True], (rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)])
    alone = start & np.concatenate([start[1:], [True]])
    return np.repeat([False, True], [int(start.sum()), int((~alone).sum())]), np.concatenate([rows[start], rows[~alone]])


def _anchors(most: int):
    """known: a gram that the task saw twice by itself. Of each gram a batch also has one row that is not known, which
    stands for it elsewhere, so that a gram of many places sends few rows to the task that compares it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def combined() -> pd.DataFrame:
            known, out = _combined(np.concatenate(held), 1)
            held.clear()
            return pd.DataFrame({"known": known, "gram": out[:, 0], "cls": out[:, 1], "place": out[:, 2]})

        size = 0
        for frame in frames:
            for text in frame["text"]:
                raw = _bytes_of(text)
                cls = _class_of(raw)
                if len(raw) >= LENGTH and cls not in seen:
                    if len(seen) < 500_000:  # copies within a task are one class
                        seen.add(cls)
                    a = anchors(raw)
                    held.append(np.stack([a[:, 3], np.full(len(a), cls), a[:, 0]], axis=1))
                    size += len(a)
                    if size >= most:
                        yield combined()
                        size = 0
        if held:
            yield combined()

    return run


DIGESTS = "gram bigint, d1 bigint, d2 bigint, cls bigint, place bigint, low bigint, high bigint"


def _digests(most: int):
    """known and DIGESTS: the digest of each context asked for, equal ones of a task combined."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def combined() -> pd.DataFrame:
            known, out = _combined(np.concatenate(held), 3)
            held.clear()
            return pd.DataFrame({"known": known} | {c.split()[0]: out[:, i] for i, c in enumerate(DIGESTS.split(", "))})

        size = 0
        for frame in frames:
            for text, cls, places in frame[["text", "cls", "places"]].itertuples(index=False):
                raw = _bytes_of(text)
                if _class_of(raw) != cls:
                    continue
                a = anchors(raw)
                a = a[np.isin(a[:, 0], places)]
                prints = [xxh3_128_digest(raw[low : high + LENGTH] + struct.pack("<H", place - low)) for place, low, high in a[:, :3].tolist()]
                d = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
                held.append(np.stack([a[:, 3], d[:, 0], d[:, 1], np.full(len(a), cls), a[:, 0], a[:, 1], a[:, 2]], axis=1))
                size += len(a)
                if size >= most:
                    yield combined()
                    size = 0
        if size:
            yield combined()

    return run


def _contexts(columns: str, make):
    """Rows that ``make`` gives for each text of its class, its places asked for and its anchors at them."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, cls, places in frame[["text", "cls", "places"]].itertuples(index=False):
                raw = _bytes_of(text)
                if _class_of(raw) == cls:
                    a = anchors(raw)
                    for place, low, high, gram in a[np.isin(a[:, 0], places)].tolist():
                        rows.append(make(raw, cls, place, low, high, gram))
                        if len(rows) >= 4096:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return run


def _context(raw: bytes, cls: int, place: int, low: int, high: int, gram: int) -> tuple:
    return cls, place, low, high, gram, raw[low:place][::-1], raw[place : high + LENGTH]


def _runs(by: str, other: str, splitters: list[tuple[bytes, bytes]], most: int):
    """Sorted front-coded runs of ``most`` rows, cut at the splitters: (range, run, block, data)."""
    import uuid

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def flush() -> pd.DataFrame:
            held.sort()
            name, rows = uuid.uuid4().hex, []
            for part, rows_of in groupby(held, key=lambda r: bisect_right(splitters, r[:2])):
                rows += [(part, name, i, block) for i, block in enumerate(front_coded(list(rows_of)))]
            held.clear()
            return pd.DataFrame(rows, columns=["part", "run", "block", "data"]).astype({"part": "int32", "block": "int32"})

        for frame in frames:
            for string, second, *numbers in frame[[by, other, *(c.split()[0] for c in NUMBERS.split(", "))]].itertuples(index=False):
                held.append((bytes(string), bytes(second), tuple(numbers)))
                if len(held) >= most:
                    yield flush()
        if held:
            yield flush()

    return run


#: reach: the longest shared prefix with a neighbour; side: of those, the longest shared other string; p_reach, p_side: those
#: of the longest passage shared with a neighbour. edge: 0, or 1 and 2 for the first and last row of a range, which come
#: with their strings.
MERGED = f"part int, {NUMBERS}, reach int, side int, p_reach int, p_side int, edge int, string binary, other binary"
#: reach, side, p_reach and p_side of a row without neighbours.
ALONE = (0, 0, 0, 0)


def _neighbour(a: tuple, b: tuple, shared: int, backwards: bool) -> tuple[int, int, int, int]:
    """reach, side, p_reach and p_side of two rows; ``backwards``: they are sorted by the bytes before the anchor."""
    side = common_prefix(a[1], b[1], 0)
    if shared + side < 2 * PASSAGE - 1 or a[2][0] == b[2][0]:
        return shared, side, 0, 0
    before, after = (a[0][:shared], a[1][:side]) if backwards else (a[1][:side], a[0][:shared])
    long = len((before[::-1] + after).split()) >= PASSAGE
    return (shared, side, shared, side) if long else (shared, side, 0, 0)


def _better(a: tuple, b: tuple) -> tuple:
    return (*max(a[:2], b[:2]), *max(a[2:], b[2:], key=sum))


def _merged(frames: Iterator[pd.DataFrame], backwards: bool) -> Iterator[pd.DataFrame]:
    """Each range's runs merged; a range is bounded by its splitters and held as its blocks."""
    names = [c.split()[0] for c in MERGED.split(", ")]

    def merge(part: int, runs: list[list[bytes]]) -> Iterator[pd.DataFrame]:
        out, before, best, first = [], None, ALONE, True
        for shared, *row in LoserTree([decoded(r) for r in runs]):
            pair = ALONE if before is None else _neighbour(before, row, shared, backwards)
            if before is not None:
                out.append((part, *before[2], *_better(best, pair), 1 if first else 0, *((before[0], before[1]) if first else (None, None))))
                first = False
            before, best = row, pair
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        if first:
            out.append((part, *before[2], *best, 1, before[0], before[1]))
        out.append((part, *before[2], *best, 2, before[0], before[1]))
        yield pd.DataFrame(out, columns=names)

    part, runs, run = None, [], None
    for frame in frames:
        for p, r, data in frame[["part", "run", "data"]].itertuples(index=False):
            if p != part:
                if runs:
                    yield from merge(part, runs)
                part, runs, run = p, [], None
            if r != run:
                runs.append([])
                run = r
            runs[-1].append(bytes(data))
    if runs:
        yield from merge(part, runs)


def _sorted_neighbours(contexts: DataFrame, by: str, other: str, rows: int) -> DataFrame:
    """NUMBERS, reach, side, p_reach and p_side of each context in the order of ``by``."""
    spark, backwards, found = contexts.sparkSession, by == "before", ["reach", "side", "p_reach", "p_side"]
    ranges = max(1, rows // RANGE)
    share = min(1.0, SPLITTER_SAMPLE / max(rows, 1))
    drawn = contexts.where(F.pmod(F.xxhash64("cls", "place", "low"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else contexts
    sample = sorted((bytes(r[0]), bytes(r[1])) for r in drawn.select(by, other).collect())
    splitters = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if len(sample) >= ranges else sample
    blocks = contexts.mapInPandas(_runs(by, other, splitters, RUN), "part int, run string, block int, data binary")
    merged = blocks.repartition("part").sortWithinPartitions("part", "run", "block").mapInPandas(partial(_merged, backwards=backwards), MERGED)
    merged = stored(merged, f"merged-{by}")
    numbers = [c.split()[0] for c in NUMBERS.split(", ")]
    # the first and last row of each range meet their neighbours of other ranges here: two rows a range
    edges = merged.where("edge > 0").orderBy("part", "edge").select(*numbers, *found, "string", "other").collect()
    known: dict[tuple, tuple] = {}
    for r in edges:
        key = tuple(r[c] for c in numbers)
        known[key] = _better(known.get(key, ALONE), tuple(r[c] for c in found))
    for a, b in zip(edges, edges[1:], strict=False):
        x, y = tuple(a[c] for c in numbers), tuple(b[c] for c in numbers)
        if x != y:
            left, right = (bytes(a["string"]), bytes(a["other"]), x), (bytes(b["string"]), bytes(b["other"]), y)
            pair = _neighbour(left, right, common_prefix(left[0], right[0], 0), backwards)
            known[x], known[y] = _better(known[x], pair), _better(known[y], pair)
    inner = merged.where("edge = 0").select(*numbers, *found)
    outer = spark.createDataFrame([(*k, *v) for k, v in known.items()], inner.schema)
    return inner.union(outer)


#: Windows of an anchor by offset (place - start): possible ones are least..most.
def _bounds(after: DataFrame, before: DataFrame) -> DataFrame:
    numbers = [c.split()[0] for c in NUMBERS.split(", ")]
    a = after.select(*numbers, F.col("reach").alias("right"), F.col("side").alias("right_side"))
    b = before.select(*numbers, F.col("reach").alias("left"), F.col("side").alias("left_side"))
    least = F.greatest(LENGTH - F.col("right"), F.col("place") - F.col("high"))
    most = F.least(F.col("left").cast("bigint"), F.col("place") - F.col("low"))
    both = a.join(b, numbers).withColumn("least", least).withColumn("most", most).where("least <= most")
    # the neighbour that matches furthest one way matches far enough the other way too
    return both.withColumn("proven", (F.col("right_side") >= F.col("least")) & (F.col("left_side") >= LENGTH - F.col("most")))


WINDOWS = "high_print bigint, low_print bigint, cls bigint, place bigint, low bigint, offset int, proven boolean"


def _window_prints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for cls, place, low, least, most, proven, before, after in frame[["cls", "place", "low", "least", "most", "proven", "before", "after"]].itertuples(index=False):
            whole, middle = bytes(before)[::-1] + bytes(after), len(before)
            rows = [(*struct.unpack("<qq", xxh3_128_digest(whole[middle - r : middle - r + LENGTH])), cls, place, low, r, proven) for r in range(least, most + 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOWS.split(", ")]).astype({"offset": "int32"})


def repeated_spans(docs: DataFrame, names: DataFrame) -> DataFrame:
    """cls, start and stop of spans of removed bytes (``removed``) and of passages, overlapping ones not joined, and the texts
    they may be in; ``names``: cls and row of each class, and how many rows are the same."""
    scanned = stored(docs.select("text").mapInPandas(_anchors(COMBINED), ANCHORS), "anchors")
    places = "gram bigint, cls bigint, place bigint"
    lone = scanned.where("NOT known").select("gram", "cls", "place")
    met = lone.repartition("gram").sortWithinPartitions("gram", "cls", "place").mapInPandas(_repeated(1, places), places)
    asked = met.unionByName(scanned.where("known").select("gram", "cls", "place")).groupBy("cls").agg(F.collect_set("place").alias("places"))
    # all that follows looks only at texts with a gram that repeats
    found = docs.join(asked.join(names, "cls"), "row").select("cls", "text", "places", "same")
    if not names.where("same > 1").isEmpty():  # of rows that are the same, one goes on
        found = found.where("same = 1").unionByName(found.where("same > 1").dropDuplicates(["cls"]))
    suspects = stored(found.drop("same"), "suspects", codec="zstd")
    made = stored(suspects.mapInPandas(_digests(COMBINED), f"known boolean, {DIGESTS}"), "digests")
    order = [c.split()[0] for c in DIGESTS.split(", ")]
    lone = made.where("NOT known").select(*order)
    twice = lone.repartition("gram", "d1").sortWithinPartitions(*order).mapInPandas(_repeated(3, DIGESTS), DIGESTS)
    twice = twice.unionByName(made.where("known").select(*order))
    full = twice.select("cls", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("stop"))
    # a context that is one of several of its gram goes on, once
    one = lone.groupBy("gram", "d1", "d2").agg(F.min(F.struct("cls", "place", "low", "high")).alias("x")).select("gram", "d1", "d2", "x.*")
    several = one.repartition("gram").sortWithinPartitions(*order).mapInPandas(_repeated(1, DIGESTS), DIGESTS)
    several = several.groupBy("cls").agg(F.collect_list("place").alias("places"), F.collect_list("low").alias("lows"))
    again = suspects.select("cls", "text").join(several, "cls")
    contexts = again.mapInPandas(_contexts(CONTEXTS, _context), CONTEXTS)
    contexts = stored(contexts.join(several.select("cls", F.explode(F.arrays_zip("places", "lows")).alias("z")).select("cls", F.col("z.places").alias("place"), F.col("z.lows").alias("low")), ["cls", "place", "low"], "left_semi"), "contexts", codec="zstd")
    rows = contexts.count()
    plain = contexts.select(*(c.split()[0] for c in CONTEXTS.split(", ")))
    after, before = _sorted_neighbours(plain, "after", "before", rows), _sorted_neighbours(plain, "before", "after", rows)
    passages = [x.where("p_reach + p_side > 0").select("cls", (F.col("place") - F.col(left)).alias("start"), (F.col("place") + F.col(right)).alias("stop")) for x, left, right in ((after, "p_side", "p_reach"), (before, "p_reach", "p_side"))]
    bounds = stored(_bounds(after, before), "bounds")
    start, stop = F.col("place") - F.col("most"), F.col("place") - F.col("least") + LENGTH
    proven = bounds.where("proven").select("cls", start.alias("start"), stop.alias("stop"))
    open_grams = bounds.where("NOT proven").select("gram").distinct()
    partners = bounds.join(open_grams, "gram", "left_semi").join(plain, ["cls", "place", "low", "high", "gram"])
    prints = partners.select("cls", "place", "low", F.col("least").cast("int"), F.col("most").cast("int"), "proven", "before", "after").mapInPandas(_window_prints, WINDOWS)
    same = prints.repartition("high_print").sortWithinPartitions("high_print", "low_print", "cls", "place", "low", "offset").mapInPandas(_repeated(2, WINDOWS), WINDOWS)
    same = same.where("NOT proven").groupBy("cls", "place", "low").agg(F.min("offset").alias("least"), F.max("offset").alias("most"))
    rest = same.select("cls", (F.col("place") - F.col("most")).alias("start"), (F.col("place") - F.col("least") + LENGTH).alias("stop"))
    gone = full.unionByName(proven).unionByName(rest).withColumn("removed", F.lit(True))
    spans = gone.unionByName(passages[0].unionByName(passages[1]).withColumn("removed", F.lit(False)))
    return stored(spans.join(names.select("cls"), "cls", "left_semi"), "spans"), suspects


CUT = "cls bigint, n_removed bigint, n_spans bigint, kept string, kept_sha256 string, n_passages bigint"


def merged_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut(with_text: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for cls, text, spans in frame[["cls", "text", "spans"]].itertuples(index=False):
                raw, kept, at = _bytes_of(text), [], 0
                if _class_of(raw) != cls:  # another text of the same row hash
                    continue
                joined = merged_spans((s["start"], s["stop"]) for s in spans if s["removed"])
                passages = merged_spans((s["start"], s["stop"]) for s in spans)
                for a, b in joined:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((cls, len(raw) - len(kept), len(joined), kept.decode("utf-8", "ignore") if with_text else None, hashlib.sha256(kept).hexdigest(), len(passages)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CUT.split(", ")])

    return run


EMPTY = hashlib.sha256(b"").hexdigest()


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, nameless: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row, and n_passages: its runs of bytes that are removed or
    in a passage of ``PASSAGE`` words that another text was found to have; ``with_text``: kept too, where something was cut
    (else null); ``nameless``: rows with a null doc_id are documents too."""
    judged = F.lit(True) if nameless else F.col("doc_id").isNotNull()
    docs = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    rows = stored(docs.mapInPandas(_rows, ROWS), "rows")
    long = rows.where(judged & (F.col("n_bytes") >= LENGTH)).groupBy("cls", "row").agg(F.count("*").alias("same"))
    least = F.min(F.struct("same", "row")).alias("least")
    classes = stored(long.groupBy("cls").agg(least, F.sum("same").alias("copies")).select("cls", "least.*", "copies"), "classes")
    spans, suspects = repeated_spans(docs.where(judged), classes.select("cls", "row", "same"))
    single = classes.where("copies = 1").select("cls")
    listed = spans.join(single, "cls", "left_semi").groupBy("cls").agg(F.collect_list(F.struct("start", "stop", "removed")).alias("spans"))
    cut = suspects.select("cls", "text").join(listed, "cls").mapInPandas(_cut(with_text), CUT)
    many = salted(classes.where("copies > 1").select("cls", F.lit(True).alias("copied")))
    marked = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(many, ["cls", "__salt"], "left").drop("__salt")
    copied = F.col("copied") & judged
    marked = marked.withColumn("copied", F.coalesce(copied, F.lit(False)))
    gone = marked.where("copied").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(EMPTY).alias("kept_sha256"), F.lit("").alias("kept"), F.lit(1).cast("bigint").alias("n_passages"))
    own = F.when(judged & (F.col("n_bytes") >= LENGTH), F.col("cls"))
    rest = marked.where("NOT copied").withColumn("own", own).drop("cls").join(cut.withColumnRenamed("cls", "own"), "own", "left")
    rest = rest.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept", F.coalesce("n_passages", F.lit(0).cast("bigint")).alias("n_passages"))
    out = gone.unionByName(rest)
    return out if with_text else out.drop("kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"), nameless=True)

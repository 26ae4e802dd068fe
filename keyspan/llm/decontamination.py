"""Benchmark decontamination by SimHash over item-sized windows.

A window of a document has as many words as the benchmark item it is held against. Windows that share enough of an
item's five-word shingles to reach the similarity at all get a 64-bit SimHash of their weighted shingles; multi-index
Hamming blocks (one more block than the radius) find every item fingerprint within the radius, and the exact weighted
similarity of shingles (sum of least counts over sum of greatest) decides.

The benchmark is gone through in blocks of ``BLOCK_WORDS`` words. One block is broadcast at a time and dropped before the
next, so that memory does not grow with the benchmark. Documents are read once a block; a benchmark of one block shuffles
nothing, and of more only the leaks found are joined to the documents, by a digest of the text.

Edge cases: null and empty texts have no leaks; an item of fewer than five words is one shingle of all of them, and an
item without words matches nothing. A document shorter than an item is one window. Repeated rows give equal results;
items of one text each match. Of equally similar windows the first is reported. Items with a null id are
skipped by ``mark``, unless ``nameless``; ``clean`` searches them too.
Extra columns are kept; ``leaks`` replaces a column of its name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, if_small, in_blocks, stored
from .shingles import shingles, word_hashes

WORD = re.compile(r"\w+")
SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which a window's fingerprint may differ. At a similarity of 0.8, 64 bits differ in 9.6 +- 2.9 places.
RADIUS = 18
#: Words of a broadcast block of the benchmark: about 30 MB of index.
BLOCK_WORDS = 250_000
_FILTER = 1 << 20
_BITS = np.arange(64, dtype=np.uint64)


def words_of(text: str | None) -> np.ndarray:
    return word_hashes(WORD.findall((text or "").lower()))


def fingerprints(s: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """SimHashes of the windows of ``size`` shingles at ``starts``; ``s``: the shingles in order."""
    low, high = int(starts.min()), int(starts.max()) + size
    votes = ((s[low:high, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes, axis=0)])
    at = starts - low
    return ((sums[at + size] - sums[at] > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class HammingIndex:
    """Fingerprints cut into ``radius + 1`` blocks: two within the radius agree in one block at least."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, min(radius + 1, 64) + 1).astype(int)
        self.cuts = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.tables = []
        for shift, mask in self.cuts:
            table = defaultdict(list)
            for i, value in enumerate(((prints >> shift) & mask).tolist()):
                table[value].append(i)
            self.tables.append({k: np.array(v) for k, v in table.items()})

    def within(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, own, distance) of all pairs within the radius."""
        found = []
        for q, p in enumerate(prints):
            hits = [t[v] for t, (shift, mask) in zip(self.tables, self.cuts, strict=True) if (v := int((p >> shift) & mask)) in t]
            if hits:
                own = np.unique(np.concatenate(hits))
                distance = np.bitwise_count(self.prints[own] ^ p)
                near = distance <= self.radius
                found += [(q, int(i), int(d)) for i, d in zip(own[near], distance[near], strict=True)]
        return found


class Index:
    """A block of benchmark items, ready to be sought in documents."""

    def __init__(self, items: Sequence[tuple[int, str | None]], similarity: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE) -> None:
        self.similarity = similarity
        self.ids, self.counts, self.sizes = [], [], []
        posted: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        by_size = defaultdict(list)
        prints = []
        for item_id, text in items:
            w = words_of(text)
            if not len(w):
                continue
            k, s = min(shingle, len(w)), shingles(w, shingle)
            i = len(self.ids)
            self.ids.append(item_id)
            self.counts.append(Counter(s.tolist()))
            self.sizes.append((k, len(s)))
            by_size[k, len(s)].append(i)
            prints.append(fingerprints(s, len(s), np.zeros(1, int))[0])
            for x in self.counts[-1]:
                posted[k][x].append(i)
        self.lists, self.keys, self.seen = {}, {}, {}
        for k, lists in posted.items():
            self.keys[k] = np.array(sorted(lists), np.uint64)
            self.lists[k] = [lists[x] for x in self.keys[k].tolist()]
            self.seen[k] = np.zeros(_FILTER, bool)
            self.seen[k][(self.keys[k] & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        prints = np.array(prints, np.uint64)
        self.near = {size: (HammingIndex(prints[own], radius), own) for size, own in by_size.items()}

    def _starts(self, hits: np.ndarray, size: int, total: int) -> np.ndarray:
        """Starts of windows of ``size`` of ``total`` shingles that hold enough of the hits."""
        need = math.ceil(self.similarity * size - 1e-9)
        width = min(size, total)
        if len(hits) < need or width < need:
            return np.zeros(0, int)
        first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
        fits = last - first < width
        spans = [np.arange(max(0, b - width + 1), min(a, total - width) + 1) for a, b in zip(first[fits], last[fits], strict=True)]
        return np.unique(np.concatenate(spans)) if spans else np.zeros(0, int)

    def leaks(self, text: str | None) -> list[dict]:
        words = words_of(text)
        best: dict[int, tuple] = {}
        for k, keys in self.keys.items():
            if len(words) < k:
                continue
            s = shingles(words, k)
            maybe = np.flatnonzero(self.seen[k][(s & np.uint64(_FILTER - 1)).astype(np.int64)])
            at = np.searchsorted(keys, s[maybe])
            sure = keys[np.minimum(at, len(keys) - 1)] == s[maybe]
            places: dict[int, list[int]] = defaultdict(list)
            for p, x in zip(maybe[sure].tolist(), at[sure].tolist(), strict=True):
                for i in self.lists[k][x]:
                    places[i].append(p)
            starts = defaultdict(list)
            for i, hits in places.items():
                found = self._starts(np.array(hits), self.sizes[i][1], len(s))
                if len(found):
                    starts[self.sizes[i]].append(found)
            for size, found in starts.items():
                windows, width = np.unique(np.concatenate(found)), min(size[1], len(s))
                index, own = self.near[size]
                groups = np.split(windows, np.flatnonzero(np.diff(windows) > 4 * width) + 1)
                for group in groups:
                    for q, j, d in index.within(fingerprints(s, width, group)):
                        i, a = own[j], int(group[q])
                        alike = self._similarity(s[a : a + width], self.counts[i])
                        if alike >= self.similarity and (i not in best or (-alike, a) < best[i][:2]):
                            best[i] = (-alike, a, width + k - 1, d)
        return [{"item_id": self.ids[i], "start_word": a, "n_words": n, "distance": d, "similarity": -x} for i, (x, a, n, d) in sorted(best.items())]

    @staticmethod
    def _similarity(window: np.ndarray, item: Counter) -> float:
        own = Counter(window.tolist())
        least = sum(min(n, item[x]) for x, n in own.items() if x in item)
        return least / (own.total() + item.total() - least)


LEAKS = "array<struct<item_id:bigint,start_word:int,n_words:int,distance:int,similarity:double>>"


def _seeker(shared: Broadcast):
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in frames:
            yield pd.Series([own.leaks(t) for t in texts], dtype=object)

    return F.pandas_udf(run, LEAKS)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", nameless: bool = False, **options) -> DataFrame:
    """``docs`` with the column leaks: the items a document holds, each with its best window; ``nameless``: items of null id too."""
    sc = docs.sparkSession.sparkContext
    items = (benchmark if nameless else benchmark.where(benchmark["item_id"].isNotNull())).select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    blocks = in_blocks(((r["item_id"], r["text"]) for r in items.toLocalIterator()), lambda r: 1 + len(r[1] or "") // 6, BLOCK_WORDS)
    body = docs[text].cast("string")
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return appended(docs, {"leaks": _seeker(sc.broadcast(Index(first, **options)))(body)})
    found = []
    for block in chain([first, second], blocks):
        shared = sc.broadcast(Index(block, **options))
        hits = docs.select(F.md5(body.cast("binary")).alias("__text"), _seeker(shared)(body).alias("__leaks")).where(F.size("__leaks") > 0)
        found.append(stored(hits.dropDuplicates(["__text"]).withColumn("__block", F.lit(len(found))), "leaks"))
        shared.destroy()
    # no more rows a text than blocks
    rows = reduce(DataFrame.unionByName, found).groupBy("__text").agg(F.sort_array(F.collect_list(F.struct("__block", "__leaks"))).alias("__all"))
    rows = rows.select("__text", F.flatten(F.transform("__all", lambda x: x["__leaks"])).alias("__leaks"))
    kept = [c for c in docs.columns if c.lower() != "leaks"]
    packed = docs.select(F.struct(*[docs[c] for c in kept]).alias("__kept"), F.md5(body.cast("binary")).alias("__text"))
    joined = packed.join(if_small(stored(rows, "all-leaks")), "__text", "left")
    return joined.select(*[F.col("__kept").getField(c).alias(c) for c in kept], F.coalesce("__leaks", F.array().cast(LEAKS)).alias("leaks"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without leaks of any item, those of null id included."""
    return mark(docs, benchmark, nameless=True, **options).where(F.size("leaks") == 0).select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")

"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

A document's set are its distinct word shingles. Documents of equal sets form a class, and classes link when
``100 * |A & B| >= percent * |A | B|``.

*Small sets* (up to a boundary) enumerate their subsets of the overlap that a pair of sizes needs: two sets link exactly
when they share such a subset, so the members of a subset's bucket are linked without further checks and a star of
links stands for all of them. *Large sets* are scanned through inverted lists. The boundary is where enumerating
would cost more than scanning, summed over the histogram of set sizes.

Texts are cut into words once. That pass sends the first shingles of each large set in the order of their hashes, some
more than one shared shingle needs, so that linked sets share ``few`` of them; a class that has fewer shingles there which
any other class has links with none. The classes that remain are few. Their whole sets are stored, and shingles are
counted exactly: a shingle of one class only adds to no overlap, so the lists hold the rarest of the others, as far as
linked sets must share one of them.

Lists are not expanded into all pairs. In a few turns, classes are verified against hubs of other components in their
lists (the classes whose shingles are the most frequent ones, as a text is that many copies stem from); links make
components. Last, all pairs of classes of components that still differ are verified, which is exact: a pair of one
component needs no link any more. A list's largest component meets the others, never itself. Each entry says
how many shingles of the set are its own and has 256 parities of the others, hence a bound on what two sets
can share; only pairs that can link come out of a list. Components spread the least class id with pointer jumping.

Edge cases: empty and null texts have empty sets, link with nothing and are their own component. A null doc_id has its
set size and a null component, and links with nothing. Rows that share a doc_id are documents of their own (rows are
known by 64 bits of id and text); their class is named by the least doc_id in it. Repeated rows are one class. Fewer words
than a shingle make one shingle of all of them. Texts of any length are one set. Extra columns are not looked at. Classes
are named by 63 bits of a digest of their sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, stored
from .shingles import mixed, shingles, word_hashes

#: No boundary above this is tried; the histogram of sizes up to it goes to the driver.
MOST_BOUNDARY = 40
#: Cost of scanning and verifying one list entry, in enumerated subsets.
LIST_COST = 4.0
#: Shingles that a task looks at together for ones that several of its classes have.
COMBINED = 1 << 18
#: Members verified by one task's stream against one partner.
GROUP = 500
ROUNDS = 60
#: Turns in which classes are verified against hubs of their lists before all pairs of different components are, hubs of a
#: list, and those of them that a class is verified against.
TURNS, HUBS, PICKS = 3, 4, 2
#: Parities of an entry, in words of 64.
WORDS = 4
PARITIES = [f"p{i}" for i in range(WORDS)]


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; sets link from ``percent`` hundredths of Jaccard similarity."""

    words: int = 5
    percent: int = 80

    def overlap(self, a: int, b: int) -> int:
        """The least overlap of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least_size(self, n):
        """The least size of a set that links with one of ``n``, which is also the least overlap of its links."""
        return -(-self.percent * n // 100)

    def few(self, n: int) -> int:
        """How many shingles of the first ones sent two linked sets of ``n`` share; it does not fall with ``n``."""
        return 1 + (n - self.least_size(n)) // 2

    def sent(self, n: int) -> int:
        """How many first shingles of a set are sent. Of the overlap, the first ``few`` in the order are followed by at
        least ``least_size - few`` others in either set, so they stand among these."""
        return min(n, n - self.least_size(n) + self.few(n))

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; words are cut at ASCII white space and A-Z lower-cased."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.unique(shingles(word_hashes(words), self.words))


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1


# --- sets, classes, and first shingles

ROW, SENT, KNOWN, SMALL = range(4)
SETS = "part int, id bigint, row bigint, n int, cls bigint"


def _rows_of(part: int, ids, row, n, cls) -> pd.DataFrame:
    out = pd.DataFrame({"part": np.int32(part), "id": ids, "row": row, "n": n, "cls": cls})
    return out.astype({"part": "int32", "id": "Int64", "row": "int64", "n": "int32", "cls": "int64"})


def _sets(frames: Iterator[pd.DataFrame], measure: Measure) -> Iterator[pd.DataFrame]:
    """ROW: doc_id, row, set size and class of each document. SMALL: the shingles of small sets. SENT: first shingles of large
    sets; one that several classes of the task have comes once, of class -1, and KNOWN counts such shingles of a class."""
    seen: set[int] = set()
    held: list[tuple[np.ndarray, int]] = []

    def combined() -> Iterator[pd.DataFrame]:
        tokens = np.concatenate([s for s, _ in held])
        cls = np.repeat([c for _, c in held], [len(s) for s, _ in held])
        held.clear()
        values, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        several = counts[place] > 1
        alone = ~several
        yield _rows_of(SENT, tokens[alone].view(np.int64), 0, 0, cls[alone])
        common = values[counts > 1]
        yield _rows_of(SENT, common.view(np.int64), 0, 0, np.full(len(common), -1))
        own, n = np.unique(cls[several], return_counts=True)
        yield _rows_of(KNOWN, 0, 0, n, own)

    size = 0
    for frame in frames:
        rows, small = [], []
        for doc_id, row, text in zip(frame["doc_id"], frame["row"], frame["text"], strict=True):
            s = measure.set_of(text)
            cls, n = class_of(s), len(s)
            rows.append((doc_id, row, n, cls))
            if not n or pd.isna(doc_id) or cls in seen:
                continue
            if len(seen) < 200_000:  # copies within a task are one class
                seen.add(cls)
            if n <= MOST_BOUNDARY:
                small.append((s, cls))
            else:
                first = s[: measure.sent(n)].copy()
                held.append((first, cls))
                size += len(first)
                if size >= COMBINED:
                    yield from combined()
                    size = 0
        yield _rows_of(ROW, *map(list, zip(*rows, strict=True))) if rows else _rows_of(ROW, [], [], [], [])
        if small:
            yield _rows_of(SMALL, np.concatenate([s for s, _ in small]).view(np.int64), 0, 0, np.repeat([c for _, c in small], [len(s) for s, _ in small]))
    if held:
        yield from combined()


def boundary(sizes: dict[int, int], measure: Measure) -> int:
    """The largest set size for which subsets are enumerated, by cost over the histogram of sizes."""

    def subsets(n: int, top: int) -> int:
        return sum(math.comb(n, measure.overlap(n, b)) for b in range(measure.least_size(n), top + 1) if measure.least_size(b) <= n)

    def total(x: int) -> float:
        small = sum(c * subsets(n, x) for n, c in sizes.items() if n <= x)
        listed = sum(c * LIST_COST * (n - measure.least_size(n) + 1) for n, c in sizes.items() if n >= measure.least_size(x + 1))
        return small + listed

    return min(range(MOST_BOUNDARY + 1), key=lambda x: (total(x), x))


# --- small sets: subsets of the overlap

#: side 0 and 1: the smaller and the larger partner of a pair of sizes; 2: either of equal sizes; 3: a first shingle for the lists.
SUBSETS = "side int, token bigint, cls bigint"


def _enumerated(s: np.ndarray, top: int, measure: Measure) -> Iterator[tuple[int, int]]:
    """(side, key) of each subset of each overlap size needed."""
    n, m = len(s), mixed(s)
    whole = int(m.sum(dtype=np.uint64))
    values = m.tolist()
    for b in range(measure.least_size(n), top + 1):
        if measure.least_size(b) <= n:
            low, high = min(n, b), max(n, b)
            for left_out in combinations(values, n - measure.overlap(n, b)):
                yield (2 if n == b else int(n == high)), (whole - sum(left_out)) ^ (low * 1_000_003 + high)


def _subsets(frames: Iterator[pd.DataFrame], measure: Measure, top: int) -> Iterator[pd.DataFrame]:
    least_listed = measure.least_size(top + 1)
    for frame in frames:
        for first in range(0, len(frame), 256):
            sides, keys, classes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for cls, tokens in frame[["cls", "tokens"]].iloc[first : first + 256].itertuples(index=False):
                s = np.sort(np.asarray(tokens, np.int64).view(np.uint64))
                made = list(_enumerated(s, top, measure)) if len(s) <= top else []
                if made:
                    side, key = zip(*made, strict=True)
                    sides.append(np.array(side, np.int32))
                    keys.append(mixed(np.array([x & (2**64 - 1) for x in key], np.uint64)).view(np.int64))
                    classes.append(np.full(len(key), cls))
                if len(s) >= least_listed:
                    own = s[: measure.sent(len(s))].view(np.int64)
                    sides.append(np.full(len(own), 3, np.int32))
                    keys.append(own)
                    classes.append(np.full(len(own), cls))
            yield pd.DataFrame({"side": np.concatenate(sides), "token": np.concatenate(keys), "cls": np.concatenate(classes)})


def _bucket_links(subsets: DataFrame) -> DataFrame:
    """Links (a, b) of each bucket: of each member with the first one that may stand on the other side."""
    low, high = F.min(F.when(F.col("side") != 1, F.col("cls"))), F.min(F.when(F.col("side") != 0, F.col("cls")))
    pairs = subsets.groupBy("token").agg(low.alias("low"), high.alias("high"), F.max("cls").alias("last")).where("low IS NOT NULL AND high IS NOT NULL AND (low <> high OR low <> last)")
    pairs = stored(pairs.select("token", "low", "high"), "buckets")
    partner = F.when(F.col("side") == 0, F.col("high")).otherwise(F.col("low"))
    return subsets.join(if_small(pairs), "token").select(F.col("cls").alias("a"), partner.alias("b")).where("a <> b").distinct()


# --- large sets: classes that share enough first shingles


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Classes of the rows (sorted by token, cls) whose token another class has too, class -1 (several of a task) included;
    only the last row is held."""
    last, told = None, False  # the row, and whether its class is out
    for frame in frames:
        token, cls = frame["token"].to_numpy(), frame["cls"].to_numpy()
        if not len(token):
            continue
        if last is not None:
            token, cls = np.concatenate([[last[0]], token]), np.concatenate([[last[1]], cls])
        follows = np.concatenate([[False], token[1:] == token[:-1]])
        new = ~(follows & np.concatenate([[False], cls[1:] == cls[:-1]]))
        token, cls, follows = token[new], cls[new], follows[new]
        shared = follows | np.concatenate([follows[1:], [False]])
        out = shared & (cls >= 0)
        out[0] &= not told
        if out.any():
            yield pd.DataFrame({"cls": cls[out]})
        told = bool(shared[-1]) or (told and len(token) == 1)
        last = token[-1], cls[-1]


def _least_size(n: Column, percent: int) -> Column:
    return F.floor((percent * n + 99) / 100).cast("int")


def _few(n: Column, percent: int) -> Column:
    return F.floor((n - _least_size(n, percent)) / 2).cast("int") + 1


KEPT = "cls bigint, tokens binary"


def _kept(frames: Iterator[pd.DataFrame], measure: Measure) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for first in range(0, len(frame), 256):
            sets = [(cls, measure.set_of(text)) for cls, text in frame[["cls", "text"]].iloc[first : first + 256].itertuples(index=False)]
            # a row of the same hash may have another text
            yield pd.DataFrame([(cls, s.tobytes()) for cls, s in sets if class_of(s) == cls], columns=["cls", "tokens"]).astype({"cls": "int64"})


def _spread(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, cls) of each shingle of stored sets."""
    for batch in frames:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            own = [np.frombuffer(t.as_buffer(), np.int64) for t in part["tokens"]]
            cls = np.repeat(part["cls"].to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(cls)], ["token", "cls"])


ENTRIES = ", ".join(["token bigint, cls bigint, n int, own int, at int, pop float", *(f"{p} bigint" for p in PARITIES)])


def _entries(frames: Iterator[pa.RecordBatch], measure: Measure) -> Iterator[pa.RecordBatch]:
    """List entries of sets (cls, n, shared: structs of the shingles that other classes have, and how many have them): those
    among the first n - least_size + 1 in the order (how many have it, hash), where ``own`` shingles of this set come first.

    at: place in the order; pop: how common the set's shingles are; p0...: parities of hashes of the shared shingles."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    for batch in frames:
        for start in range(0, batch.num_rows, 256):
            part, rows = batch.slice(start, 256), []
            for cls, n, shared in zip(part["cls"].to_pylist(), part["n"].to_pylist(), part["shared"], strict=True):
                token, have = (shared.values.field(k).to_numpy() for k in ("token", "have"))
                own, listed = n - len(token), n - measure.least_size(n) + 1
                if own >= listed:
                    continue
                first = token[np.lexsort((token, have))[: listed - own]]
                bits = np.bincount((mixed(token.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
                pop = np.log2(have).sum() / n
                rows.append((first, np.arange(own, listed), (cls, n, own, pop, *np.packbits(bits.astype(np.uint8)).view(np.int64).tolist())))
            if rows:
                size = [len(r[0]) for r in rows]
                cls, n, own, pop, *words = (np.repeat(np.array(x), size) for x in zip(*(r[2] for r in rows), strict=True))
                columns = [np.concatenate([r[0] for r in rows]), cls, n.astype(np.int32), own.astype(np.int32), np.concatenate([r[1] for r in rows]).astype(np.int32), pop.astype(np.float32), *words]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _listed(kept: DataFrame, measure: Measure) -> DataFrame:
    """The list entries of the stored sets."""
    spread = kept.mapInArrow(_spread, "token bigint, cls bigint")
    spread = stored(spread, "shingles")
    have = spread.groupBy("token").agg(F.count("*").cast("int").alias("have")).where("have > 1")
    shared = spread.join(have, "token").groupBy("cls").agg(F.collect_list(F.struct("token", "have")).alias("shared"))
    sizes = kept.select("cls", (F.octet_length("tokens") / 8).cast("int").alias("n"))
    return shared.join(sizes, "cls").mapInArrow(partial(_entries, measure=measure), ENTRIES)


# --- pairs of a list that can link


def _can_link(one: str, other: str, percent: int) -> Column:
    """Whether two sets that share a shingle at these places of the order can link; it holds for each shared shingle of
    linked sets. They share no more before it than either has there besides its own ones, no more after it than the
    shorter rest, and they differ in their own shingles and in one for each parity that differs."""
    a, b = (lambda c: F.col(one + c)), (lambda c: F.col(other + c))
    need = F.ceil(percent * (a("n") + b("n")) / (100 + percent))
    sizes = (100 * a("n") >= percent * b("n")) & (100 * b("n") >= percent * a("n"))
    before, after = F.least(a("at") - a("own"), b("at") - b("own")), F.least(a("n") - a("at"), b("n") - b("at"))
    differ = a("own") + b("own")
    for p in PARITIES:
        differ = differ + F.bit_count(a(p).bitwiseXOR(b(p)))
    return sizes & (before + after >= need) & (a("n") + b("n") - 2 * need >= differ)


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])


def _marked(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with their components, of the lists that hold more than one component."""
    label = F.col("cls") if labels is None else F.coalesce("label", "cls")
    rows = entries if labels is None else entries.drop("label").join(labels, "cls", "left")
    rows = rows.withColumn("label", label)
    rows = stored(rows, "marked") if labels is not None else rows
    split = rows.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("token")
    return stored(rows.join(if_small(stored(split, "split")), "token"), "split-lists")


def _counted(near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share list entries enough to reach the overlap. Of the set whose entries end first in the order, all
    shared shingles up to there are counted; the rest of it has least_size - 1 shingles, and the larger set has more."""
    counted = near.groupBy(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"), F.col("a_n").alias("n1"), F.col("b_n").alias("n2")).agg(F.count("*").alias("shared"))
    need = F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent))
    return counted.where(F.col("shared") + F.ceil(percent * F.greatest("n1", "n2") / 100) - 1 >= need)


def _to_hubs(marked: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each class, the ``PICKS`` hubs of other components that it shares most list entries with, if enough. A list has
    ``HUBS`` hubs, each the class of the most common shingles among a share of the list that differs by turn."""
    share = F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(HUBS)).alias("hub")
    order = ["pop", *(c for c in marked.columns if c not in ("token", "pop"))]
    hubs = marked.groupBy("token", share).agg(F.max(F.struct(*order)).alias("h")).select("token", "h.*")
    near = _named(marked, "a_").join(_named(hubs, "b_"), (F.col("a_token") == F.col("b_token")) & (F.col("a_label") != F.col("b_label")) & _can_link("a_", "b_", percent))
    most = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    return _counted(near, percent).withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= PICKS).select("a", "b")


def _crossing(marked: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that can link. In each list the component of most entries is the main one;
    entries of the others meet all entries, so that the main one never meets itself."""
    most = marked.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "label")).alias("m"))
    most = stored(most.select("token", F.col("m.label").alias("main")), "main")
    rows = marked.join(if_small(most), "token")
    rows = stored(rows.withColumn("main", F.col("main") == F.col("label")), "sides")
    left, right = _named(rows.where("NOT main"), "a_"), _named(rows, "b_")
    once = F.col("b_main") | (F.col("a_cls") < F.col("b_cls"))
    near = left.join(right, (F.col("a_token") == F.col("b_token")) & (F.col("a_label") != F.col("b_label")) & once & _can_link("a_", "b_", percent))
    # a pair may have its main side in one list only
    a, b = F.least("a_cls", "b_cls"), F.greatest("a_cls", "b_cls")
    n1, n2 = (F.when(F.col("a_cls") < F.col("b_cls"), F.col(x)).otherwise(F.col(y)) for x, y in (("a_n", "b_n"), ("b_n", "a_n")))
    return _counted(near.select(a.alias("a_cls"), b.alias("b_cls"), n1.alias("a_n"), n2.alias("b_n")), percent).select("a", "b")


# --- verification

CHECKED = "a bigint, b bigint"


def _checked(frames: Iterator[pd.DataFrame], measure: Measure) -> Iterator[pd.DataFrame]:
    """Links of members with the partner of their group: the partner's row comes first, and one set is held."""
    key, partner = None, None
    for frame in frames:
        links = []
        for group, salt, member, cls, tokens in frame[["grp", "salt", "member", "cls", "tokens"]].itertuples(index=False):
            s = np.frombuffer(tokens, np.uint64)
            if not member:
                key, partner = (group, salt), s.copy()
            elif key == (group, salt):
                both = np.searchsorted(partner, s)
                shared = int((partner[np.minimum(both, len(partner) - 1)] == s).sum())
                if 100 * shared >= measure.percent * (len(s) + len(partner) - shared):
                    links.append((cls, group))
        yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def verified(pairs: DataFrame, kept: DataFrame, measure: Measure) -> DataFrame:
    """The links among ``pairs`` (a, b) of classes; ``kept``: their sets."""
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    partners = groups.select(F.col("b").alias("cls"), F.col("b").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    # a group of many members is known by its count; its rows are spread over the salts by their class
    members = pairs.join(groups, "b").select(F.col("a").alias("cls"), F.col("b").alias("grp"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    asked = stored(partners.unionByName(members), "asked")
    found = kept.join(if_small(asked), "cls").select("grp", "salt", "member", "cls", "tokens")
    return found.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "member").mapInPandas(partial(_checked, measure=measure), CHECKED)


# --- components


def components(edges: DataFrame) -> DataFrame:
    """cls and the least class id of its component, for classes with links."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("a", "b"), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).toDF("cls", "label"), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["cls"] == near["a"]).select("cls", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        lower = stored(lower, "labels")
        if lower.where("label <> old").isEmpty():
            return lower.drop("old")
        # a class's label is a class: its label is no greater
        jumps = lower.select(F.col("cls").alias("label"), F.col("label").alias("next"))
        labels = stored(lower.drop("old").join(jumps, "label").select("cls", F.col("next").alias("label")), "labels")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links; a class without a label is a component of its own."""
    a = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    above = components(a.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    fresh = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(labels, "cls", "left_anti").withColumn("label", F.col("cls"))
    joined = labels.unionByName(fresh).join(above.toDF("label", "top"), "label", "left")
    return stored(joined.select("cls", F.coalesce("top", "label").alias("label")), "labels")


def join(docs: DataFrame, measure: Measure = Measure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    docs = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    made = stored(docs.mapInPandas(partial(_sets, measure=measure), SETS), "sets", ["part"])
    rows = made.where(f"part = {ROW}").select(F.col("id").alias("doc_id"), "row", "n", "cls")
    first = F.min(F.struct("doc_id", "row", "n")).alias("first")
    classes = stored(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(first).select("cls", "first.*"), "classes")

    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= 2 * MOST_BOUNDARY).groupBy("n").count().collect()}
    top = boundary(sizes, measure)
    # no more than MOST_BOUNDARY shingles are gathered
    small = made.where(f"part = {SMALL}").groupBy("cls").agg(F.collect_set("id").alias("tokens"))
    subsets = stored(small.mapInPandas(partial(_subsets, measure=measure, top=top), SUBSETS), "subsets")
    links = stored(_bucket_links(subsets.where("side < 3")), "subset-links")

    sent = made.where(f"part = {SENT}").select(F.col("id").alias("token"), "cls").unionByName(subsets.where("side = 3").select("token", "cls"))
    shared = sent.repartition("token").sortWithinPartitions("token", "cls").mapInPandas(_shared, "cls bigint")
    matched = shared.withColumn("n", F.lit(1)).unionByName(made.where(f"part = {KNOWN}").select("cls", "n")).groupBy("cls").agg(F.sum("n").alias("matched"))
    enough = F.col("matched") >= _few(_least_size(F.col("n"), measure.percent), measure.percent)
    survivors = stored(classes.join(matched, "cls").where(enough).select("cls", "row"), "survivors")
    kept = stored(docs.join(if_small(survivors), "row").select("cls", "text").mapInPandas(partial(_kept, measure=measure), KEPT), "kept")
    if not kept.groupBy("cls").count().where("count > 1").isEmpty():  # repeated rows
        kept = stored(kept.dropDuplicates(["cls"]), "kept-once")
    entries = stored(_listed(kept, measure), "entries")

    labels = None if links.isEmpty() else components(links)
    for turn in range(TURNS + 1):
        entries = _marked(entries, labels)  # components only grow: a list of one component stays so
        pairs = _to_hubs(entries, measure.percent, turn) if turn < TURNS else _crossing(entries, measure.percent)
        more = stored(verified(stored(pairs, "pairs"), kept, measure), "more")
        if not more.isEmpty():
            labels = components(more) if labels is None else _joined(labels, more)
    of_class = classes.select("cls", "doc_id")
    if labels is not None:
        of_class = of_class.join(labels, "cls", "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label"))
        least = of_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        of_class = of_class.join(least, "label").select("cls", "component_id")
    else:
        of_class = of_class.select("cls", F.col("doc_id").alias("component_id"))
    of_class = stored(of_class, "components")
    linked = rows.where("n > 0 AND doc_id IS NOT NULL").join(of_class, "cls")
    alone = rows.where("n = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", "n", "component_id").union(alone.select("doc_id", "n", "component_id")).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), Measure(words=4, percent=85))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 85 * (x.n + y.n - o.o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

"""Sets of keys: alignment, intersection, difference, union, membership and late fetch of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import if_small, stored


def null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])


class KeySet:
    """Distinct keys. Operators answer each key once however often a side repeats it."""

    def __init__(self, df: DataFrame, keys: Sequence[str] | None = None, distinct: bool = True) -> None:
        self.keys = list(keys or df.columns)
        rows = df.select(*self.keys)
        self.df = rows.distinct() if distinct else rows

    def _of(self, df: DataFrame) -> KeySet:
        return KeySet(df, self.keys, distinct=False)

    def _other(self, other: KeySet) -> DataFrame:
        if len(other.keys) != len(self.keys):
            raise ValueError(f"keys differ: {self.keys} and {other.keys}")
        return other.df.toDF(*self.keys)

    def intersect(self, other: KeySet) -> KeySet:
        return self._of(self.df.intersect(self._other(other)))

    def difference(self, other: KeySet) -> KeySet:
        return self._of(self.df.subtract(self._other(other)))

    def union(self, other: KeySet) -> KeySet:
        return self._of(self.df.union(self._other(other)).distinct())

    __and__, __sub__, __or__ = intersect, difference, union

    def gallop_intersect(self, other: KeySet) -> KeySet:
        """As ``intersect`` where ``other`` should be far smaller: broadcast if a count shows that it is."""
        small = if_small(self._other(other))
        return self._of(self.df.join(small, self.keys, "left_semi"))

    def gallop_difference(self, other: KeySet) -> KeySet:
        small = if_small(self._other(other))
        return self._of(self.df.join(small, self.keys, "left_anti"))

    def merge(self, other: KeySet) -> DataFrame:
        """Every key of either side once, with ``in_left`` and ``in_right``."""
        left = self.df.withColumn("in_left", F.lit(True))
        right = self._other(other).withColumn("in_right", F.lit(True))
        both = left.join(right, self.keys, "full")
        return both.select(*self.keys, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.keys)

    def held(self) -> KeySet:
        """The set written to the shared folder once, for several uses."""
        return self._of(stored(self.df, "keyset"))

    def contains(self, *key) -> bool:
        return not self.df.where(reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.keys, key, strict=True)])).isEmpty()

    def __contains__(self, key) -> bool:
        return self.contains(*(key if isinstance(key, tuple) else (key,)))

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def fetch(self, rows: DataFrame, on: Sequence[str] | None = None, ordered: bool = True) -> DataFrame:
        """The rows of the keys; a key without one has nulls. ``on``: the key columns of ``rows``."""
        there = rows.withColumns({k: rows[c] for k, c in zip(self.keys, on or self.keys, strict=True)})
        out = self.df.join(there, self.keys, "left")
        return out.orderBy(*self.keys) if ordered else out

    def semi(self, rows: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
        """Rows whose key is in the set."""
        return rows.join(self._named(on), list(on or self.keys), "left_semi")

    def anti(self, rows: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
        """Rows whose key is not in the set."""
        return rows.join(self._named(on), list(on or self.keys), "left_anti")

    def _named(self, on: Sequence[str] | None) -> DataFrame:
        return self.df.toDF(*on) if on else self.df


def prefer_left(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either side, one a key; where both have it, the left one."""
    first = a.dropDuplicates(list(keys))
    return first.unionByName(b.dropDuplicates(list(keys)).join(first.select(*keys), list(keys), "left_anti"))

"""Aggregates: maintained reduces over rows or change rows, and folds over runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Reduce:
    """``name``: of the result. ``kind``: count, sum, high_water or low_water of ``field``. Sums are exact: integers, or
    decimals of ``places``."""

    name: str
    kind: str
    field: str | None = None
    places: int | None = None

    def _value(self) -> Column:
        if self.field is None:
            raise ValueError(f"{self.name}: {self.kind} needs a field")
        c = F.col(self.field)
        return c.cast("bigint") if self.places is None else c.cast(f"decimal(18,{self.places})")

    def over_rows(self) -> Column:
        made = {"count": lambda: F.count("*"), "sum": lambda: F.sum(self._value()), "high_water": lambda: F.max(self._value()), "low_water": lambda: F.min(self._value())}
        return made[self.kind]().alias(self.name)

    def over_changes(self, sign: str) -> Column:
        """Of rows signed +1 (folded) and -1 (unfolded). A water mark never turns back."""
        s = F.col(sign)
        made = {
            "count": lambda: F.sum(s).cast("bigint"),
            "sum": lambda: F.sum(self._value() * s),
            "high_water": lambda: F.max(F.when(s > 0, self._value())),
            "low_water": lambda: F.min(F.when(s > 0, self._value())),
        }
        return made[self.kind]().alias(self.name)


def resolve_group(key: Sequence[str], payload: Sequence[str], names: Sequence[str]) -> list[str]:
    """Group columns; a name in both the key and the payload is the key's."""
    out = []
    for n in names:
        if n not in key and n not in payload:
            raise ValueError(f"{n} is neither in the key nor in the payload")
        out.append(n)
    return out


def reduced(rows: DataFrame, group: Sequence[str], reduces: Sequence[Reduce], ordered: bool = False) -> DataFrame:
    """One row a group; no group columns: the whole table is one."""
    out = rows.groupBy(*group).agg(*[r.over_rows() for r in reduces])
    return out.orderBy(*group) if ordered and group else out


def reduce_get(rows: DataFrame, group: dict, reduces: Sequence[Reduce]) -> DataFrame:
    """One group's accumulators, or no row. The filter comes first, so only that group is read."""
    for k, v in group.items():
        rows = rows.where(F.col(k) == F.lit(v))
    return reduced(rows, list(group), reduces)


def signed(changes: DataFrame, key: Sequence[str], seq: str, op: str, columns: Sequence[str]) -> DataFrame:
    """Change rows as +1 for a put and -1 for what it or a delete takes back: the key's row before."""
    w = Window.partitionBy(*key).orderBy(seq)
    put = F.col(op) == "put"
    before = changes.withColumn("__old", F.lag(F.when(put, F.struct(*columns))).over(w))
    plus = before.where(put).select(*key, *columns, F.lit(1).alias("sign"))
    minus = before.where(F.col("__old").isNotNull()).select(*key, *[F.col("__old")[c].alias(c) for c in columns], F.lit(-1).alias("sign"))
    return plus.unionByName(minus)


def reduced_changes(changes: DataFrame, key: Sequence[str], seq: str, op: str, group: Sequence[str], reduces: Sequence[Reduce]) -> DataFrame:
    """Reduces as kept by a write path: a group that was ever written keeps its row, at zero if all left."""
    columns = list(dict.fromkeys([g for g in group if g not in key] + [r.field for r in reduces if r.field and r.field not in key]))
    return signed(changes, key, seq, op, columns).groupBy(*group).agg(*[r.over_changes("sign") for r in reduces])


def runs(rows: DataFrame, key: Sequence[str], order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``run``: which run of equal ``key`` values in ``order`` they are in, from 1. ``within``: streams that are
    ordered apart; without, the order is one of the whole input and one task follows it."""
    w = Window.partitionBy(*within).orderBy(*order)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    first = F.lag(F.lit(1)).over(w).isNull()
    return rows.withColumn("__starts", F.when(first | ~same, 1).otherwise(0)).withColumn("run", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def group_fold(rows: DataFrame, key: Sequence[str], order: Sequence[str], aggregates: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """Folds runs: a key that comes again after another makes a group of its own again."""
    return runs(rows, key, order, within).groupBy(*within, "run", *key).agg(*aggregates)


def rollup_levels(rows: DataFrame, levels: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by each leading part of ``levels``, shortest first (``level`` fields of it are set), by one expansion."""
    # grouping_id has a bit for each field that is rolled up
    level = F.lit(len(levels)) - F.expr("bit_count(grouping_id())").cast("int")
    return rows.rollup(*levels).agg(*aggregates, level.alias("level")).where("level > 0")


def merged_reduce(rows: DataFrame, group: Sequence[str], seed: Callable, fold: Callable, merge: Callable, schema: str) -> DataFrame:
    """A host fold that can be cut: ``fold(acc, row)`` over the rows of a group that a task has, then ``merge(acc, acc)`` of
    what tasks have made, in no set order. A hot group sends an accumulator (a tuple as ``schema`` says) a task, and tasks
    hold ``FOLDED`` groups."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema)
    place = [rows.columns.index(g) for g in group]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame([(*k, *acc) for k, acc in held.items()], columns=[*group, *names])
            held.clear()
            return made

        for frame in frames:
            for row in frame.itertuples(index=False):
                key = tuple(row[i] for i in place)
                held[key] = fold(held[key] if key in held else seed(), row)
                if len(held) >= FOLDED:
                    yield out()
        if held:
            yield out()

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = frame[names].itertuples(index=False, name=None)
        return pd.DataFrame([(*key, *reduce(merge, parts))], columns=[*group, *names])

    return rows.mapInPandas(partial, f"{kinds}, {schema}").groupBy(*group).applyInPandas(whole, f"{kinds}, {schema}")


#: Groups whose accumulators a task holds before it sends them.
FOLDED = 100_000


def user_reduce(rows: DataFrame, group: Sequence[str], fold: Callable, seed: Callable, schema: str, order: Sequence[str] = ()) -> DataFrame:
    """A host fold: ``seed()`` then ``fold(acc, row)`` over a group's rows, in ``order``; the result is the accumulator."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        acc = seed()
        if order:
            frame = frame.sort_values(list(order))
        for row in frame.itertuples(index=False):
            acc = fold(acc, row)
        return pd.DataFrame([(*key, *(acc if isinstance(acc, tuple) else (acc,)))], columns=names)

    return rows.groupBy(*group).applyInPandas(run, schema)


def byte_reduce(changes: DataFrame, group: Sequence[str], seq: str, sign: str, value: str, seed: Callable[[], bytes], fold: Callable, unfold: Callable) -> DataFrame:
    """A host reduce on bytes: folds of +1 rows and unfolds of -1 rows in order; a group is seeded by its first fold, and
    an unfold before it is left out."""
    schema = changes.select(*group).schema
    spelled = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "acc binary"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        acc = None
        for s, v in frame.sort_values(seq)[[sign, value]].itertuples(index=False):
            if s > 0:
                acc = fold(seed() if acc is None else acc, v)
            elif acc is not None:
                acc = unfold(acc, v)
        return pd.DataFrame([(*key, acc)], columns=[*schema.names, "acc"])

    return changes.groupBy(*group).applyInPandas(run, spelled)

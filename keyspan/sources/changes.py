"""Change rows and the fold that makes current state of them.

A change row has the key, the declared columns, ``ks_op`` (put, put_open, del), ``ks_slot`` (1: only the open half),
``ks_seq`` (the order) and ``cell``, open fields as JSON text. A put makes the document live, a whole delete ends both
halves, an open delete ends the open half, and cells merge from left to right; a later put leaves the open half alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.documents import json_text, merged
from ..session import if_small, stored

OP, SLOT, SEQ, CELL = "ks_op", "ks_slot", "ks_seq", "cell"


class SchemaDrift(ValueError):
    pass


def aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """The union by name, columns in the order they first appear; a missing one is null, one of two types is refused."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            if kinds.setdefault(f.name, f.dataType) != f.dataType:
                raise SchemaDrift(f"{f.name} is {kinds[f.name].simpleString()} and {f.dataType.simpleString()}")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*kinds)


def as_changes(df: DataFrame) -> DataFrame:
    """Final rows as change rows: a frame without ``ks_op``, or with a null one, is all puts."""
    op = F.coalesce(F.col(OP), F.lit("put")) if OP in df.columns else F.lit("put")
    out = df.withColumn(OP, op)
    for name, kind in ((SLOT, "int"), (CELL, "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def current_state(changes: DataFrame, key: Sequence[str], order: Sequence[str] = (SEQ,), renumber: bool = True) -> DataFrame:
    """One row a live key. The two passes are aggregates by key, and the window between them needs only the last deletes."""
    changes = as_changes(changes)
    columns = [c for c in changes.columns if c not in (*key, OP, SLOT, SEQ, CELL, *order)]
    rows = changes.withColumn("__pos", F.struct(*order))
    whole = (F.col(OP) == "del") & ~F.coalesce(F.col(SLOT) == 1, F.lit(False))
    open_ = (F.col(OP) == "del") & F.coalesce(F.col(SLOT) == 1, F.lit(False))
    ends = rows.where(F.col(OP) == "del").groupBy(*key).agg(F.max(F.when(whole, F.col("__pos"))).alias("__d"), F.max(F.when(whole | open_, F.col("__pos"))).alias("__od"))
    rest = rows.where(F.col(OP) != "del").join(ends, list(key), "left")

    def after(mark: str) -> Column:
        return F.col(mark).isNull() | (F.col("__pos") > F.col(mark))

    put = (F.col(OP) == "put") & after("__d")
    alive = F.col(OP).isin("put", "put_open") & after("__d")
    folded = rest.groupBy(*key).agg(
        F.max(F.when(put, F.col("__pos"))).alias("__pp"),
        F.max_by(F.struct(*columns) if columns else F.struct(F.lit(1).alias("__none")), F.when(put, F.col("__pos"))).alias("__row"),
        F.max(F.when(alive, F.col("__pos"))).alias("__sp"),
        F.count_if(F.col(CELL).isNotNull() & after("__od")).alias("__cells"),
    )
    cells = rest.where(F.col(CELL).isNotNull() & after("__od")).select(*key, "__pos", CELL)
    live = folded.join(folded_cells(cells, key, "__pos"), list(key), "left")
    live = live.where(F.col("__pp").isNotNull() | (F.col("__sp").isNotNull() & (F.col("__cells") > 0)))
    out = live.select(
        *key,
        *[F.when(F.col("__pp").isNotNull(), F.col("__row")[c]).alias(c) for c in columns],
        F.when(F.col("__pp").isNotNull(), "put").otherwise("put_open").alias(OP),
        F.lit(None).cast("int").alias(SLOT),
        F.coalesce("__pp", "__sp").alias("__at"),
        CELL,
    )
    if not renumber:
        return out.select(*key, *columns, OP, SLOT, CELL, F.col("__at").alias("last_write"))
    return numbered(out, "__at", SEQ).drop("__at")


def folded_cells(cells: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Each key's cells merged from left to right, as they pass in order: what is held is one key's merged cell, however many
    it has. (Merging can't be cut and put together: a value that replaces a map ends what came before it.)"""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*key).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, acc = None, None
        for frame in frames:
            out = []
            for *k, text in frame.itertuples(index=False, name=None):
                if k != last:
                    if last is not None:
                        out.append((*last, json_text(acc)))
                    last, acc = k, None
                value = json.loads(text)
                acc = value if acc is None else merged(acc, value)
            if out:
                yield pd.DataFrame(out, columns=[*key, CELL])
        if last is not None:
            yield pd.DataFrame([(*last, json_text(acc))], columns=[*key, CELL])

    # by a hash: where a join already dealt by the key, Spark drops a repartition by it, and may then read that join unshuffled
    return cells.repartition(F.xxhash64(*key)).sortWithinPartitions(*key, order).select(*key, CELL).mapInPandas(run, f"{kind}, {CELL} string")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Dense numbers from 0 in ``order`` without one task for all rows: sorted ranges, then each range's count before it."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    ranged = stored(ranged, "numbered")
    # a row a range
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("__base"))
    return ranged.join(F.broadcast(bases), "__p").withColumn(name, (F.col("__base") + F.col("__i")).cast("bigint")).drop("__p", "__i", "__base")


def project_window(ops: DataFrame, key: Sequence[str], order: Sequence[str] = (SEQ,)) -> tuple[DataFrame, DataFrame]:
    """A log window (``kind``: put, del, dynamic, derived_del) as change rows, and a count of derived deletes, which are not
    written. Open fields of a put ride its row; others are put_open rows."""
    derived = ops.where(F.col("kind") == "derived_del").agg(F.count("*").alias("derived_deletes"))
    op = F.when(F.col("kind") == "dynamic", "put_open").otherwise(F.col("kind"))
    rows = ops.where(F.col("kind") != "derived_del").withColumn(OP, op).drop("kind")
    return rows, derived


def captured(old: DataFrame, new: DataFrame, key: Sequence[str], touched: DataFrame | None = None, open_column: str = "open", first_seq: int = 0) -> DataFrame:
    """What a write did, as change rows numbered from ``first_seq`` in the order of keys: a put of each document that is new
    or changed, a delete of each that is gone, nothing for one written as it was. ``touched``: the keys that were written,
    without which whole tables are compared.

    An open half that changed is ended and written anew, so that names which are gone do not come back by a merge."""
    if touched is not None:
        asked = if_small(touched.select(*key).distinct())
        old, new = old.join(asked, list(key), "left_semi"), new.join(asked, list(key), "left_semi")
    declared = [c for c in old.columns if c not in key and c != open_column]
    has_open = open_column in old.columns

    def half(df: DataFrame, name: str) -> DataFrame:
        cell = F.col(open_column) if has_open else F.lit(None).cast("string")
        return df.select(*key, F.struct(*[F.col(c).alias(c) for c in declared], cell.alias(CELL)).alias(name))

    both = half(old, "__a").join(half(new, "__b"), list(key), "full")
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    for c in [*declared, CELL]:
        same = same & F.col("__a")[c].eqNullSafe(F.col("__b")[c])
    there, gone = F.col("__a").isNotNull(), F.col("__b").isNull()
    moved = ~F.col(f"__a.{CELL}").eqNullSafe(F.col(f"__b.{CELL}"))

    def change(place: int, op: str, slot: int | None, full: bool) -> Column:
        values = [(F.col("__b")[c] if full else F.lit(None).cast(old.schema[c].dataType)).alias(c) for c in declared]
        cell = F.when(moved, F.col(f"__b.{CELL}")) if full else F.lit(None).cast("string")
        return F.struct(F.lit(place).alias("__place"), *values, F.lit(op).alias(OP), F.lit(slot).cast("int").alias(SLOT), cell.alias(CELL))

    ended = there & F.col(f"__a.{CELL}").isNotNull() & moved
    rows = F.when(gone, F.array(change(0, "del", None, False))).otherwise(F.filter(F.array(F.when(ended, change(0, "del", 1, False)), change(1, "put", None, True)), lambda c: c.isNotNull()))
    out = both.where(~same).select(*key, F.explode(rows).alias("__c")).select(*key, "__c.*")
    out = numbered(out.withColumn("__order", F.struct(*key, "__place")), "__order", SEQ)
    return out.select(*key, *declared, OP, SLOT, (F.col(SEQ) + first_seq).alias(SEQ), CELL)


def reconcile(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """What makes ``new`` equal to ``old``: each key as adopted (only or differently in old), removed or unchanged."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("__a"))
    b = new.select(*key, F.struct(*rest).alias("__b"))
    same = F.lit(True)
    for c in rest:
        same = same & F.col("__a")[c].eqNullSafe(F.col("__b")[c])
    verdict = F.when(F.col("__b").isNull(), "adopted").when(F.col("__a").isNull(), "removed").when(same, "unchanged").otherwise("adopted")
    return a.join(b, list(key), "full").select(*key, verdict.alias("verdict"))


def replayed(baseline: DataFrame, tail: DataFrame, key: Sequence[str], order: Sequence[str] = (SEQ,)) -> DataFrame:
    """State from a baseline and the changes after it: the baseline's rows come before all of the tail."""
    first = as_changes(baseline).withColumn("__late", F.lit(0))
    last = as_changes(tail).withColumn("__late", F.lit(1))
    return current_state(aligned([first, last]), key, ("__late", *order))

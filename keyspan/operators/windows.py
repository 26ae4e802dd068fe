"""What each row sees of the rows before it in its stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _stream(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """The values of ``columns`` in the row before of the same key; null at first sight."""
    w = _stream(keys, order)
    return rows.withColumns({prefix + c: F.lag(c).over(w) for c in columns})


def changed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "is_changed") -> DataFrame:
    """Whether ``value`` differs from the row before of the key; true at first sight."""
    w = _stream(keys, order)
    first = F.lag(F.lit(1)).over(w).isNull()
    return rows.withColumn("__v", value).withColumn(name, first | ~F.col("__v").eqNullSafe(F.lag("__v").over(w))).drop("__v")


def clamped_clock(rows: DataFrame, streams: Sequence[str], order: Sequence[str], ts: str, name: str = "clamped") -> DataFrame:
    """A time stamp that never falls within a stream."""
    w = _stream(streams, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.max(ts).over(w))


def offsets(rows: DataFrame, streams: Sequence[str], order: Sequence[str], name: str = "offset", first: Column | None = None) -> DataFrame:
    """A dense counter of each stream, from 0 or ``first``."""
    return rows.withColumn(name, (F.row_number().over(_stream(streams, order)) - 1 + (F.lit(0) if first is None else first)).cast("bigint"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: an aggregate, so that tasks combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return best.select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in rows.columns])

"""Event streams: (op, epoch, key, document) rows from files, with stateless and keyed operators.

Each keyed operator has a batch twin in ``operators.windows``. State holds the last document of a key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch


def source(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """A stream over the files of a folder that match, as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def keep(stream: DataFrame, condition: Column) -> DataFrame:
    return stream.where(condition)


def keep_field(stream: DataFrame, field: str, test: Callable[[Column], Column]) -> DataFrame:
    return stream.where(test(F.col(f"document.{field}")))


def mapped(stream: DataFrame, *columns: Column) -> DataFrame:
    return stream.select(*columns)


def _keyed(stream: DataFrame, key: str, order: str, value: str, out: str, row: Callable) -> DataFrame:
    """``row(previous JSON or None, JSON) -> tuple of added values`` for each event of a key in order."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values(order)
        rows = []
        for at, text in frame[[order, value]].itertuples(index=False):
            rows.append((group[0], at, *row(last, text)))
            last = text
        state.update((last,))
        yield pd.DataFrame(rows, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, out, "last string", "append", GroupStateTimeout.NoTimeout)


def with_previous(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, the value's previous text (null at first sight) and its text."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, previous string, value string"
    return _keyed(stream, key, order, value, out, lambda last, text: (last, text))


def distinct_by(stream: DataFrame, key: str, order: str, value: str, fields: Sequence[str] | None = None) -> DataFrame:
    """key, order, whether the value (or its JSON ``fields``) changed, and the value; first sight is a change."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, is_changed boolean, value string"

    def view(text: str) -> object:
        return text if fields is None else [json.loads(text).get(f) for f in fields]

    return _keyed(stream, key, order, value, out, lambda last, text: (last is None or view(last) != view(text), text))


def maintained(stream: DataFrame, group: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """A reduce kept as rows arrive; write it in complete or update mode."""
    return stream.groupBy(*group).agg(*aggregates)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Takes all that is there, once: each micro-batch is written in a folder of its own number, so that a batch that runs
    again replaces itself; the position moves when a batch is done."""

    def write(batch: DataFrame, number: int) -> None:
        out = batch if each is None else each(batch, number)
        name = "batch=0" if mode == "complete" else f"batch={number}"
        out.write.mode("overwrite").parquet(f"{path}/{name}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives over all that is there now."""
    spark = stream.sparkSession
    path = scratch(spark, "drained")
    drain(stream, path, scratch(spark, "position"), mode)
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)

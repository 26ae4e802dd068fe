"""An append-only record log in time buckets: Parquet partitioned by bucket and stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucket_of
from ..operators.windows import clamped_clock, offsets
from ..session import if_small
from .files import Files


class SeriesError(ValueError):
    pass


@dataclass(frozen=True)
class Format:
    per_second: int = 1_000_000
    bucket_seconds: int = 86_400

    def bucket(self, ts: Column) -> Column:
        return bucket_of(ts, self.per_second, self.bucket_seconds)


def rendered(value: Column, kind: str) -> Column:
    """A stream's name in paths: text as it is, numbers in decimal, bytes in hex."""
    return F.lower(F.hex(value)) if kind == "binary" else value.cast("string")


def stamped(records: DataFrame, fmt: Format, order: list[str], stream: str | None = None, tail: DataFrame | None = None) -> DataFrame:
    """Records with ``ts`` (never falling within a stream), ``offset`` (dense in it) and ``bucket``. ``tail``: partition,
    next_offset and last_ts of what is already in the log. Without a stream all records are one, in one task's order."""
    kind = records.schema[stream].dataType.simpleString() if stream else ""
    rows = records.withColumn("partition", rendered(F.col(stream), kind) if stream else F.lit(None).cast("string"))
    if stream:
        missing = F.raise_error(F.lit("a record without its stream's value")).cast("string")
        rows = rows.withColumn("partition", F.when(F.col("partition").isNull(), missing).otherwise(F.col("partition")))
    rows = rows.withColumn("__clock", F.col("ts"))
    if tail is not None:
        t = tail.select(F.col("partition").alias("__p"), "next_offset", "last_ts")
        rows = rows.join(if_small(t), rows["partition"].eqNullSafe(F.col("__p")), "left").drop("__p")
        rows = rows.withColumn("__clock", F.greatest("ts", F.coalesce("last_ts", "ts")))
        first = F.coalesce("next_offset", F.lit(0))
    else:
        first = F.lit(0)
    rows = clamped_clock(rows, ["partition"], order, "__clock", "__clamped")
    rows = offsets(rows, ["partition"], order, "offset", first)
    return rows.withColumn("ts", F.col("__clamped")).withColumn("bucket", fmt.bucket(F.col("ts"))).drop("__clock", "__clamped", "next_offset", "last_ts")


def read(log: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """Records from an offset on; cut to ``most`` in the order of parts (first offset, bucket, stream), then by time."""
    rows = log.where(F.col("offset") >= start)
    if most is None:
        return rows.orderBy("ts", "offset")
    parts = log.groupBy("bucket", "partition").agg(F.min("offset").alias("first_offset"))
    r, p = rows.alias("r"), parts.alias("p")
    placed = r.join(p, (F.col("r.bucket") == F.col("p.bucket")) & F.col("r.partition").eqNullSafe(F.col("p.partition"))).select("r.*", "first_offset")
    return placed.orderBy("first_offset", "bucket", "partition", "offset").limit(most).drop("first_offset").orderBy("ts", "offset")


def read_stream(log: DataFrame, stream: str | None, start: int = 0) -> DataFrame:
    return log.where(F.col("partition").eqNullSafe(F.lit(stream)) & (F.col("offset") >= start)).orderBy("offset")


def read_time(log: DataFrame, fmt: Format, low: int, high: int, stream: str | None = None, any_stream: bool = True) -> DataFrame:
    """Records with ``low <= ts <= high``; the buckets' bounds prune partitions."""
    size = fmt.per_second * fmt.bucket_seconds
    rows = log.where(F.col("bucket").between(low // size, high // size) & F.col("ts").between(low, high))
    return (rows if any_stream else rows.where(F.col("partition").eqNullSafe(F.lit(stream)))).orderBy("ts", "offset")


def parts(log: DataFrame) -> DataFrame:
    return log.groupBy("bucket", "partition").agg(F.min("offset").alias("first_offset"), F.count("*").alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def retained(log: DataFrame, fmt: Format, ts: int) -> DataFrame:
    """Without buckets before the one of ``ts``."""
    return log.where(F.col("bucket") >= ts // (fmt.per_second * fmt.bucket_seconds))


class SeriesLog:
    """The log as files: ``append`` adds, ``retain`` drops whole buckets."""

    def __init__(self, spark: SparkSession, path: str, fmt: Format = Format(), stream: str | None = None) -> None:
        self.spark, self.path, self.fmt, self.stream = spark, path.rstrip("/"), fmt, stream
        self.files = Files(spark, self.path)

    def log(self) -> DataFrame:
        if not self.exists():
            raise SeriesError("the log is empty")
        df = self.spark.read.parquet(self.path)
        name = F.when(F.col("stream") == "all", F.lit(None)).otherwise(F.expr("substring(stream, 3)"))
        return df.withColumn("partition", name.cast("string")).drop("stream").withColumn("bucket", F.col("bucket").cast("bigint"))

    def exists(self) -> bool:
        return any(i.name.startswith("bucket=") for i in self.files.list())

    def tail(self) -> DataFrame | None:
        if not self.exists():
            return None
        return self.log().groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"), F.max("ts").alias("last_ts"))

    def append(self, records: DataFrame, order: list[str]) -> None:
        rows = stamped(records, self.fmt, order, self.stream, self.tail())
        named = rows.withColumn("stream", F.when(F.col("partition").isNull(), "all").otherwise(F.concat(F.lit("s="), "partition"))).drop("partition")
        named.write.mode("append").option("compression", "zstd").partitionBy("bucket", "stream").parquet(self.path)

    def retain(self, ts: int) -> list[int]:
        """Drops buckets before the one of ``ts`` and returns them."""
        first = ts // (self.fmt.per_second * self.fmt.bucket_seconds)
        gone = sorted(int(i.name.split("=")[1]) for i in self.files.list() if i.name.startswith("bucket=") and int(i.name.split("=")[1]) < first)
        for b in gone:
            self.files.delete(f"bucket={b}")
        return gone

    def parts(self) -> DataFrame:
        return parts(self.log())

    def follow(self, position: int, most: int) -> tuple[DataFrame, int]:
        """The next records and the position after them."""
        rows = read(self.log(), position, most)
        last = rows.agg(F.max("offset")).first()[0]
        return rows, position if last is None else last + 1

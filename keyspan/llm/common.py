"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of a small side in a salted join; a hot key is spread over as many tasks.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a local master has one of its own; a cluster,
    whose executors would not see it, must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/keyspan-shared"
    return found.rstrip("/")


#: The folder that scratch tables go to now, below the shared one.
_FOLDER = ContextVar("folder", default="keyspan")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{_FOLDER.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made meanwhile are deleted at the end, so what comes of them must be stored elsewhere by then."""
    own = f"keyspan/run-{uuid.uuid4().hex}"
    token = _FOLDER.set(own)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{own}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that Python workers are sent together where a scratch table is made: whole texts, so a few MB.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000
#: Bytes of such rows, and rows that a scan of Parquet decodes together.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SCAN_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def held(spark: SparkSession, confs: dict[str, str]) -> Iterator[None]:
    """``confs`` hold meanwhile; afterwards they are as they were."""
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, partitions: Sequence[str] = (), path: str | None = None, codec: str = "snappy", options: dict[str, str] | None = None, confs: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Most tables are hashes, which no codec makes smaller; ``codec``, ``options``: others for texts. ``confs`` hold while it is
    written."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    most = int(spark.conf.get(BATCH))
    with held(spark, {BATCH: str(min(most, BATCH_ROWS) if most > 0 else BATCH_ROWS), **(confs or {})}):
        df.write.options(compression=codec, **(options or {})).partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids and numbers that may be broadcast: about 15 MB.
BROADCAST_ROWS = 250_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count, cut off beyond ``most``, shows that it has few rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def appended(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` added; a column of the same name in ``df`` is replaced."""
    taken = {c.lower() for c in columns}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def salted(small: DataFrame, salts: int = SALTS) -> DataFrame:
    """``small`` once per salt; the other side of the join takes ``salt_of`` its own row id."""
    return small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(*ids: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int").alias("__salt")


def in_blocks(rows: Iterable, weight, most: int):
    """Consecutive blocks of ``rows`` whose summed weight stays near ``most``; one heavy row is a block of its own."""
    block, total = [], 0
    for row in rows:
        w = weight(row)
        if block and total + w > most:
            yield block
            block, total = [], 0
        block.append(row)
        total += w
    if block:
        yield block

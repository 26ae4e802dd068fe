"""Sessions and sizes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame of up to this many rows may be broadcast, if its rows are keys (under about 64 MB).
BROADCAST_ROWS = 1_000_000


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and small runs; a cluster brings its own."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count, cut off beyond ``most`` rows, shows that it is small; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset a local master has one of its own; a
    cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/keyspan-shared"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/keyspan/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Mixing sources to target weights by Poisson replication.

Each document of a source repeats a Poisson number of times whose mean is the source's target repetition rate,
``weight / sum of weights * total / documents of the source``. The number is drawn by inverting the distribution at a
uniform value hashed from the seed and the document's id, so that it does not change when a lost task runs again.
Documents are exploded by their count and dealt out at random. Only DataFrame functions are used.

Edge cases: a null source is a source of its own; a source without a weight has the weight 0 when weights are given.
Rows that share a doc_id draw the same number, and are dealt out one by one; rows of a null doc_id draw by their text.
Empty and long texts are treated like others. An empty table gives an empty result. ``mix_copy`` and ``mix_key`` replace columns of these names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, salt_of, salted

SEED = "keyspan-mix-1"
#: A larger mean is the sum of as many equal Poisson draws as keep each below it (exp(-mean) must not underflow).
CHUNK = 256.0
#: Sources of up to this many are broadcast with their tables (a row of at most about 5 KB).
BROADCAST_SOURCES = 2_000
#: Parts that the rows of one key are dealt to.
DEAL = 64


def uniform(seed: str, doc_id: Column, part: Column | int = 0) -> Column:
    """A uniform value in [0, 1) from 52 bits of an MD5."""
    part = part if isinstance(part, Column) else F.lit(part)
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), part.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """The distribution function at 0, 1, ... up to where the rest is below any uniform value's step."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / k)).alias("c")),
        lambda acc: acc["c"],
    )


def inverse(cdf: Column, u: Column) -> Column:
    return F.size(F.filter(cdf, lambda c: c < u))


def rates(docs: DataFrame, weights: Mapping[str, float] | None, source: str, total: float | None) -> tuple[DataFrame, int]:
    """A row a source: its number of chunks and the distribution function of a chunk. Weights default to equal ones."""
    sizes = docs.groupBy(docs[source].alias("__source")).agg(F.count("*").alias("__n"))
    n_sources, rows = sizes.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    whole = float(rows if total is None else total)
    if weights is None:
        share = F.lit(1.0 / max(n_sources, 1))
    else:
        all_weights = float(sum(weights.values())) or 1.0
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(w / all_weights)).otherwise(share)
    mean = F.lit(whole) * share / F.col("__n")
    out = sizes.withColumn("__mean", mean).withColumn("__chunks", F.greatest(F.lit(1), F.ceil(F.col("__mean") / CHUNK).cast("int")))
    return out.select("__source", "__mean", "__chunks", poisson_cdf(F.col("__mean") / F.col("__chunks")).alias("__cdf")), n_sources


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", total: float | None = None, seed: str = SEED, shuffle: bool = True) -> DataFrame:
    """``docs`` repeated and shuffled: columns of ``docs``, then mix_copy (from 1) and mix_key (the order)."""
    rate, n_sources = rates(docs, weights, source, total)
    docs = appended(docs, {"__src": F.coalesce(F.concat(F.lit("="), docs[source].cast("string")), F.lit("null"))})
    by_text = F.concat(F.lit("null:"), F.md5(docs[text].cast("string").cast("binary"))) if text in docs.columns else F.lit(None)
    docs = docs.withColumn("__id", F.coalesce(docs[doc_id].cast("string"), by_text, F.lit("null")))
    # repeated rows have one key: the place in the input, the same when a task runs again, spreads them
    docs = docs.withColumn("__place", F.monotonically_increasing_id())
    rate = rate.withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col("__source").cast("string")), F.lit("null"))).drop("__source")
    if n_sources <= BROADCAST_SOURCES:
        with_rate = docs.join(F.broadcast(rate), "__src")
    else:
        with_rate = docs.withColumn("__salt", salt_of("__id")).join(salted(rate), ["__src", "__salt"]).drop("__salt")
    draws = F.transform(F.sequence(F.lit(0), F.col("__chunks") - 1), lambda i: inverse(F.col("__cdf"), uniform(seed, F.col("__id"), i)))
    count = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    counted = with_rate.withColumn("__count", count).where("__count > 0").drop("__cdf", "__mean", "__chunks", "__src")
    counted = counted.drop("mix_copy", "mix_key")
    out = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__count")))).drop("__count")
    digest = F.md5(F.concat_ws(":", F.lit(seed + "/order"), F.col("__id"), F.col("mix_copy").cast("string")))
    out = out.withColumn("mix_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")).drop("__id")
    if shuffle:
        out = out.withColumn("__deal", F.pmod(F.col("__place"), F.lit(DEAL))).repartition("mix_key", "__deal").sortWithinPartitions("mix_key").drop("__deal")
    return out.drop("__place")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
means AS (SELECT source, CAST((SELECT count(*) FROM documents) AS DOUBLE) * (CAST(1 AS DOUBLE) / (SELECT count(*) FROM sizes)) / n AS m FROM sizes),
cdf(source, m, k, p, c) AS (
  SELECT source, m, 0, exp(-m), exp(-m) FROM means
  UNION ALL
  SELECT source, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k < ceil(m + 12 * sqrt(m) + 30)),
u AS (SELECT *, CAST(('0x' || substr(md5('keyspan-mix-1:' || doc_id || ':0'), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
counts AS (SELECT u.doc_id, u.source, count(*) AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c < u.u GROUP BY u.doc_id, u.source),
copies AS (SELECT doc_id, unnest(range(1, copies + 1)) AS mix_copy FROM counts)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(mix_copy AS INTEGER) AS mix_copy,
       CAST(('0x' || substr(md5('keyspan-mix-1/order:' || d.doc_id || ':' || mix_copy), 1, 15)) AS BIGINT) AS mix_key
FROM documents d JOIN copies USING (doc_id)
"""

"""URL filters by host-suffix and path-prefix expressions.

Each URL expands into (host suffix, path prefix) expressions, at the label boundaries of the host and at the path
lengths that occur in the rules. An equi-join on the first four bytes of the expression's SHA-256 finds candidate
rules, the full digest confirms them, and the longest rule wins.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule. Of rules of equal length
the one first in text order wins; the same rule listed as both allow and block blocks. Repeated rows are judged
alike, extra columns are kept, and ``host``, ``path``, ``rule`` and ``verdict`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of up to this many are broadcast (under 40 MB); more are joined by a shuffle.
BROADCAST_RULES = 200_000
#: Hex digits of the join key: four bytes.
SHORT = 8


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The production list.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def expressions(host: Column, path: Column, lengths: Sequence[int], labels: int) -> Column:
    """An array of (host suffix, path prefix): suffixes of up to ``labels`` labels, prefixes of the given lengths."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    fitting = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length(path))
    prefixes = F.transform(fitting, lambda k: F.substring(path, F.lit(1), k))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row a rule; blocks win over allows of the same host and path."""
    rows = {}
    for r in rules:
        key = (r.host.translate(str.maketrans(UPPER, LOWER)), r.path)
        rows[key] = "block" if "block" in (r.verdict, rows.get(key)) else r.verdict
    frame = spark.createDataFrame([(h, p, v) for (h, p), v in sorted(rows.items())], "r_host string, r_path string, r_verdict string")
    digest = F.sha2(F.concat_ws("\x00", "r_host", "r_path"), 256)
    return frame.select(
        F.substring(digest, 1, SHORT).alias("r_short"),
        digest.alias("r_digest"),
        F.concat("r_host", "r_path").alias("r_rule"),
        "r_verdict",
    )


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(pages[url].cast("string"))
    base = appended(pages, {"host": host, "path": path}).drop("rule", "verdict")
    if not rules:
        return appended(base, {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # helper columns stand beside one struct of all that is kept, so that no name of the input can clash
    kept = base.columns
    packed = base.select(F.struct(*[base[c] for c in kept]).alias("__kept"), F.monotonically_increasing_id().alias("__row"))
    lengths = sorted({len(r.path) for r in rules})
    labels = max(r.host.count(".") + 1 for r in rules)
    listed = rules_table(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    made = packed.withColumn("__e", F.explode_outer(expressions(F.col("__kept.host"), F.col("__kept.path"), lengths, labels)))
    digest = F.sha2(F.concat_ws("\x00", "__e.host", "__e.path"), 256)
    made = made.withColumn("__digest", digest).drop("__e").withColumn("__short", F.substring("__digest", 1, SHORT))
    hits = made.join(listed, F.col("__short") == F.col("r_short"), "left")
    sure = F.col("__digest") == F.col("r_digest")
    # the least of (negated length, text): the longest rule, of equal ones the first in text order
    best = F.min(F.when(sure, F.struct((-F.length("r_rule")).alias("n"), F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict"))))
    out = hits.groupBy("__row").agg(F.first("__kept").alias("__kept"), best.alias("__best"))
    return out.select(*[F.col("__kept").getField(c).alias(c) for c in kept], F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rules(h, p, v) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'),
                               ('com','/fr/','allow'), ('com','/de/','block')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT u.page_id, u.host, u.path, max_by(r.h || r.p, length(r.h || r.p)) AS rule,
       coalesce(max_by(r.v, length(r.h || r.p)), 'allow') AS verdict
FROM u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
GROUP BY u.page_id, u.host, u.path
"""

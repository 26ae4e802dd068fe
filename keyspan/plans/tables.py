"""Versioned tables, change rows, the series log and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucket_of
from ..operators.reduces import Reduce, reduced
from ..schema import CollectionSchema, Field
from ..session import scratch
from ..sources import changes as ch
from ..sources import lake, series
from ..streaming import events as ev
from .registry import Tables, query

#: Events as change rows of the key user_id, in the order of event_id.
CHANGES = """(SELECT user_id, value, event_type, CASE event_id % 7 WHEN 0 THEN 'del' WHEN 1 THEN 'put_open' WHEN 2 THEN 'put_open' ELSE 'put' END AS op,
CASE WHEN event_id % 14 = 0 THEN 1 END AS slot, event_id AS seq, CASE WHEN event_id % 7 IN (1, 2, 3) THEN props END AS cell FROM events)"""


def fold_sql(source: str) -> str:
    return f"""WITH c AS (SELECT * FROM {source}),
d AS (SELECT user_id, max(CASE WHEN op = 'del' AND slot IS DISTINCT FROM 1 THEN seq END) AS d, max(CASE WHEN op = 'del' THEN seq END) AS od FROM c GROUP BY user_id),
x AS (SELECT c.*, d.d, d.od FROM c JOIN d USING (user_id) WHERE op <> 'del'),
f AS (SELECT user_id, max(CASE WHEN op = 'put' AND seq > coalesce(d, -1) THEN seq END) AS pp, max(CASE WHEN seq > coalesce(d, -1) THEN seq END) AS sp,
  max_by(cell, CASE WHEN cell IS NOT NULL AND seq > coalesce(od, -1) THEN seq END) FILTER (cell IS NOT NULL AND seq > coalesce(od, -1)) AS cell FROM x GROUP BY user_id)
SELECT f.user_id, c.value, c.event_type, CASE WHEN pp IS NOT NULL THEN 'put' ELSE 'put_open' END AS ks_op, CAST(json_extract(f.cell, '$.k') AS BIGINT) AS k
FROM f LEFT JOIN c ON c.user_id = f.user_id AND c.seq = f.pp WHERE pp IS NOT NULL OR (sp IS NOT NULL AND f.cell IS NOT NULL)"""


def event_changes(t: Tables) -> DataFrame:
    return event_changes_of(t.events)


def event_changes_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    op = F.when(e % 7 == 0, "del").when((e % 7 == 1) | (e % 7 == 2), "put_open").otherwise("put")
    return events.select("user_id", "value", "event_type", op.alias(ch.OP), F.when(e % 14 == 0, 1).alias(ch.SLOT), e.alias(ch.SEQ), F.when((e % 7).isin(1, 2, 3), F.col("props")).alias(ch.CELL))


def shown(state: DataFrame) -> DataFrame:
    return state.select("user_id", "value", "event_type", ch.OP, F.get_json_object(ch.CELL, "$.k").cast("bigint").alias("k"))


def change_lake(t: Tables) -> lake.LakeTable:
    """Three versions of a third of the events each."""
    c = event_changes(t)
    table = lake.LakeTable(t.spark, scratch(t.spark, "lake"), ["user_id"])
    n = t.events.count()
    for i in range(3):
        table.append(c.where((F.col(ch.SEQ) >= i * n // 3) & (F.col(ch.SEQ) < (i + 1) * n // 3)).coalesce(2), covers=i + 1)
    return table


CUSTOMER = CollectionSchema("customer", (Field("c_custkey", "i64"),), (Field("c_name", "str"), Field("c_acctbal", "f64"), Field("c_mktsegment", "vocab"), Field("c_rank", "i32", default=7)))


@query("l03_import", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, 7::INT AS c_rank FROM customer")
def _(t):
    path = scratch(t.spark, "export")
    t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.parquet(path)
    return lake.import_table(t.spark, CUSTOMER, path)


@query("l04_catalog", "SELECT 'customer_' || lower(seg) AS name, CAST(row_number() OVER (ORDER BY seg) - 1 AS INT) AS ns, CAST(1 + length(seg) % 3 AS INT) AS generation FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer)")
def _(t):
    """A collection a market segment."""
    names = sorted(r[0] for r in t.customer.select("c_mktsegment").distinct().collect())
    return lake.export_catalog(t.spark, [replace(CUSTOMER, name=f"customer_{n.lower()}", generation=1 + len(n) % 3) for n in names])


@query("l05_reduce_export", "SELECT 'orders' AS \"table\", 'count' AS reduce, o_orderstatus AS \"group\", CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 3 UNION ALL SELECT 'lineitem', 'sum', CAST(l_suppkey AS VARCHAR), CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem GROUP BY 3")
def _(t):
    a = reduced(t.orders, ["o_orderstatus"], [Reduce("n", "count")])
    b = reduced(t.lineitem, ["l_suppkey"], [Reduce("s", "sum", "l_extendedprice", 2)])
    out = lake.export_reduces([("orders", "count", a, "o_orderstatus", "n"), ("lineitem", "sum", b, "l_suppkey", "s")])
    return out.withColumn("value", F.col("value").cast("double"))


@query("l06_edge_export", "SELECT 'customer' AS src_table, c_custkey AS src_pkey, 'nation' AS dst_table, CAST(c_nationkey AS BIGINT) AS dst_pkey, 'lives' AS predicate, CAST(1 AS BIGINT) AS weight FROM customer")
def _(t):
    from .graphs import places

    return lake.export_edges(places(t).edges_of_predicate("lives"), {"customer": "customer", "nation": "nation"})


@query("l08_drain", "SELECT user_id, max_by(value, event_id) AS value, max_by(event_type, event_id) AS event_type, 'put' AS ks_op, NULL::BIGINT AS k FROM events GROUP BY user_id")
def _(t):
    spark = t.spark
    stream = ev.source(spark, t.folder, "events.parquet", t.events.schema)
    table = lake.LakeTable(spark, scratch(spark, "lake"), ["user_id"])

    def add(batch, number):
        table.append_named(event_puts_of(batch), f"batch-{number}", covers=number + 1)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", scratch(spark, "position")).trigger(availableNow=True).start().awaitTermination()
    return shown(table.current())


def event_puts_of(batch: DataFrame) -> DataFrame:
    return batch.select("user_id", "value", "event_type", F.lit("put").alias(ch.OP), F.lit(None).cast("int").alias(ch.SLOT), F.col("event_id").alias(ch.SEQ), F.lit(None).cast("string").alias(ch.CELL))


@query("l16_key_bounds", "SELECT least(event_id * 3 // (SELECT count(*) FROM events), 2)::INT AS part, min(user_id) AS low, max(user_id) AS high, count(*) AS rows FROM events GROUP BY 1")
def _(t):
    table = lake.LakeTable(t.spark, scratch(t.spark, "lake"), ["user_id"])
    n = t.events.count()
    for i in range(3):
        table.append(event_changes(t).where(F.floor(F.col(ch.SEQ) * 3 / n) == i).coalesce(1))
    return table.key_bounds().select(F.col("__file").alias("part"), "low", "high", "rows")


@query("l17_current_state", fold_sql(CHANGES))
def _(t):
    return shown(ch.current_state(event_changes(t), ["user_id"]))


@query("l17b_lake_state", fold_sql(CHANGES))
def _(t):
    return shown(change_lake(t).current())


@query("l18_state_at_version", fold_sql(f"(SELECT * FROM {CHANGES} WHERE seq < (SELECT count(*) FROM events) * 2 // 3)"))
def _(t):
    return shown(change_lake(t).current(version=1))


@query("l19_union_align", "SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    return ch.aligned([t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))])


@query("l20_condense", fold_sql(CHANGES))
def _(t):
    table = change_lake(t)
    table.condense()
    return shown(table.current())


@query("l22_status", f"SELECT CAST(2 AS BIGINT) AS version, count(*) AS change_rows, count(*) FILTER (op = 'del') AS deletes, (SELECT count(*) FROM ({fold_sql(CHANGES)})) AS live_rows FROM {CHANGES}")
def _(t):
    return change_lake(t).status(with_rows=True).drop("live_files", "live_bytes", "stale_bytes")


@query("l25_restore", fold_sql(CHANGES))
def _(t):
    n = t.events.count()
    return shown(change_lake(t).restore(1, event_changes(t).where(F.col(ch.SEQ) >= 2 * n // 3)))


@query("l38_replay", fold_sql(CHANGES))
def _(t):
    n = t.events.count()
    base = ch.current_state(event_changes(t).where(F.col(ch.SEQ) < n // 2), ["user_id"])
    return shown(ch.replayed(base, event_changes(t).where(F.col(ch.SEQ) >= n // 2), ["user_id"]))


@query("l39_reconcile", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'adopted' WHEN a.k IS NULL THEN 'removed' WHEN a.seg = b.seg THEN 'unchanged' ELSE 'adopted' END AS verdict FROM (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 4 <> 0) b ON a.k = b.k")
def _(t):
    a = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    b = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 == 0, "X").otherwise(F.col("c_mktsegment")).alias("seg"))
    return ch.reconcile(a, b, ["k"])


@query("l41_window_position", "SELECT event_id, user_id, CASE WHEN event_id < (SELECT count(*) FROM events) // 2 THEN 0 ELSE 1 END AS part FROM events")
def _(t):
    """A consumer that stops and goes on: what came before its position does not come again."""
    n, spark = t.events.count(), t.spark
    rows, out, position = scratch(spark, "window"), scratch(spark, "drained"), scratch(spark, "position")
    for i in range(2):
        half = (F.col("event_id") < n // 2) if i == 0 else (F.col("event_id") >= n // 2)
        t.events.select("event_id", "user_id").where(half).write.mode("append").parquet(rows)
        stream = spark.readStream.schema("event_id bigint, user_id bigint").parquet(rows)
        ev.drain(stream, out, position)
    return spark.read.schema("event_id bigint, user_id bigint, batch int").parquet(out).withColumnRenamed("batch", "part")


# series: a record an event, a stream an event type, a bucket a day


FMT = series.Format(1_000_000, 86_400)
LOG = """(SELECT event_type AS partition, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS "offset", epoch_us(ts) AS ts, epoch_us(ts) // 86400000000 AS bucket, event_id FROM events)"""


def series_store(t: Tables, stream: str | None = None) -> series.SeriesLog:
    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    records = t.events.select("event_id", ts.alias("ts"), "event_type").where(F.lit(True) if stream is None else F.col("event_type") == stream)
    log = series.SeriesLog(t.spark, scratch(t.spark, "series"), FMT, "event_type")
    n = t.events.count()
    log.append(records.where(F.col("event_id") < n // 2), ["event_id"])
    log.append(records.where(F.col("event_id") >= n // 2), ["event_id"])
    return log


def series_log(t: Tables) -> DataFrame:
    return series_store(t).log()


COLS = ["partition", "offset", "ts", "bucket", "event_id"]


@query("l27_append", f"SELECT * FROM {LOG}")
def _(t):
    return series_log(t).select(*COLS)


@query("l28_read", f"SELECT * FROM {LOG} WHERE \"offset\" >= 100 AND partition = 'click' ORDER BY \"offset\" LIMIT 40")
def _(t):
    return series.read(series_log(t).where("partition = 'click'"), 100, 40).select(*COLS)


@query("l29_read_stream", f"SELECT * FROM {LOG} WHERE partition = 'view' AND \"offset\" >= 500")
def _(t):
    return series.read_stream(series_log(t), "view", 500).select(*COLS)


DAY = 86_400_000_000
FIRST = 1_704_067_200_000_000


@query("l30_read_time", f"SELECT * FROM {LOG} WHERE ts BETWEEN {FIRST + DAY} AND {FIRST + 3 * DAY}")
def _(t):
    return series.read_time(series_log(t), FMT, FIRST + DAY, FIRST + 3 * DAY).select(*COLS)


@query("l31_read_stream_time", f"SELECT * FROM {LOG} WHERE ts BETWEEN {FIRST + DAY} AND {FIRST + 3 * DAY} AND partition = 'error'")
def _(t):
    return series.read_time(series_log(t), FMT, FIRST + DAY, FIRST + 3 * DAY, "error", any_stream=False).select(*COLS)


@query("l32_bucket_of", "SELECT event_id, epoch_us(ts) // 1000000 // 3600 AS bucket FROM events")
def _(t):
    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return t.events.select("event_id", bucket_of(ts, 1_000_000, 3600).alias("bucket"))


@query("l33_parts", f"SELECT bucket, partition, min(\"offset\") AS first_offset, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts FROM {LOG} GROUP BY 1, 2")
def _(t):
    return series.parts(series_log(t))


@query("l34_retention", f"SELECT * FROM {LOG} WHERE bucket >= {FIRST + 10 * DAY} // {DAY}")
def _(t):
    log = series_store(t)
    log.retain(FIRST + 10 * DAY + 5)
    return log.log().select(*COLS)


# streams


def event_stream(t: Tables) -> DataFrame:
    return ev.source(t.spark, t.folder, "events.parquet", t.events.schema)


@query("e01_emit", "SELECT event_id, event_type FROM events")
def _(t):
    return ev.drained(event_stream(t).select("event_id", "event_type"))


@query("e02_op_epoch", "SELECT event_id AS epoch, user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op FROM events")
def _(t):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return ev.drained(event_stream(t).select(F.col("event_id").alias("epoch"), F.col("user_id").alias("key"), op.alias("op")))


@query("e03_stateless", "SELECT event_id, round(value * 100) AS cents FROM events WHERE event_type = 'click' AND value > 20")
def _(t):
    made = event_stream(t).select("event_id", F.struct("event_type", "value").alias("document"))
    kept = ev.keep_field(ev.keep(made, F.col("document.event_type") == "click"), "value", lambda v: v > 20)
    return ev.drained(ev.mapped(kept, F.col("event_id"), F.round(F.col("document.value") * 100).alias("cents")))


@query("e04_with_previous", "SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous, event_type AS value FROM events")
def _(t):
    return ev.drained(ev.with_previous(event_stream(t).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"))


@query("e05_distinct_by", "SELECT user_id, event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS is_changed, event_type AS value FROM events")
def _(t):
    return ev.drained(ev.distinct_by(event_stream(t).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"))


@query("e07_maintained_reduce", "SELECT event_type, count(*) AS n, max(event_id) AS high FROM events GROUP BY 1")
def _(t):
    return ev.drained(ev.maintained(event_stream(t), ["event_type"], [F.count("*").alias("n"), F.max("event_id").alias("high")]), "complete")


@query("e08_drain_loop", f"SELECT count(*) AS change_rows, CAST(0 AS BIGINT) AS deletes, count(*) AS live_rows FROM ({fold_sql(CHANGES)})")
def _(t):
    """Each batch is drained to the table, and the table condensed after it."""
    table = lake.LakeTable(t.spark, scratch(t.spark, "lake"), ["user_id"])

    def add(batch, number):
        table.append_named(event_changes_of(batch), f"batch-{number}", covers=number + 1)
        table.condense()

    event_stream(t).writeStream.foreachBatch(add).option("checkpointLocation", scratch(t.spark, "position")).trigger(availableNow=True).start().awaitTermination()
    return table.status(with_rows=True).select("change_rows", "deletes", "live_rows")


@query("e09_follow", f"SELECT * FROM {LOG} WHERE partition = 'click' AND \"offset\" < 50")
def _(t):
    log = series_store(t, "click")
    first, position = log.follow(0, 30)
    return first.union(log.follow(position, 20)[0]).select(*COLS)

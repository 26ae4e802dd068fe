"""Aggregates, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import reduces, windows
from ..operators.reduces import Reduce
from .registry import Tables, query

#: Orders as change rows of one key space: an order is a put of its customer's row, every fifth a delete of it.
CHANGES = "SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'del' ELSE 'put' END AS op, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders"
SIGNED = f"""WITH c AS ({CHANGES}),
b AS (SELECT *, lag(op) OVER w AS p_op, lag(status) OVER w AS p_status, lag(price) OVER w AS p_price FROM c WINDOW w AS (PARTITION BY id ORDER BY seq)),
s AS (SELECT id, status, price, 1 AS sign FROM b WHERE op = 'put' UNION ALL SELECT id, p_status, p_price, -1 FROM b WHERE p_op = 'put')"""


def order_changes(t: Tables):
    op = F.when(F.col("o_orderkey") % 5 == 0, "del").otherwise("put")
    return t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), op.alias("op"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


def by_changes(t: Tables, *made: Reduce):
    return reduces.reduced_changes(order_changes(t), ["id"], "seq", "op", ["status"], made)


@query("a01_run_fold", "SELECT event_type, run, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)) GROUP BY user_id, event_type, run")
def _(t):
    got = reduces.group_fold(t.events.select("event_id", "user_id", "event_type"), ["event_type"], ["event_id"], [F.count("*").alias("n"), F.min("event_id").alias("first_id")], ["user_id"])
    return got.select("event_type", "run", "n", "first_id")


@query("a01b_ordered_fold", "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY o_custkey")
def _(t):
    made = [F.count("*").alias("n"), F.sum("o_orderkey").alias("total")]
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_custkey").alias("own"))
    return reduces.group_fold(rows, ["own"], ["o_orderkey"], made, ["o_custkey"]).select("o_custkey", "n", "total")


@query("a02_count_reduce", f"{SIGNED} SELECT status, CAST(sum(sign) AS BIGINT) AS n FROM s GROUP BY status")
def _(t):
    return by_changes(t, Reduce("n", "count"))


@query("a03_sum_reduce", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag")
def _(t):
    got = reduces.reduced(t.lineitem, ["l_returnflag"], [Reduce("total", "sum", "l_extendedprice", 2)])
    return got.select("l_returnflag", F.col("total").cast("double").alias("total"))


@query("a04_high_water", f"{SIGNED} SELECT status, CAST(max(price) AS DOUBLE) AS high FROM s WHERE sign > 0 GROUP BY status")
def _(t):
    return by_changes(t, Reduce("high", "high_water", "price", 2)).select("status", F.col("high").cast("double").alias("high"))


@query("a05_low_water", f"{SIGNED} SELECT status, CAST(min(price) AS DOUBLE) AS low FROM s WHERE sign > 0 GROUP BY status")
def _(t):
    return by_changes(t, Reduce("low", "low_water", "price", 2)).select("status", F.col("low").cast("double").alias("low"))


@query("a06_user_reduce", "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, CAST(sum(o_orderkey) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY o_custkey")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey")
    made = reduces.merged_reduce(rows, ["o_custkey"], lambda: (0, 0), lambda acc, row: (acc[0] + 1, acc[1] + row.o_orderkey), lambda a, b: (a[0] + b[0], a[1] + b[1]), "n bigint, total bigint")
    return made.withColumn("mean", F.col("total").cast("double") / F.col("n"))


@query("a06b_host_reduce", "SELECT user_id, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY user_id")
def _(t):
    return reduces.user_reduce(t.events.select("user_id", "event_id"), ["user_id"], lambda acc, row: (acc[0] + 1, max(acc[1], row.event_id)), lambda: (0, -1), "user_id bigint, n bigint, last bigint")


@query("a08_group_source", "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    group = reduces.resolve_group(["l_orderkey", "l_linenumber"], ["l_returnflag", "l_quantity"], ["l_orderkey", "l_returnflag"])
    return reduces.reduced(t.lineitem, group, [Reduce("n", "count")])


@query("a08b_whole_table", "SELECT count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer")
def _(t):
    got = reduces.reduced(t.customer, [], [Reduce("n", "count"), Reduce("total", "sum", "c_acctbal", 2)])
    return got.select("n", F.col("total").cast("double").alias("total"))


@query("a09_reduce_get", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey = 7 GROUP BY 1")
def _(t):
    return reduces.reduce_get(t.orders, {"o_custkey": 7}, [Reduce("n", "count")])


@query("a10_scan_reduces", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    return reduces.reduced(t.lineitem, ["l_returnflag", "l_linestatus"], [Reduce("n", "count")], ordered=True)


@query("a11_overwrite", f"{SIGNED} SELECT status, CAST(sum(sign) AS BIGINT) AS n, CAST(sum(price * sign) AS DOUBLE) AS total FROM s GROUP BY status")
def _(t):
    got = by_changes(t, Reduce("n", "count"), Reduce("total", "sum", "price", 2))
    return got.select("status", "n", F.col("total").cast("double").alias("total"))


@query("a12_narrowing", "SELECT 1 AS level, n_regionkey, NULL::INT AS n_nationkey, NULL::VARCHAR AS c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey UNION ALL SELECT 2, n_regionkey, n_nationkey, NULL, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2, 3 UNION ALL SELECT 3, n_regionkey, n_nationkey, c_mktsegment, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2, 3, 4")
def _(t):
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return reduces.rollup_levels(rows, ["n_regionkey", "n_nationkey", "c_mktsegment"], [F.count("*").alias("n")])


@query("a13_cluster_counts", "SELECT n_regionkey AS id, count(DISTINCT n_nationkey) AS node_count, 0::BIGINT AS edge_count FROM nation GROUP BY 1 UNION ALL SELECT 77, 0, 0")
def _(t):
    from .graphs import store

    return store(t).counts().where("kind = 'region'").select(F.col("id").cast("int").alias("id"), "node_count", "edge_count")


# windows


@query("w01_with_previous", "SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_event_type, event_type FROM events")
def _(t):
    return windows.with_previous(t.events.select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], ["event_type"])


@query("w02_change_flag", "SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true) AS is_changed FROM events")
def _(t):
    return windows.changed(t.events, ["user_id"], ["event_id"], F.col("event_type")).select("event_id", "is_changed")


@query("w03_runs", "SELECT event_id, sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)")
def _(t):
    return reduces.runs(t.events, ["event_type"], ["event_id"], ["user_id"]).select("event_id", "run")


@query("w04_clock_clamp", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS clamped FROM events")
def _(t):
    return windows.clamped_clock(t.events, ["user_id"], ["event_id"], "value").select("event_id", "clamped")


@query("w05_stream_offset", 'SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS "offset" FROM events')
def _(t):
    return windows.offsets(t.events, ["event_type"], ["event_id"]).select("event_id", "offset")


@query("w06_latest", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(t):
    return windows.latest(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


# scalars


@query("n01_ngrams", "SELECT p_partkey, unnest(list_transform(range(1, length(p_name) - 1), lambda i: p_name[i:i+2])) AS gram FROM part")
def _(t):
    return t.part.select("p_partkey", F.explode(scalars.ngrams(F.col("p_name"), 3)).alias("gram"))


@query("n02_bm25", "SELECT doc_id, round(ln((1000 - (doc_id % 50) + 0.5) / ((doc_id % 50) + 0.5) + 1) * 3 * 2.2 / (3 + 1.2 * (1 - 0.75 + 0.75 * n_chars / 2000)), 6) AS score FROM documents")
def _(t):
    s = scalars.bm25(F.lit(3), F.col("n_chars"), F.lit(2000.0), F.col("doc_id") % 50, F.lit(1000))
    return t.documents.select("doc_id", F.round(s, 6).alias("score"))


@query("v01_dist2", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda p: power(CAST(p[1] - p[2] AS DOUBLE), 2))), 4) AS d FROM embeddings, q")
def _(t):
    q = F.array(*[F.lit(x).cast("float") for x in t.embeddings.where("vec_id = 3").first()["embedding"]])
    return t.embeddings.select("vec_id", F.round(scalars.dist2(F.col("embedding"), q), 4).alias("d"))


@query("v02_bucket_id", "SELECT vec_id, array_to_string(list_transform(embedding[1:4], lambda x: CAST(round(CAST(x / CAST(0.25 AS FLOAT) AS FLOAT)) AS INT)), ',') AS bucket FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.array_join(F.transform(scalars.bucket_id(F.slice("embedding", 1, 4), 0.25), lambda x: x.cast("string")), ",").alias("bucket"))


@query("v04_quantize", "SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS units, CAST(round(c_acctbal * 100) AS BIGINT) / 100 AS back FROM customer")
def _(t):
    q = scalars.quantize(F.col("c_acctbal"), 2)
    return t.customer.select("c_custkey", q.alias("units"), scalars.dequantize(q, 2).alias("back"))


@query("v05_offset", "SELECT o_orderkey, o_orderkey + 1000 AS delta, o_orderkey AS back FROM orders")
def _(t):
    d = scalars.offset_encode(F.col("o_orderkey"), -1000)
    return t.orders.select("o_orderkey", d.alias("delta"), scalars.offset_decode(d, -1000).alias("back"))


@query("v07_dict_ops", "SELECT c_custkey, c_mktsegment AS got, true AS has, 2::INT AS size_after, CASE WHEN c_acctbal < 0 THEN 'low' ELSE c_name END AS replaced FROM customer")
def _(t):
    m = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("x"), F.lit("y"))
    set_ = scalars.with_entry(m, "name", F.when(F.col("c_acctbal") < 0, "low").otherwise(F.col("c_name")))
    return t.customer.select("c_custkey", F.element_at(m, "seg").alias("got"), F.map_contains_key(m, "name").alias("has"), F.size(scalars.without_entry(m, "x")).alias("size_after"), F.element_at(set_, "name").alias("replaced"))


@query("v10_uuid", "SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def _(t):
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000")
    text = F.concat(F.lpad(F.lower(F.hex(ms)), 12, "0"), F.lit("-7000-8000-"), F.lpad(F.lower(F.hex("event_id")), 12, "0"))
    return t.events.select("event_id", scalars.uuid7_millis(scalars.uuid_bytes(text)).alias("millis"))


@query("v11_vocab", "SELECT event_type AS label, CAST(row_number() OVER (ORDER BY first_id) - 1 AS BIGINT) AS id FROM (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1)")
def _(t):
    from ..sources.changes import numbered

    seen = t.events.groupBy(F.col("event_type").alias("label")).agg(F.min("event_id").alias("first_id"))
    return numbered(seen, "first_id", "id").select("label", "id")

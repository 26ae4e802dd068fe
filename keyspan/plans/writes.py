"""Writes: verbs over documents and what they capture, batches over tables, upkeep of tables, and writes to clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import documents as docs
from ..operators.clusters import Fragment
from ..operators.graph import EDGE
from ..operators.keyset import KeySet
from ..operators.reduces import byte_reduce
from ..operators.vectors import shard_of, splitmix64
from ..schema import CollectionSchema, Field
from ..session import scratch
from ..sources import changes as ch
from ..sources import lake
from .graphs import CLUSTERS, LIVES, NODES, PART_OF, E, store
from .reads import orders
from .registry import Tables, query
from .tables import CHANGES, change_lake, event_changes, fold_sql, shown

KEY = ["k"]
#: Customers as documents; every fourth has an open half with the name n.
BASE = "(SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey::BIGINT END AS n FROM customer)"
NEW = "(SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, s_nationkey::BIGINT AS nation FROM supplier)"


def people(t: Tables) -> DataFrame:
    half = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('{"n":'), "c_nationkey", F.lit("}")))
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), half.alias("open"))


def arrivals(t: Tables, *columns: str) -> DataFrame:
    half = F.concat(F.lit('{"m":'), "s_nationkey", F.lit("}"))
    rows = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), half.alias("open"))
    return rows.select("k", *columns)


def open_name(name: str, column: str = "open"):
    return F.get_json_object(column, f"$.{name}").cast("bigint").alias(name)


@query("m01_put", f"SELECT * FROM {BASE} WHERE k NOT IN (SELECT k FROM {NEW}) UNION ALL SELECT k, name, bal, NULL FROM {NEW}")
def _(t):
    new = arrivals(t, "name", "bal").withColumn("open", F.lit(None).cast("string"))
    return docs.put(people(t), new, KEY).select("k", "name", "bal", open_name("n"))


MERGED = f"(SELECT coalesce(a.k, b.k) AS k, a.name, coalesce(b.bal, a.bal) AS bal, a.n, b.nation AS m FROM {BASE} a FULL JOIN {NEW} b ON a.k = b.k)"


@query("m02_put_merge", f"SELECT * FROM {MERGED}")
def _(t):
    return docs.put_merge(people(t), arrivals(t, "bal", "open"), KEY).select("k", "name", "bal", open_name("n"), open_name("m"))


@query("m03_put_replace", f"SELECT * FROM {BASE} WHERE k NOT IN (SELECT k FROM {NEW}) UNION ALL SELECT k, name, 7.5, NULL FROM {NEW} WHERE k % 3 <> 0")
def _(t):
    new = arrivals(t, "name").withColumn("name", F.when(F.col("k") % 3 != 0, F.col("name")))
    return docs.put_replace(people(t), new, KEY, {"bal": 7.5}).select("k", "name", "bal", open_name("n"))


@query("m04_purge", f"SELECT s.k, b.k IS NOT NULL AS purged, (SELECT count(*) FROM {BASE} WHERE k NOT IN (SELECT 3 * k FROM {NEW})) AS kept FROM (SELECT DISTINCT 3 * k AS k FROM {NEW}) s LEFT JOIN {BASE} b USING (k)")
def _(t):
    rest, told = docs.purge(people(t), arrivals(t).select((3 * F.col("k")).alias("k")), KEY)
    return told.join(F.broadcast(rest.agg(F.count("*").alias("kept"))))


@query("m05_upsert_with", f"SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, 'new') AS name, CASE WHEN b.k IS NOT NULL THEN coalesce(a.bal, 0) + 1 ELSE a.bal END AS bal FROM {BASE} a FULL JOIN (SELECT 2 * k AS k FROM {NEW}) b ON a.k = b.k")
def _(t):
    keys = arrivals(t).select((2 * F.col("k")).alias("k"))
    changes = {"name": F.coalesce("name", F.lit("new")), "bal": F.coalesce("bal", F.lit(0.0)) + 1}
    return docs.upsert_with(people(t), keys, KEY, changes).select("k", "name", "bal")


@query("m06_batch", f"SELECT 'people' AS tab, k FROM {BASE} WHERE k % 10 <> 0 UNION ALL SELECT 'log', event_id FROM events WHERE event_id % 2 = 0")
def _(t):
    """Two batches over two tables, the second written twice; a batch that one table alone got is not seen."""
    root = scratch(t.spark, "batches")
    tables = {name: lake.LakeTable(t.spark, f"{root}/{name}", key) for name, key in (("people", KEY), ("log", ["event_id"]))}
    batches = lake.Batches(t.spark, root, tables)
    put = ch.as_changes(people(t).drop("open")).withColumn(ch.SEQ, F.col("k"))
    log = ch.as_changes(t.events.select("event_id", "user_id")).withColumn(ch.SEQ, F.col("event_id"))
    batches.commit("first", {"people": put, "log": log.where("event_id % 4 = 0")})
    gone = put.where("k % 10 = 0").withColumn(ch.OP, F.lit("del"))
    for _ in range(2):
        batches.commit("second", {"people": gone, "log": log.where("event_id % 4 = 2")})
    tables["log"].append_named(log.where("event_id % 4 = 1"), "cut off")
    state = batches.snapshot()
    return state["people"].select(F.lit("people").alias("tab"), "k").union(state["log"].select(F.lit("log"), "event_id"))


@query("m07_plan", f"SELECT k, 'put' AS ks_op, row_number() OVER (ORDER BY k) + 99 AS ks_seq, bal FROM (SELECT b.k, b.bal FROM {NEW} b LEFT JOIN {BASE} a USING (k) WHERE a.k IS NULL OR a.bal IS DISTINCT FROM b.bal)")
def _(t):
    """What a merge would write, without writing it."""
    rows, new = people(t), arrivals(t, "bal")
    plan = ch.captured(rows, docs.put_merge(rows, new, KEY), KEY, new, first_seq=100)
    return plan.select("k", ch.OP, ch.SEQ, "bal")


@query("m08_children", "SELECT event_id AS id, CASE WHEN user_id % 7 = 0 THEN 0.0 ELSE value END AS value FROM events WHERE user_id % 7 <> 0 OR event_id IN (SELECT min(event_id) FROM events GROUP BY user_id)")
def _(t):
    """Users refer to their events; every seventh is overwritten and names its first event only, with a new value."""
    e = t.events.select("user_id", F.col("event_id").alias("id"), "value")
    parents = e.groupBy("user_id").agg(F.collect_list("id").alias("refs"))
    first = e.where("user_id % 7 = 0").groupBy("user_id").agg(F.min("id").alias("id"))
    new = first.select("user_id", F.array(F.struct("id", F.struct(F.lit(0.0).alias("value")).alias("value"))).alias("children"))
    return docs.put_with_children(parents, e.select("id", "value"), new, ["user_id"], "refs", "id", "children")[1]


@query("l36_capture", f"SELECT * FROM {MERGED} WHERE k % 9 <> 0")
def _(t):
    """A table that is told only what each write captured has what the writes made."""
    table = lake.LakeTable(t.spark, scratch(t.spark, "captured"), KEY)
    rows = people(t)
    table.append(ch.captured(rows.limit(0), rows, KEY))
    new = arrivals(t, "bal", "open")
    merged = docs.put_merge(rows, new, KEY)
    table.append(ch.captured(rows, merged, KEY, new))
    gone = merged.where("k % 9 = 0").select("k")
    table.append(ch.captured(merged, docs.purge(merged, gone, KEY)[0], KEY, gone))
    return table.current().select("k", "name", "bal", open_name("n", ch.CELL), open_name("m", ch.CELL))


@query("p08_split_compose", "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN json_extract(props, '$.k')::BIGINT END AS k, round(value, 4) AS value, event_type AS again FROM events")
def _(t):
    whole = F.to_json(F.struct("event_type", "value", F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k").cast("bigint")).alias("k")))
    halves = docs.split(t.events.select("event_id", whole.alias("document")), ["event_id"], {"event_type": "string"})
    again = docs.compose(halves, ["event_id"])
    got = F.get_json_object("document", "$.value").cast("double")
    return halves.join(again, "event_id").select("event_id", "event_type", open_name("k"), F.round(got, 4).alias("value"), F.get_json_object("document", "$.event_type").alias("again"))


# --- exchange and upkeep of tables


#: Events with the version of ``change_lake`` that they come in.
THIRDS = "(SELECT (event_id >= n // 3)::INT + (event_id >= 2 * n // 3)::INT AS version, * FROM events, (SELECT count(*) AS n FROM events))"
EVENT = CollectionSchema("event", (Field("event_id", "i64"),), (Field("event_type", "vocab"), Field("secret", "secret", optional=True)), open="attrs")


@query("l01_export", "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders")
def _(t):
    s = CollectionSchema("orders", (Field("o_orderkey", "i64"),), (Field("o_custkey", "i64"), Field("o_totalprice", "f64"), Field("o_orderpriority", "vocab", redact=True)))
    path = scratch(t.spark, "export")
    lake.export_table(t.orders, s, path)
    return t.spark.read.parquet(path)


@query("l02_open_export", "SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k, true AS hidden FROM events")
def _(t):
    path = scratch(t.spark, "export")
    rows = t.events.select("event_id", "event_type", F.encode("event_type", "utf-8").alias("secret"), F.try_parse_json("props").alias("attrs"))
    lake.export_table(rows, EVENT, path)
    back = lake.import_table(t.spark, EVENT, path)
    return back.select("event_id", "event_type", F.try_variant_get("attrs", "$.k", "bigint").alias("k"), F.col("secret").isNull().alias("hidden"))


@query("l07_schema_json", "SELECT s_suppkey, s_name, 3::INT AS s_rank FROM supplier")
def _(t):
    s = CollectionSchema("supplier", (Field("s_suppkey", "i64"),), (Field("s_name", "str"), Field("s_rank", "i32", default=3)))
    return CollectionSchema.from_json(s.to_json()).conform(t.supplier.select("s_suppkey", "s_name"))


@query("l09_project_window", "SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'del' WHEN 1 THEN 'put_open' ELSE 'put' END AS ks_op, (SELECT count(*) FROM events WHERE event_id % 5 = 4) AS derived_deletes FROM events WHERE event_id % 5 <> 4")
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ["del", "dynamic", "put", "put", "derived_del"])), (F.col("event_id") % 5 + 1).cast("int"))
    rows, derived = ch.project_window(t.events.select(F.col("event_id").alias("seq"), "user_id", kind.alias("kind")), ["user_id"], ["seq"])
    return rows.select("seq", ch.OP).join(F.broadcast(derived))


@query("l10_split", "SELECT o_orderstatus AS part, true AS within, count(*) AS rows FROM orders GROUP BY 1")
def _(t):
    table = lake.LakeTable(t.spark, scratch(t.spark, "split"), ["o_orderstatus", "o_orderkey"], partition="o_orderstatus")
    table.append(t.orders.select("o_orderstatus", "o_orderkey"), max_rows=100)
    files = table.changes().groupBy("__file").agg(F.min("o_orderstatus").alias("part"), F.max("o_orderstatus").alias("other"), F.count("*").alias("n"))
    return files.groupBy("part").agg(F.every((F.col("n") <= 100) & (F.col("part") == F.col("other"))).alias("within"), F.sum("n").alias("rows"))


@query("l11_log_append", f"SELECT version::BIGINT AS version, count(*) AS rows, version + 1 AS covers FROM {THIRDS} GROUP BY version")
def _(t):
    """The log itself, read as any reader of the open protocol does: add actions and their statistics."""
    table = change_lake(t)
    log = t.spark.read.schema("add struct<path:string,stats:string,tags:map<string,string>>").json(f"{table.path}/{lake.LOG}/*.json").select("add.*", F.regexp_extract("_metadata.file_name", "^([0-9]+)", 1).cast("bigint").alias("version"))
    rows = F.sum(F.get_json_object("stats", "$.numRecords").cast("bigint")).alias("rows")
    return log.where("path IS NOT NULL").groupBy("version").agg(rows, F.max(F.col("tags")["covers"].cast("int")).alias("covers"))


@query("l12_log_replace", "SELECT user_id, value FROM events WHERE event_id % 3 = 0")
def _(t):
    table = lake.LakeTable(t.spark, scratch(t.spark, "replaced"), ["event_id"])
    rows = t.events.select("event_id", "user_id", "value")
    table.append(rows.where("event_id % 3 = 1"))
    table.replace(rows.where("event_id % 3 = 0"))
    return table.changes().select("user_id", "value")


@query("l13_checkpoint", fold_sql(CHANGES))
def _(t):
    """A state read from a checkpoint and the log after it, the log before it being gone."""
    n = t.events.count()
    c = event_changes(t)
    table = lake.LakeTable(t.spark, scratch(t.spark, "lake"), ["user_id"])
    for i in range(3):
        table.append(c.where((F.col(ch.SEQ) >= i * n // 3) & (F.col(ch.SEQ) < (i + 1) * n // 3)))
        if i == 1:
            table.checkpoint()
            for v in range(2):
                table.files.delete(f"{lake.LOG}/{v:020d}.json")
    return shown(table.current())


@query("l14_live_files", "SELECT v AS version, count(*) AS rows FROM range(3) r(v), events WHERE event_id < (v + 1) * (SELECT count(*) FROM events) // 3 GROUP BY 1")
def _(t):
    table = change_lake(t)
    return t.spark.createDataFrame([(v, sum(a["rows"] for a in table.live(v))) for v in range(3)], "version bigint, rows bigint")


@query("l15_file_stats", f"SELECT version::BIGINT AS version, count(*) AS rows, min(user_id) AS low, max(user_id) AS high, count(*) FILTER (event_id % 7 NOT IN (1, 2, 3)) AS nulls FROM {THIRDS} GROUP BY 1")
def _(t):
    found = {}
    for a in change_lake(t).live():
        if not a["rows"]:
            continue
        low, high, _ = a["stats"]["user_id"]
        r = found.get(a["version"], (0, None, None, 0))
        lows, highs = ([x for x in pair if x is not None] for pair in ((r[1], low), (r[2], high)))
        found[a["version"]] = (r[0] + a["rows"], min(lows, default=None), max(highs, default=None), r[3] + a["stats"][ch.CELL][2])
    return t.spark.createDataFrame([(v, *r) for v, r in found.items()], "version bigint, rows bigint, low bigint, high bigint, nulls bigint")


@query("l21_vacuum", f"SELECT *, true AS removed FROM ({fold_sql(CHANGES)})")
def _(t):
    table = change_lake(t)
    before = {a["name"] for a in table.live()}
    table.condense()
    told, gone = table.vacuum(0, dry_run=True), table.vacuum(0)
    return shown(table.current()).withColumn("removed", F.lit(told == gone and set(gone) <= before and bool(gone) and not table.vacuum(0)))


@query("l23_publish", "SELECT s_suppkey AS k, s_name AS name FROM supplier")
def _(t):
    table = lake.LakeTable(t.spark, scratch(t.spark, "published"), KEY)
    table.publish(people(t).select("k", "name"))
    table.publish(arrivals(t, "name"), checkpoint_every=1, delete_replaced=True)
    return table.changes().select("k", "name")


@query("l24_baseline", fold_sql(CHANGES))
def _(t):
    """A log whose first two segments a table has: they go from the log, and table and log are the state together."""
    n, c = t.events.count(), event_changes(t)
    log, table = (lake.LakeTable(t.spark, scratch(t.spark, x), ["user_id"]) for x in ("log", "lake"))
    for i in range(3):
        part = c.where((F.col(ch.SEQ) >= i * n // 3) & (F.col(ch.SEQ) < (i + 1) * n // 3))
        log.append(part, covers=i + 1)
        if i < 2:
            table.append(part, covers=i + 1)
    log.drop_covered(table, 2)
    return shown(table.restore(table.version(), log.changes().drop("__file")))


@query("l37_compaction", fold_sql(CHANGES))
def _(t):
    table = change_lake(t)
    table.compact(keep=1)
    return shown(table.current())


@query("l40_generations", "SELECT c_custkey, c_name, 'none' AS c_note, 1 AS generations FROM customer")
def _(t):
    old = CollectionSchema("customer", (Field("c_custkey", "i64"),), (Field("c_name", "str"),))
    new = CollectionSchema("customer", (Field("c_custkey", "i64"),), (Field("c_name", "str"), Field("c_note", "vocab", default="none")), generation=2)
    root = scratch(t.spark, "generations")
    lake.write_generation(t.customer.select("c_custkey", "c_name"), old, root)
    lake.write_generation(lake.migrate(lake.read_generation(t.spark, root), old, new), new, root)
    lake.vacuum_generations(t.spark, root)
    return lake.read_generation(t.spark, root).withColumn("generations", F.lit(len(lake.generations(t.spark, root))))


# --- faces, paths, key sets, scalars


@query("s18_faces", "SELECT 'open_only' AS name, 'plain' AS kind, true AS partial, count(*) FILTER (o_orderstatus = 'O') AS entries FROM orders UNION ALL SELECT 'by_customer', 'plain', false, count(*) FROM orders UNION ALL SELECT 'by_price_band', 'function', false, count(*) FROM orders")
def _(t):
    c = orders(t)
    counts = [c.count(n).select(F.lit(n).alias("name"), "entries") for n in ("open_only", "by_customer", "by_price_band")]
    status = t.spark.createDataFrame([(s["name"], s["kind"], s["partial"]) for s in c.faces_status()], "name string, kind string, partial boolean")
    return status.join(counts[0].union(counts[1]).union(counts[2]), "name")


@query("f08_path_parse", "SELECT event_id, [event_id, user_id] AS found, user_id AS second FROM events")
def _(t):
    v = F.parse_json(F.concat(F.lit('{"a b":{"c":['), "event_id", F.lit(","), "user_id", F.lit("]}}")))
    at = lambda path: F.transform(paths.resolve(v, path), lambda x: F.try_variant_get(x, "$", "bigint"))
    return t.events.select("event_id", at('"a b".c').alias("found"), F.element_at(at('"a b".c[1]'), 1).alias("second"))


@query("f09_path_resolve", "SELECT event_id, [event_id, user_id, 7, 8] AS leaves, 0 AS missing FROM events")
def _(t):
    v = F.parse_json(F.concat(F.lit('{"a":[{"b":'), "event_id", F.lit('},{"b":['), "user_id", F.lit(',[7,8]]},{"c":1}]}')))
    leaves = F.transform(paths.resolve(v, "a.b"), lambda x: F.try_variant_get(x, "$", "bigint"))
    return t.events.select("event_id", leaves.alias("leaves"), F.size(paths.resolve(v, "a[0][1]")).alias("missing"))


@query("f12_rebuild_face", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def _(t):
    return orders(t).materialize("by_customer", scratch(t.spark, "face"))


@query("k12_operators", "SELECT k, (SELECT count(*) FROM customer WHERE c_nationkey < 12) AS size FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 12 AND (c_acctbal > 0 OR c_custkey % 2 = 0) AND c_mktsegment <> 'BUILDING')")
def _(t):
    keys = lambda cond: KeySet(t.customer.where(cond).select(F.col("c_custkey").alias("k")))
    near = keys("c_nationkey < 12")
    got = (near & (keys("c_acctbal > 0") | keys("c_custkey % 2 = 0"))) - keys("c_mktsegment = 'BUILDING'")
    return got.df.withColumn("size", F.lit(len(near)).cast("bigint"))


@query("a07_byte_reduce", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * (event_id % 100)) AS BIGINT) AS total FROM (SELECT *, min(event_id) FILTER (event_type <> 'error') OVER (PARTITION BY user_id) AS first FROM events) WHERE event_id >= first GROUP BY user_id")
def _(t):
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("sign"), (F.col("event_id") % 100).alias("v"))

    def step(by: int):
        return lambda acc, v: (int.from_bytes(acc, "big", signed=True) + by * int(v)).to_bytes(8, "big", signed=True)

    made = byte_reduce(rows, ["user_id"], "event_id", "sign", "v", lambda: bytes(8), step(1), step(-1))
    total = F.conv(F.hex("acc"), 16, -10).cast("bigint")
    return made.where("acc IS NOT NULL").select("user_id", total.alias("total"))


@query("v06_merge", "SELECT c_custkey, c_nationkey::BIGINT AS x, c_custkey AS y, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 1 END::BIGINT AS b FROM customer")
def _(t):
    first = F.concat(F.lit('{"a":{"x":'), "c_nationkey", F.lit(',"y":0},"b":1}'))
    second = F.concat(F.lit('{"a":{"y":'), "c_custkey", F.lit("}"), F.when(F.col("c_custkey") % 2 == 0, ',"b":5').otherwise(""), F.lit("}"))
    got = t.customer.select("c_custkey", docs.merge_cells(F.array(first, second)).alias("m"))
    return got.select("c_custkey", *[F.get_json_object("m", p).cast("bigint").alias(n) for n, p in (("x", "$.a.x"), ("y", "$.a.y"), ("b", "$.b"))])


@query("v13_shard_hash", "SELECT vec_id, CAST(list_reduce([14695981039346656037::UHUGEINT] || list_transform([56, 48, 40, 32, 24, 16, 8, 0], lambda s: ((vec_id::BIGINT >> s) & 255)::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 7 AS INTEGER) AS shard FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", shard_of(F.col("vec_id"), 7).alias("shard"))


M64 = "18446744073709551616::UHUGEINT"


@query("v14_splitmix", f"WITH s AS (SELECT vec_id, (vec_id::UHUGEINT + 11400714819323198485::UHUGEINT) % {M64} AS z FROM embeddings), a AS (SELECT vec_id, (xor(z, z // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {M64} AS z FROM s), b AS (SELECT vec_id, (xor(z, z // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {M64} AS z FROM a) SELECT vec_id, CAST(xor(z, z // 2147483648::UHUGEINT) % 1000003 AS BIGINT) AS drawn FROM b")
def _(t):
    return t.embeddings.select("vec_id", splitmix64(F.col("vec_id"), 1_000_003).alias("drawn"))


# --- clusters


def _edges_of(df: DataFrame) -> DataFrame:
    return df.select(*EDGE, "weight")


@query("h01_incorporate", f"SELECT * FROM {E} UNION ALL SELECT 'region', r_regionkey::BIGINT, 'holds', 'nation', r_regionkey::BIGINT, 5 FROM region")
def _(t):
    """Every part_of edge is declared again and keeps its payload; new ones get the default."""
    s = store(t)
    fresh = t.region.select(F.lit("region").alias("src_ns"), F.col("r_regionkey").cast("bigint").alias("src"), F.lit("holds").alias("predicate"), F.lit("nation").alias("dst_ns"), F.col("r_regionkey").cast("bigint").alias("dst"))
    nodes = t.region.select(F.lit("region").alias("ns"), F.col("r_regionkey").cast("bigint").alias("node"))
    f = Fragment(nodes=nodes, edges=fresh.union(s.edges.where("predicate = 'part_of'").select(*EDGE)))
    return _edges_of(s.incorporate(f, {"weight": F.lit(5).cast("bigint")})[0].edges)


@query("h02_retract", f"SELECT * FROM {E} WHERE NOT (dst_ns = 'nation' AND dst % 2 = 0) AND NOT (src_ns = 'nation' AND src % 2 = 0)")
def _(t):
    out = t.nation.where("n_nationkey % 2 = 0").select(F.lit("nation").alias("ns"), F.col("n_nationkey").cast("bigint").alias("node"))
    return _edges_of(store(t).retract(Fragment(nodes=out))[0].edges)


@query("h03_replace", f"SELECT src_ns, src, predicate, dst_ns, CASE WHEN dst_ns = 'nation' AND dst = 0 THEN 1 ELSE dst END AS dst, CASE WHEN dst_ns = 'nation' AND dst = 0 THEN 9 ELSE weight END AS weight FROM {E} WHERE NOT (src_ns = 'nation' AND src = 0)")
def _(t):
    s = store(t)
    into, out = (F.col("dst_ns") == "nation") & (F.col("dst") == 0), (F.col("src_ns") == "nation") & (F.col("src") == 0)
    node = t.nation.where("n_nationkey = 0").select(F.lit("nation").alias("ns"), F.col("n_nationkey").cast("bigint").alias("node"))
    removed = Fragment(nodes=node, edges=s.edges.where(into | out).select(*EDGE))
    declared = Fragment(edges=s.edges.where(into).withColumn("dst", F.lit(1).cast("bigint")).select(*EDGE))
    return _edges_of(s.replace(removed, declared, {"weight": F.lit(9).cast("bigint")})[0].edges)


@query("h04_repoint", f"SELECT src_ns, src, predicate, dst_ns, CASE WHEN dst_ns = 'nation' AND dst = 3 THEN 4 ELSE dst END AS dst, weight FROM {E}")
def _(t):
    return _edges_of(store(t).repoint(("nation", 3), ("nation", 4)).edges)


@query("h05_materialize", f"SELECT kind, id, ns, node FROM {NODES} UNION ALL SELECT 'picked', 5, 'customer', c_custkey FROM customer WHERE c_acctbal < 0")
def _(t):
    chosen = t.customer.where("c_acctbal < 0").select(F.lit("customer").alias("ns"), F.col("c_custkey").alias("node"))
    unknown = t.supplier.select(F.lit("nowhere").alias("ns"), F.col("s_suppkey").alias("node"))
    return store(t).materialize("picked", 5, chosen.union(unknown)).node_members


@query("h06_declare", f"SELECT * FROM {CLUSTERS} UNION ALL VALUES ('segment', 999::BIGINT, 1000::BIGINT)")
def _(t):
    return store(t).declare("segment", 999, 1000).declare("root", 1000, 55).clusters


@query("h07_merge_sets", f"SELECT DISTINCT kind, CASE WHEN kind = 'region' AND id IN (1, 2) THEN 0 ELSE id END AS id, ns, node FROM {NODES} WHERE NOT (kind = 'region' AND id = 4) AND NOT (kind = 'segment' AND node % 2 = 0)")
def _(t):
    s = store(t).merge_sets("region", 0, [1, 2]).delete_set("region", 4)
    for r in s.clusters.where("kind = 'segment'").select("id").distinct().collect():
        s = s.remove_members("segment", r["id"], nodes=t.customer.where("c_custkey % 2 = 0").select(F.lit("customer").alias("ns"), F.col("c_custkey").alias("node")))
    return s.node_members


@query("h17_open_clusters", "SELECT r_regionkey::BIGINT AS id, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'old' END AS label, CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE 1 END::BIGINT AS size FROM region")
def _(t):
    """Clusters with an open payload: names that are declared again are overwritten, the rest stays."""
    s = store(t)
    none = s.clusters.where("kind = 'region' AND id < 50").withColumn("open", F.when(F.col("id") % 2 == 1, F.lit('{"label":"old","size":1}')))
    kept = type(s)(s.nodes, s.edges, none, s.edge_members, s.node_members)
    named = t.region.where("r_regionkey % 2 = 0").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("bigint").alias("id"), F.to_json(F.struct(F.col("r_name").alias("label"))).alias("open"))
    return kept.incorporate_open(named)[0].clusters.select("id", F.get_json_object("open", "$.label").alias("label"), open_name("size"))

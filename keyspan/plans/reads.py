"""Reads of collections, faces and key sets; joins, set operations, order and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import joins
from ..operators.collection import FIELDS, INCLUDE, KEY, Collection, Face, take_while
from ..operators.keyset import KeySet, prefer_left
from ..operators.vectors import nearest
from .registry import Tables, query

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def orders(t: Tables) -> Collection:
    faces = (
        Face("by_customer", ("o_custkey",), includes=("o_totalprice",)),
        Face("by_status", ("o_custkey", "o_orderstatus"), includes=("o_totalprice",)),
        Face("by_priority", ("o_orderpriority",)),
        Face("open_only", ("o_custkey",), where=lambda d: d["o_orderstatus"] == "O"),
        Face("by_price_band", ("band",), func=lambda d: F.floor(d["o_totalprice"] / 50000).cast("bigint")),
        Face("by_word", ("word",), func=lambda d: F.split(d["o_orderpriority"], "-"), many=True),
    )
    return Collection(t.orders.drop("o_orderdate"), ["o_orderkey"], faces)


def lines(t: Tables) -> Collection:
    faces = (
        Face("by_supplier", ("l_suppkey",), key=("l_orderkey",)),
        Face("by_part", ("l_partkey", "l_suppkey"), lead=True),
        Face("by_quantity", ("l_suppkey", "l_quantity"), includes=("l_extendedprice",), reverse=("l_quantity",)),
    )
    return Collection(t.lineitem.drop("l_shipdate"), LINE_KEY, faces)


def documents(t: Tables) -> Collection:
    """Users whose declared half comes from clicks and whose open half from all events but clicks."""
    e = t.events
    rows = e.where("event_type = 'click'").groupBy(F.col("user_id")).agg(F.count("*").alias("clicks"))
    half = e.where("event_type <> 'click' AND user_id % 3 <> 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    half = half.join(e.select("event_id", "props"), "event_id").select("user_id", F.try_parse_json("props").alias("open"))
    return Collection(rows.where("user_id % 5 <> 0"), ["user_id"], open_half=half)


OPEN = "(SELECT user_id, max_by(props, event_id) AS props FROM events WHERE event_type <> 'click' AND user_id % 3 <> 0 GROUP BY user_id)"
CLICKS = "(SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' AND user_id % 5 <> 0 GROUP BY user_id)"
O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"  # noqa: E741


@query("s01_point_read", f"SELECT {O} FROM orders WHERE o_orderkey = 77")
def _(t):
    return orders(t).get(o_orderkey=77)


@query("s02_exists", "SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 99")
def _(t):
    return orders(t).has_frame(o_orderkey=99)


@query("s03_point_parts", f"SELECT c.clicks, o.props IS NOT NULL AS has_open, CAST(json_extract(o.props, '$.k') AS BIGINT) AS k FROM (SELECT CAST(7 AS BIGINT) AS user_id) q LEFT JOIN {CLICKS} c USING (user_id) LEFT JOIN {OPEN} o USING (user_id)")
def _(t):
    got = documents(t).get_parts(user_id=7)
    return got.select("row.clicks", F.col("open").isNotNull().alias("has_open"), F.try_variant_get("open", "$.k", "bigint").alias("k"))


@query("s04_key_prefix", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 5 ORDER BY 1 DESC, 2 DESC, 3 DESC, 4 DESC LIMIT 3 OFFSET 1")
def _(t):
    return lines(t).scan_keys(5, reverse=True, take=3, skip=1)


@query("s05_full_scan", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return lines(t).all()


@query("s06_document_keys", f"SELECT user_id FROM {CLICKS} UNION SELECT user_id FROM {OPEN}")
def _(t):
    return documents(t).document_keys().ordered()


@query("s07_raw_documents", f"SELECT user_id, c.clicks, o.props IS NOT NULL AS has_open FROM {CLICKS} c FULL JOIN {OPEN} o USING (user_id)")
def _(t):
    return documents(t).raw_documents().select("user_id", "row.clicks", F.col("open").isNotNull().alias("has_open"))


@query("s08_face_scan", f"SELECT {O} FROM orders WHERE o_orderpriority LIKE '1-%'")
def _(t):
    return orders(t).scan("by_priority", "1-")


@query("s09_exact_scan", f"SELECT {O} FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'O'")
def _(t):
    return orders(t).exact("by_status", 10, "O")


@query("s10_range_scan", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 20")
def _(t):
    return orders(t).range("by_customer", 10, 20, parts=(FIELDS, KEY))


@query("s12_parts", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = 42")
def _(t):
    return orders(t).scan("by_customer", 42, parts=(FIELDS, KEY))


@query("s13_count_only", "SELECT count(*) AS entries FROM orders WHERE o_custkey = 42")
def _(t):
    return orders(t).count("by_customer", 42)


@query("s14_covered_scan", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42")
def _(t):
    return orders(t).covered("by_customer", 42)


@query("s15_entry_keys", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 3")
def _(t):
    return lines(t).entry_keys("by_supplier", 3).df


@query("s16_fetch_back", "SELECT k.o_orderkey, o_custkey, o_totalprice FROM (SELECT DISTINCT l_orderkey + 14900 AS o_orderkey FROM lineitem WHERE l_suppkey = 3 AND l_orderkey < 200) k LEFT JOIN orders USING (o_orderkey)")
def _(t):
    keys = KeySet(t.lineitem.where("l_suppkey = 3 AND l_orderkey < 200").select((F.col("l_orderkey") + 14900).alias("o_orderkey")))
    return keys.fetch(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"))


@query("f01_plain_face", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders")
def _(t):
    return orders(t).scan("by_status", parts=(FIELDS, KEY))


@query("f02_covering_face", "SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders")
def _(t):
    return orders(t).scan("by_status", parts=(FIELDS, KEY, INCLUDE))


@query("f03_truncated_key", "SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem")
def _(t):
    return lines(t).scan("by_supplier", parts=(FIELDS, KEY))


@query("f04_function_face", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS band, o_orderkey FROM orders")
def _(t):
    return orders(t).scan("by_price_band", parts=(FIELDS, KEY))


@query("f05_multi_value_face", "SELECT DISTINCT unnest(string_split(o_orderpriority, '-')) AS word, o_orderkey FROM orders")
def _(t):
    return orders(t).scan("by_word", parts=(FIELDS, KEY))


@query("f06_partial_face", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    return orders(t).scan("open_only", parts=(FIELDS, KEY))


@query("f07_path_face", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 255")
def _(t):
    e = Collection(t.events.select("event_id", F.try_parse_json("props").alias("open")), ["event_id"], [Face("by_k", ("k",), path=("k", "u8"))])
    return e.scan("by_k", parts=(FIELDS, KEY)).select(F.col("k").cast("bigint").alias("k"), "event_id")


@query("f10_lead_face", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 12")
def _(t):
    return lines(t).scan("by_part", 12, parts=(FIELDS, KEY))


# predicates and projections


@query("p01_physical_equality", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 1234")
def _(t):
    return t.lineitem.where("l_orderkey = 1234").select("l_orderkey", "l_linenumber", "l_quantity")


@query("p02_physical_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 200")
def _(t):
    return t.lineitem.where("l_orderkey >= 100 AND l_orderkey < 200").select("l_orderkey", "l_linenumber", "l_quantity")


@query("p03_filter", "SELECT l_orderkey, l_quantity * l_extendedprice AS amount FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 10")
def _(t):
    return t.lineitem.where("l_discount > 0.05 AND l_quantity < 10").select("l_orderkey", (F.col("l_quantity") * F.col("l_extendedprice")).alias("amount"))


@query("p04_event_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def _(t):
    return t.events.where("event_type = 'purchase' AND value > 50").select("event_id", "user_id")


@query("p05_field_filter", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select("event_id", k.alias("k")).where("k >= 90")


@query("p06_event_map", "SELECT event_id, user_id, round(value * 100) AS cents FROM events")
def _(t):
    return t.events.select("event_id", "user_id", F.round(F.col("value") * 100).alias("cents"))


@query("p07_redaction", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_mktsegment FROM customer")
def _(t):
    from ..schema import CollectionSchema, Field

    s = CollectionSchema("customer", (Field("c_custkey", "i64"),), (Field("c_name", "str", redact=True), Field("c_mktsegment", "str")))
    return s.exported(t.customer.select("c_custkey", "c_name", "c_mktsegment"))


# joins


@query("j01_inner_join", "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return joins.inner(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), t.customer.select("c_custkey", "c_name"), ["c_custkey"])


@query("j02_full_alignment", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.k = b.k")
def _(t):
    return urgent(t, "o_orderstatus = 'O'").merge(building(t))


def urgent(t: Tables, condition: str = "o_orderpriority = '1-URGENT'") -> KeySet:
    return KeySet(t.orders.where(condition).select(F.col("o_custkey").alias("k")))


def building(t: Tables) -> KeySet:
    return KeySet(t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")))


U = "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'"
B = "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"
N = "SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0"


@query("j03_left_remainder", f"{B} EXCEPT {U}")
def _(t):
    return building(t).difference(urgent(t)).df


@query("j04_left_outer", "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def _(t):
    return joins.left_outer(t.customer.select("c_custkey", "c_name"), t.orders.where("o_totalprice > 300000").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("j05_semi_join", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({U}) AND c_mktsegment = 'BUILDING'")
def _(t):
    return flagship(t)


def flagship(t: Tables) -> DataFrame:
    """Customers of a segment with an urgent order: two key sets, intersected, then rows."""
    return (building(t) & urgent(t)).semi(t.customer.select("c_custkey", "c_name"), ["c_custkey"])


@query("j06_anti_join", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN ({U})")
def _(t):
    return urgent(t).anti(t.customer.select("c_custkey", "c_name"), ["c_custkey"])


@query("j07_merge_join", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    return joins.merge_join(t.lineitem.select(*LINE_KEY), t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"])


@query("j08_n_way", f"({B} INTERSECT {U}) EXCEPT {N}")
def _(t):
    negative = KeySet(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k")))
    return joins.chain(building(t), ("and", urgent(t)), ("minus", negative)).df


@query("j09_relation_table", "SELECT p_partkey, p_name, s_suppkey, s_name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def _(t):
    pairs = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    return joins.through(t.part.select("p_partkey", "p_name"), pairs, t.supplier.select("s_suppkey", "s_name"), "p_partkey", "s_suppkey")


@query("j10_ref", "SELECT s_suppkey, s_nationkey, n_name AS child_n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def _(t):
    return joins.deref(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", t.nation.where("n_regionkey <> 2"), "n_nationkey").select("s_suppkey", "s_nationkey", "child_n_name")


@query("j11_refs", "SELECT k, string_agg(coalesce(n_name, '-'), ',' ORDER BY pos) AS names FROM (SELECT s_suppkey AS k, unnest([s_nationkey, s_nationkey + 1, 99]) AS ref, unnest([0, 1, 2]) AS pos FROM supplier) LEFT JOIN nation ON ref = n_nationkey GROUP BY k")
def _(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("k"), F.array(F.col("s_nationkey"), F.col("s_nationkey") + 1, F.lit(99)).alias("refs"))
    got = joins.deref_all(rows, ["k"], "refs", t.nation, "n_nationkey", "n_name")
    return got.select("k", F.array_join("values", ",", "-").alias("names"))


@query("j12_graph_hop", "SELECT c_custkey, l_suppkey AS far, count(*) AS edges FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(t):
    from .graphs import purchases

    heads = t.customer.select(F.lit("customer").alias("ns"), F.col("c_custkey").alias("id"))
    return purchases(t).hop(heads).groupBy(F.col("src").alias("c_custkey"), F.col("dst").alias("far")).agg(F.sum("weight").alias("edges"))


# set operations


@query("k01_merge", f"SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT DISTINCT k FROM ({U})) a FULL JOIN (SELECT DISTINCT k FROM ({B})) b ON a.k = b.k")
def _(t):
    return urgent(t).merge(building(t))


@query("k02_intersect", f"{U} INTERSECT {B}")
def _(t):
    return urgent(t).intersect(building(t)).df


@query("k03_difference", f"{U} EXCEPT {B}")
def _(t):
    return urgent(t).difference(building(t)).df


@query("k04_union", f"{U} UNION {B}")
def _(t):
    return urgent(t).union(building(t)).df


@query("k04b_union_left_wins", "SELECT k, side FROM (SELECT DISTINCT o_custkey AS k, 'left' AS side FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    return prefer_left(urgent(t).df.withColumn("side", F.lit("left")), building(t).df.withColumn("side", F.lit("right")), ["k"])


@query("k05_held_ops", f"(({U} INTERSECT {B}) UNION ({N})) EXCEPT SELECT k FROM ({U}) WHERE k % 2 = 0")
def _(t):
    a, b = urgent(t).held(), building(t).held()
    negative = KeySet(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k")))
    return (((a & b) | negative) - KeySet(a.df.where("k % 2 = 0"))).df


@query("k06_gallop", f"SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    big = KeySet(t.lineitem.select(F.col("l_orderkey").alias("k")))
    return big.gallop_intersect(KeySet(t.orders.where("o_totalprice > 400000").select(F.col("o_orderkey").alias("k")))).df


@query("k07_intersect_seek", f"{B} INTERSECT {U}")
def _(t):
    return building(t).gallop_intersect(urgent(t)).df


@query("k08_difference_seek", f"{B} EXCEPT {U}")
def _(t):
    return building(t).gallop_difference(urgent(t)).df


@query("k09_union_seek", f"{B} UNION {U}")
def _(t):
    return building(t).union(urgent(t)).df


@query("k10_construct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t):
    return KeySet(t.lineitem, ["l_partkey", "l_suppkey"]).df


@query("k11_contains_len", f"SELECT count(DISTINCT k) AS n, count(*) = 0 AS is_empty, count_if(k = 5) > 0 AS has_5 FROM ({U})")
def _(t):
    return urgent(t).df.agg(F.count("*").alias("n"), (F.count("*") == 0).alias("is_empty"), (F.count_if(F.col("k") == 5) > 0).alias("has_5"))


@query("k13_partition_law", f"SELECT k, k IN ({B}) AS both FROM (SELECT DISTINCT k FROM ({U}))")
def _(t):
    a, b = urgent(t), building(t)
    return (a & b).df.withColumn("both", F.lit(True)).unionByName((a - b).df.withColumn("both", F.lit(False)))


# order and limits


@query("o01_natural_order", "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 50")
def _(t):
    return orders(t).scan("by_customer", parts=(FIELDS, KEY), take=50)


@query("o02_reverse_scan", "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1 DESC, 2 DESC LIMIT 50")
def _(t):
    return orders(t).scan("by_customer", parts=(FIELDS, KEY), reverse=True, take=50)


@query("o03_reverse_field", "SELECT l_suppkey, l_quantity, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 4 ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def _(t):
    return lines(t).scan("by_quantity", 4, parts=(FIELDS, KEY), take=20)


@query("o04_limit", "SELECT o_orderkey FROM orders WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey LIMIT 10")
def _(t):
    return orders(t).range("by_customer", 100, parts=(FIELDS, KEY), ordered=True).limit(10).select("o_orderkey")


@query("o05_offset_page", "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 10 OFFSET 30")
def _(t):
    return orders(t).scan("by_customer", parts=(FIELDS, KEY), take=10, skip=30)


@query("o06_first_match", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 1")
def _(t):
    return t.orders.where("o_totalprice > 200000").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(1)


@query("o06b_take_while", "SELECT event_id, value FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE NOT value < 90)")
def _(t):
    return take_while(t.events.select("event_id", "value"), ["event_id"], F.col("value") < 90)


@query("o07_top_k_distance", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, CAST(round(list_sum(list_transform(list_zip(embedding, e), lambda p: power(CAST(p[1] - p[2] AS DOUBLE), 2))), 4) AS DOUBLE) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10")
def _(t):
    q = t.embeddings.where("vec_id = 0").first()["embedding"]
    return nearest(t.embeddings, "vec_id", "embedding", q, 10, digits=4).select("vec_id", "distance")


@query("o08_top_k_tally", "SELECT c_mktsegment AS id, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, id LIMIT 3")
def _(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(3)


@query("v08_path_extraction", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    found = paths.resolve(F.try_parse_json("props"), "k")
    return t.events.select("event_id", F.try_variant_get(F.get(found, 0), "$", "bigint").alias("k"))

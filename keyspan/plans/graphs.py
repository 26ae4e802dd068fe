"""Graphs, clusters and graph algorithms: customers buy of suppliers, customers live in nations, nations are in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators.clusters import Store
from ..operators.graph import EDGE, Graph
from ..session import stored
from .registry import Tables, query

BOUGHT = "(SELECT 'customer' AS src_ns, o_custkey AS src, 'buys' AS predicate, 'supplier' AS dst_ns, l_suppkey AS dst, count(*) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey)"
LIVES = "(SELECT 'customer' AS src_ns, c_custkey AS src, 'lives' AS predicate, 'nation' AS dst_ns, CAST(c_nationkey AS BIGINT) AS dst, CAST(1 AS BIGINT) AS weight FROM customer)"
PART_OF = "(SELECT 'nation' AS src_ns, CAST(n_nationkey AS BIGINT) AS src, 'part_of' AS predicate, 'region' AS dst_ns, CAST(n_regionkey AS BIGINT) AS dst, CAST(1 AS BIGINT) AS weight FROM nation)"
SITS = "(SELECT 'supplier' AS src_ns, s_suppkey AS src, 'sits' AS predicate, 'nation' AS dst_ns, CAST(s_nationkey AS BIGINT) AS dst, CAST(1 AS BIGINT) AS weight FROM supplier)"
E = f"(SELECT * FROM {LIVES} UNION ALL SELECT * FROM {PART_OF} UNION ALL SELECT * FROM {SITS})"
COLS = "src_ns, src, predicate, dst_ns, dst, weight"


def _edges(df: DataFrame, src_ns: str, src: str, predicate: str, dst_ns: str, dst: str) -> DataFrame:
    return df.select(F.lit(src_ns).alias("src_ns"), F.col(src).cast("bigint").alias("src"), F.lit(predicate).alias("predicate"), F.lit(dst_ns).alias("dst_ns"), F.col(dst).cast("bigint").alias("dst"), F.lit(1).cast("bigint").alias("weight"))


def purchases(t: Tables) -> Graph:
    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("weight"))
    named = bought.select(F.lit("customer").alias("src_ns"), F.col("o_custkey").alias("src"), F.lit("buys").alias("predicate"), F.lit("supplier").alias("dst_ns"), F.col("l_suppkey").alias("dst"), "weight")
    return Graph(named)


def places(t: Tables) -> Graph:
    edges = _edges(t.customer, "customer", "c_custkey", "lives", "nation", "c_nationkey").union(_edges(t.nation, "nation", "n_nationkey", "part_of", "region", "n_regionkey")).union(_edges(t.supplier, "supplier", "s_suppkey", "sits", "nation", "s_nationkey"))
    return Graph(edges)


def store(t: Tables) -> Store:
    """Segments are node sets of customers under the cluster 1000, regions are node sets of nations, quarters edge sets of
    who lives where."""
    p = places(t)
    segments = t.customer.select("c_mktsegment").distinct().select((F.ascii("c_mktsegment").cast("bigint") + F.length("c_mktsegment")).alias("id"))
    clusters = segments.select(F.lit("segment").alias("kind"), "id", F.lit(1000).cast("bigint").alias("parent"))
    clusters = clusters.union(t.region.select(F.lit("region"), F.col("r_regionkey").cast("bigint"), F.lit(2000).cast("bigint")))
    clusters = clusters.union(t.spark.createDataFrame([("root", 1000, 1), ("root", 2000, 1), ("root", 1, 0), ("region", 77, 2000), ("quarter", 0, 1), ("quarter", 1, 1)], "kind string, id bigint, parent bigint"))
    nodes = t.customer.select(F.lit("segment").alias("kind"), (F.ascii("c_mktsegment").cast("bigint") + F.length("c_mktsegment")).alias("id"), F.lit("customer").alias("ns"), F.col("c_custkey").alias("node"))
    nodes = nodes.union(t.nation.select(F.lit("region"), F.col("n_regionkey").cast("bigint"), F.lit("nation"), F.col("n_nationkey").cast("bigint")))
    members = p.edges.where("predicate = 'lives' AND src % 4 < 2").select(F.lit("quarter").alias("kind"), F.pmod("src", F.lit(4)).alias("id"), *EDGE)
    known = t.customer.select(F.lit("customer").alias("ns"), F.col("c_custkey").alias("node")).union(t.nation.select(F.lit("nation"), F.col("n_nationkey").cast("bigint")))
    return Store(known, p.edges, clusters, members, nodes)


SEG = "(ascii(c_mktsegment) + length(c_mktsegment))::BIGINT"
NODES = f"(SELECT 'segment' AS kind, {SEG} AS id, 'customer' AS ns, c_custkey AS node FROM customer UNION ALL SELECT 'region', n_regionkey::BIGINT, 'nation', n_nationkey::BIGINT FROM nation)"
MEMBERS = f"(SELECT 'quarter' AS kind, src % 4 AS id, src_ns, src, predicate, dst_ns, dst FROM {LIVES} WHERE src % 4 < 2)"
CLUSTERS = f"(SELECT DISTINCT 'segment' AS kind, {SEG} AS id, 1000::BIGINT AS parent FROM customer UNION ALL SELECT 'region', r_regionkey::BIGINT, 2000 FROM region UNION ALL VALUES ('root', 1000::BIGINT, 1::BIGINT), ('root', 2000, 1), ('root', 1, 0), ('region', 77, 2000), ('quarter', 0, 1), ('quarter', 1, 1))"


@query("g01_edge_read", f"SELECT {COLS} FROM {E} WHERE src_ns = 'customer' AND src = 5 AND predicate = 'lives'")
def _(t):
    nation = t.customer.where("c_custkey = 5").first()["c_nationkey"]
    return places(t).edge_at("lives", ("customer", 5), ("nation", nation))


@query("g02_all_edges", f"SELECT {COLS} FROM {E}")
def _(t):
    return places(t).all_edges()


@query("g03_has_edges", f"SELECT count(*) > 0 AS has FROM {E}")
def _(t):
    return t.spark.range(1).select(F.lit(places(t).has_edges()).alias("has"))


@query("g04_out_in_edges", f"SELECT {COLS} FROM {E} WHERE (src_ns = 'nation' AND src = 3) OR (dst_ns = 'nation' AND dst = 3)")
def _(t):
    p = places(t)
    return p.out_edges(("nation", 3)).union(p.in_edges(("nation", 3)))


@query("g05_typed_edges", f"SELECT {COLS} FROM {E} WHERE dst_ns = 'nation' AND dst = 3 AND predicate = 'sits'")
def _(t):
    return places(t).in_edges(("nation", 3), "sits")


@query("g06_pair_filter", f"SELECT {COLS} FROM {BOUGHT} WHERE src = 11 AND dst < 5")
def _(t):
    p = purchases(t)
    found = p.out_edges_to(("customer", 11), ("supplier", 0))
    for s in range(1, 5):
        found = found.union(p.in_edges_from(("supplier", s), ("customer", 11)))
    return found


@query("g07_of_predicate", f"SELECT {COLS} FROM {E} WHERE predicate = 'part_of'")
def _(t):
    return places(t).edges_of_predicate("part_of")


@query("g08_by_attributes", f"SELECT {COLS} FROM {BOUGHT} WHERE weight = 3")
def _(t):
    return purchases(t).by_attributes(["weight"], weight=3)


@query("g09_far_nodes", "SELECT 'lives' AS predicate, 'customer' AS ns, c_custkey AS id FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'sits', 'supplier', s_suppkey FROM supplier WHERE s_nationkey = 4")
def _(t):
    return places(t).in_nodes(("nation", 4))


@query("g10_walk", f"SELECT b.dst_ns AS ns, b.dst AS id FROM {LIVES} a JOIN {PART_OF} b ON a.dst = b.src ")
def _(t):
    p = places(t)
    heads = t.customer.select(F.lit("customer").alias("ns"), F.col("c_custkey").alias("id"))
    return p.walk(p.walk(heads, ["lives"]), ["part_of"])


HOPS = f"""WITH RECURSIVE s AS (SELECT src_ns AS a_ns, src AS a, dst_ns AS b_ns, dst AS b FROM {E} UNION ALL SELECT dst_ns, dst, src_ns, src FROM {E}),
r(ns, id, hop) AS (SELECT 'region', 2::BIGINT, 0 UNION SELECT b_ns, b, hop + 1 FROM r JOIN s ON ns = a_ns AND id = a WHERE hop < 2),
m AS (SELECT ns, id, min(hop) AS hop FROM r GROUP BY ns, id)"""


def _region(t: Tables) -> DataFrame:
    return t.region.where("r_regionkey = 2").select(F.lit("region").alias("ns"), F.col("r_regionkey").cast("bigint").alias("id"))


@query("g11_hops", f"{HOPS} SELECT * FROM m")
def _(t):
    return places(t).hops(_region(t), 2, both_ways=True)


CUT = "SELECT src_ns, src, predicate, dst_ns, dst, weight, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'interior' ELSE 'boundary' END AS side, CASE WHEN a.id IS NULL THEN dst_ns WHEN b.id IS NULL THEN src_ns END AS member_ns, CASE WHEN a.id IS NULL THEN dst WHEN b.id IS NULL THEN src END AS member, CASE WHEN a.id IS NULL THEN src_ns WHEN b.id IS NULL THEN dst_ns END AS far_ns, CASE WHEN a.id IS NULL THEN src WHEN b.id IS NULL THEN dst END AS far"


@query("g12_subgraph", f"{HOPS.replace('hop < 2', 'hop < 1')} {CUT} FROM {E} e LEFT JOIN m a ON a.ns = src_ns AND a.id = src LEFT JOIN m b ON b.ns = dst_ns AND b.id = dst WHERE a.id IS NOT NULL OR b.id IS NOT NULL")
def _(t):
    return places(t).subgraph(_region(t), 1)


@query("g13_cut", f"WITH m AS (SELECT 'nation' AS ns, n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey < 6 UNION ALL SELECT 'region', 1) {CUT} FROM {E} e LEFT JOIN m a ON a.ns = src_ns AND a.id = src LEFT JOIN m b ON b.ns = dst_ns AND b.id = dst WHERE a.id IS NOT NULL OR b.id IS NOT NULL")
def _(t):
    chosen = t.nation.where("n_nationkey < 6").select(F.lit("nation").alias("ns"), F.col("n_nationkey").cast("bigint").alias("id"))
    return places(t).cut(chosen.union(t.region.where("r_regionkey = 1").select(F.lit("region"), F.col("r_regionkey").cast("bigint"))))


@query("g14_predicates", f"SELECT DISTINCT predicate FROM {E}")
def _(t):
    return places(t).predicates()


@query("g16_conjunctive", f"SELECT src, dst FROM {BOUGHT} WHERE weight >= 2 INTERSECT SELECT src, dst FROM {BOUGHT} JOIN supplier ON s_suppkey = dst WHERE s_acctbal > 0")
def _(t):
    g = purchases(t)
    rich = t.supplier.where("s_acctbal > 0").select(F.lit("supplier").alias("ns"), F.col("s_suppkey").alias("id"))
    return g.edges.where("weight >= 2").select("src", "dst").intersect(g.hop(rich, inward=True).select("src", "dst"))


@query("g17_open_attributes", "SELECT user_id AS src, event_id AS dst, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id = 9 AND event_type = 'click'")
def _(t):
    e = t.events.select(F.lit("user").alias("src_ns"), F.col("user_id").alias("src"), F.col("event_type").alias("predicate"), F.lit("event").alias("dst_ns"), F.col("event_id").alias("dst"), F.try_parse_json("props").alias("attrs"))
    return Graph(e).out_edges(("user", 9), "click").select("src", "dst", F.try_variant_get("attrs", "$.k", "bigint").alias("k"))


# clusters


@query("h08_lookup", f"SELECT kind, id, parent FROM {CLUSTERS} WHERE kind = 'segment' OR (kind = 'quarter')")
def _(t):
    s = store(t)
    return s.lookup("segment").union(s.edge_sets().select("kind", "id", "parent"))


@query("h09_members", f"SELECT src AS node FROM {MEMBERS} WHERE id = 1 UNION ALL SELECT node FROM {NODES} WHERE kind = 'region' AND id = 3")
def _(t):
    s = store(t)
    return s.edges_in("quarter", 1).select(F.col("src").alias("node")).union(s.nodes_in("region", 3).select("node"))


@query("h10_member_tests", f"SELECT kind, id, src FROM {MEMBERS} WHERE src IN (4, 5, 6)")
def _(t):
    s = store(t)
    return s.edge_sets_of(s.edges.where("predicate = 'lives' AND src IN (4, 5, 6)")).select("kind", "id", "src")


@query("h11_sets_of_node", f"SELECT DISTINCT kind, id FROM (SELECT kind, id FROM {MEMBERS} WHERE src = 5 AND src_ns = 'customer' UNION ALL SELECT kind, id FROM {NODES} WHERE ns = 'customer' AND node = 5)")
def _(t):
    return store(t).node_sets_of("customer", 5)


@query("h12_descendants", f"WITH RECURSIVE c AS (SELECT * FROM {CLUSTERS}), r(id, depth) AS (SELECT id, 1 FROM c WHERE parent = 1 UNION SELECT c.id, depth + 1 FROM r JOIN c ON c.parent = r.id WHERE depth < 6) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def _(t):
    return store(t).descendants(1)


@query("h13_participants", f"SELECT 'customer' AS ns, src AS node FROM {MEMBERS} WHERE id = 0 UNION SELECT 'nation', dst FROM {MEMBERS} WHERE id = 0")
def _(t):
    return store(t).participants("quarter", 0)


@query("h14_cluster_algebra", f"SELECT dst FROM {MEMBERS} WHERE id = 0 INTERSECT SELECT dst FROM {MEMBERS} WHERE id = 1")
def _(t):
    s = store(t)
    return s.edges_in("quarter", 0).select("dst").intersect(s.edges_in("quarter", 1).select("dst"))


@query("h15_community_recall", f"SELECT kind, id, count(DISTINCT node) AS members FROM {NODES} WHERE ns = 'customer' AND node IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1, 2 ORDER BY members DESC, kind, id LIMIT 3")
def _(t):
    return store(t).community_recall(t.customer.where("c_acctbal < 0").select(F.lit("customer").alias("ns"), F.col("c_custkey").alias("node")), 3)


@query("h16_kinds", f"SELECT DISTINCT kind FROM {CLUSTERS}")
def _(t):
    return store(t).clusters.select("kind").distinct()


# algorithms, over who bought of whom, both ways: customer c is node 2c, supplier s is node 2s + 1


PAIRS = f"(SELECT 2 * src AS node, 2 * dst + 1 AS neighbor FROM {BOUGHT} UNION ALL SELECT 2 * dst + 1, 2 * src FROM {BOUGHT})"
#: Each node is its own neighbour too, so that the two sides do not swap their labels for ever.
LOOPED = f"(SELECT * FROM {PAIRS} UNION ALL SELECT DISTINCT node, node FROM {PAIRS})"


def pairs(t: Tables) -> DataFrame:
    e = purchases(t).edges.select((2 * F.col("src")).alias("node"), (2 * F.col("dst") + 1).alias("neighbor"))
    return e.union(e.select("neighbor", "node"))


def _label_sql(steps: int, source: str) -> str:
    text = f"WITH p AS MATERIALIZED (SELECT * FROM {source}), l0 AS (SELECT DISTINCT node, node AS label FROM p)"
    for i in range(steps):
        text += f", v{i} AS MATERIALIZED (SELECT p.node, l.label, count(*) AS n FROM p JOIN l{i} l ON l.node = p.neighbor GROUP BY 1, 2), b{i} AS (SELECT node, label FROM v{i} QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1), l{i + 1} AS MATERIALIZED (SELECT l.node, coalesce(b.label, l.label) AS label FROM l{i} l LEFT JOIN b{i} b USING (node))"
    return f"{text} SELECT node, label FROM l{steps}"


@query("ga1_label_step", _label_sql(1, PAIRS))
def _(t):
    p = pairs(t)
    return g.label_step(p, p.select("node").distinct().withColumn("label", F.col("node")))


@query("ga2_label_propagation", _label_sql(10, LOOPED))
def _(t):
    """The ten steps of the SQL. These tables have no fixpoint: two states alternate in the end."""
    p = stored(pairs(t), "bought")
    nodes = p.select("node").distinct()
    return g.label_propagation(p.union(nodes.select("node", "node")), nodes.withColumn("label", F.col("node")), 10)


def _rank_sql(steps: int) -> str:
    text = f"WITH p AS MATERIALIZED (SELECT * FROM {PAIRS}), n AS (SELECT DISTINCT node FROM p UNION SELECT -1), c AS (SELECT count(*)::DOUBLE AS c FROM n), d AS (SELECT node, count(*) AS d FROM p GROUP BY node), r0 AS (SELECT node, 1 / c AS r FROM n, c)"
    for i in range(steps):
        text += f", z{i} AS (SELECT coalesce(sum(r), 0) AS z FROM r{i} WHERE node NOT IN (SELECT node FROM d)), f{i} AS (SELECT p.neighbor AS node, sum(r.r / d.d) AS f FROM p JOIN r{i} r ON r.node = p.node JOIN d ON d.node = p.node GROUP BY 1), r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15 / c + 0.85 * z / c + 0.85 * coalesce(f, 0) AS r FROM n CROSS JOIN c CROSS JOIN z{i} LEFT JOIN f{i} f ON f.node = n.node)"
    return f"{text} SELECT node, round(r, 9) AS rank FROM r{steps}"


@query("ga3_pagerank", _rank_sql(5))
def _(t):
    p = pairs(t)
    nodes = p.select("node").union(t.spark.range(-1, 0).toDF("node"))
    return g.pagerank(nodes, p, 5).select("node", F.round("rank", 9).alias("rank"))

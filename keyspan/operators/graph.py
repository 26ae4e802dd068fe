"""Property graphs as edge tables: reads, hops, cuts, and the two graph algorithms.

An edge is (src_ns, src, predicate, dst_ns, dst) with payload columns; that tuple is its identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import if_small, stored

EDGE = ["src_ns", "src", "predicate", "dst_ns", "dst"]


def node(ns: str | Column, key: Column) -> Column:
    return F.struct((F.lit(ns) if isinstance(ns, str) else ns).alias("ns"), key.cast("bigint").alias("id"))


class Graph:
    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None) -> None:
        """``nodes``: ns, id, and what else is known of a node."""
        self.edges, self.nodes = edges, nodes

    # reads

    def all_edges(self) -> DataFrame:
        return self.edges.orderBy(*EDGE)

    def has_edges(self) -> bool:
        return not self.edges.isEmpty()

    def edge_at(self, predicate: str, src: tuple, dst: tuple) -> DataFrame:
        return self.out_edges(src, predicate).where((F.col("dst_ns") == dst[0]) & (F.col("dst") == dst[1]))

    def has_edge(self, predicate: str, src: tuple, dst: tuple) -> bool:
        return not self.edge_at(predicate, src, dst).isEmpty()

    def out_edges(self, src: tuple, predicate: str | None = None) -> DataFrame:
        found = self.edges.where((F.col("src_ns") == src[0]) & (F.col("src") == src[1]))
        return found if predicate is None else found.where(F.col("predicate") == predicate)

    def in_edges(self, dst: tuple, predicate: str | None = None) -> DataFrame:
        found = self.edges.where((F.col("dst_ns") == dst[0]) & (F.col("dst") == dst[1]))
        return found if predicate is None else found.where(F.col("predicate") == predicate)

    def out_edges_to(self, src: tuple, dst: tuple) -> DataFrame:
        return self.out_edges(src).where((F.col("dst_ns") == dst[0]) & (F.col("dst") == dst[1]))

    def in_edges_from(self, dst: tuple, src: tuple) -> DataFrame:
        return self.out_edges_to(src, dst)

    def edges_of_predicate(self, predicate: str) -> DataFrame:
        return self.edges.where(F.col("predicate") == predicate)

    def by_attributes(self, declared: Sequence[str], **values) -> DataFrame:
        """Edges whose declared attributes all equal the values; naming fewer matches nothing."""
        if set(values) != set(declared):
            return self.edges.limit(0)
        found = self.edges
        for k, v in values.items():
            found = found.where(F.col(k) == F.lit(v))
        return found

    def out_nodes(self, src: tuple, predicate: str | None = None) -> DataFrame:
        """Far ends, once an edge."""
        return self._resolved(self.out_edges(src, predicate).select("predicate", F.col("dst_ns").alias("ns"), F.col("dst").alias("id")))

    def in_nodes(self, dst: tuple, predicate: str | None = None) -> DataFrame:
        return self._resolved(self.in_edges(dst, predicate).select("predicate", F.col("src_ns").alias("ns"), F.col("src").alias("id")))

    def _resolved(self, ends: DataFrame) -> DataFrame:
        return ends if self.nodes is None else ends.join(self.nodes, ["ns", "id"])

    def predicates(self) -> DataFrame:
        return self.edges.select("predicate").distinct()

    # walks

    def walk(self, heads: DataFrame, predicates: Sequence[str] | None = None, inward: bool = False) -> DataFrame:
        """One hop from ``heads`` (ns, id): a row for each edge met, so that paths keep their multiplicity."""
        far = ("src_ns", "src") if inward else ("dst_ns", "dst")
        return self.hop(heads, predicates, inward).select(F.col(far[0]).alias("ns"), F.col(far[1]).alias("id"))

    def hop(self, heads: DataFrame, predicates: Sequence[str] | None = None, inward: bool = False) -> DataFrame:
        """The edges met by one hop from ``heads`` (ns, id)."""
        near = ("dst_ns", "dst") if inward else ("src_ns", "src")
        edges = self.edges if predicates is None else self.edges.where(F.col("predicate").isin(*predicates))
        met = heads.select("ns", "id").join(edges, (F.col("ns") == F.col(near[0])) & (F.col("id") == F.col(near[1])))
        return met.select(*edges.columns)

    def _steps(self, predicates: Sequence[str] | None, both_ways: bool) -> DataFrame:
        edges = self.edges if predicates is None else self.edges.where(F.col("predicate").isin(*predicates))
        ahead = edges.select(F.col("src_ns").alias("a_ns"), F.col("src").alias("a"), F.col("dst_ns").alias("b_ns"), F.col("dst").alias("b"))
        if not both_ways:
            return ahead
        return ahead.union(edges.select("dst_ns", "dst", "src_ns", "src"))

    def hops(self, seeds: DataFrame, most: int, predicates: Sequence[str] | None = None, both_ways: bool = False) -> DataFrame:
        """ns, id and hop (0 for the seeds) of nodes within ``most`` hops, each at its least hop."""
        steps = self._steps(predicates, both_ways)
        reached = seeds.select("ns", "id").distinct().withColumn("hop", F.lit(0))
        ring = reached
        for hop in range(1, most + 1):
            far = ring.join(steps, (F.col("ns") == F.col("a_ns")) & (F.col("id") == F.col("a"))).select(F.col("b_ns").alias("ns"), F.col("b").alias("id")).distinct()
            ring = stored(far.join(reached.select("ns", "id"), ["ns", "id"], "left_anti").withColumn("hop", F.lit(hop)), "ring")
            reached = reached.unionByName(ring)
            if ring.isEmpty():
                break
        return reached

    def subgraph(self, seeds: DataFrame, most: int, predicates: Sequence[str] | None = None) -> DataFrame:
        """The cut around nodes within ``most`` hops either way: edges with ``side`` interior (both ends are members) or
        boundary (one is), and for the latter the member and the far end."""
        members = self.hops(seeds, most, predicates, both_ways=True).select("ns", "id")
        edges = self.edges if predicates is None else self.edges.where(F.col("predicate").isin(*predicates))
        return cut_of(edges, members)

    def cut(self, selection: DataFrame) -> DataFrame:
        return cut_of(self.edges, selection.select("ns", "id").distinct())


def cut_of(edges: DataFrame, members: DataFrame) -> DataFrame:
    s = members.select(F.col("ns").alias("src_ns"), F.col("id").alias("src"), F.lit(True).alias("__s"))
    d = members.select(F.col("ns").alias("dst_ns"), F.col("id").alias("dst"), F.lit(True).alias("__d"))
    marked = edges.dropDuplicates(EDGE).join(s, ["src_ns", "src"], "left").join(d, ["dst_ns", "dst"], "left").where("__s OR __d")
    both = F.col("__s").isNotNull() & F.col("__d").isNotNull()
    from_member = F.col("__s").isNotNull()

    def end(a: str, b: str) -> Column:
        return F.when(~both, F.when(from_member, F.col(a)).otherwise(F.col(b)))

    return marked.select(
        *edges.columns,
        F.when(both, "interior").otherwise("boundary").alias("side"),
        end("src_ns", "dst_ns").alias("member_ns"), end("src", "dst").alias("member"),
        end("dst_ns", "src_ns").alias("far_ns"), end("dst", "src").alias("far"),
    )


def label_step(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """One synchronous step of label propagation: (node, neighbor) pairs and (node, label). The most frequent label among the
    labelled neighbours wins, of equally frequent ones the smallest; a node without labelled neighbours keeps its own."""
    votes = neighbors.join(labels.toDF("neighbor", "vote"), "neighbor").groupBy("node", "vote").agg(F.count("*").alias("n"))
    best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("vote"))).alias("best"))
    return labels.join(best, "node", "left").select("node", F.coalesce("best.vote", "label").alias("label"))


def label_propagation(neighbors: DataFrame, labels: DataFrame, most: int = 30) -> DataFrame:
    """Labels after ``most`` steps. No step is made once labels stay as they are, or are those of two steps before: from there
    two states alternate, and the last one follows from the number of steps that are left.

    Pairs are stored in the order of their nodes, so that most votes of a node are counted before they are shuffled."""
    neighbors = stored(neighbors, "pairs")
    neighbors = stored(neighbors.repartitionByRange("node", "neighbor"), "neighbors")
    labels, before = stored(labels, "labels"), None
    for i in range(most):
        after = stored(label_step(neighbors, if_small(labels)), "labels")
        both = after.join(labels.toDF("node", "old"), "node").join((labels if before is None else before).toDF("node", "older"), "node")
        moved, alternate = both.selectExpr("coalesce(bool_or(label <> old), false)", "coalesce(bool_and(label = older), false)").first()
        if not moved:
            return after
        if before is not None and alternate:
            return after if (most - i - 1) % 2 == 0 else labels
        before, labels = labels, after
    return labels


def pagerank(nodes: DataFrame, neighbors: DataFrame, iterations: int, damping: float = 0.85) -> DataFrame:
    """node and rank: ranks start equal, a node without neighbours gives its rank to all alike, and what flows to targets
    outside ``nodes`` is lost. Repeated neighbours count again."""
    nodes = nodes.select("node").distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    degree = neighbors.groupBy("node").agg(F.count("*").alias("degree"))
    nodes = stored(nodes.join(degree, "node", "left"), "nodes")
    ranks = nodes.select("node", "degree", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        lost = ranks.where("degree IS NULL").agg(F.sum("rank")).first()[0] or 0.0
        base = (1 - damping) / n + damping * lost / n
        flow = neighbors.join(ranks.where("degree IS NOT NULL").select("node", (F.col("rank") / F.col("degree")).alias("part")), "node").groupBy(F.col("neighbor").alias("node")).agg(F.sum("part").alias("got"))
        ranks = nodes.join(flow, "node", "left").select("node", "degree", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        ranks = stored(ranks, "ranks")  # the next round reads it twice
    return ranks.select("node", "rank")

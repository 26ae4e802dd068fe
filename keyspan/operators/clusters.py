"""Clusters of edges and of nodes, and writes to a graph with them.

Tables: clusters (kind, id, parent, ...), edge_members (kind, id, edge columns), node_members (kind, id, ns, node).
Writes return a new snapshot and a report of counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .documents import merge_cells
from .graph import EDGE, cut_of

SET = ["kind", "id"]
MEMBER = ["ns", "node"]


class FragmentError(ValueError):
    pass


@dataclass
class Fragment:
    """Declarations: each frame may be absent. ``edges``: EDGE heads, with payload if any; ``nodes``: ns, node."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    clusters: DataFrame | None = None
    edge_members: DataFrame | None = None
    node_members: DataFrame | None = None
    report: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Store:
    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame
    edge_members: DataFrame
    node_members: DataFrame

    # reads

    def lookup(self, kind: str, id_: int | None = None) -> DataFrame:
        found = self.clusters.where(F.col("kind") == kind)
        return found if id_ is None else found.where(F.col("id") == id_)

    def edge_sets(self) -> DataFrame:
        return self.clusters.join(self.edge_members.select(*SET).distinct(), SET, "left_semi")

    def node_sets(self) -> DataFrame:
        return self.clusters.join(self.node_members.select(*SET).distinct(), SET, "left_semi")

    def edges_in(self, kind: str, id_: int) -> DataFrame:
        return self.edge_members.where((F.col("kind") == kind) & (F.col("id") == id_)).select(*EDGE)

    def nodes_in(self, kind: str, id_: int) -> DataFrame:
        return self.node_members.where((F.col("kind") == kind) & (F.col("id") == id_)).select(*MEMBER)

    def edge_sets_of(self, edges: DataFrame) -> DataFrame:
        return self.edge_members.join(edges.select(*EDGE), EDGE, "left_semi")

    def node_sets_of(self, ns: str, node: int) -> DataFrame:
        """Clusters of the node's edges, and those it was declared in; each once."""
        at = ((F.col("src_ns") == ns) & (F.col("src") == node)) | ((F.col("dst_ns") == ns) & (F.col("dst") == node))
        declared = self.node_members.where((F.col("ns") == ns) & (F.col("node") == node))
        return self.edge_members.where(at).select(*SET).union(declared.select(*SET)).distinct()

    def counts(self) -> DataFrame:
        """Each cluster's edge_count and node_count, zero if it has none."""
        e = self.edge_members.groupBy(*SET).agg(F.count("*").alias("edge_count"))
        n = self.node_members.groupBy(*SET).agg(F.count("*").alias("node_count"))
        joined = self.clusters.select(*SET).join(e, SET, "left").join(n, SET, "left")
        return joined.select(*SET, F.coalesce("edge_count", F.lit(0)).cast("bigint").alias("edge_count"), F.coalesce("node_count", F.lit(0)).cast("bigint").alias("node_count"))

    def participants(self, kind: str, id_: int) -> DataFrame:
        """Ends of member edges and declared nodes, each once."""
        e = self.edges_in(kind, id_)
        return e.select("src_ns", "src").toDF(*MEMBER).union(e.select("dst_ns", "dst").toDF(*MEMBER)).union(self.nodes_in(kind, id_)).distinct()

    def children(self, id_: int) -> DataFrame:
        return self.clusters.where(F.col("parent") == id_)

    def descendants(self, id_: int, most: int = 100) -> DataFrame:
        """Ids below a cluster with their depth; parent 0 is none. Goes down one level at a time."""
        level = self.clusters.where(F.col("parent") == id_).select("id").withColumn("depth", F.lit(1))
        out = level
        for depth in range(2, most + 1):
            level = self.clusters.join(level.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").withColumn("depth", F.lit(depth))
            level = stored(level.join(out.select("id"), "id", "left_anti"), "level")
            if level.isEmpty():
                break
            out = out.unionByName(level)
        return out

    def community_recall(self, recalled: DataFrame, most: int) -> DataFrame:
        """Clusters by how many of the recalled nodes (ns, node) they hold, ties by id."""
        met = self.node_members.join(recalled.select(*MEMBER).distinct(), MEMBER).groupBy(*SET).agg(F.countDistinct(*MEMBER).alias("members"))
        return met.orderBy(F.desc("members"), *SET).limit(most)

    # writes

    def incorporate(self, f: Fragment, edge_default: dict[str, Column], on_edge_conflict: Callable | None = None, on_cluster_conflict: Callable | None = None) -> tuple[Store, dict]:
        """All of a fragment at once. A new edge has the default payload (or what the hook makes of two defaults), a stored
        one keeps its own unless the hook ``(stored, declared) -> columns`` says otherwise; clusters merge into those of
        their name. A node that no edge or cluster of the fragment names is refused."""
        payload = [c for c in self.edges.columns if c not in EDGE]
        nodes, edges, clusters, em, nm = self.nodes, self.edges, self.clusters, self.edge_members, self.node_members
        report = {"nodes": 0, "edges": 0, "clusters": 0}
        if f.nodes is not None:
            named = [x.toDF(*MEMBER) for x in ([f.edges.select("src_ns", "src"), f.edges.select("dst_ns", "dst")] if f.edges is not None else []) + ([f.node_members.select(*MEMBER)] if f.node_members is not None else [])]
            used = named[0] if named else f.nodes.select(*MEMBER).limit(0)
            for x in named[1:]:
                used = used.union(x)
            if not f.nodes.select(*MEMBER).join(used, MEMBER, "left_anti").isEmpty():
                raise FragmentError("a node without an edge or a cluster")
            fresh = f.nodes.select(*MEMBER).distinct().join(nodes.select(*MEMBER), MEMBER, "left_anti")
            report["nodes"] = fresh.count()
            nodes = nodes.unionByName(fresh, allowMissingColumns=True)
        if f.edges is not None:
            heads = f.edges.select(*EDGE, *[c for c in payload if c in f.edges.columns]).dropDuplicates(EDGE)
            declared = heads.select(*EDGE, F.struct(*[(F.col(c) if c in heads.columns else edge_default[c]).alias(c) for c in payload]).alias("__declared"), F.lit(True).alias("__new"))
            stored_ = edges.select(*EDGE, F.struct(*payload).alias("__stored"))
            both = stored_.join(declared, EDGE, "full")
            default = F.struct(*[edge_default[c].alias(c) for c in payload])
            fresh_value = F.col("__declared") if any(c in heads.columns for c in payload) else default
            if on_edge_conflict is not None:
                first = on_edge_conflict(default, default)
                again = on_edge_conflict(F.col("__stored"), F.col("__declared"))
            else:
                first, again = fresh_value, F.col("__stored")
            value = F.when(F.col("__stored").isNull(), first).when(F.col("__new"), again).otherwise(F.col("__stored"))
            report["edges"] = both.where("__stored IS NULL").count()
            edges = both.select(*EDGE, value.alias("__v")).select(*EDGE, *[F.col("__v")[c].alias(c) for c in payload])
        if f.clusters is not None:
            rest = [c for c in clusters.columns if c not in SET]
            d = f.clusters.select(*SET, F.struct(*[(F.col(c) if c in f.clusters.columns else F.lit(None).cast(clusters.schema[c].dataType)).alias(c) for c in rest]).alias("__d"))
            both = clusters.select(*SET, F.struct(*rest).alias("__s")).join(d, SET, "full")
            over = F.struct(*[F.coalesce(F.col("__d")[c], F.col("__s")[c]).alias(c) for c in rest])
            value = over if on_cluster_conflict is None else F.when(F.col("__s").isNull() | F.col("__d").isNull(), over).otherwise(on_cluster_conflict(F.col("__s"), over))
            report["clusters"] = both.where("__s IS NULL").count()
            clusters = both.select(*SET, value.alias("__v")).select(*SET, *[F.col("__v")[c].alias(c) for c in rest])
        if f.edge_members is not None:
            em = em.unionByName(f.edge_members.select(*em.columns)).distinct()
        if f.node_members is not None:
            nm = nm.unionByName(f.node_members.select(*nm.columns)).distinct()
        return Store(nodes, edges, clusters, em, nm), report

    def incorporate_open(self, declared: DataFrame, open_column: str = "open") -> tuple[Store, dict]:
        """Clusters (kind, id, JSON text of open names, and a parent if they have one) merged into those of their name, map
        by map; a new one has what it declares."""
        d = declared.select(*SET, F.col(open_column).alias("__open"), (F.col("parent") if "parent" in declared.columns else F.lit(None)).cast("bigint").alias("__parent"), F.lit(True).alias("__new"))
        both = self.clusters.withColumn("__there", F.lit(True)).join(d, SET, "full")
        out = both.select(*[{open_column: merge_cells(F.array(open_column, "__open")).alias(open_column), "parent": F.coalesce("__parent", "parent", F.lit(0)).cast("bigint").alias("parent")}.get(c, F.col(c)) for c in self.clusters.columns])
        return replace(self, clusters=out), {"clusters": both.where("__there IS NULL").count()}

    def retract(self, f: Fragment) -> tuple[Store, dict]:
        """Deletes nodes with their edges and memberships, and edges without their ends. Clusters keep their rows."""
        edges, nodes, em, nm = self.edges, self.nodes, self.edge_members, self.node_members
        gone = edges.limit(0).select(*EDGE)
        if f.edges is not None:
            gone = edges.join(f.edges.select(*EDGE), EDGE, "left_semi").select(*EDGE)
        report = {"nodes": 0, "edges": 0}
        if f.nodes is not None:
            out = f.nodes.select(*MEMBER).distinct()
            for ns, end in (("src_ns", "src"), ("dst_ns", "dst")):
                gone = gone.union(edges.join(out.toDF(ns, end), [ns, end], "left_semi").select(*EDGE))
            report["nodes"] = nodes.join(out, MEMBER, "left_semi").count()
            nodes = nodes.join(out, MEMBER, "left_anti")
            nm = nm.join(out, MEMBER, "left_anti")
        gone = gone.distinct()
        report["edges"] = gone.count()
        return Store(nodes, edges.join(gone, EDGE, "left_anti"), self.clusters, em.join(gone, EDGE, "left_anti"), nm), report

    def replace(self, removed: Fragment, declared: Fragment, edge_default: dict[str, Column], **hooks) -> tuple[Store, dict]:
        """A removal and a declaration as one change. Refused if an edge is left with one end removed that the fragments do
        not account for."""
        if removed.nodes is not None:
            half = cut_of(self.edges.select(*EDGE), removed.nodes.select(F.col("ns"), F.col("node").alias("id")).distinct()).where("side = 'boundary'").select(*EDGE)
            for f in (removed, declared):
                if f.edges is not None:
                    half = half.join(f.edges.select(*EDGE), EDGE, "left_anti")
            if not half.isEmpty():
                raise FragmentError("half-edges of removed nodes are not accounted for")
        without, out = self.retract(removed)
        store, made = without.incorporate(declared, edge_default, **hooks)
        return store, {"removed": out, "declared": made}

    def repoint(self, old: tuple, new: tuple, end: str = "dst", on_conflict: Callable | None = None) -> Store:
        """Moves that end of edges from one node to another with their payload. Where the target edge exists, the hook
        ``(stored, moved)`` decides, else the moved payload wins."""
        payload = [c for c in self.edges.columns if c not in EDGE]
        at = (F.col(f"{end}_ns") == old[0]) & (F.col(end) == old[1])
        moved = self.edges.where(at).withColumn(f"{end}_ns", F.lit(new[0])).withColumn(end, F.lit(new[1]).cast(self.edges.schema[end].dataType))
        rest = self.edges.where(~at).select(*EDGE, F.struct(*payload).alias("__s"))
        both = rest.join(moved.select(*EDGE, F.struct(*payload).alias("__m")), EDGE, "full")
        value = F.coalesce("__m", "__s")
        if on_conflict is not None:
            value = F.when(F.col("__s").isNotNull() & F.col("__m").isNotNull(), on_conflict(F.col("__s"), F.col("__m"))).otherwise(value)
        edges = both.select(*EDGE, value.alias("__v")).select(*EDGE, *[F.col("__v")[c].alias(c) for c in payload])
        held = self.edge_members.withColumn(f"{end}_ns", F.when(at, F.lit(new[0])).otherwise(F.col(f"{end}_ns"))).withColumn(end, F.when(at, F.lit(new[1])).otherwise(F.col(end)).cast(self.edge_members.schema[end].dataType))
        return replace(self, edges=edges, edge_members=held.distinct())

    def materialize(self, kind: str, id_: int, selection: DataFrame) -> Store:
        """A node set from a selection; nodes that are not known contribute nothing."""
        known = selection.select(*MEMBER).distinct().join(self.nodes.select(*MEMBER), MEMBER, "left_semi")
        rows = known.select(F.lit(kind).alias("kind"), F.lit(id_).cast(self.node_members.schema["id"].dataType).alias("id"), *MEMBER)
        return replace(self.declare(kind, id_), node_members=self.node_members.unionByName(rows).distinct())

    def declare(self, kind: str, id_: int, parent: int = 0) -> Store:
        there = self.clusters.where((F.col("kind") == kind) & (F.col("id") == id_))
        one = self.clusters.sparkSession.createDataFrame([(kind, id_, parent)], "kind string, id bigint, parent bigint")
        fresh = one.join(there.select(*SET), SET, "left_anti")
        return replace(self, clusters=self.clusters.unionByName(fresh, allowMissingColumns=True))

    def remove_members(self, kind: str, id_: int, edges: DataFrame | None = None, nodes: DataFrame | None = None) -> Store:
        """Takes members out of a cluster; edges and nodes stay."""
        here = (F.col("kind") == kind) & (F.col("id") == id_)
        em, nm = self.edge_members, self.node_members
        if edges is not None:
            em = em.where(~here).unionByName(em.where(here).join(edges.select(*EDGE), EDGE, "left_anti").select(*em.columns))
        if nodes is not None:
            nm = nm.where(~here).unionByName(nm.where(here).join(nodes.select(*MEMBER), MEMBER, "left_anti").select(*nm.columns))
        return replace(self, edge_members=em, node_members=nm)

    def delete_set(self, kind: str, id_: int) -> Store:
        here = (F.col("kind") == kind) & (F.col("id") == id_)
        return replace(self, clusters=self.clusters.where(~here), edge_members=self.edge_members.where(~here), node_members=self.node_members.where(~here))

    def merge_sets(self, kind: str, target: int, sources: Sequence[int]) -> Store:
        """Members of the sources join the target; the sources go."""
        from_source = (F.col("kind") == kind) & F.col("id").isin(*sources)

        def moved(df: DataFrame) -> DataFrame:
            return df.withColumn("id", F.when(from_source, F.lit(target)).otherwise(F.col("id")).cast(df.schema["id"].dataType)).distinct()

        return replace(self, clusters=self.clusters.where(~(from_source & (F.col("id") != target))), edge_members=moved(self.edge_members), node_members=moved(self.node_members))

"""Golden vectors of the engine's own operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keyspan.functions import paths, scalars
from keyspan.operators import documents, graph, joins, reduces, windows
from keyspan.operators.clusters import Fragment, FragmentError, Store
from keyspan.operators.collection import FIELDS, KEY, Collection, Face
from keyspan.operators.keyset import KeySet
from keyspan.operators.reduces import Reduce
from keyspan.schema import CollectionSchema, Field, SchemaError


def keys(spark, *values):
    return KeySet(spark.createDataFrame([(v,) for v in values], "k bigint"))


def ints(ks):
    return [r[0] for r in ks.ordered().collect()]


def test_set_operators_answer_each_key_once(spark):
    a, b = keys(spark, 1, 2, 4, 4, 7), keys(spark, 4, 4, 4, 5, 7)
    assert ints(a & b) == [4, 7] == ints(a.gallop_intersect(b))
    assert ints(a - b) == [1, 2] == ints(a.gallop_difference(b))
    assert ints(a | b) == [1, 2, 4, 5, 7]
    assert sorted(ints(a & b) + ints(a - b)) == ints(a)
    assert len(a) == 4 and 7 in a and 9 not in a and not a.is_empty() and keys(spark).is_empty()
    merged = {r.k: (r.in_left, r.in_right) for r in a.merge(b).collect()}
    assert merged == {1: (True, False), 2: (True, False), 4: (True, True), 5: (False, True), 7: (True, True)}


def test_two_step_join(spark):
    persons = spark.createDataFrame([(1, "ada"), (2, "bob")], "id bigint, name string")
    orders = spark.createDataFrame([(10, "ada", 5), (11, "bob", 7), (12, "ada", 9)], "oid bigint, name string, total bigint")
    got = {(r.id, r.oid) for r in joins.inner(persons, orders, ["name"]).collect()}
    assert got == {(1, 10), (1, 12), (2, 11)}
    fetched = KeySet(spark.createDataFrame([(2,), (3,)], "id bigint")).fetch(persons).collect()
    assert [(r.id, r.name) for r in fetched] == [(2, "bob"), (3, None)]


def test_refs_keep_their_order_and_dangle(spark):
    rows = spark.createDataFrame([(1, [3, 9, 1, 3]), (2, [])], "k bigint, refs array<bigint>")
    kids = spark.createDataFrame([(1, "a"), (3, "c")], "id bigint, name string")
    got = {r.k: r["values"] for r in joins.deref_all(rows, ["k"], "refs", kids, "id", "name").collect()}
    assert got == {1: ["c", None, "a", "c"], 2: []}


def test_faces(spark):
    rows = spark.createDataFrame([(1, 5, "open,red", 0), (2, 5, "red", 1), (3, 6, "", 0)], "id bigint, owner bigint, tags string, status int")
    c = Collection(rows, ["id"], [
        Face("by_owner", ("owner",), includes=("status",)),
        Face("open_by_owner", ("owner",), where=lambda d: d["status"] == 0),
        Face("by_tag", ("tag",), func=lambda d: F.filter(F.split(d["tags"], ","), lambda x: x != ""), many=True),
        Face("by_tags", ("tags",)),
    ])
    assert [(r.owner, r.id) for r in c.scan("by_owner", parts=(FIELDS, KEY)).collect()] == [(5, 1), (5, 2), (6, 3)]
    assert [r.id for r in c.scan("by_owner", 5, parts=(KEY,), reverse=True).collect()] == [2, 1]
    assert [r.id for r in c.scan("open_by_owner", parts=(KEY,)).collect()] == [1, 3]
    assert [(r.tag, r.id) for r in c.scan("by_tag", parts=(FIELDS, KEY)).collect()] == [("open", 1), ("red", 1), ("red", 2)]
    assert [r.id for r in c.scan("by_tags", "op", parts=(KEY,)).collect()] == [1]
    assert [r.id for r in c.range("by_owner", 5, 6, parts=(KEY,)).collect()] == [1, 2]
    assert c.count("by_owner", 5).first()[0] == 2 and c.has(id=3) and not c.has(id=4)
    with pytest.raises(ValueError):
        c.exact("by_owner")


def test_a_limit_takes_the_first_in_the_order_of_the_face(spark, tmp_path):
    from keyspan import catalog

    rows = spark.range(40).selectExpr("id AS o_orderkey", "100 + (id * 7) % 40 AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice", "'1-URGENT' AS o_orderpriority", "current_date() AS o_orderdate")
    rows.repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    got = [r.o_orderkey for r in catalog.queries()["o04_limit"](spark, str(tmp_path)).collect()]
    assert got == sorted(range(40), key=lambda i: (i * 7) % 40)[:10]


def test_a_covered_scan_reads_only_what_it_names(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS a", "id * 2 AS b", "cast(id AS string) AS c").write.parquet(str(tmp_path / "t"))
    c = Collection(spark.read.parquet(str(tmp_path / "t")), ["id"], [Face("by_a", ("a",), includes=("b",))])
    plan = c.covered("by_a", 3, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,3)" in plan and "c:string" not in plan.split("ReadSchema")[1]


def test_declarations_that_cannot_be():
    key = (Field("id", "u64"),)
    for wrong in (
        lambda: CollectionSchema("x", ()),
        lambda: CollectionSchema("x", (Field("name", "str"),)),
        lambda: CollectionSchema("x", key, (Field("ID", "u8"),)),
        lambda: CollectionSchema("x", key, (Field("a", "u8"),), partition="a"),
        lambda: Field("a", "f64", reverse=True),
        lambda: Field("a", "no such kind"),
        lambda: CollectionSchema("x", key, (Field("s", "str"), Field("n", "u8")), faces=(Face("f", ("s", "n")),)),
        lambda: Face("f", ()),
        lambda: Face("f", ("a",), lead=True, includes=("b",)),
    ):
        with pytest.raises(SchemaError):
            wrong()


def test_schema_conforms_and_round_trips(spark):
    s = CollectionSchema("t", (Field("id", "i64"),), (Field("n", "u8", default=3), Field("secret", "secret", redact=True, optional=True)))
    assert CollectionSchema.from_json(s.to_json()) == s
    df = s.conform(spark.createDataFrame([(1, None), (2, 9)], "id bigint, n smallint"))
    assert [(r.id, r.n, r.secret) for r in df.orderBy("id").collect()] == [(1, 3, None), (2, 9, None)]
    with pytest.raises(SchemaError):
        s.conform(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(Exception, match="does not fit"):
        s.conform(spark.createDataFrame([(1, 300)], "id bigint, n smallint")).collect()


def test_run_fold_repeats_groups_of_unordered_input(spark):
    rows = spark.createDataFrame([(1, 7, 10), (2, 7, 20), (3, 9, 30), (4, 7, 1)], "o int, k bigint, v bigint")
    got = reduces.group_fold(rows, ["k"], ["o"], [F.sum("v").alias("s")]).orderBy("run").collect()
    assert [(r.k, r.s) for r in got] == [(7, 30), (9, 30), (7, 1)]


def test_reduces_over_changes(spark):
    changes = spark.createDataFrame([(1, 1, "put", "a", 5), (1, 2, "put", "b", 9), (2, 3, "put", "a", 7), (2, 4, "del", None, None)], "id bigint, seq int, op string, g string, v bigint")
    made = [Reduce("n", "count"), Reduce("s", "sum", "v"), Reduce("hi", "high_water", "v")]
    got = {r.g: (r.n, r.s, r.hi) for r in reduces.reduced_changes(changes, ["id"], "seq", "op", ["g"], made).collect()}
    assert got == {"a": (0, 0, 7), "b": (1, 9, 9)}


def test_byte_reduce_seeds_by_a_fold_only(spark):
    rows = spark.createDataFrame([("a", 1, -1, 4), ("a", 2, 1, 5), ("a", 3, 1, 6), ("a", 4, -1, 5)], "g string, seq int, sign int, v bigint")
    number = lambda b: int.from_bytes(b, "big")
    got = reduces.byte_reduce(rows, ["g"], "seq", "sign", "v", lambda: bytes(8), lambda a, v: (number(a) + int(v)).to_bytes(8, "big"), lambda a, v: (number(a) - int(v)).to_bytes(8, "big"))
    assert number(got.first().acc) == 6


def test_windows(spark):
    rows = spark.createDataFrame([(1, "s", 100), (2, "s", 150), (3, "s", 120), (4, "t", 1)], "seq int, k string, v bigint")
    prev = {r.seq: r.prev_v for r in windows.with_previous(rows, ["k"], ["seq"], ["v"]).collect()}
    assert prev == {1: None, 2: 100, 3: 150, 4: None}
    assert [r.clamped for r in windows.clamped_clock(rows, ["k"], ["seq"], "v").orderBy("seq").collect()] == [100, 150, 150, 1]
    assert {r.k: r.seq for r in windows.latest(rows, ["k"], ["seq"]).collect()} == {"s": 3, "t": 4}


def test_ngrams_and_scalars(spark):
    df = spark.createDataFrame([("abcd", 2), ("数据", 2), ("ab", 3), ("", 2)], "t string, n int")
    assert [r[0] for r in df.select(scalars.ngrams(F.col("t"), 2)).collect()] == [["ab", "bc", "cd"], ["数据"], ["ab"], [""]]
    with pytest.raises(ValueError):
        scalars.ngrams(F.col("t"), 0)
    one = spark.range(1)
    assert one.select(scalars.offset_decode(scalars.offset_encode(F.lit(1_700_000_005), 1_700_000_000), 1_700_000_000)).first()[0] == 1_700_000_005
    with pytest.raises(Exception):  # noqa: B017
        one.select(scalars.offset_encode(F.lit(-1), 0)).collect()
    with pytest.raises(Exception):  # noqa: B017
        one.select(scalars.quantize(F.lit(float("nan")), 2)).collect()
    got = one.select(scalars.bucket_id(F.array(F.lit(0.125).cast("float"), F.lit(-0.375).cast("float"), F.lit(1e9).cast("float")), 0.25)).first()[0]
    assert got == [1, -2, 32767]
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one.select(F.map_keys(scalars.with_entry(m, "a", F.lit(9)))).first()[0] == ["a", "b"]
    assert one.select(scalars.same_entries(m, F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)))).first()[0]


def test_paths(spark):
    assert paths.parse('a.b[0]."x.y"') == ["a", "b", 0, "x.y"]
    for wrong in ("", "a.", ".a", "a[", "a[x]", '"a', "a..b", '""'):
        with pytest.raises(paths.PathError):
            paths.parse(wrong)
    doc = '{"author":{"name":"ada"},"tags":["x","y",["z"],3,"x"],"meta":{"rank":7},"refs":[{"href":"u"},{"href":"v"}]}'
    df = spark.createDataFrame([(doc,)], "j string").select(F.parse_json("j").alias("v"))
    get = lambda path, kind: df.select(paths.leaves(F.col("v"), path, kind)).first()[0]
    assert get("author.name", "str") == ["ada"] and get("tags", "str") == ["x", "y", "z"] and get("meta.rank", "u32") == [7]
    assert get("refs.href", "str") == ["u", "v"] and get("refs[0].href", "str") == ["u"] and get("refs[9].href", "str") == []
    assert get("author", "str") == [] and get("author.name", "u8") == [] and get("no.such", "str") == []


def test_documents(spark):
    assert documents.merged({"a": {"x": 1, "y": 2}, "b": [1]}, {"a": {"y": 3}, "b": [2]}) == {"a": {"x": 1, "y": 3}, "b": [2]}
    rows = spark.createDataFrame([(1, 5, '{"a":{"x":1}}'), (2, 6, None)], "id bigint, n bigint, open string")
    new = spark.createDataFrame([(1, None, '{"a":{"y":2}}'), (3, 8, None)], "id bigint, n bigint, open string")
    got = {r.id: (r.n, r.open) for r in documents.put_merge(rows, new, ["id"]).collect()}
    assert got == {1: (5, '{"a":{"x":1,"y":2}}'), 2: (6, None), 3: (8, None)}
    with pytest.raises(documents.WriteError):
        documents.put_merge(rows, spark.createDataFrame([(1, "x")], "id bigint, n string"), ["id"])
    replaced = documents.put_replace(rows, spark.createDataFrame([(1, None, '{"z":1}'), (2, None, None)], "id bigint, n bigint, open string"), ["id"], {"n": 0})
    assert {r.id: (r.n, r.open) for r in replaced.collect()} == {1: (0, '{"z":1}')}
    left, told = documents.purge(rows, spark.createDataFrame([(1,), (9,)], "id bigint"), ["id"])
    assert [r.id for r in left.collect()] == [2] and {r.id: r.purged for r in told.collect()} == {1: True, 9: False}
    up = documents.upsert_with(rows, spark.createDataFrame([(2,), (4,)], "id bigint"), ["id"], {"n": F.coalesce(F.col("n"), F.lit(0)) + 1})
    assert {r.id: r.n for r in up.collect()} == {1: 5, 2: 7, 4: 1}


def test_embedded_children(spark):
    parents = spark.createDataFrame([(1, [10, 11])], "id bigint, kids array<bigint>")
    children = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "kid bigint, name string")
    new = spark.createDataFrame([(1, [(11, None), (13, ("d",))])], "id bigint, e array<struct<kid:bigint,value:struct<name:string>>>")
    p, c = documents.put_with_children(parents, children, new, ["id"], "kids", "kid", "e")
    assert p.first().kids == [11, 13] and {r.kid: r.name for r in c.collect()} == {11: "b", 12: "c", 13: "d"}


def triangle(spark):
    adjacency = {1: [2, 3, 4], 2: [1, 3], 3: [1, 2], 4: [1]}
    return spark.createDataFrame([(a, b) for a, bs in adjacency.items() for b in bs], "node bigint, neighbor bigint")


def test_graph_algorithms(spark):
    pairs = triangle(spark)
    ranks = {r.node: r["rank"] for r in graph.pagerank(pairs.select("node"), pairs, 20).collect()}
    assert max(ranks, key=ranks.get) == 1 and abs(sum(ranks.values()) - 1) < 1e-9
    labels = pairs.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(3):
        labels = graph.label_step(pairs, labels)
    assert labels.select("label").distinct().count() == 1


def test_label_propagation_ends_when_two_states_alternate(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (5, 5)], "node bigint, neighbor bigint")
    labels = pairs.select("node").withColumn("label", F.col("node"))
    steps, one = [], graph.label_step
    monkeypatch.setattr(graph, "label_step", lambda *a: steps.append(1) or one(*a))
    swapped, same = {1: 2, 2: 1, 3: 4, 4: 3, 5: 5}, {i: i for i in range(1, 6)}
    for most in (0, 1, 2, 9, 30):
        assert {r.node: r.label for r in graph.label_propagation(pairs, labels, most).collect()} == (swapped if most % 2 else same)
    assert len(steps) == 0 + 1 + 2 + 2 + 2
    assert graph.label_propagation(pairs.limit(0), labels.limit(0)).count() == 0


def small_store(spark):
    edges = spark.createDataFrame([("p", 1, "works", "o", 7, 3), ("p", 2, "works", "o", 7, 4), ("p", 2, "knows", "p", 1, 5)], "src_ns string, src bigint, predicate string, dst_ns string, dst bigint, weight bigint")
    nodes = spark.createDataFrame([("p", 1), ("p", 2), ("o", 7)], "ns string, node bigint")
    clusters = spark.createDataFrame([("team", 1, 0), ("team", 2, 1)], "kind string, id bigint, parent bigint")
    em = edges.where("predicate = 'works'").select(F.lit("team").alias("kind"), F.lit(1).cast("bigint").alias("id"), *graph.EDGE)
    nm = spark.createDataFrame([("team", 2, "p", 1)], "kind string, id bigint, ns string, node bigint")
    return Store(nodes, edges, clusters, em, nm)


def test_cut_and_hops(spark):
    g = graph.Graph(small_store(spark).edges)
    chosen = spark.createDataFrame([("p", 1), ("p", 2)], "ns string, id bigint")
    sides = {(r.src, r.predicate): (r.side, r.member, r.far) for r in g.cut(chosen).collect()}
    assert sides == {(1, "works"): ("boundary", 1, 7), (2, "works"): ("boundary", 2, 7), (2, "knows"): ("interior", None, None)}
    reached = {(r.ns, r.id): r.hop for r in g.hops(chosen.where("id = 1"), 2, both_ways=True).collect()}
    assert reached == {("p", 1): 0, ("o", 7): 1, ("p", 2): 1}


def test_cluster_writes(spark):
    s = small_store(spark)
    assert {(r.kind, r.id): (r.edge_count, r.node_count) for r in s.counts().collect()} == {("team", 1): (2, 0), ("team", 2): (0, 1)}
    without, report = s.retract(Fragment(nodes=spark.createDataFrame([("p", 2)], "ns string, node bigint")))
    assert report == {"nodes": 1, "edges": 2} and without.edges.count() == 1
    assert {(r.kind, r.id): r.edge_count for r in without.counts().collect()} == {("team", 1): 1, ("team", 2): 0}
    default = {"weight": F.lit(0).cast("bigint")}
    heads = spark.createDataFrame([("p", 1, "works", "o", 7), ("p", 1, "works", "o", 8)], "src_ns string, src bigint, predicate string, dst_ns string, dst bigint")
    more, made = s.incorporate(Fragment(edges=heads), default)
    assert made["edges"] == 1 and {(r.src, r.dst): r.weight for r in more.edges.where("predicate = 'works'").collect()} == {(1, 7): 3, (2, 7): 4, (1, 8): 0}
    with pytest.raises(FragmentError):
        s.incorporate(Fragment(nodes=spark.createDataFrame([("p", 9)], "ns string, node bigint")), default)
    with pytest.raises(FragmentError):
        s.replace(Fragment(nodes=spark.createDataFrame([("p", 2)], "ns string, node bigint")), Fragment(), default)
    moved = s.repoint(("o", 7), ("o", 9))
    assert {(r.src, r.dst): r.weight for r in moved.edges.where("predicate = 'works'").collect()} == {(1, 9): 3, (2, 9): 4}
    assert s.materialize("team", 5, spark.createDataFrame([("p", 1), ("p", 99)], "ns string, node bigint")).nodes_in("team", 5).count() == 1
    assert s.merge_sets("team", 1, [2]).nodes_in("team", 1).count() == 1
    assert [r.id for r in s.descendants(1).collect()] == [2]


def test_split_and_compose_are_inverse(spark):
    rows = spark.createDataFrame([(1, '{"a":"x","n":{"m":[1,2]},"b":2}'), (2, '{"a":null}'), (3, "{}"), (4, '{"z":true}')], "id bigint, document string")
    halves = documents.split(rows, ["id"], {"a": "string", "b": "bigint"})
    assert sorted((r.id, r.a, r.b, r.open) for r in halves.collect()) == [(1, "x", 2, '{"n":{"m":[1,2]}}'), (2, None, None, None), (3, None, None, None), (4, None, None, '{"z":true}')]
    again = {r.id: r.document for r in documents.compose(halves, ["id"]).collect()}
    assert again == {1: '{"a":"x","b":2,"n":{"m":[1,2]}}', 2: "{}", 3: "{}", 4: '{"z":true}'}
    with pytest.raises(Exception, match="b is not bigint"):
        documents.split(rows.selectExpr("id", """'{"b":"no"}' AS document"""), ["id"], {"b": "bigint"}).collect()


def test_merged_reduce_is_one_fold_however_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(reduces, "FOLDED", 3)
    rows = spark.range(200).selectExpr("id % 7 AS g", "id AS v")
    want = {g: (len(v), sum(v)) for g in range(7) for v in [[x for x in range(200) if x % 7 == g]]}
    for parts in (1, 9):
        got = reduces.merged_reduce(rows.repartition(parts), ["g"], lambda: (0, 0), lambda acc, r: (acc[0] + 1, acc[1] + r.v), lambda a, b: (a[0] + b[0], a[1] + b[1]), "n bigint, total bigint")
        assert {r.g: (r.n, r.total) for r in got.collect()} == want


def test_text_is_ranked_in_place(spark):
    from keyspan.operators import text

    docs = spark.createDataFrame([(1, "aaaa"), (2, "xaax"), (3, "a.\\Eb"), (4, None), (5, ""), (6, "aa"), (7, "a")], "id bigint, t string")
    assert [r.id for r in text.matching(docs, "id", "t", ["aa"], 2).orderBy("id").collect()] == [1, 2, 6]
    assert [r.id for r in text.matching(docs, "id", "t", ["\\E", "xa"], 2, every=False).orderBy("id").collect()] == [2, 3]
    got = [r.id for r in text.rank(docs, "id", "t", "aa", 2, 9).collect()]
    assert got[0] in (1, 6) and sorted(got) == [1, 2, 6] and [r.id for r in text.rank(docs, "id", "t", "a", 2, 9).collect()] == [7]
    assert docs.select(text.occurrences(F.col("t"), "aa", 2).alias("n")).first().n == 3 and text.rank(docs.limit(0), "id", "t", "aa", 2, 9).count() == 0


def test_graph_holds_coded_vectors(spark):
    import numpy as np

    from keyspan.operators import vectors

    r = np.random.default_rng(3)
    data = r.normal(size=(300, 8)).astype(np.float32)
    pq = vectors.ProductQuantizer.train(data, 4)
    for codec, least in ((None, 9), ("i8", 8), (pq, 4)):
        g = vectors.NavigableGraph(codec=codec)
        for i, v in enumerate(data):
            g.insert(i, v)
        exact = set(np.argsort(((data - data[0]) ** 2).sum(axis=1))[:10].tolist())
        assert len({k for k, _ in g.search(data[0], 10)} & exact) >= least

"""Versioned tables, change rows, series, streams, text and vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyspan.operators import text, vectors
from keyspan.sources import changes as ch
from keyspan.sources import lake, series
from keyspan.streaming import events as ev

KIND = "id bigint, v string, ks_op string, ks_slot int, ks_seq bigint, cell string"


def rows_of(df):
    return {r.id: (r.v, r.ks_op, r.cell) for r in df.collect()}


def test_the_fold(spark):
    log = [
        (1, "a", "put", None, 0, None), (1, None, "put_open", None, 1, '{"m":{"x":1}}'), (1, "b", "put", None, 2, '{"m":{"y":2}}'),
        (2, "c", "put", None, 3, '{"q":1}'), (2, None, "del", 1, 4, None),
        (3, "d", "put", None, 5, None), (3, None, "del", None, 6, None),
        (4, None, "put_open", None, 7, '{"k":1}'),
        (5, None, "put_open", None, 8, '{"k":1}'), (5, None, "del", 1, 9, None),
        (6, "e", "put", None, 10, None), (6, None, "del", None, 11, None), (6, None, "put_open", None, 12, '{"z":0}'),
    ]
    got = ch.current_state(spark.createDataFrame(log, KIND), ["id"])
    assert rows_of(got) == {1: ("b", "put", '{"m":{"x":1,"y":2}}'), 2: ("c", "put", None), 4: (None, "put_open", '{"k":1}'), 6: (None, "put_open", '{"z":0}')}
    assert {r.id: r.ks_seq for r in got.collect()} == {1: 0, 2: 1, 4: 2, 6: 3}


def test_versions_condense_vacuum_and_restore(spark, tmp_path):
    t = lake.LakeTable(spark, f"file://{tmp_path}/lake", ["id"])
    make = lambda log: spark.createDataFrame(log, KIND).coalesce(1)
    t.append(make([(1, "a", "put", None, 0, None), (2, "b", "put", None, 1, None)]), covers=1)
    t.append(make([(2, None, "del", None, 0, None), (3, "c", "put", None, 1, None)]), covers=2)
    t.append(make([(100, "z", "put", None, 0, None)]), covers=3)
    assert rows_of(t.current(0)) == {1: ("a", "put", None), 2: ("b", "put", None)}
    want = {1: ("a", "put", None), 3: ("c", "put", None), 100: ("z", "put", None)}
    assert rows_of(t.current()) == want
    assert len(t.overlapping()) == 2
    v = t.condense()
    assert v == 3 and rows_of(t.current()) == want and len(t.live()) == 2
    assert t.vacuum(1) == [] and len(t.vacuum(0, dry_run=True)) == 2
    t.checkpoint()
    assert len(t.vacuum(0)) == 2 and rows_of(t.current()) == want
    t.verify_baseline(3)
    with pytest.raises(lake.LakeError):
        t.verify_baseline(4)
    tail = spark.createDataFrame([(3, None, "del", None, 0, None)], KIND)
    assert set(rows_of(t.restore(v, tail))) == {1, 100}
    assert t.status(with_rows=True).first().live_rows == 3
    with pytest.raises(lake.Conflict):
        t._commit([], 1)
    t.publish(make([(9, "n", "put", None, 0, None)]))
    assert rows_of(t.current()) == {9: ("n", "put", None)}


def test_a_batch_is_added_once(spark, tmp_path):
    t = lake.LakeTable(spark, f"file://{tmp_path}/lake", ["id"])
    df = spark.createDataFrame([(1, "a", "put", None, 0, None)], KIND)
    assert t.append_named(df, "b0") == t.append_named(df, "b0") == 0


def test_union_refuses_two_types(spark):
    with pytest.raises(ch.SchemaDrift):
        ch.aligned([spark.range(1).selectExpr("id AS a"), spark.range(1).selectExpr("cast(id AS string) AS a")])


def test_reconcile(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (4, "d")], "k int, v string")
    assert {r.k: r.verdict for r in ch.reconcile(old, new, ["k"]).collect()} == {1: "unchanged", 2: "unchanged", 3: "adopted", 4: "removed"}


def test_series_clock_offsets_and_retention(spark, tmp_path):
    log = series.SeriesLog(spark, f"file://{tmp_path}/log", series.Format(1, 10), "s")
    log.append(spark.createDataFrame([(0, 5, "a"), (1, 25, "a"), (2, 7, "b")], "i int, ts bigint, s string"), ["i"])
    log.append(spark.createDataFrame([(3, 20, "a"), (4, 31, "b")], "i int, ts bigint, s string"), ["i"])
    got = {r.i: (r.partition, r.offset, r.ts, r.bucket) for r in log.log().collect()}
    assert got == {0: ("a", 0, 5, 0), 1: ("a", 1, 25, 2), 3: ("a", 2, 25, 2), 2: ("b", 0, 7, 0), 4: ("b", 1, 31, 3)}
    assert [r.i for r in series.read_stream(log.log(), "a", 1).collect()] == [1, 3]
    rows, position = log.follow(0, 2)
    assert len(rows.collect()) == 2 and position >= 1
    assert log.retain(20) == [0] and log.parts().count() == 2
    with pytest.raises(Exception, match="stream's value"):
        log.append(spark.createDataFrame([(9, 40, None)], "i int, ts bigint, s string"), ["i"])


def test_streams(spark, tmp_path):
    schema = "symbol string, epoch bigint, cents string"
    src = str(tmp_path / "in")
    spark.createDataFrame([("x", 1, "100"), ("x", 2, "150"), ("y", 3, "7"), ("x", 4, "150")], schema).coalesce(1).write.parquet(src)
    stream = lambda: ev.source(spark, src, "*.parquet", spark.read.parquet(src).schema)
    prev = {r.epoch: r.previous for r in ev.drained(ev.with_previous(stream(), "symbol", "epoch", "cents")).collect()}
    assert prev == {1: None, 2: "100", 3: None, 4: "150"}
    flags = {r.epoch: r.is_changed for r in ev.drained(ev.distinct_by(stream(), "symbol", "epoch", "cents")).collect()}
    assert flags == {1: True, 2: True, 3: True, 4: False}


def test_text(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (2, "abcx"), (3, "zzz")], "id bigint, t string")
    posted = text.postings(docs, "id", "t", 2)
    assert posted.where("gram = 'ab'").count() == 2
    assert [r.id for r in text.recall(posted, "id", ["ca"]).collect()] == [1]
    ranked = text.rank(docs, "id", "t", "abc", 2, 5).collect()
    assert [r.id for r in ranked][0] == 1 and len(ranked) == 2


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [5.0, 0.0, 0.0])], "k bigint, v array<float>")
    assert [r.k for r in vectors.nearest(df, "k", "v", [0.9, 0, 0], 2).collect()] == [2, 1]
    assert vectors.fnv1a(b"") == 0xCBF29CE484222325 and vectors.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    allowed = spark.createDataFrame([(1,), (3,)], "k bigint")
    assert [r.k for r in vectors.nearest_allowed(df, "k", "v", [0.9, 0, 0], 1, allowed).collect()] == [1]


def test_nearest_orders_by_what_it_returns(spark, tmp_path):
    from keyspan import catalog

    # thirteen squared distances that are 9.0 in four places, each a little less than that of the row before
    rows = [(0, [0.0, 0.0]), *[(i, [3.0, 0.0066 - 0.0005 * i]) for i in range(1, 14)]]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in catalog.queries()["o07_top_k_distance"](spark, str(tmp_path)).collect()]
    assert got == [(0, 0.0), *[(i, 9.0) for i in range(1, 10)]]
    # squared distances that differ in double precision only
    near = spark.createDataFrame([(1, [0.0, 1.0, 0.0001]), (2, [0.0, 1.0, 0.00001])], "k bigint, v array<float>")
    assert [r.k for r in vectors.nearest(near, "k", "v", [0.0, 0.0, 0.0], 2).collect()] == [2, 1]


def test_nearest_all_goes_through_queries_in_blocks(spark, monkeypatch):
    x = _rows(60, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k bigint, v array<float>").repartition(3)
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2).astype(np.float32)
    want = sorted((q, i, rank) for q in range(0, 60, 2) for rank, i in enumerate(np.lexsort((np.arange(60), d[q]))[:4].tolist(), 1))
    for most in (7, 15, 30, 100):
        monkeypatch.setattr(vectors, "MOST_QUERIES", most)
        got = vectors.nearest_all(df, "k", "v", df.where("k % 2 = 0").select(F.col("k").alias("q"), "v"), "q", 4)
        assert sorted((r.q, r.k, r["rank"]) for r in got.collect()) == want


def _rows(n=400, dim=64):
    x = np.random.default_rng(42).normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_index_recall():
    x = _rows()
    g = vectors.NavigableGraph(12, 24, 64, 42)
    for i, v in enumerate(x):
        g.insert(i, v)
    hits = 0
    for i in range(40):
        exact = set(np.argsort(((x - x[i]) ** 2).sum(1))[:10])
        hits += len(exact & {k for k, _ in g.search(x[i], 10)})
    assert hits / 400 >= 0.85
    assert g.remove(0) and 0 not in {k for k, _ in g.search(x[0], 10)}


def test_graph_index_recall_among_copies_and_in_dense_clusters():
    rng = np.random.default_rng(7)
    own = rng.normal(size=(40, 16)).astype(np.float32)
    copies = vectors.NavigableGraph(m=6, m0=12, breadth=32)
    for key in range(2400):
        copies.insert(key, own[key % 40])
    for i in range(40):  # the copies with the least keys, as an exact search has them
        assert [k for k, _ in copies.search(own[i], 10)] == [i + 40 * j for j in range(10)]
    assert copies.remove(3) and copies.remove(43) and not copies.remove(3)
    copies.insert(43, own[5])
    assert [k for k, _ in copies.search(own[3], 2)] == [83, 123] and [k for k, _ in copies.search(own[5], 3)] == [5, 43, 45]

    centres = rng.normal(size=(8, 16))
    points = (np.repeat(centres, 150, axis=0) + rng.normal(size=(1200, 16)) * 0.02).astype(np.float32)
    dense = vectors.NavigableGraph(m=6, m0=12, breadth=24)
    for key in range(1200):
        dense.insert(key, points[key])
    for q in points[::60]:
        exact = set(np.argsort(((points - q) ** 2).sum(axis=1))[:10].tolist())
        assert len(exact & {k for k, _ in dense.search(q, 10)}) >= 9


def test_quantiser_recall():
    x = _rows()
    pq = vectors.ProductQuantizer.train(x, 16)
    codes, hits = pq.encode(x), 0
    for i in range(40):
        exact = set(np.argsort(((x - x[i]) ** 2).sum(1))[:10])
        hits += len(exact & set(np.argsort(pq.distances(pq.table(x[i]), codes))[:10]))
    assert hits / 400 >= 0.6
    assert vectors.ProductQuantizer.train(x, 7) is None and vectors.ProductQuantizer.train(x[:1], 8) is None


def test_the_log_is_one_that_others_can_read(spark, tmp_path):
    import json

    t = lake.LakeTable(spark, f"file://{tmp_path}/open", ["id"])
    make = lambda log: spark.createDataFrame(log, KIND).coalesce(1)
    t.append(make([(1, "a", "put", None, 0, None)]), covers=1)
    t.append(make([(5, None, "put", None, 1, None)]).withColumn("more", F.lit(1)), covers=2)
    actions = [[json.loads(x) for x in (tmp_path / "open/_delta_log" / f"{v:020d}.json").read_text().splitlines()] for v in range(2)]
    assert [next(iter(a)) for a in actions[0]] == ["commitInfo", "protocol", "metaData", "add"]
    add = actions[1][-1]["add"]
    stats = json.loads(add["stats"])
    assert (tmp_path / "open" / add["path"]).stat().st_size == add["size"] and stats["numRecords"] == 1 and stats["minValues"]["id"] == 5 and stats["nullCount"]["v"] == 1
    assert [f["name"] for f in json.loads(actions[1][2 - 1]["metaData"]["schemaString"])["fields"]][-1] == "more"
    t.checkpoint()
    before = t.live()
    for v in range(2):
        t.files.delete(f"_delta_log/{v:020d}.json")
    again = lake.LakeTable(spark, f"file://{tmp_path}/open", ["id"])
    assert again.live() == before and again.version() == 1 and again.append(make([(7, "z", "put", None, 2, None)])) == 2
    assert set(rows_of(again.current().drop("more"))) == {1, 5, 7}


def test_a_baseline_keeps_the_order_of_changes(spark, tmp_path):
    t = lake.LakeTable(spark, f"file://{tmp_path}/base", ["id"])
    make = lambda log: spark.createDataFrame(log, KIND)
    t.append(make([(1, "a", "put", None, 0, None), (2, "b", "put", None, 1, None)]))
    t.append(make([(1, "c", "put", None, 0, None)]))
    t.append(make([(1, None, "del", None, 0, None), (2, "d", "put", None, 1, None)]))
    t.compact(keep=1)
    assert rows_of(t.current()) == {2: ("d", "put", None)} and t.compact(keep=10) == t.version()


def test_rows_of_a_version_are_folded_by_number_however_they_lie_in_files(spark, tmp_path):
    t = lake.LakeTable(spark, f"file://{tmp_path}/mixed", ["id"])

    def make(*tasks):
        return spark.createDataFrame(spark.sparkContext.parallelize([r for rows in tasks for r in rows], len(tasks)), KIND)

    late, early = [(1, "new", "put", None, 7, None), (2, None, "del", None, 8, None)], [(1, "old", "put", None, 2, None), (2, "b", "put", None, 3, None)]
    t.append(make(late, early), covers=1)
    assert len(t.live()) == 2 and rows_of(t.current()) == {1: ("new", "put", None)}
    assert rows_of(t.restore(0, make([(3, "c", "put", None, 9, None)]))) == {1: ("new", "put", None), 3: ("c", "put", None)}
    t.append(make([(1, "last", "put", None, 0, None)]))  # a later version comes after all of the first, whatever its numbers
    assert rows_of(t.current()) == {1: ("last", "put", None)}
    t.checkpoint()
    assert t.status(with_rows=True).first().live_rows == 1
    t.compact(keep=1)
    assert rows_of(t.current()) == {1: ("last", "put", None)}
    t.condense()
    assert rows_of(t.current()) == {1: ("last", "put", None)}


def test_a_key_has_one_state_when_a_join_turns_into_a_broadcast(spark, tmp_path):
    """The deletes turn out to be few only as the plan runs; the cells of a key must still meet in one task."""
    rows = [(i % 40, f"v{i}", "put" if i < 800 else "del" if i % 40 < 5 else "put_open", 1 if i >= 800 and i % 40 < 5 else None, i, None if i >= 800 and i % 40 < 5 else f'{{"n":{i}}}') for i in range(840)]
    spark.createDataFrame(rows, KIND).repartition(4).write.parquet(f"{tmp_path}/rows")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted((r.id, r.cell) for r in ch.current_state(spark.read.parquet(f"{tmp_path}/rows"), ["id"]).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == [(i, None if i < 5 else f'{{"n":{800 + i}}}') for i in range(40)]


def test_files_without_rows_are_not_added(spark, tmp_path):
    """Spark's first task leaves a file even if it has no rows."""
    from keyspan import catalog

    t = lake.LakeTable(spark, f"file://{tmp_path}/empty", ["id"])
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(9, "x", "del", None, 0, None), (1, "a", "put", None, 1, None)], 2), KIND)
    t.append(rows.where("id = 1"))
    (only,) = t.live()
    assert only["stats"]["id"] == [1, 1, 0] and len(t._data()) == 1
    t.append(rows.limit(0))
    assert rows_of(t.current()) == {1: ("a", "put", None)} and sum(a["rows"] for a in t.live()) == 1

    events = spark.sql("SELECT id AS event_id, CASE WHEN id < 4 THEN id END AS user_id, 'click' AS event_type, 1.0D AS value, CAST(NULL AS STRING) AS props FROM range(6)")
    events.sort(F.desc("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(catalog.queries()["l15_file_stats"](spark, str(tmp_path)).collect()) == [(0, 2, 0, 1, 2), (1, 2, 2, 3, 2), (2, 2, None, None, 2)]


def test_captured_changes_replay_to_what_the_write_made(spark):
    kind = "id bigint, name string, open string"
    old = spark.createDataFrame([(1, "a", '{"x":1,"y":2}'), (2, "b", None), (3, "c", '{"z":1}'), (4, None, None)], kind)
    new = spark.createDataFrame([(1, "a", '{"x":1}'), (2, "b", None), (4, "d", None), (9, "n", '{"k":[1]}')], kind)
    made = ch.captured(old, new, ["id"], first_seq=10)
    assert [(r.id, r.ks_op, r.ks_slot, r.ks_seq) for r in made.orderBy("ks_seq").collect()] == [(1, "del", 1, 10), (1, "put", None, 11), (3, "del", None, 12), (4, "put", None, 13), (9, "put", None, 14)]
    base = ch.captured(old.limit(0), old, ["id"])
    got = ch.current_state(ch.aligned([base, made]), ["id"])
    assert sorted((r.id, r.name, r.cell) for r in got.collect()) == [(1, "a", '{"x":1}'), (2, "b", None), (4, "d", None), (9, "n", '{"k":[1]}')]
    assert ch.captured(old, old, ["id"]).count() == 0 and ch.captured(old, new, ["id"], new.where("id = 9")).count() == 1


def test_batches_are_seen_whole_or_not(spark, tmp_path):
    tables = {n: lake.LakeTable(spark, f"file://{tmp_path}/{n}", ["id"]) for n in ("a", "b")}
    batches = lake.Batches(spark, f"file://{tmp_path}/all", tables)
    make = lambda i: spark.createDataFrame([(i, "x", "put", None, i, None)], KIND)
    assert batches.snapshot() == {}
    assert batches.commit("one", {"a": make(1), "b": make(1)}) == 0 == batches.commit("one", {"a": make(1), "b": make(1)})
    tables["a"].append_named(make(2), "two")
    assert {n: set(rows_of(df)) for n, df in batches.snapshot().items()} == {"a": {1}, "b": {1}}
    assert batches.commit("two", {"a": make(2), "b": make(3)}) == 1
    assert {n: set(rows_of(df)) for n, df in batches.snapshot().items()} == {"a": {1, 2}, "b": {1, 3}}
    assert set(rows_of(batches.snapshot(0)["b"])) == {1}
    with pytest.raises(lake.LakeError):
        batches.commit("three", {"c": make(1)})

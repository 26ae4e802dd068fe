"""Text and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text, vectors
from ..session import scratch, stored
from .registry import query

GRAMS = "SELECT doc_id, unnest(list_transform(range(1, greatest(length(text) - 1, 2)), lambda i: text[i:i+2])) AS gram FROM documents"


@query("t01_postings", "SELECT gram, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text)), lambda i: text[i:i+1])) AS gram FROM documents) GROUP BY gram")
def _(t):
    return text.postings(t.documents, "doc_id", "text", 2).groupBy("gram").agg(F.count("*").alias("docs"))


@query("t02_recall", "SELECT doc_id FROM documents WHERE contains(text, 'tio') AND contains(text, 'ion') AND contains(text, 'onh')")
def _(t):
    return text.matching(t.documents, "doc_id", "text", text.query_grams("tionh", 3), 3)


@query("t02b_recall_any", "SELECT doc_id FROM documents WHERE contains(text, 'zzu') OR contains(text, 'ñga')")
def _(t):
    return text.matching(t.documents, "doc_id", "text", ["zzu", "ñga"], 3, every=False)


@query(
    "t03_bm25",
    f"WITH g AS ({GRAMS}), q AS (SELECT unnest(['tio', 'ion', 'onh']) AS gram), n AS (SELECT doc_id, greatest(length(text) - 2, 1) AS dl FROM documents), a AS (SELECT avg(dl) AS m, count(*) AS c FROM n), tf AS (SELECT doc_id, gram, count(*) AS tf FROM g JOIN q USING (gram) GROUP BY 1, 2), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1) "
    "SELECT doc_id, round(sum(ln((c - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 6) AS score FROM tf JOIN df USING (gram) JOIN n USING (doc_id), a GROUP BY doc_id ORDER BY sum(ln((c - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))) DESC, doc_id LIMIT 20",
)
def _(t):
    return text.rank(t.documents, "doc_id", "text", "tionh", 3, 20).select("doc_id", F.round("score", 6).alias("score"))


D2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: power(CAST(p[1] - p[2] AS DOUBLE), 2)))"


@query("x01_exact_search", f"SELECT query_id, vec_id, round(d, 3) AS distance, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {D2} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {D2}, e.vec_id)::INT AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5")
def _(t):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = vectors.nearest_all(t.embeddings, "vec_id", "embedding", q, "query_id", 5)
    return got.select("query_id", "vec_id", F.round(F.col("distance").cast("double"), 3).alias("distance"), "rank")


I8 = "list_transform({0}.embedding, lambda x: round(CAST(x AS DOUBLE) * (127.0 / list_max(list_transform({0}.embedding, lambda y: abs(CAST(y AS DOUBLE)))))))"


@query("x02_i8_codec", f"WITH c AS (SELECT vec_id, {I8.format('e')} AS c FROM embeddings e), q AS (SELECT c AS q FROM c WHERE vec_id = 1) SELECT vec_id, round(1 - list_dot_product(c, q) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(q, q))), 6) AS distance FROM c, q")
def _(t):
    q, _s = vectors.encode_i8(F.array(*[F.lit(x).cast("float") for x in t.embeddings.where("vec_id = 1").first()["embedding"]]))
    c, _s = vectors.encode_i8(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(vectors.code_distance(c, q), 6).alias("distance"))


TOP = f"SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q ORDER BY {D2}, e.vec_id LIMIT 10"


def graphs(t, **options):
    shards = max(1, t.embeddings.count() // vectors.SHARD_ROWS + 4)
    return vectors.build_shards(t.embeddings, "vec_id", "embedding", shards, m=12, m0=24, breadth=64, **options)


def recalled(t, found, least: float):
    """The exact ten nearest of vector 2, and whether the search found enough of them."""
    exact = vectors.nearest(t.embeddings, "vec_id", "embedding", t.embeddings.where("vec_id = 2").first()["embedding"], 10)
    met = exact.join(found.select("vec_id"), "vec_id", "left_semi").agg((F.count("*") >= 10 * least).alias("enough"))
    return exact.select("vec_id").join(F.broadcast(met))


@query("x06_shard_search", f"SELECT vec_id, true AS enough FROM ({TOP})")
def _(t):
    q = t.embeddings.where("vec_id = 2").first()["embedding"]
    return recalled(t, vectors.search_shards(graphs(t), q, 10).withColumnRenamed("key", "vec_id"), 0.9)


@query("x04_product_codes", f"SELECT vec_id, true AS enough FROM ({TOP})")
def _(t):
    """Codes of 256 centroids a part: the exact ten nearest are among the forty nearest by table distance."""
    q = t.embeddings.where("vec_id = 2").first()["embedding"]
    pq = vectors.train_pq(t.embeddings, "embedding", max(1, len(q) // 4))
    return recalled(t, vectors.nearest_pq(t.embeddings, "vec_id", "embedding", q, 40, pq), 0.6)


@query("x05_coded_graph", f"SELECT vec_id, true AS enough FROM ({TOP})")
def _(t):
    q = t.embeddings.where("vec_id = 2").first()["embedding"]
    return recalled(t, vectors.search_shards(graphs(t, codec="i8"), q, 10).withColumnRenamed("key", "vec_id"), 0.8)


@query("x07_snapshot", f"SELECT vec_id, true AS enough, true AS whole FROM ({TOP})")
def _(t):
    """A snapshot of the shards is written and read, and one that was wiped is not there."""
    q, path = t.embeddings.where("vec_id = 2").first()["embedding"], scratch(t.spark, "shards")
    vectors.save_shards(graphs(t), path)
    back = vectors.load_shards(t.spark, path)
    found = stored(vectors.search_shards(back, q, 10).withColumnRenamed("key", "vec_id"), "found")
    whole = vectors.load_shards(t.spark, path, back.count() + 1) is None and vectors.wipe_shards(t.spark, path) and vectors.load_shards(t.spark, path) is None
    return recalled(t, found, 0.9).withColumn("whole", F.lit(whole))


@query("x08_bucket_recall", f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 4) SELECT e.vec_id, round({D2}, 3) AS distance FROM embeddings e, q WHERE round(CAST(e.embedding[1] / CAST(0.2 AS FLOAT) AS FLOAT)) = round(CAST(q.embedding[1] / CAST(0.2 AS FLOAT) AS FLOAT)) AND round(CAST(e.embedding[2] / CAST(0.2 AS FLOAT) AS FLOAT)) = round(CAST(q.embedding[2] / CAST(0.2 AS FLOAT) AS FLOAT)) ORDER BY {D2}, e.vec_id LIMIT 10")
def _(t):
    q = t.embeddings.where("vec_id = 4").first()["embedding"]
    got = vectors.bucket_recall(t.embeddings, "vec_id", "embedding", q, 0.2, 2, 10)
    return got.select("vec_id", F.round(F.col("distance").cast("double"), 3).alias("distance"))


@query("x09_filtered_search", f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 5) SELECT e.vec_id, round({D2}, 3) AS distance FROM embeddings e, q WHERE e.label = 3 ORDER BY {D2}, e.vec_id LIMIT 10")
def _(t):
    q = t.embeddings.where("vec_id = 5").first()["embedding"]
    got = vectors.nearest_allowed(t.embeddings, "vec_id", "embedding", q, 10, t.embeddings.where("label = 3"))
    return got.select("vec_id", F.round(F.col("distance").cast("double"), 3).alias("distance"))

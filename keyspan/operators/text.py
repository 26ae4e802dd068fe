"""N-gram postings, recall and ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bm25, ngrams


def postings(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """gram and key, each pair once: tasks combine pairs before the shuffle, in time linear in the text."""
    return docs.select(F.explode(ngrams(F.col(text), n)).alias("gram"), F.col(key)).distinct()


def query_grams(query: str, n: int) -> list[str]:
    return list(dict.fromkeys([query] if len(query) < n else [query[i : i + n] for i in range(len(query) - n + 1)]))


def recall(posted: DataFrame, key: str, grams: Sequence[str], every: bool = True) -> DataFrame:
    """Keys with all of the grams, or with any."""
    wanted = list(dict.fromkeys(grams))
    hits = posted.where(F.col("gram").isin(*wanted)) if wanted else posted.limit(0)
    counted = hits.groupBy(key).agg(F.countDistinct("gram").alias("found"))
    return counted.where(F.col("found") >= (len(wanted) if every else 1)).select(key)


def _quoted(gram: str) -> str:
    return "\\Q" + gram.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def holds(text: Column, gram: str, n: int) -> Column:
    """Whether ``gram`` is one of the text's windows of ``n``; a gram that is shorter is only the window of a text as short."""
    return text.contains(F.lit(gram)) if len(gram) == n else text == F.lit(gram)


def occurrences(text: Column, gram: str, n: int) -> Column:
    """How many of the text's windows of ``n`` are ``gram``, overlapping ones included."""
    return F.regexp_count(text, F.lit(f"(?={_quoted(gram)})")) if len(gram) == n else (text == F.lit(gram)).cast("int")


def matching(docs: DataFrame, key: str, text: str, grams: Sequence[str], n: int, every: bool = True) -> DataFrame:
    """Keys of the documents with all of the grams, or with any: one scan, for when no postings are stored."""
    tests = [holds(F.col(text), g, n) for g in dict.fromkeys(grams)]
    if not tests:
        return docs.select(key).limit(0)
    return docs.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)).select(key)


#: Grams that are counted in one pass over the texts, as a column each.
GRAMS_A_PASS = 32


def rank(docs: DataFrame, key: str, text: str, query: str, n: int, most: int) -> DataFrame:
    """The ``most`` documents with the highest BM25 for the query's grams: key and score; ties by key.

    Texts are searched in place and nothing is shuffled but the best rows: a first pass counts documents a gram, a second
    one scores the documents that hold any."""
    grams, body = query_grams(query, n), F.col(text)
    length = F.greatest(F.char_length(body) - n + 1, F.lit(1))
    found: list[int] = []
    for first in range(0, len(grams), GRAMS_A_PASS):
        part = grams[first : first + GRAMS_A_PASS]
        total, mean, *counts = docs.agg(F.count("*"), F.avg(length), *[F.count_if(holds(body, g, n)) for g in part]).first()
        found += counts
    sought = [(g, df) for g, df in zip(grams, found, strict=True) if df]
    if not sought:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    scored = docs.select(key, body.alias("__text"), length.alias("__dl"), F.lit(0.0).alias("score"), F.lit(False).alias("__any"))
    for first in range(0, len(sought), GRAMS_A_PASS):
        part = sought[first : first + GRAMS_A_PASS]
        score, hit = F.col("score"), F.col("__any")
        for g, df in part:
            here = holds(F.col("__text"), g, n)
            hit = hit | here
            tf = occurrences(F.col("__text"), g, n)
            score = score + F.when(here, bm25(tf, F.col("__dl"), F.lit(mean), F.lit(df), F.lit(total))).otherwise(0.0)
        scored = scored.select(key, "__text", "__dl", score.alias("score"), F.coalesce(hit, F.lit(False)).alias("__any"))
    return scored.where("__any").select(key, "score").orderBy(F.desc("score"), key).limit(most)

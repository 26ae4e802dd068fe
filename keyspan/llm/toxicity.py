"""A counterfactually regularised toxicity classifier.

A logistic model over the presence of words and word beginnings. Identity terms in labelled sentences are swapped for
others of their group, and the squared change of the score under a swap is part of the loss, so that a neutral mention
of a group does not raise the score.

The model is fitted on the driver to a bounded sample of labelled documents: about ``SAMPLE`` of each class, drawn by
a hash of the id over all labelled ones; the intercept is set back to the true odds. Scoring reads whole texts.

Edge cases: a null or empty text scores by the intercept alone; without labels of both classes the score is the share
of toxic labels. A document with several labels counts as toxic if one is. Null ids are never learned from and not
held out. Repeated rows score alike. Extra columns are kept; ``score`` replaces a column of its name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import fold

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Documents of each class in the sample.
SAMPLE = 3000
PREFIXES = (4, 5, 6)
#: A feature is used if its odds in toxic documents are higher by so many standard errors (no harmless word excuses an
#: insult), in at least so many documents; at most so many are used.
Z, LEAST_DOCS, MOST_FEATURES = 4.0, 4, 4000
EPOCHS, RATE, DECAY, SWAP = 400, 0.5, 1e-5, 4.0
#: Identity terms by group and language: within a group any may stand for any other.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "transgender"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
#: Swapped pairs that are learned from, at most; drawn evenly.
PAIRS = 4000


def features(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + "*" for w in words if len(w) > n)
    return found


def swaps(texts: Sequence[str], identities: Sequence[Sequence[str]]) -> list[tuple[set[str], set[str]]]:
    """Features of sentences with an identity term and of the same sentences with another term of its group."""
    others = {a: [b for x, b in permutations(group, 2) if x == a] for group in identities for a in group}
    if not others:
        return []
    term = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, others)) + r")(?!\w)", re.IGNORECASE)
    found = []
    for text in texts:
        for sentence in SENTENCE.findall(text):
            for a in sorted({m[1].lower() for m in term.finditer(sentence)}):
                for b in others[a]:
                    turned = term.sub(lambda m, a=a, b=b: b if m[1].lower() == a else m[0], sentence)
                    found.append((features(sentence), features(turned)))
    step = max(1, math.ceil(len(found) / PAIRS))
    return found[::step]


class Model:
    def __init__(self, weights: dict[str, float], intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def score(self, text: str | None) -> float:
        get = self.weights.get
        total = self.intercept + sum(get(f, 0.0) for f in sorted(features(text) & self.weights.keys()))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def fit(rows: Sequence[tuple[str, int]], odds: float, identities: Sequence[Sequence[str]] = IDENTITIES, swap: float = SWAP) -> Model:
    """A model from (text, toxic) rows; ``odds``: of a toxic label among all labelled documents."""
    rows = sorted(rows)
    n = Counter(y for _, y in rows)
    if not n[0] or not n[1]:
        share = odds / (1 + odds) if math.isfinite(odds) else 1.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, math.log(share / (1 - share)))
    counts = {0: Counter(), 1: Counter()}
    for text, y in rows:
        counts[y].update(features(text))
    picked = []
    for f in counts[0].keys() | counts[1].keys():
        a, b = counts[1][f], counts[0][f]
        if a + b >= LEAST_DOCS:
            p, q = (a + 0.5) / (n[1] + 1), (b + 0.5) / (n[0] + 1)
            z = (math.log(p / (1 - p)) - math.log(q / (1 - q))) / math.sqrt(1 / (a + 0.5) + 1 / (n[1] - a + 0.5) + 1 / (b + 0.5) + 1 / (n[0] - b + 0.5))
            if z >= Z:
                picked.append((-z, f))
    # terms that swaps touch always have weights, which the penalty holds together
    pairs = swaps([t for t, _ in rows], identities)
    touched = {f for a, b in pairs for f in a ^ b if counts[0][f] + counts[1][f] >= 1}
    names = sorted({f for _, f in sorted(picked)[:MOST_FEATURES]} | touched)
    place = {f: i for i, f in enumerate(names)}
    at = [(i, place[f]) for i, (text, _) in enumerate(rows) for f in features(text) & place.keys()]
    row, col = np.array(at, np.int64).reshape(-1, 2).T
    y = np.array([y for _, y in rows], float)
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    turned = [(k, place[f], 1.0 if f in a else -1.0) for k, (a, b) in enumerate(pairs) for f in (a ^ b) & place.keys()]
    s_row, s_col, s_by = (np.array(v) for v in zip(*turned, strict=True)) if turned else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    w, b = np.zeros(len(names)), 0.0
    seen_w, seen_b = np.full(len(names), 1e-8), 1e-8
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)) + b, -50, 50)))
        miss = weight * (p - y)
        g = np.bincount(col, miss[row], len(names)) + DECAY * w
        if len(s_row):
            change = np.bincount(s_row, s_by * w[s_col], len(pairs))
            g += 2 * swap / len(pairs) * np.bincount(s_col, s_by * change[s_row], len(names))
        seen_w += g * g
        seen_b += miss.sum() ** 2
        w -= RATE * g / np.sqrt(seen_w)
        b -= RATE * miss.sum() / math.sqrt(seen_b)
    return Model(dict(zip(names, w.tolist(), strict=True)), b + math.log(odds))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents of each class where ``learn`` holds of the label's doc_id."""
    spark = docs.sparkSession
    marked = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {int(r["toxic"]): r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    wanted = F.lit(False)
    for y, size in n.items():
        wanted = wanted | ((F.col("toxic") == y) & (drawn < sample / size))
    ids = marked.where(wanted)
    # two classes of about ``sample`` ids each: a few hundred KB at most
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect() if n else []
    odds = n.get(1, 0) / n[0] if n.get(0) else (math.inf if n else 0.0)
    return fit([(r["text"] or "", int(r["toxic"])) for r in rows], odds)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the column score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != "score"]

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in frames:
            yield pd.Series([own.score(t) for t in texts], dtype=float)

    return docs.select(*kept, F.pandas_udf(run, "double")(docs[text].cast("string")).alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train(docs, labels, ~out & F.col("doc_id").isNotNull())
    scored = score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Language identification of code-switched text by a linear-chain conditional random field.

Words are labelled with languages: affixes, character n-grams and learned lexicons score each word, learned transitions
score neighbours, and forward-backward gives each word's marginal. A document's language is the one with the largest
mean marginal over all its words, which is also the score.

The field is fitted on the driver to a bounded sample: ``SAMPLE_DOCS`` labelled documents a language, drawn by a hash
of the id over all of them (fewer if more than ``MOST_DOCS`` would come together), ``SAMPLE_WORDS`` words of each, in runs
spread over its whole text; executors draw the words, so that the driver gets no whole text. Half of the training
sequences are spliced from pieces of several documents, so that transitions between languages are learned.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing was labelled.
Repeated rows are judged alike. Ties go to the language first in text order. Long texts are one chain. Runs of
more than ``SEEN`` letters are judged in overlapping pieces, each a word of the chain. Extra columns are kept; ``lang_pred`` and ``score`` replace columns of their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, in_blocks

WORD = re.compile(r"[^\W\d_]+")
UND = "und"
SAMPLE_DOCS, SAMPLE_WORDS = 200, 400
#: Words of a training sequence, and the sizes of spliced pieces.
SEQUENCE, PIECES = 48, (3, 16)
BUCKETS = 1 << 16
#: Letters of a word; a longer run is several, which share three letters or more with the next, so that no n-gram is lost.
SEEN = 24
LEXICON = 300
EPOCHS, RATE, DECAY = 40, 0.35, 1e-6
#: Documents of the sample in all, however many languages there are.
MOST_DOCS = 20_000
#: Words scored together, and words whose scores are remembered by a worker.
TOGETHER, REMEMBERED = 200_000, 80_000


def words_of(text: str) -> list[str]:
    """The lower-case words of a text, long ones in pieces."""
    found = WORD.findall(text.lower())
    return [p for w in found for p in _pieces(w)] if any(len(w) > SEEN for w in found) else found


def _pieces(word: str) -> list[str]:
    """Pieces of ``SEEN`` letters, evenly spread over the word; the word if it has no more."""
    rest = len(word) - SEEN
    if rest <= 0:
        return [word]
    n = -(-rest // (SEEN - 3))
    return [word[i * rest // n : i * rest // n + SEEN] for i in range(n + 1)]


def _drawn(words: list[str]) -> list[str]:
    """``SAMPLE_WORDS`` of the words, in runs evenly spread over all of them; all if they are no more."""
    rest, n = len(words) - PIECES[1], SAMPLE_WORDS // PIECES[1]
    if len(words) <= SAMPLE_WORDS:
        return words
    return [w for i in range(n) for w in words[i * rest // (n - 1) : i * rest // (n - 1) + PIECES[1]]]


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^word$`` padded with zeros, and the lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    body = np.array(words, dtype=f"U{SEEN}").view(np.uint32).reshape(len(words), SEEN)
    out = np.zeros((len(words), SEEN + 2), np.uint32)
    out[:, 0] = 2
    out[:, 1:-1] = body
    out[np.arange(len(words)), size + 1] = 3
    return out, size + 2


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)


def features(words: list[str]) -> np.ndarray:
    """Feature buckets of each word, a row a word; bucket 0 stands for none."""
    c, size = _characters(words)
    c = c.astype(np.uint64)
    rows = np.arange(len(words))
    found = []
    grams = c
    for n in (2, 3, 4):
        grams = grams[:, : c.shape[1] - n + 1] * np.uint64(1_000_003) + c[:, n - 1 :]
        there = np.arange(grams.shape[1]) + n <= size[:, None]
        found.append(np.where(there, _mixed(grams, n), 0))
    whole = np.zeros(len(words), np.uint64)
    for k in range(c.shape[1]):
        whole = np.where(k < size, whole * np.uint64(1_000_003) + c[:, k], whole)
        if k in (1, 2, 3):
            found.append(_mixed(whole, 10 + k)[:, None])
    tail = np.zeros(len(words), np.uint64)
    for k in range(1, 5):
        tail = tail * np.uint64(1_000_003) + c[rows, np.maximum(size - k, 0)]
        if k > 1:
            found.append(_mixed(tail, 20 + k)[:, None])
    found.append(_mixed(whole, 30)[:, None])
    return np.concatenate(found, axis=1).astype(np.int32)


class Field:
    """A fitted field: languages, weights by bucket, lexicons and transitions."""

    def __init__(self, langs: list[str], weights: np.ndarray, lexicon: dict[str, int], lexical: np.ndarray, moves: np.ndarray, start: np.ndarray) -> None:
        self.langs, self.weights, self.lexicon, self.lexical, self.moves, self.start = langs, weights, lexicon, lexical, moves, start
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)), np.float32)

    def __getstate__(self) -> tuple:
        return self.langs, self.weights, self.lexicon, self.lexical, self.moves, self.start

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.langs)), np.float32)
        for a in range(0, len(words), 4_000):
            part = words[a : a + 4_000]
            f = features(part)
            out[a : a + len(part)] = self.weights[f].sum(axis=1)
            out[a : a + len(part)] += self.lexical[np.fromiter((self.lexicon.get(w, 0) for w in part), np.int64, len(part))]
        return out

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of ``scores`` for the words; unknown words are scored and remembered."""
        if len(self.known) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        new = list({w for w in words if w not in self.known})
        if new:
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.emissions(new)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """For each document a row of language probabilities a word."""
        sizes = np.array([len(d) for d in docs])
        flat, post = self._chains(docs, sizes)
        return np.split(post[flat], np.cumsum(sizes)[:-1]) if len(docs) else []

    def shares(self, docs: list[list[str]]) -> np.ndarray:
        """The mean marginals of each document; all have words."""
        sizes = np.array([len(d) for d in docs])
        flat, post = self._chains(docs, sizes)
        return np.add.reduceat(post[flat].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]

    def _chains(self, docs: list[list[str]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over all documents together: the k-th words of all that have one are neighbours in memory.

        Returns where each word (by document) stands, and the marginals there."""
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        longest = int(sizes.max())
        active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
        at = np.concatenate([[0], np.cumsum(active)])
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = at[step] + np.repeat(rank, sizes)
        e = np.empty((len(flat), len(self.langs)), np.float32)
        places = self.places([w for d in docs for w in d])
        e[flat] = self.scores[places]
        e -= e.max(axis=1, keepdims=True)
        # no word may rule out a language outright, or a chain could lose all its mass
        np.exp(np.maximum(e, -30, out=e), out=e)
        moves = np.exp(self.moves - self.moves.max()).astype(np.float32)
        alpha = np.empty_like(e)
        a = e[: active[0]] * np.exp(self.start - self.start.max()).astype(np.float32)
        a /= a.sum(axis=1, keepdims=True)
        alpha[: active[0]] = a
        for t in range(1, longest):
            i, j = at[t], at[t + 1]
            a = _times(alpha[at[t - 1] : at[t - 1] + j - i], moves) * e[i:j]
            a /= a.sum(axis=1, keepdims=True)
            alpha[i:j] = a
        b = np.ones((len(sizes), len(self.langs)), np.float32)
        back = np.ascontiguousarray(moves.T)
        for t in range(longest - 1, 0, -1):
            i, j = at[t], at[t + 1]
            n = _times(e[i:j] * b[: j - i], back)
            n /= n.sum(axis=1, keepdims=True)
            alpha[i:j] *= b[: j - i]
            b[: j - i] = n
        alpha[: active[0]] *= b
        alpha /= alpha.sum(axis=1, keepdims=True)
        return flat, alpha


def _times(rows: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``rows @ moves``, each row by itself: a library's product of a row may differ in the last bit by the rows beside it."""
    return (rows[:, :, None] * moves).sum(axis=1)


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Field | None:
    """A field from (text, language) pairs, by adaptive gradient steps on the mean log-likelihood of the sequences."""
    docs = [(_drawn(words_of(t)), lang) for t, lang in sorted(texts)]
    docs = [(w, lang) for w, lang in docs if w]
    langs = sorted({lang for _, lang in docs})
    if not langs:
        return None
    size, rng = len(langs), np.random.default_rng(seed)
    label = {lang: i for i, lang in enumerate(langs)}
    seen = {lang: Counter(w for words, own in docs if own == lang for w in words) for lang in langs}
    total = Counter()
    for c in seen.values():
        total.update(c)
    lexicon: dict[str, int] = {}
    for lang in langs:
        own = [(n, w) for w, n in seen[lang].items() if 2 * n > total[w] and n > 1]
        lexicon |= {w: 1 + label[lang] for _, w in sorted(own, key=lambda x: (-x[0], x[1]))[:LEXICON]}
    pieces = []
    for words, lang in docs:
        a = 0
        while a < len(words):
            n = int(rng.integers(*PIECES))
            pieces.append((words[a : a + n], label[lang]))
            a += n
    half = len(pieces) // 2
    spliced = [pieces[half + k] for k in rng.permutation(len(pieces) - half)]
    line = [(w, y) for ws, y in pieces[:half] + spliced for w in ws]
    line += line[: -len(line) % SEQUENCE]
    while len(line) % SEQUENCE:
        line += line[: -len(line) % SEQUENCE]
    vocabulary = sorted({w for w, _ in line})
    place = {w: i for i, w in enumerate(vocabulary)}
    x = np.array([place[w] for w, _ in line]).reshape(-1, SEQUENCE)
    y = np.array([y for _, y in line]).reshape(-1, SEQUENCE)
    f = features(vocabulary)
    lex = np.array([lexicon.get(w, 0) for w in vocabulary])
    weights, lexical = np.zeros((BUCKETS, size)), np.zeros((size + 1, size))
    moves, start = np.zeros((size, size)), np.zeros(size)
    sums = [np.full_like(p, 1e-8) for p in (weights, lexical, moves, start)]
    gold = np.zeros((*y.shape, size))
    np.put_along_axis(gold, y[..., None], 1, axis=2)
    pairs = np.zeros((size, size))
    np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for _ in range(EPOCHS):
        post, expected = _batch(weights[f].sum(axis=1) + lexical[lex], x, moves, start)
        miss = ((gold - post) / len(x)).reshape(-1, size)
        by_word = np.stack([np.bincount(x.ravel(), miss[:, k], len(vocabulary)) for k in range(size)], axis=1)
        spread = np.repeat(by_word, f.shape[1], axis=0)
        step = [
            np.stack([np.bincount(f.ravel(), spread[:, k], BUCKETS) for k in range(size)], axis=1) - DECAY * weights,
            np.stack([np.bincount(lex, by_word[:, k], size + 1) for k in range(size)], axis=1),
            (pairs - expected) / len(x),
            (gold[:, 0] - post[:, 0]).mean(axis=0),
        ]
        step[0][0] = 0
        step[1][0] = 0
        for p, g, s in zip((weights, lexical, moves, start), step, sums, strict=True):
            s += g * g
            p += RATE * g / np.sqrt(s)
    return Field(langs, weights.astype(np.float32), lexicon, lexical.astype(np.float32), moves, start)


def _batch(scores: np.ndarray, x: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transition counts of equally long sequences of words ``x``."""
    e = scores[x]
    e = np.exp(e - e.max(axis=2, keepdims=True))
    a, b = np.empty_like(e), np.ones_like(e)
    m = np.exp(moves - moves.max())
    a[:, 0] = e[:, 0] * np.exp(start - start.max())
    a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, x.shape[1]):
        a[:, t] = (a[:, t - 1] @ m) * e[:, t]
        a[:, t] /= a[:, t].sum(axis=1, keepdims=True)
    expected = np.zeros_like(m)
    for t in range(x.shape[1] - 2, -1, -1):
        right = e[:, t + 1] * b[:, t + 1]
        b[:, t] = right @ m.T
        b[:, t] /= b[:, t].sum(axis=1, keepdims=True)
        z = np.einsum("ni,ij,nj->n", a[:, t], m, right)
        expected += m * ((a[:, t] / z[:, None]).T @ right)
    post = a * b
    return post / post.sum(axis=2, keepdims=True), expected


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def train(docs: DataFrame, learn: Column, per_lang: int = SAMPLE_DOCS) -> Field | None:
    """A field from at most about ``per_lang`` documents a language of the rows where ``learn`` holds."""

    @F.pandas_udf("string")
    def some_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(_drawn(words_of(t))))

    rows = docs.where(learn).select("doc_id", docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = counts.count()
    if not langs:
        return None
    share = F.lit(min(per_lang, max(1.0, MOST_DOCS / langs))) / F.col("n")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    wanted = rows.join(if_small(counts.select(F.col("lang").alias("own"), share.alias("share"))), F.col("lang") == F.col("own")).where(drawn < F.col("share"))
    return fit([(r["text"], r["lang"]) for r in wanted.select(some_words("text").alias("text"), "lang").collect()])


def identify(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]

    def run(frames: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in frames:
            pred, score = np.full(len(texts), UND, dtype=object), np.zeros(len(texts))
            # a few texts at a time are taken out of the batch
            some = (t for first in range(0, len(texts), 64) for t in texts.slice(first, 64).to_pylist())
            rows = ((i, words_of(t)) for i, t in enumerate(some) if t)
            lettered = ((i, w) for i, w in rows if own and any(c.isalpha() for x in w for c in x))
            for part in in_blocks(lettered, lambda r: len(r[1]), TOGETHER):
                share = own.shares([w for _, w in part])
                at = [i for i, _ in part]
                best = share.argmax(axis=1)
                pred[at] = [own.langs[k] for k in best]
                score[at] = np.minimum(share[np.arange(len(part)), best], 1.0)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score)], ["lang_pred", "score"])

    judged = F.arrow_udf(run, "struct<lang_pred:string,score:double>")
    out = docs.select(*kept, judged(docs[text].cast("string")).alias("__lang"))
    return out.select(*kept, "__lang.lang_pred", "__lang.score")


def label_words(texts: list[str], field: Field) -> list[list[tuple[str, str]]]:
    """Each text's words with their likeliest languages; of a long one, that of its pieces together."""
    docs = [WORD.findall(t.lower()) for t in texts]
    pieces = [[_pieces(w) for w in d] for d in docs]
    marked = iter(field.marginals([[p for ps in d for p in ps] for d in pieces if d]))
    out = []
    for d, own in zip(docs, pieces, strict=True):
        starts = np.cumsum([0, *map(len, own)])[:-1]
        out.append([(w, field.langs[k]) for w, k in zip(d, np.add.reduceat(next(marked), starts).argmax(axis=1), strict=True)] if d else [])
    return out


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    field = train(docs, ~out)
    return identify(docs.select("doc_id", "text"), field).select("doc_id", out.alias("held_out"), "lang_pred", "score")

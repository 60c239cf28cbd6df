"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the words
of a text and the probabilities of the categories before it.  Those
probabilities come, in training, from models that have not seen the row
(out-of-fold), so later models do not learn from numbers that are better than
they will be in use.

Features: presence of words (lower case), of words with a given beginning of
three to seven letters, so that inflected and compound forms count, and of two
different words with that beginning.  A
category's features are those of the largest chi-squared statistic, of at
least `LEAST_CHI`; each model is a logistic regression with an L1 penalty,
then refitted on the features that it kept.  A word can only raise a
probability (its weight is not negative), so ordinary words around a toxic one
do not hide it; the earlier categories' weights may have either sign.

Training sample: at most `sample_rows` labelled rows, those first by a hash of
the id, each with its text (of documents that share the id the first by a hash); there are at most `vocabulary` features for
each category.  Every row of the table is scored by its whole text.

Defined cases: a null or wordless text is scored by the intercepts, like any
text without known words; a label that is null counts as 0; a category
without positive (or negative) examples has the constant probability 0 (or 1);
without labelled rows all probabilities are 0; repeated labels of one id are
separate examples; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings that are features; "abc*" is one, "abc*2" stands for two words with it.
STEMS = (3, 4, 5, 6, 7)
LEAST_CHI = 20.0


def features(text: str | None) -> set[str]:
    """All features of a text."""
    words = set(WORD.findall((text or "").lower()))
    stems = Counter(f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n)
    return words.union(stems, (f"{s}2" for s, n in stems.items() if n > 1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, free: int = 0, l1: float = 0.0003, l2: float = 1e-6, steps: int = 1000) -> np.ndarray:
    """Weights, intercept last, by accelerated proximal gradient, then without the L1 part on the kept columns.

    All but the last `free` columns have weights of at least zero and the L1 penalty.
    """
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1] + 1)
        w[-1] = -40 if not len(y) or y[0] == 0 else 40
        return w

    x, at, counts = np.unique(x, axis=0, return_inverse=True, return_counts=True)  # rows are few, as most texts have no feature
    n, hits = len(y), np.bincount(at.ravel(), weights=y, minlength=len(x))
    x = x.astype(np.float64)

    def descend(x: np.ndarray, l1: float, steps: int) -> np.ndarray:
        bound = x.shape[1] - free
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
        v = np.ones(x.shape[1])
        for _ in range(12):
            v = x.T @ (counts * (x @ v))
            v /= np.linalg.norm(v)
        rate = 1 / (0.25 * np.linalg.norm(x.T @ (counts * (x @ v))) / n * 1.05 + l2)
        w = at = np.zeros(x.shape[1])
        t = 1.0
        for _ in range(steps):
            gradient = x.T @ (counts * _sigmoid(x @ at) - hits) / n
            gradient[:-1] += l2 * at[:-1]
            new = at - rate * gradient
            new[:bound] = np.maximum(new[:bound] - rate * l1, 0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            at = new + (t - 1) / t_new * (new - w)
            w, t = new, t_new
        return w

    w = descend(x, l1, steps)
    kept = np.flatnonzero((w[:-1] != 0) | (np.arange(x.shape[1]) >= x.shape[1] - free))
    again = descend(x[:, kept], 0.0, 2 * steps)
    w = np.zeros(x.shape[1] + 1)
    w[kept], w[-1] = again[:-1], again[-1]
    return w


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hits, ranked = np.cumsum(y[order]), p[order]
    ends = np.flatnonzero(np.append(np.diff(ranked) != 0, True)) if len(p) else np.zeros(0, dtype=int)
    if not len(ends) or not y.sum():
        return 0.5
    best = ends[(2 * hits[ends] / (ends + 1 + y.sum())).argmax()]
    below = ranked[best + 1] if best + 1 < len(p) else 0.0
    return float(np.sqrt(max(ranked[best], 1e-12) * max(below, 1e-12)))


@dataclass
class Chain:
    """Weights of each category: words, then the earlier categories' probabilities, then the intercept.

    A category's threshold is the one of the best F-score of the out-of-fold
    probabilities, half way (of logarithms) between the rows that it parts.
    """

    categories: list[str]
    words: list[str]
    weights: list[np.ndarray]
    thresholds: list[float] = field(default_factory=list)

    @staticmethod
    def fit(categories: list[str], words: list[str], x: np.ndarray, y: np.ndarray, folds: np.ndarray, own: list[np.ndarray] | None = None) -> "Chain":
        """x: rows by words; y: rows by categories; folds: each row's fold number; own: each category's columns of x (default: all)."""
        earlier = np.zeros((len(x), 0), dtype=np.float32)
        weights, thresholds = [], []
        for c in range(len(categories)):
            columns = np.arange(len(words)) if own is None else own[c]
            seen = np.hstack([x[:, columns], earlier])
            out_of_fold = np.zeros(len(x))
            for fold in np.unique(folds):
                w = fit_logistic(seen[folds != fold], y[folds != fold, c], free=c)
                held = folds == fold
                out_of_fold[held] = _sigmoid(seen[held] @ w[:-1] + w[-1])
            w = fit_logistic(seen, y[:, c], free=c)
            full = np.zeros(len(words) + c + 1)
            full[columns], full[len(words) :] = w[: len(columns)], w[len(columns) :]
            weights.append(full)
            thresholds.append(_threshold(out_of_fold, y[:, c]))
            earlier = np.hstack([earlier, out_of_fold[:, None].astype(np.float32)])
        return Chain(categories, words, weights, thresholds)

    def predict(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (n by categories) of texts given as (row, word number) pairs."""
        out = np.zeros((n, len(self.categories)))
        for c, w in enumerate(self.weights):
            z = np.bincount(rows, weights=w[columns], minlength=n) if len(rows) else np.zeros(n)
            out[:, c] = _sigmoid(z + out[:, :c] @ w[len(self.words) : -1] + w[-1])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], sample_rows: int = 8000, vocabulary: int = 300, n_folds: int = 4, key: str = "doc_id", text: str = "text") -> Chain:
    """Fits a chain; categories maps names, in the chain's order, to 0/1 columns of labels."""
    names = list(categories)
    marks = labels.filter(F.col(key).isNotNull()).select(F.col(key).alias("_id"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(f"_{k}") for k, c in categories.items()])
    n = marks.count()
    if not n:
        return Chain(names, [], [np.array([*np.zeros(c), -40.0]) for c in range(len(names))])
    order = F.xxhash64(F.lit("toxicity"), "_id")
    marks = marks.filter(F.pmod(order, F.lit(1 << 20)) < (1 << 20) * min(1.0, 1.2 * sample_rows / n)).orderBy(order, *marks.columns).limit(sample_rows)
    marks = common.staged(marks.withColumn("row", F.monotonically_increasing_id()), "labelled")
    marked = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("t")).join(F.broadcast(marks), F.col(key) == F.col("_id"))  # at most sample_rows rows
    marked = marked.groupBy("row", *[f"_{k}" for k in names]).agg(F.min_by("t", F.xxhash64("t")).alias("t"))  # one text each, however many documents share an id

    def listed_features(batches):
        for rows in batches:
            yield {c: [r[i] for r in rows] for i, c in enumerate(columns[:-1])} | {"w": [sorted(features(r[-1])) for r in rows]}

    columns = ["row", *[f"_{k}" for k in names], "t"]
    words = common.map_rows(marked.select(*columns), listed_features, "row bigint, " + "".join(f"_{k} int, " for k in names) + "w array<string>")
    words = common.staged(words, "labelled-words")
    totals = words.agg(F.count("*").alias("n"), *[F.sum(f"_{k}").alias(k) for k in names]).first()
    if not totals["n"]:
        return Chain(names, [], [np.array([*np.zeros(c), -40.0]) for c in range(len(names))])
    counts = words.select(*[f"_{k}" for k in names], F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("df"), *[F.sum(f"_{k}").alias(k) for k in names]).filter("df >= 3")
    counts = common.staged(counts, "word-counts")
    wanted: dict[str, set[str]] = {}
    for k in names:  # chi-squared of presence and category, from the four counts
        total, positive = float(totals["n"]), float(totals[k])
        expected = F.col("df") * F.lit(positive / total)
        spread = F.col("df") * F.lit(max(positive * (total - positive), 1e-9) / total**2) * (F.lit(1.0) - F.col("df") / F.lit(total + 1e-9))
        score_of = (F.col(k) - expected) * (F.col(k) - expected) / F.greatest(spread, F.lit(1e-9))
        best = counts.filter((F.col(k) > expected) & (score_of >= LEAST_CHI)).orderBy(score_of.desc(), "w").limit(vocabulary)
        wanted[k] = {r["w"] for r in best.select("w").collect()}
    chosen = sorted(set().union(*wanted.values()))
    number = {w: i for i, w in enumerate(chosen)}
    listed = words.select("row", *[f"_{k}" for k in names], F.array_intersect("w", F.array(*map(F.lit, chosen)) if chosen else F.array().cast("array<string>")).alias("w")).orderBy("row").collect()
    x = np.zeros((len(listed), len(chosen)), dtype=np.float32)
    for i, r in enumerate(listed):
        x[i, [number[w] for w in r["w"]]] = 1
    y = np.array([[r[f"_{k}"] for k in names] for r in listed], dtype=float)
    chosen, x = _told_apart(chosen, x)
    folds = np.arange(len(listed)) % n_folds  # the rows are in the order of a hash
    own = [np.array([i for i, w in enumerate(chosen) if w in wanted[k]], dtype=np.int64) for k in names]
    return Chain.fit(names, chosen, x, y, folds, own)


def _told_apart(words: list[str], x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Leaves out features that occur in the same rows as a more specific one (a whole word, else a longer beginning)."""
    order = sorted(range(len(words)), key=lambda i: ("*" in words[i], -len(words[i]), words[i]))
    seen: dict[bytes, int] = {}
    for i in order:
        seen.setdefault(np.packbits(x[:, i] > 0).tobytes(), i)
    kept = sorted(seen.values())
    return [words[i] for i in kept], x[:, kept]


def score(docs: DataFrame, model: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p_<category> ..., is_<category> ...) for every row of docs."""
    kind = dict(docs.dtypes)[key]
    held = common.Shipped(docs.sparkSession, model)  # vocabulary words and weights
    names = [f"p_{c}" for c in model.categories]

    def run(batches):
        number = {w: i for i, w in enumerate(held.value.words)}
        known = set(number)
        stems = {f.removesuffix("2") for f in known if "*" in f}
        cache: dict[str, tuple[str, ...]] = {}
        for rows in batches:
            if len(cache) > 200_000:
                cache.clear()
            at, columns = [], []
            for i, (_, t) in enumerate(rows):
                words = set(WORD.findall((t or "").lower()))
                for w in words.difference(cache):
                    cache[w] = tuple(s for n in STEMS if len(w) >= n and (s := f"{w[:n]}*") in stems)
                counts = Counter(chain.from_iterable(map(cache.__getitem__, words)))
                found = known.intersection(words.union(counts, (f"{s}2" for s, n in counts.items() if n > 1)))
                at += [i] * len(found)
                columns += sorted(number[f] for f in found)
            p = held.value.predict(np.array(at, dtype=np.int64), np.array(columns, dtype=np.int64), len(rows))
            bounds = held.value.thresholds or [0.5] * len(names)
            yield {key: [k for k, _ in rows], **{c: p[:, j] for j, c in enumerate(names)}, **{f"is_{c}": p[:, j] >= bounds[j] for j, c in enumerate(held.value.categories)}}

    return common.map_rows(docs.select(key, text), run, f"{key} {kind}, " + ", ".join([f"{c} double" for c in names] + [f"is_{c} boolean" for c in model.categories]))

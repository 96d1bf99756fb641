"""Quality classifier: a generalised additive model with pairwise interactions over statistics of whole texts.

Cyclic boosting: each round visits every feature and fits a shallow tree (at most four leaves) to the gradient of the
logistic loss over that feature's bins; the trees of a feature add up to one lookup table. Then pairs are ranked by how
much a two-way cut explains of what is left, and the best get tables over two coarse bins in the same way. A score is the
logistic of an intercept and table entries picked by bin number: vectorised additions, no tree is walked.

The model is fitted in numpy on a bounded sample: the `sample` labelled documents (default 20,000) of least hash that are
outside the held-out fold (crc32 of doc_id mod 3 = 1). Scoring is a column expression over all texts, without a shuffle.

Defined results: a null text is scored like an empty one; labels that are null or without a document are not used; with no
label of one of the two classes the score is the share of label 1 among those there are (0.5 without any); of repeated
labels or documents of one id one is learned from. Only doc_id, text and quality are read; other columns may have any name.
"""
from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erisk.llm.common import held_out

FEATURES = ["log_words", "word_length", "upper", "symbols", "marks", "digits", "other_scripts", "line_words", "distinct",
            "top_word", "stutter", "repeats", "dup_lines", "short_words"]
SAMPLE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, BINS, PAIR_BINS = 20_000, 150, 60, 6, 0.1, 48, 8


def features(text: str | None) -> list[float]:
    """Statistics of one whole text; none depends on language, source or id."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = Counter(text)
    solid = sum(k for c, k in chars.items() if not c.isspace())
    letters = sum(k for c, k in chars.items() if c.isalpha())
    share = lambda test: sum(k for c, k in chars.items() if test(c)) / solid
    count = Counter(words)
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    return [math.log(n), min(solid / n, 50.0), share(str.isupper) * solid / max(letters, 1), share("#*$%&|<>{}=".__contains__),
            1 - share(str.isalnum), share(str.isdigit), share(lambda c: c > "\x7f"), math.log(n / len(lines)),
            math.log(len(count)) / math.log(n) if n > 1 else 1.0, max(count.values()) / n,
            sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(grams)) / len(grams) if grams else 0.0,
            1 - len(set(lines)) / len(lines), sum(k for w, k in count.items() if len(w) < 4) / n]


def text_features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(map(features, texts.to_pylist()), pa.list_(pa.float64()))
    return run(text)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best single cut of a run of bins (bins below the place go left)."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * a / (b + 1.0) + (g.sum() - a) ** 2 / (h.sum() - b + 1.0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (-1.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps of the leaves of a tree over ordered bins, one value a bin."""
    _, at = best_cut(g, h) if depth and len(g) > 1 else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1), shallow_tree(g[at:], h[at:], depth - 1)])


def two_way_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A cut of the one axis, then one of the other axis on each side; the better of the two orders."""
    best, table = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, at = best_cut(a.sum(1), b.sum(1))
        if not at:
            continue
        out, gain = np.zeros_like(a), 0.0
        for part in (slice(0, at), slice(at, None)):
            ga, ha = a[part].sum(0), b[part].sum(0)
            value = shallow_tree(ga, ha, 1)
            gain += float((value * ga).sum())
            out[part] = value
        if gain > best:
            best, table = gain, out.T if flip else out
    return table


class AdditiveModel:
    """Intercept, cuts and lookup tables of features and of pairs of features."""

    def __init__(self, prior: float = 0.5):
        self.base = math.log(prior / (1 - prior)) if 0 < prior < 1 else (2 * prior - 1) * 4.0 if prior != 0.5 else 0.0
        self.cuts: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        quantiles = lambda k: [np.unique(np.quantile(v, np.arange(1, k) / k)) for v in x.T]
        self.cuts, self.coarse = quantiles(BINS), quantiles(PAIR_BINS)
        bins, wide = binned(x, self.cuts), binned(x, self.coarse)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        f = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                step = RATE * shallow_tree(np.bincount(bins[:, j], y - p, len(t)), np.bincount(bins[:, j], p * (1 - p), len(t)))
                t += step
                f += step[bins[:, j]]
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for i, j in self.ranked(wide, y, f)]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                p, cell = 1 / (1 + np.exp(-f)), wide[:, i] * t.shape[1] + wide[:, j]
                g, h = (np.bincount(cell, v, t.size).reshape(t.shape) for v in (y - p, p * (1 - p)))
                step = RATE * two_way_tree(g, h)
                t += step
                f += step.ravel()[cell]
        return self

    def ranked(self, wide: np.ndarray, y: np.ndarray, f: np.ndarray) -> list[tuple[int, int]]:
        """The pairs whose cells explain most of the residuals beyond what either feature explains."""
        p, found = 1 / (1 + np.exp(-f)), []
        for i, j in combinations(range(wide.shape[1]), 2):
            shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            cell = wide[:, i] * shape[1] + wide[:, j]
            g, h = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))
            gain = [(a * a / (b + 1)).sum() for a, b in ((g, h), (g.sum(0), h.sum(0)), (g.sum(1), h.sum(1)))]
            found.append((gain[0] - gain[1] - gain[2], i, j))
        return [(i, j) for _, i, j in sorted(found, reverse=True)[:PAIRS]]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.tables and len(x):
            bins, wide = binned(x, self.cuts), binned(x, self.coarse)
            for j, t in enumerate(self.tables):
                f += t[bins[:, j]]
            for i, j, t in self.pairs:
                f += t[wide[:, i], wide[:, j]]
        return 1 / (1 + np.exp(-f))


def training_rows(documents: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded sample; at most `sample` rows reach the driver."""
    own = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    own = own.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")   # broadcast: at most `sample` ids
    rows = texts.select("doc_id", "y", text_features(F.col("text")).alias("x")).groupBy("doc_id").agg(
        F.first("y").alias("y"), F.max("x").alias("x")).orderBy("doc_id").collect()
    return np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows])


def fitted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    x, y = training_rows(documents, labels, sample)
    model = AdditiveModel(float(y.mean()) if len(y) else 0.5)
    return model.fit(x, y) if 0 < y.sum() < len(y) else model


def quality_score(text: Column, model: AdditiveModel) -> Column:
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        x = np.array(list(map(features, texts.to_pylist()))).reshape(len(texts), len(FEATURES))
        return pa.array(model.score(x), pa.float64())
    return run(text)


def scored(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is at least 0.5) of every document."""
    model = fitted(documents, labels, sample)
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score")
                            ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    return documents.filter(quality_score(F.col("text"), fitted(documents, labels, sample)) >= 0.5)

"""Quality rules: base rules on whole texts, and robust multivariate outliers per language and source.

Each text gets a vector of transformed statistics. For each (language, source) group a minimum-covariance-determinant
estimate of centre and scatter is found by concentration steps from a deterministic start (coordinate-wise median and
MAD): a step keeps the h rows of least Mahalanobis distance and takes their mean and covariance. Rows beyond a chi-square
quantile under the final, reweighted estimate are rejected.

Every step is a pass of aggregates over the table of vectors: exact counts of distances in fine bins give the h-th
distance, sums and cross products give the next estimate. Both combine before the shuffle, so a source with a third of
all rows sends one row per task and bin, and estimates stay a small table that is joined, never collected.

Defined results: a null or empty text has no words and fails the base rules; null language or source is a group of its
own; a group with fewer than `min_group` rows shares the estimate of its language's small groups, then that of all small
groups; if that is still below `min_group` its rows pass (there is no estimate to judge by). Repeated rows are judged
alike. Other columns of the input are not read and may have any name.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erisk.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SHINGLE = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The coordinates of the vector, and the standard deviation added to each: differences well below it never count. Shares
#: that are zero in most texts and legitimate in some get wide ones: repeats, which the base rule bounds, and repeated lines, where only
#: a text that is nearly all copies of its own lines is out of bounds by this alone.
FLOOR = {"word_length": 0.25, "symbols": 0.15, "repeats": 0.25, "dup_lines": 0.15, "upper": 0.08, "marks": 0.08}
DIMS = list(FLOOR)
P = len(DIMS)
#: Means over few words vary more: such a coordinate is scaled by sqrt(n / (n + this)).
NOISE_WORDS = {"word_length": 200, "upper": 100, "marks": 100}
H_SHARE, STEPS, REWEIGHT, REJECT, MIN_GROUP = 0.75, 4, 0.975, 1 - 1e-6, 100
TYPE = pa.struct([(c, pa.int64()) for c in BASE] + [(c, pa.float64()) for c in DIMS])
DDL = ", ".join([f"{c}: bigint" for c in BASE] + [f"{c}: double" for c in DIMS])


def repeated_words(words: list[str]) -> int:
    """Words inside 5-word windows that are found twice or more in the text, the first included."""
    grams = list(zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    hit = bytearray(len(words))
    for k, g in enumerate(grams):
        if seen[g] > 1:
            hit[k:k + SHINGLE] = b"\x01" * SHINGLE
    return sum(hit)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def statistics(text: str | None) -> tuple:
    """Base counts and vector of one whole text; a null text is empty."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    dup, rep = duplicate_lines(text), repeated_words(words)
    if not n:
        return 0, 0, symbols, dup, rep, *[0.0] * P
    count = Counter(text)
    letters = sum(k for c, k in count.items() if c.isalpha())
    upper = sum(k for c, k in count.items() if c.isupper())
    marks = chars - sum(k for c, k in count.items() if c.isalnum())
    return (n, chars, symbols, dup, rep, chars / n, math.asinh(50 * symbols / chars), math.sqrt(rep / n),
            math.sqrt(dup / (text.count("\n") + 1)), math.sqrt(upper / max(letters, 1)), math.sqrt(max(marks, 0) / chars))


def text_statistics(text: Column) -> Column:
    """Struct of the base counts and the vector."""
    @F.arrow_udf(f"struct<{DDL}>")
    def stats(texts: pa.Array) -> pa.Array:
        rows = list(map(statistics, texts.to_pylist()))
        cols = list(zip(*rows, strict=True)) or [()] * len(TYPE)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, TYPE, strict=True)], fields=list(TYPE))
    return stats(text)


def base_failed(s: str) -> Column:
    n, rep = F.col(f"{s}.n_words"), F.col(f"{s}.n_repeat_words")
    return (n < 10) | (100 * rep > 20 * n)


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function by the series of the incomplete gamma function."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = math.exp(a * math.log(y) - y - math.lgamma(a + 1))
    n = 1
    while term > 1e-17 * total or y > a + n:
        term *= y / (a + n)
        total += term
        n += 1
    return min(total, 1.0)


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def group_key() -> Column:
    return F.to_json(F.struct("lang", "source"))


def groups_of(vectors: DataFrame, min_group: int) -> DataFrame:
    """k (language and source) -> g, the group whose estimate judges it: itself, or a pool of small groups."""
    sizes = vectors.groupBy("k", "lang").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") < min_group).groupBy(F.col("lang").alias("pool")).agg(F.sum("n").alias("pooled"))
    pool = F.when(F.col("pooled") >= min_group, F.concat(F.lit("lang "), F.coalesce("lang", F.lit("")))).otherwise("small")
    return sizes.join(small, F.col("lang").eqNullSafe(F.col("pool")), "left").select(
        "k", F.when(F.col("n") >= min_group, F.col("k")).otherwise(pool).alias("g"))


def start(vectors: DataFrame, groups: DataFrame, min_group: int) -> DataFrame:
    """g -> median and quartile scale of each coordinate, from exact counts of finely rounded values."""
    at = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.round(F.col(c) / (FLOOR[c] / 50)).cast("long").alias("v"))
                             for j, c in enumerate(DIMS))))
    cells = (vectors.join(groups, "k").select("g", at.alias("c")).select("g", "c.j", "c.v")
             .groupBy("g", "j", "v").agg(F.count("*").alias("n")))
    w = Window.partitionBy("g", "j")
    below = cells.select("*", F.sum("n").over(w.orderBy("v")).alias("upto"), F.sum("n").over(w).alias("all"))
    q = [F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("v"))).alias(n) for n, p in (("a", .25), ("m", .5), ("b", .75))]
    unit = F.element_at(F.array(*(F.lit(f / 50) for f in FLOOR.values())), F.col("j") + 1)
    found = below.groupBy("g", "j").agg(F.max("all").alias("n"), *q).withColumns(
        {"mid": F.col("m") * unit, "sd": (F.col("b") - F.col("a")) * unit / 1.349})
    ordered = F.sort_array(F.collect_list(F.struct("j", "mid", "sd")))
    return found.filter(F.col("n") >= min_group).groupBy("g").agg(ordered.alias("s")).select(
        "g", F.col("s.mid").alias("mid"), F.col("s.sd").alias("sd"))


def whitening(cov: np.ndarray) -> list[float]:
    """Rows of the inverse Cholesky factor, lower triangle: the squared length of its product is the distance."""
    inv = np.linalg.inv(np.linalg.cholesky(cov))
    return [float(inv[i, j]) for i in range(P) for j in range(i + 1)]


def floors() -> np.ndarray:
    return np.diag(np.square(list(FLOOR.values())))


PARAMS = "g string, mid array<double>, mu array<double>, w array<double>"


def first_params(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"g": b.g, "mid": b.mid, "mu": [[0.0] * P] * len(b),
                            "w": [whitening(np.diag(np.square(sd)) + floors()) for sd in b.sd]})


def next_params(share: float):
    """Mean and covariance of the kept rows; the covariance of a trimmed normal sample is scaled back to the whole."""
    factor = share / chi2_cdf(chi2_quantile(share, P), P + 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mus, ws = [], []
            for n, s1, s2 in zip(b.n, b.s1, b.s2, strict=True):
                mu, cov = np.array(s1) / n, np.zeros((P, P))
                cov[np.tril_indices(P)] = np.array(s2) / n
                cov = cov + np.tril(cov, -1).T - np.outer(mu, mu)
                mus.append(list(mu))
                ws.append(whitening(factor * (cov + cov.T) / 2 + floors()))
            yield pd.DataFrame({"g": b.g, "mid": b.mid, "mu": mus, "w": ws})
    return run


def centred(j: int, c: str, s: str = "", p: str = "") -> Column:
    """A coordinate less its group's median, damped where it is a mean over few words; s, p: prefixes of the columns."""
    x, n = F.col(s + c) - F.col(f"{p}mid")[j], F.col(f"{s}n_words")
    return x * F.sqrt(n / (n + NOISE_WORDS[c])) if c in NOISE_WORDS else x


def squared_distance(s: str = "", p: str = "") -> Column:
    x = [centred(j, c, s, p) - F.col(f"{p}mu")[j] for j, c in enumerate(DIMS)]
    w, total, at = F.col(f"{p}w"), F.lit(0.0), 0
    for i in range(P):
        y = sum((w[at + j] * x[j] for j in range(1, i + 1)), w[at] * x[0])
        total, at = total + y * y, at + i + 1
    return total


def concentrated(vectors: DataFrame, params: DataFrame, share: float | None) -> DataFrame:
    """One concentration step (`share` of the rows of each group, by distance), or the reweighting step (None)."""
    x = vectors.join(params, "k").withColumn("d2", squared_distance())
    if share is None:
        x, share, bin_of = x.filter(F.col("d2") <= chi2_quantile(REWEIGHT, P)), REWEIGHT, F.lit(0)
        part = 1.0
    else:
        bin_of, part = F.floor(16 * F.log2(F.col("d2") + 0.01)).cast("int"), share
    z = [centred(j, c) for j, c in enumerate(DIMS)]
    sums = [F.sum(v).alias(f"a{j}") for j, v in enumerate(z)]
    sums += [F.sum(z[i] * z[j]).alias(f"b{i}_{j}") for i in range(P) for j in range(i + 1)]
    bins = x.groupBy("g", bin_of.alias("bin")).agg(F.count("*").alias("n"), F.first("mid").alias("mid"), *sums)
    w = Window.partitionBy("g")
    bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    taken = bins.filter(F.col("upto") - F.col("n") < F.col("all") * part).groupBy("g").agg(
        F.first("mid").alias("mid"), F.sum("n").alias("n"),
        F.array(*(F.sum(f"a{j}") for j in range(P))).alias("s1"),
        F.array(*(F.sum(f"b{i}_{j}") for i in range(P) for j in range(i + 1))).alias("s2"))
    return taken.mapInPandas(next_params(share), PARAMS)


def vector_table(documents: DataFrame) -> DataFrame:
    """doc_id, base counts, vector and base verdict of every document, without the texts."""
    return documents.select("doc_id", "lang", "source", group_key().alias("k"), text_statistics(F.col("text")).alias("s")).select(
        "doc_id", "lang", "k", "s.*", base_failed("s").alias("base_failed"))


def estimates(vectors: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """k -> robust centre and whitening of the group that judges it, for groups with enough rows."""
    rows = vectors.filter(~F.col("base_failed"))
    groups = written(groups_of(rows, min_group), "groups")
    params = start(rows, groups, min_group).mapInPandas(first_params, PARAMS)
    for share in [H_SHARE] * STEPS + [None]:
        params = concentrated(rows, written(groups.join(params, "g"), "estimates"), share)
    return written(groups.join(params, "g"), "estimates")


def judged(vectors: DataFrame, params: DataFrame) -> DataFrame:
    d2 = squared_distance()
    return vectors.join(params, "k", "left").withColumns(
        {"distance": F.when(~F.col("base_failed"), F.sqrt(d2)),
         "kept": ~F.col("base_failed") & F.coalesce(d2 <= chi2_quantile(REJECT, P), F.lit(True))})


def quality_rules(documents: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, base counts, base_failed, robust distance (null if the base rules failed or no estimate) and kept."""
    vectors = written(vector_table(documents), "vectors")
    return judged(vectors, estimates(vectors, min_group)).select("doc_id", *BASE, "base_failed", "distance", "kept")


def kept_documents(documents: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that the rules keep, with all their columns. Statistics are computed on the row itself, so null or
    repeated ids do no harm."""
    params = estimates(written(vector_table(documents), "vectors"), min_group)
    packed = params.select(F.col("k").alias("key"), F.struct("mid", "mu", "w").alias("p"))
    # the input's own columns are one struct, so they may have any name
    own = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("d"), text_statistics(F.col("text")).alias("s"),
                           group_key().alias("key"))
    near = F.coalesce(squared_distance("s.", "p.") <= chi2_quantile(REJECT, P), F.lit(True))
    return own.join(packed, "key", "left").filter(~base_failed("s") & near).select("d.*")

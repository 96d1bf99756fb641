"""Language identification: a byte convolutional network, trained in numpy, applied to batches of fixed-length windows.

Lower-cased UTF-8 bytes are cut into windows of 256. Each byte has a learned vector; filters of widths 2, 3 and 4 slide
over the window, each filter keeps its largest response, and a softmax layer over these gives language probabilities. A
text's answer is the mean over all its windows, weighted by their bytes. All filters run as one matrix product.

Training uses a bounded sample (`sample` documents in all, default 12,000, split evenly over all languages, but some
`LEAST` of each, so the sample grows with their number beyond 1,200) of documents with a language outside the held-out
fold, four windows of each. Every language has at least one document in it. Only text and language are learned from. Prediction is a column expression over all texts, without a shuffle.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing could be learned; with one
language learned, that one with score 1. Repeated rows are predicted alike. Other columns are not read.
"""
from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erisk.llm.common import held_out

WINDOW, DIM, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 8
SAMPLE, LEAST, EPOCHS, BATCH, RATE, SEED = 12_000, 10, 4, 128, 0.01, 7
PAD, WIDEST, ALL = 256, max(WIDTHS), FILTERS * len(WIDTHS)
UNKNOWN = "und"
#: Windows that one matrix product takes: bounds memory to some 60 MB.
CHUNK = 1024


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows(text: str) -> np.ndarray:
    """All windows of a text as rows of byte numbers, the last filled up with PAD."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    out = np.full(max(1, -(-len(raw) // WINDOW)) * WINDOW, PAD, np.int16)
    out[:len(raw)] = raw
    return out.reshape(-1, WINDOW)


class ByteNetwork:
    """Byte vectors, filters of several widths in one matrix, max pooling and a softmax layer."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.mask = np.zeros((WIDEST * DIM, ALL), np.float32)      # a filter of width w reads the first w bytes
        for k, w in enumerate(WIDTHS):
            self.mask[:w * DIM, k * FILTERS:(k + 1) * FILTERS] = 1
        self.p = [draw(PAD + 1, DIM), draw(WIDEST * DIM, ALL) * self.mask, np.zeros(ALL, np.float32),
                  draw(ALL, len(languages)), np.zeros(len(languages), np.float32)]
        self.p[0][PAD] = 0

    def unfolded(self, ids: np.ndarray) -> np.ndarray:
        padded = np.pad(ids, ((0, 0), (0, WIDEST - 1)), constant_values=PAD)
        e = self.p[0][padded].reshape(len(ids), -1)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDEST * DIM, axis=1)[:, ::DIM]
        return np.ascontiguousarray(view).reshape(-1, WIDEST * DIM)

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cols = self.unfolded(ids)
        z = (cols @ self.p[1]).reshape(len(ids), WINDOW, ALL)
        top = z.max(axis=1)
        pooled = np.maximum(top + self.p[2], 0)
        logits = pooled @ self.p[3] + self.p[4]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return cols, z, pooled, e / e.sum(axis=1, keepdims=True)

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        cols, z, pooled, prob = self.forward(ids)
        n = len(ids)
        d = prob.copy()
        d[np.arange(n), y] -= 1
        d /= n
        dpool = (d @ self.p[3].T) * (pooled > 0)
        where = z.argmax(axis=1)                                    # (n, filters): where each filter responded most
        picked = cols.reshape(n, WINDOW, -1)[np.arange(n)[:, None], where]
        dfilter = np.einsum("nfk,nf->kf", picked, dpool) * self.mask
        back = dpool[:, :, None] * self.p[1].T[None]                # (n, filters, widest * dim)
        padded = np.pad(ids, ((0, 0), (0, WIDEST - 1)), constant_values=PAD)
        at = padded[np.arange(n)[:, None, None], where[:, :, None] + np.arange(WIDEST)]
        dembed = np.zeros_like(self.p[0])
        np.add.at(dembed, at.ravel(), back.reshape(-1, DIM))
        dembed[PAD] = 0
        return [dembed, dfilter, dpool.sum(0), pooled.T @ d, d.sum(0)]

    def fit(self, ids: np.ndarray, y: np.ndarray) -> ByteNetwork:
        """Adam over shuffled batches; seeded, so the same sample gives the same network."""
        rng, t = np.random.default_rng(SEED), 0
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                t += 1
                for p, a, b, g in zip(self.p, m, v, self.gradients(ids[order[i:i + BATCH]], y[order[i:i + BATCH]]), strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (RATE * a / (1 - 0.9 ** t) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
        return self

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        parts = [self.forward(ids[i:i + CHUNK])[3] for i in range(0, len(ids), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        queue: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            ids = np.concatenate([w for _, w in queue])
            weight = (ids != PAD).sum(axis=1, keepdims=True)
            total = self.probabilities(ids) * weight
            first = np.cumsum([0, *(len(w) for _, w in queue)])[:-1]
            mean = np.add.reduceat(total, first) / np.add.reduceat(weight, first)
            for (k, _), row in zip(queue, mean, strict=True):
                lang[k], score[k] = self.languages[int(row.argmax())], min(1.0, float(row.max()))
            queue.clear()

        held = 0
        for k, text in enumerate(texts):
            if self.languages and text and has_letter(text):
                queue.append((k, windows(text)))
                held += len(queue[-1][1])
                if held >= 4 * CHUNK:
                    flush()
                    held = 0
        if queue:
            flush()
        return lang, score


def training_windows(documents: DataFrame, sample: int) -> list:
    """(lang, four pieces of text) of the bounded sample; some `sample` rows, or `LEAST` a language, reach the driver."""
    h = F.xxhash64("doc_id", "text")
    own = documents.select("doc_id", "text", "lang", h.alias("h"), F.pmod(h, F.lit(1 << 40)).alias("u")).filter(
        F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("first")).collect()
    if not counts:
        return []
    each = max(sample / len(counts), LEAST)
    shares = documents.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"]), r["first"]) for r in counts],
                                                    "lang string, share double, first bigint")
    drawn = own.join(F.broadcast(shares), "lang").filter((F.col("u") / float(1 << 40) < F.col("share")) | (F.col("u") == F.col("first")))
    span = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    pieces = [F.substring("text", (1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), span)).cast("int"), F.lit(WINDOW)) for k in range(4)]
    rows = drawn.select("lang", F.array(*pieces).alias("w"), "h", "doc_id", (F.col("u") > F.col("first")).alias("later")).dropDuplicates(
        ["lang", "h"]).orderBy("later", "h", "doc_id").limit(int(2 * each * len(counts)) + 1).collect()
    return sorted(rows, key=lambda r: (r["h"], r["doc_id"] is not None, r["doc_id"], r["lang"]))


def fitted(documents: DataFrame, sample: int = SAMPLE) -> ByteNetwork:
    rows = training_windows(documents, sample)
    languages = sorted({r["lang"] for r in rows})
    net = ByteNetwork(languages)
    if len(languages) < 2:
        return net
    pairs = [(windows(w)[0], languages.index(r["lang"])) for r in rows for w in r["w"] if has_letter(w)]
    return net.fit(np.stack([a for a, _ in pairs]), np.array([b for _, b in pairs])) if pairs else net


def language_of(text: Column, net: ByteNetwork) -> Column:
    """Struct of the predicted language and its score."""
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        lang, score = net.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
    return run(text)


def identified(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    net = fitted(documents, sample)
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_of(F.col("text"), net).alias("p")
                            ).select("doc_id", "held_out", "p.*")

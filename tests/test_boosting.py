"""Histogram boosting against a plain row-by-row reading of its rules."""
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from erisk.operators import boosting as B


def plain_boosting(codes, y, rounds):
    """Each node splits its own rows by the best (feature, cut, side of NULL), best gain first; probabilities after all rounds."""
    rate = y.mean()
    raw = np.full(len(y), np.log(rate / (1 - rate)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = np.rint((p - y) * B.ONE) / B.ONE, np.rint(p * (1 - p) * B.ONE) / B.ONE

        def split(rows):
            best = (1e-12, None)
            G, H = g[rows].sum(), h[rows].sum()
            for null_left in (False, True):
                here = (0.0, None)
                for f in range(codes.shape[1]):
                    c = codes[rows, f]
                    for cut in range(B.BINS):
                        left = np.where(c == B.MISSING, null_left, c <= cut)
                        n = int(left.sum())
                        if n < B.MIN_LEAF_ROWS or len(rows) - n < B.MIN_LEAF_ROWS:
                            continue
                        gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                        gain = gl * gl / (hl + B.L2) + (G - gl) ** 2 / (H - hl + B.L2) - G * G / (H + B.L2)
                        if gain > here[0] + 1e-10:
                            here = (gain, left)
                if here[0] > best[0] + 1e-10:
                    best = here
            return best

        leaves, heap, k = {0: np.arange(len(y))}, [], 0

        def offer(node):
            gain, left = split(leaves[node])
            if left is not None:
                heapq.heappush(heap, (-gain, node, left))

        offer(0)
        while heap and len(leaves) < B.MAX_LEAVES:
            _, node, left = heapq.heappop(heap)
            rows = leaves.pop(node)
            for part in (rows[left], rows[~left]):
                k += 1
                leaves[k] = part
                offer(k)
        for rows in leaves.values():
            raw[rows] -= B.LEARNING_RATE * g[rows].sum() / (h[rows].sum() + B.L2)
    return 1 / (1 + np.exp(-raw))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 700
    a, b, c = rng.integers(0, 6, n).astype(float), np.round(rng.normal(size=n), 1), rng.integers(0, 3, n).astype(float)
    z = 0.8 * (a > 2) - 1.2 * (b > 0.3) * (c == 1) + 0.9 * (np.arange(n) % 5 == 0)
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    null = np.arange(n) % 5 == 0                              # a missing b tells something
    out = [(k, float(a[k]), None if null[k] else float(b[k]), float(c[k]) if k % 7 else None, int(y[k])) for k in range(n)]
    return out


def test_equals_plain_boosting(spark, rows, monkeypatch):
    monkeypatch.setattr(B, "HELD_OUT_PERCENT", 0)
    monkeypatch.setattr(B, "ROUNDS_HELD", 2)                  # running scores are written between rounds
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(3)
    models = B.fit(df, {"two": ["a", "b"], "three": ["a", "b", "c"]}, "y", "id", max_iter=3)
    y = np.array([r[4] for r in rows], float)
    for name, columns in (("two", [1, 2]), ("three", [1, 2, 3])):
        codes = np.empty((len(rows), len(columns)), np.int64)
        for k, c in enumerate(columns):
            known = sorted({r[c] for r in rows if r[c] is not None})
            codes[:, k] = [B.MISSING if r[c] is None else known.index(r[c]) for r in rows]
        want = plain_boosting(codes, y, 3)
        got = {r["id"]: r["score"] for r in models[name].score(df).collect()}
        assert [got[k] for k in range(len(rows))] == pytest.approx(list(want), abs=1e-6)
        assert len(models[name].trees) == 3 and all(len(t.feature) <= 2 * B.MAX_LEAVES - 1 for t in models[name].trees)


def test_repeatable_and_stops_by_held_out_rows(spark):
    df = spark.range(600).select("id", (F.col("id") % 50).alias("x"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"))
    a = B.fit(df.repartition(1), {"m": ["x"]}, "y", "id")["m"]
    b = B.fit(df.repartition(4), {"m": ["x"]}, "y", "id")["m"]
    assert a.trees == b.trees and a.losses == b.losses and B.PATIENCE <= len(a.trees) < 500
    assert B.stopping_round(a.losses) == len(a.trees)
    assert a.score(df).where("score between 0 and 1").count() == 600


def test_stopping_round():
    assert B.stopping_round([5, 4, 4.1, *[3.9 - k / 100 for k in range(40)]]) is None
    assert B.stopping_round([5, 4, 3, *[3.5] * 30]) == 12 and B.stopping_round([1.0] * 10) is None


def test_bins(spark):
    """Few values have a bin each; many share equal-frequency bins; NULL has its own."""
    df = spark.createDataFrame([(float(k), float(k % 7), None) for k in range(2000)], "many double, few double, none double")
    edges = B.bin_edges(df, ["many", "few", "none"])
    assert edges["few"] == list(range(7)) and edges["none"] == [] and len(edges["many"]) == B.BINS
    codes = df.select("many", "few", B.binned(["many", "few", "none"], [edges[c] for c in ("many", "few", "none")]).alias("c")).collect()
    sizes = np.bincount([r["c"][0] for r in codes])
    assert sizes.max() <= 2 * sizes.min() and all(r["c"][1] == r["few"] and r["c"][2] == B.MISSING for r in codes)


def grown(rng, leaves, features):
    t = B.Tree()
    while t.feature.count(-1) < leaves:
        node = int(rng.choice([k for k, f in enumerate(t.feature) if f < 0]))
        t.split(node, int(rng.integers(features)), int(rng.integers(B.BINS)), bool(rng.integers(2)))
    t.value = list(rng.normal(size=len(t.feature)))
    return t


@pytest.mark.parametrize("leaves", [1, 2, 31, 32, 33, 64, 65, 90])
def test_leaves_by_tables_are_those_of_a_walk(leaves):
    rng = np.random.default_rng(leaves)
    codes = rng.integers(0, B.BINS + 1, (5, 4000)).astype(np.uint8)
    t = grown(rng, leaves, 5)
    assert np.array_equal(B.Leaves(t).of(codes), B.Leaves(t).walked(codes))


def test_a_pass_scores_only_rows_of_the_nodes_it_measures(spark, monkeypatch):
    """Pending trees are applied to the rows of wanted nodes, and blocks are cut and filled as rows come."""
    import pyarrow as pa

    monkeypatch.setattr(B, "BLOCK", 64)
    n = 500
    rows = pa.record_batch({"codes": pa.array([bytes([k % 200, k % 7]) for k in range(n)], pa.binary()), "y": pa.array([float(k % 2) for k in range(n)]), "held": pa.array([k % 5 == 0 for k in range(n)])})
    blocks = list(B.blocked(2, [0.25])(iter([rows.slice(0, 30), rows.slice(30, 300), rows.slice(330)])))
    assert [len(b.column("y")[0].as_buffer()) // 8 for b in blocks] == [64] * 7 + [52] and sum(b.column("held")[0].as_py() for b in blocks) == 100
    tree, seen = B.Tree(), []
    tree.split(0, 0, 9, True)                                   # rows of bin 0 to 9 of the first feature: 30 of 500, 24 not held out
    plain = B.summed
    monkeypatch.setattr(B, "summed", lambda trees, codes: seen.append(len(codes[0])) or plain(trees, codes))
    job = {"model": 0, "columns": [0, 1], "pending": [B.Tree()], "tree": tree, "wanted": [1], "judge": False}
    out = pa.Table.from_batches(B.measured([job], 2)(iter(blocks))).to_pandas()
    want = [k for k in range(n) if k % 200 <= 9 and k % 5]
    assert sum(seen) == len(want) and out[out.slot < B.BINS + 1].n.sum() == len(want)
    p = 1 / (1 + np.exp(-0.25))
    assert out[out.slot < B.BINS + 1].g.sum() == sum(int(np.rint((p - k % 2) * B.ONE)) for k in want)

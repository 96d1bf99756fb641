"""Leaf-wise histogram boosting (M10): gradient sums per (leaf, feature, bin), best-first growth, a learned side for NULL.

Values become bin numbers once: equal-frequency bins, or one bin a value where these are few; NULL is a bin of its own. A pass
over the binned rows sums gradients, Hessians and counts per (node, feature, bin). A task folds its rows to one such table
before the shuffle, so a pass moves and returns nodes x features x bins numbers, whatever the number of rows. Gradients are
fixed-point integers: sums do not depend on the order of rows, and a repeated or moved task gives the same trees.

Rows are kept as blocks, each feature of a block one run of bytes, so a pass reads a few arrays and no single rows. A row finds
its leaf by the splits of a tree taken together: for each feature and bin a table has the leaves that stay open, and of those open
in all tables the leftmost is the row's. Only rows of the nodes measured are scored.

Growth is best first, yet several leaves share a pass: the split of a node depends on its own rows alone, so each pass measures
all children that the best-first order, as known so far, would need, and the order is replayed until it needs no more. Of two
children only the smaller is measured, the other is the parent less its sibling. Models of several feature sets are grown in
the same passes. Rounds continue from the rows' running scores, which are written every few rounds; nothing is fitted twice.
The first pass of a round also gives the held-out loss of the rounds before it, which decides when to stop.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from erisk.operators import scan
from erisk.session import durable, ship_package

# The settings of the pilot's booster; a round without a gain of more than STOP_TOL for PATIENCE rounds ends it.
LEARNING_RATE, MAX_LEAVES, L2, MIN_LEAF_ROWS, HELD_OUT_PERCENT, PATIENCE, STOP_TOL = 0.05, 31, 1.0, 20, 15, 10, 1e-7
BINS, MISSING, MIN_HESSIAN = 255, 255, 1e-3
ONE = 2.0 ** 30        # fixed point: sums of 8 billion gradients fit 64 bits
BLOCK = 16_384         # rows of a block; sums of a block stay below 2^53
ROWS_A_TASK = 500_000  # a pass is short, and each task sends a table: fewer, fuller tasks, but one for each core
ROUNDS_HELD = 16       # trees applied in passing before the running scores are written


# ---- bins ---------------------------------------------------------------------

def bin_edges(df: DataFrame, features) -> dict[str, list[float]]:
    """The upper edge of each bin, exact: running counts of distinct values, no window over a whole column."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    long = df.select(F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)"))
    bounds = scan.value_bounds(long, ["value"])["value"]
    cells = scan.cells(long, ["feature"], "value", {"n": F.lit(1)}, bounds).withColumn("one", F.lit(1))
    ranked = scan.running(cells, ["feature"], "value", ["n", "one"])
    by_value = F.col("total_one") <= BINS
    number = F.when(by_value, F.col("before_one")).otherwise(F.floor(F.col("before_n") * BINS / F.col("total_n")))
    rows = ranked.groupBy("feature", number.alias("bin")).agg(F.max("value").alias("edge")).collect()    # features x bins
    return {c: sorted(r["edge"] for r in rows if r["feature"] == c) for c in features}


def binned(columns, edges: list[list[float]]) -> Column:
    """One byte per feature: the number of edges below the value; NULL is 255."""
    cut = [np.array(e[:-1], np.float64) for e in edges]

    @F.arrow_udf("binary")
    def codes(*values: pa.Array) -> pa.Array:
        out = np.empty((len(values[0]), len(values)), np.uint8)
        for k, v in enumerate(values):
            out[:, k] = np.searchsorted(cut[k], v.fill_null(0.0).to_numpy(zero_copy_only=False), "left")
            out[v.is_null().to_numpy(zero_copy_only=False), k] = MISSING
        return pa.array([row.tobytes() for row in out], pa.binary())
    return codes(*[F.col(c).cast("double") for c in columns])


# ---- trees --------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1. Rows of bin <= cut go left, NULL where `null_left` says."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    null_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, null_left: bool) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.null_left[node] = feature, cut, null_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for name, x in (("feature", -1), ("cut", 0), ("null_left", False), ("left", 0), ("right", 0), ("value", 0.0)):
                getattr(self, name).append(x)
        return self.left[node], self.right[node]


@dataclass
class Leaves:
    """The leaves of a tree from left to right; by feature, bits of the leaves still open at a bin (None: too many leaves for bits)."""
    tree: Tree
    leaves: list[int] = field(default_factory=list)
    tables: dict[int, np.ndarray] | None = field(default_factory=dict)

    def __post_init__(self):
        bits = np.uint32 if len(self.tree.feature) < 64 else np.uint64
        if len(self.tree.feature) >= 128:
            self.tables = None
            return
        every, todo, starts = int(np.iinfo(bits).max), [(0, False)], {}
        while todo:
            node, left_done = todo.pop()
            f = self.tree.feature[node]
            if f < 0:
                self.leaves.append(node)
            elif not left_done:
                starts[node] = len(self.leaves)
                todo += [(node, True), (self.tree.left[node], False)]
            else:
                right = np.arange(BINS + 1) > self.tree.cut[node]
                right[MISSING] = not self.tree.null_left[node]
                gone = (1 << len(self.leaves)) - (1 << starts[node])
                self.tables.setdefault(f, np.full(BINS + 1, every, bits))[right] &= bits(every ^ gone)
                todo.append((self.tree.right[node], False))

    def of(self, codes) -> np.ndarray:
        """The leaf of each row; codes are the bin numbers of each feature."""
        if self.tables is None:
            return self.walked(codes)
        still = None
        for f, table in self.tables.items():
            still = table[codes[f]] if still is None else np.bitwise_and(still, table[codes[f]], out=still)
        if still is None:
            return np.zeros(len(codes[0]), np.int64)
        lowest = (still & (~still + still.dtype.type(1))).astype(np.float64)
        return np.array(self.leaves)[(lowest.view(np.int64) >> 52) - 1023]

    def walked(self, codes) -> np.ndarray:
        t = self.tree
        feature, cut, null_left, left, right = (np.array(x) for x in (t.feature, t.cut, t.null_left, t.left, t.right))
        every = np.stack(codes)
        at, inner = np.zeros(every.shape[1], np.int64), np.arange(every.shape[1])
        while True:
            inner = inner[feature[at[inner]] >= 0]
            if not len(inner):
                return at
            node = at[inner]
            b = every[feature[node], inner]
            go_left = np.where(b == MISSING, null_left[node], b <= cut[node])
            at[inner] = np.where(go_left, left[node], right[node])


def summed(trees: list[Leaves], codes) -> np.ndarray:
    out = np.zeros(len(codes[0]))
    for t in trees:
        out += np.array(t.tree.value)[t.of(codes)]
    return out


def best_split(hist: np.ndarray) -> tuple[float, int, int, bool] | None:
    """Gain, feature, cut and side of NULL of a node's best split; hist is (feature, bin, [gradient, Hessian, rows])."""
    real, null = hist[:, :BINS].cumsum(axis=1), hist[:, MISSING]
    whole = real[:, -1] + null
    best = None
    for null_left in (False, True):
        low = real + null[:, None] if null_left else real
        high = whole[:, None] - low
        (gl, hl), (gr, hr) = ((x[..., 0] / ONE, x[..., 1] / ONE) for x in (low, high))
        g, h = whole[:, None, 0] / ONE, whole[:, None, 1] / ONE
        gain = gl * gl / (hl + L2) + gr * gr / (hr + L2) - g * g / (h + L2)
        fits = (low[..., 2] >= MIN_LEAF_ROWS) & (high[..., 2] >= MIN_LEAF_ROWS) & (hl >= MIN_HESSIAN) & (hr >= MIN_HESSIAN)
        gain = np.where(fits, gain, 0.0)
        k = int(gain.argmax())
        f, cut = divmod(k, gain.shape[1])
        if gain[f, cut] > 1e-12 and (best is None or gain[f, cut] > best[0]):
            side = null_left if null[f, 2] else bool(low[f, cut, 2] > high[f, cut, 2])     # no NULL seen: the larger side
            best = (float(gain[f, cut]), f, cut, side)
    return best


class Growth:
    """One tree while it grows: the measured nodes and the replay of the best-first order."""

    def __init__(self):
        self.tree, self.hist, self.best, self.parent = Tree(), {}, {}, {0: None}
        self.wanted = [0]

    def take(self, measured: dict[int, np.ndarray]) -> None:
        for node, hist in measured.items():
            self.hist[node] = hist
            up = self.parent[node]
            if up is not None:
                other = self.tree.left[up] + self.tree.right[up] - node
                self.hist[other] = self.hist[up] - hist
        for node in self.hist:
            if node not in self.best:
                self.best[node] = best_split(self.hist[node])

    def replay(self) -> list[int]:
        """Split in order of gain; returns the nodes that were split. `wanted`: smaller children not measured yet."""
        heap, chosen, self.wanted = [], [], []

        def offer(node: int) -> None:
            if self.best[node] is not None:
                heapq.heappush(heap, (-self.best[node][0], node))

        offer(0)
        while heap and len(chosen) < MAX_LEAVES - 1:
            _, node = heapq.heappop(heap)
            chosen.append(node)
            if self.tree.feature[node] < 0:
                _, f, cut, side = self.best[node]
                for child in self.tree.split(node, f, cut, side):
                    self.parent[child] = node
            low, high = self.tree.left[node], self.tree.right[node]
            if low in self.hist:
                offer(low)
                offer(high)
            elif len(chosen) < MAX_LEAVES - 1:
                self.wanted.append(self.smaller(node, low, high))
        return chosen

    def smaller(self, node: int, low: int, high: int) -> int:
        _, f, cut, side = self.best[node]
        rows = self.hist[node][f, :, 2]
        left = rows[:cut + 1].sum() + (rows[MISSING] if side else 0)
        return low if 2 * left <= rows.sum() else high

    def finished(self, chosen: list[int]) -> Tree:
        """The tree of the nodes that were split, with the leaves' values."""
        out, number = Tree(), {0: 0}
        for node in chosen:
            low, high = out.split(number[node], self.tree.feature[node], self.tree.cut[node], self.tree.null_left[node])
            number[self.tree.left[node]], number[self.tree.right[node]] = low, high
            # a child's totals follow from the split of its parent
        for node, k in number.items():
            if out.feature[k] < 0:
                g, h = self.totals(node)
                out.value[k] = -LEARNING_RATE * g / (h + L2)
        return out

    def totals(self, node: int) -> tuple[float, float]:
        if node in self.hist:
            g, h, _ = self.hist[node][0].sum(axis=0) / ONE
            return g, h
        up = self.parent[node]
        _, f, cut, side = self.best[up]
        own = self.hist[up][f]
        left = own[:cut + 1].sum(axis=0) + (own[MISSING] if side else 0)
        g, h, _ = (left if node == self.tree.left[up] else own.sum(axis=0) - left) / ONE
        return g, h


# ---- passes -------------------------------------------------------------------

SUMS = "model int, node int, slot int, g bigint, h bigint, n bigint"
LOSS = -1


BLOCKS = "codes binary, y binary, raw binary, held int"


def blocked(width: int, starts: list[float]):
    """Rows as blocks: bin numbers by feature, outcomes, and running scores by model; held-out rows first, and their number."""
    schema = pa.schema([("codes", pa.binary()), ("y", pa.binary()), ("raw", pa.binary()), ("held", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            held = rows.column("held").to_numpy()
            order = np.argsort(~held, kind="stable")
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(held), width)[order].T
            raw = np.repeat(np.array(starts, np.float64), len(held))
            return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([rows.column("y").to_numpy()[order].astype(np.float64).tobytes()], pa.binary()),
                                               pa.array([raw.tobytes()], pa.binary()), pa.array([int(held.sum())], pa.int32())], schema=schema)

        for b in batches:
            waiting.append(b)
            n += b.num_rows
            if n >= BLOCK:
                rows = pa.Table.from_batches(waiting)
                for k in range(0, n - BLOCK + 1, BLOCK):
                    yield block(rows.slice(k, BLOCK))
                waiting = rows.slice(n - n % BLOCK).to_batches()
                n %= BLOCK
        if n:
            yield block(pa.Table.from_batches(waiting))
    return run


def arrays(b: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each block: bin numbers (feature, row), running scores (model, row), and its place in the batch."""
    for i in range(b.num_rows):
        codes = np.frombuffer(b.column("codes")[i].as_buffer(), np.uint8).reshape(width, -1)
        yield codes, np.frombuffer(b.column("raw")[i].as_buffer(), np.float64).reshape(-1, codes.shape[1]), i


def measured(jobs: list[dict], width: int):
    """Sums of one task's rows for each job: (columns, trees not yet in the running score, growing tree, wanted nodes)."""
    schema = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("slot", pa.int32()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((3, len(j["columns"]), len(j["wanted"]) * (BINS + 1)), np.int64) for j in jobs]
        loss = np.zeros((len(jobs), 2), np.int64)
        pending, growing = [[Leaves(t) for t in j["pending"]] for j in jobs], [Leaves(j["tree"]) for j in jobs]
        for b in batches:
            for every, raws, i in arrays(b, width):
                y, held = np.frombuffer(b.column("y")[i].as_buffer(), np.float64), b.column("held")[i].as_py()
                for k, j in enumerate(jobs):
                    if j["judge"] and held:
                        z, t = raws[j["model"], :held] + summed(pending[k], [every[c, :held] for c in j["columns"]]), y[:held]
                        loss[k] += np.rint((np.logaddexp(0, z) - t * z) * ONE).astype(np.int64).sum(), len(z)
                    if held == len(y):
                        continue
                    codes, raw, t = [every[c, held:] for c in j["columns"]], raws[j["model"], held:], y[held:]
                    place = np.full(len(j["tree"].feature), -1)
                    place[j["wanted"]] = np.arange(len(j["wanted"]))
                    own = place[growing[k].of(codes)]
                    use = np.flatnonzero(own >= 0)
                    if len(use) < len(own):
                        codes, raw, t, own = [c[use] for c in codes], raw[use], t[use], own[use]
                    p = 1 / (1 + np.exp(-(raw + summed(pending[k], codes))))
                    g, h = np.rint((p - t) * ONE), np.rint(p * (1 - p) * ONE)     # whole numbers below 2^53: sums of a block are exact
                    first = own * (BINS + 1)
                    for f, c in enumerate(codes):
                        slot = first + c
                        for out, x in zip(total[k][:, f], (g, h, None), strict=True):
                            out += np.bincount(slot, x, len(out)).astype(np.int64)
        for k, j in enumerate(jobs):
            f, w, b = np.nonzero(total[k][2].reshape(len(j["columns"]), len(j["wanted"]), BINS + 1))
            node = np.array(j["wanted"], np.int32)[w]
            sums = total[k][:, f, w * (BINS + 1) + b].T
            if j["judge"]:
                node, f, b = np.append(node, LOSS), np.append(f, 0), np.append(b, 0)
                sums = np.concatenate([sums, [[loss[k, 0], 0, loss[k, 1]]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), j["model"]), pa.int32()), pa.array(node, pa.int32()), pa.array(f * (BINS + 1) + b, pa.int32()),
                                              *(pa.array(sums[:, c], pa.int64()) for c in range(3))], schema=schema)
    return run


def totals(rows: DataFrame, jobs: list[dict], width: int) -> tuple[dict[int, dict[int, np.ndarray]], dict[int, tuple[int, int]]]:
    """Histograms by model and node, and held-out losses by model, over all rows."""
    found = rows.mapInArrow(measured(jobs, width), SUMS).groupBy("model", "node", "slot").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()       # nodes x features x bins rows
    model, node, slot, g, h, n = (found.column(c).to_numpy() for c in ("model", "node", "slot", "g", "h", "n"))
    hists, losses = {}, {}
    for j in jobs:
        own = model == j["model"]
        hists[j["model"]] = {}
        for w in j["wanted"]:
            at = own & (node == w)
            hist = np.zeros((len(j["columns"]) * (BINS + 1), 3), np.int64)
            hist[slot[at]] = np.stack([g[at], h[at], n[at]], 1)
            hists[j["model"]][w] = hist.reshape(len(j["columns"]), BINS + 1, 3)
        at = np.flatnonzero(own & (node == LOSS))
        if len(at):
            losses[j["model"]] = int(g[at[0]]), int(n[at[0]])
    return hists, losses


def stopping_round(losses, patience: int = PATIENCE, tol: float = STOP_TOL) -> int | None:
    """The first round after which none of the last ``patience`` losses is below the loss before them; losses[0] is of no round."""
    for k in range(patience, len(losses)):
        if min(losses[k - patience + 1:k + 1]) >= losses[k - patience] - tol:
            return k
    return None


@dataclass
class Booster:
    features: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree]
    losses: list[float]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``score``, the probability of the outcome."""
        ship_package(df.sparkSession)
        cut, trees, start = [np.array(e[:-1], np.float64) for e in self.edges], [Leaves(t) for t in self.trees], self.start

        @F.arrow_udf("double")
        def probability(*values: pa.Array) -> pa.Array:
            codes = np.empty((len(values), len(values[0])), np.uint8)
            for k, v in enumerate(values):
                codes[k] = np.searchsorted(cut[k], v.fill_null(0.0).to_numpy(zero_copy_only=False), "left")
                codes[k, v.is_null().to_numpy(zero_copy_only=False)] = MISSING
            return pa.array(1 / (1 + np.exp(-(start + summed(trees, codes)))), pa.float64())
        return df.withColumn("score", probability(*[F.col(c).cast("double") for c in self.features]))


def fit(train: DataFrame, sets: dict[str, list[str]], label: str, key: str, max_iter: int = 500, seed: int = 0) -> dict[str, Booster]:
    """One booster per set of features, grown in common passes. A hash of the key holds rows out for stopping; without such
    rows max_iter rounds are fitted. Rows without an outcome are left out."""
    spark = train.sparkSession
    ship_package(spark)
    names = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    known = train.where(F.col(label).isNotNull())
    edges = bin_edges(known, names)
    held = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(100)) < HELD_OUT_PERCENT
    rows = known.select(binned(names, [edges[c] for c in names]).alias("codes"), F.col(label).cast("double").alias("y"),
                        F.coalesce(held, F.lit(False)).alias("held"))
    first = rows.where("NOT held").agg(F.avg("y"), F.count("*")).first()
    rate = min(max(first[0] if first[1] else 0.5, 1e-6), 1 - 1e-6)
    start = math.log(rate / (1 - rate))
    models = {name: Booster(list(c), [edges[x] for x in c], start, [], []) for name, c in sets.items()}
    tasks = max(1, -(-first[1] // ROWS_A_TASK), min(spark.sparkContext.defaultParallelism, -(-first[1] // BLOCK)))
    rows = durable(rows.repartition(tasks).mapInArrow(blocked(len(names), [start] * len(sets)), BLOCKS))
    place = {c: k for k, c in enumerate(names)}
    columns = [[place[c] for c in m.features] for m in models.values()]
    pending: list[list[Tree]] = [[] for _ in models]
    active = [(k, m) for k, m in enumerate(models.values())]
    while active:
        growths = {k: Growth() for k, _ in active}
        judge, grown = True, {}
        while growths:
            jobs = [{"model": k, "columns": columns[k], "pending": pending[k], "tree": g.tree, "wanted": g.wanted, "judge": judge} for k, g in growths.items()]
            hists, losses = totals(rows, jobs, len(names))
            for k, m in active:
                if judge and losses[k][1]:
                    m.losses.append(losses[k][0] / ONE / losses[k][1])
            if judge:
                done = {k for k, m in active if stopping_round(m.losses) or len(m.trees) >= max_iter}
                active = [(k, m) for k, m in active if k not in done]
                growths = {k: g for k, g in growths.items() if k not in done}
                judge = False
            for k, g in list(growths.items()):
                g.take(hists[k])
                chosen = g.replay()
                if not g.wanted:
                    grown[k] = g.finished(chosen)
                    del growths[k]
        for k, m in active:
            m.trees.append(grown[k])
            pending[k].append(grown[k])
        if active and max(map(len, pending)) >= ROUNDS_HELD:
            rows = durable(advanced(rows, columns, pending, len(names)))
            pending = [[] for _ in models]
    return models


def advanced(rows: DataFrame, columns: list[list[int]], pending: list[list[Tree]], width: int) -> DataFrame:
    """The blocks with the pending trees added to their running scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [[Leaves(t) for t in p] for p in pending]
        for b in batches:
            raw = [np.stack([raws[k] + summed(trees[k], [codes[c] for c in columns[k]]) for k in range(len(trees))]).tobytes() for codes, raws, _ in arrays(b, width)]
            yield b.set_column(b.schema.get_field_index("raw"), "raw", pa.array(raw, pa.binary()))
    return rows.mapInArrow(run, BLOCKS)

"""Fingerprints bit by bit, links and components against all pairs, at every depth of the search."""
import random
import re

import numpy as np
import pytest
import xxhash

from erisk.llm import hot, simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, distance=3):
    """The least index that links lead to, for each fingerprint."""
    fp, seen, label = np.array(fps, np.uint64), np.zeros(len(fps), bool), [0] * len(fps)
    for i in range(len(fps)):
        stack = [] if seen[i] else [i]
        while stack:
            x = stack.pop()
            if not seen[x]:
                seen[x], label[x] = True, i
                stack += np.flatnonzero((np.bitwise_count(fp ^ fp[x]) <= distance) & ~seen).tolist()
    return label


@pytest.mark.parametrize("limit", [1024, 8, 2])
def test_components_against_all_pairs(spark, limit):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(50):
            x = centre
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    rng.shuffle(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(fps)], "fp long, doc_id long")
    edges = simhash.Links(nodes, 3, limit).edges.collect()
    assert all((((e["a"] ^ e["b"]) & ((1 << 64) - 1)).bit_count()) <= 3 for e in edges)
    root = {r["c"]: r["root"] for r in hot.components(spark.createDataFrame([(e["a_id"], e["b_id"]) for e in edges], "u long, v long")).collect()}
    assert [root.get(k, k) for k in range(len(fps))] == classes(fps)


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_every_near_pair_is_a_candidate(distance):
    """Of any two fingerprints within the distance some mask of each depth leaves equal bits."""
    rng = random.Random(distance)
    own = [simhash.masks(distance, depth) for depth in (1, 2, 3)]
    for _ in range(150):
        x = 0
        for _ in range(distance):
            x |= 1 << rng.randrange(64)
        assert all(any(x & m == 0 for chain in depth for m in chain) for depth in own)


def test_documents(documents, hard_texts, prose):
    rng, rows = random.Random(5), []
    for base in range(8):
        words = prose(base, rng.randrange(20, 400)).split()
        for _ in range(6):
            new = list(words)
            new[rng.randrange(len(new))] = "Changed"
            rows.append((len(rows), "\t".join(new) if rng.random() < .3 else " ".join(new).upper()))
    rows += [(500 + k, t) for k, t in enumerate(hard_texts)] + [(None, "only here, without a number"), (None, None), (3, rows[3][1]), (3, rows[3][1])]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain_fingerprint(t) for _, t in order]
    want = sorted(((k, f"{f:016x}", order[c][0]) for (k, _), f, c in zip(order, fps, classes(fps), strict=True)), key=str)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.deduplicated(documents(rows)).collect()), key=str)
    assert got == want and ("0" * 16) in {f for _, f, _ in got}
    assert simhash.deduplicated(documents([])).count() == 0


def test_hot_join(spark, monkeypatch):
    """Hot keys take the broadcast, others Spark's join, and the rows are those of a plain join."""
    monkeypatch.setattr(hot, "ROWS", 20)
    left = spark.createDataFrame([(k % 7 if k % 2 else 100, k) for k in range(300)] + [(None, 1)], "key long, x long")
    right = left.filter("key IS NOT NULL AND key <> 3").groupBy("key").count().withColumnRenamed("count", "w").withColumn("y", simhash.F.col("key") * 2)
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right.drop("w"), "key", how).collect()), key=str)
        assert sorted(map(tuple, hot.hot_join(left, right, "key", "w", how).collect()), key=str) == want


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(hot, "ROWS", 10)
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    got = {r["c"]: r["root"] for r in hot.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 200)} | {k: 1000 for k in range(1001, 1041)} or got == {k: 0 for k in range(200)} | {k: 1000 for k in range(1000, 1041)}

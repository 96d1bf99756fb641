"""The join against all pairs, on planted copies of many degrees."""
import random

import numpy as np
import pytest

from erisk.llm import jaccard


def sets(text):
    words = text.lower().split() if text else []
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, similarity=0.8):
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if own[i] and own[j] and len(own[i] & own[j]) >= similarity * len(own[i] | own[j]):
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return sorted(((k is None, k or 0, least[find(i)] if own[i] else k, links[i]) for i, (k, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(prose):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = prose(base, rng.randrange(6, 150)).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randrange(8)):
            new = list(words)
            for _ in range(rng.randrange(5)):
                new[rng.randrange(len(new))] = f"changed{rng.random()}"
            rows.append((len(rows), " ".join(new)))
    return rows


def test_against_all_pairs(documents, corpus):
    assert got(jaccard.joined(documents(corpus))) == brute(corpus)


def test_large_groups_in_blocks(spark, documents, prose):
    """A group far larger than a block is dealt over blocks, and no pair is lost or counted twice."""
    words = prose("hot", 120).split()
    rows = [(k, " ".join([*words[:60], f"own{k}", *words[61:]])) for k in range(45)] + [(100 + k, " ".join(words)) for k in range(7)]
    found = jaccard.Join(documents(rows), block=8).documents()
    assert got(found) == brute(rows)
    found = jaccard.Join(documents(rows), block_shingles=900).documents()        # the length of texts bounds a block too
    assert got(found) == brute(rows)


def test_hard_cases(documents, hard_texts, prose):
    rows = [(k, t) for k, t in enumerate(hard_texts)] + [(5, hard_texts[5]), (None, hard_texts[6]), (None, prose("alone", 30)), (90, "a b"), (91, "A  b")]
    assert got(jaccard.joined(documents(rows))) == brute(rows)
    assert jaccard.joined(documents([])).count() == 0


def test_one_of_each(documents, corpus, hard_texts):
    rows = corpus + [(500 + k, t) for k, t in enumerate(hard_texts)] + [corpus[0], corpus[0], (None, corpus[0][1])]
    table = documents(rows)
    left = jaccard.one_of_each(table)
    assert left.columns == table.columns
    ids = [r["doc_id"] for r in left.collect()]
    classes = brute(rows)
    want = sorted({c for null, k, c, n in classes if n} | {k for null, k, c, n in classes if not n})
    assert sorted(ids) == want
    assert jaccard.one_of_each(documents([])).count() == 0


def test_depth():
    assert jaccard.depth_for(0.8, 0.999, 12, 6) == 3 and jaccard.depth_for(0.8, 0.97, 12, 6) == 6


def test_recall_of_the_forest_at_the_threshold():
    """Pairs of sets exactly at 0.8 share a prefix in some tree nearly always."""
    rng, found = np.random.default_rng(1), 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, 110, np.uint64))[:100]
        a, b = x[:90], np.concatenate([x[:80], x[90:]])
        ka, kb = (jaccard.forest_keys(s, 12, 3, 6) for s in (a, b))
        found += bool((ka == kb).any())
    assert found >= 297


def test_components(spark):
    edges = [(b"a", b"b"), (b"b", b"c"), (b"x", b"y"), (b"c", b"d"), (b"y", b"y"), (b"q", b"d")] + [(f"n{k:03}".encode(), f"n{k + 1:03}".encode()) for k in range(40)]
    out = {bytes(r["c"]): bytes(r["root"]) for r in jaccard.components(spark.createDataFrame(edges, "c binary, other binary")).collect()}
    assert all(out[k] == b"a" for k in (b"b", b"c", b"d", b"q")) and out[b"y"] == b"x" and out[b"n040"] == b"n000"


def test_a_pair_belongs_to_one_group(prose):
    """Whatever its longest common prefix, a pair is owned at one depth by one tree."""
    rng, trees, least, full = np.random.default_rng(3), 16, 4, 6
    for _ in range(40):
        x = np.unique(rng.integers(0, 1 << 63, 130, np.uint64))[:120]
        k = int(rng.integers(2, 20))
        a, b = (jaccard.forest_keys(s, trees, least, full).reshape(-1, trees) for s in (x[:100], x[k:100 + k]))
        owned = 0
        for depth in range(full, least - 1, -1):
            now = np.stack([a[depth - least], b[depth - least]])
            deeper = np.stack([a[depth - least + 1], b[depth - least + 1]]) if depth < full else np.zeros((2, 0), np.int64)
            for tree in range(trees):
                if now[0, tree] == now[1, tree]:
                    owned += int(jaccard.own_pairs(now, deeper, np.array([True, False]), np.zeros(2, int), tree, 0, 0)[0, 1])
        assert owned == int((a[0] == b[0]).any())


def test_only_classes_that_ask_open_pairs():
    now, none = np.ones((3, 4), np.int64), np.zeros((3, 0), np.int64)
    pair = jaccard.own_pairs(now, none, np.array([False, False, True]), np.zeros(3, int), 0, 0, 0)
    assert pair.tolist() == [[False, False, True], [False, False, True], [False, False, False]]


def test_recall_and_shortening(spark, documents, prose):
    """Links of every degree from the threshold up, most near it: at least 0.99 of them are found, none is false."""
    rng, rows = random.Random(8), []
    for base in range(140):
        words = prose(("r", base), 130).split()
        rows.append((len(rows), " ".join(words)))
        for copy in range(4):
            new = list(words)
            for k in range(rng.choice([1, 2, 2, 3])):
                new[rng.randrange(10, 120)] = f"new{base} {copy} {k}".replace(" ", "x")
            rows.append((len(rows), " ".join(new)))
    want, found = brute(rows), got(jaccard.joined(documents(rows)))
    links = sum(n for *_, n in want)
    assert links > 1000
    assert all(n <= m for (*_, n), (*_, m) in zip(found, want, strict=True))
    assert sum(n for *_, n in found) >= 0.99 * links


def test_pairs_exactly_at_the_threshold():
    """112 shingles of 140 are 0.8 and a link, whatever single precision makes of 112 * 1.8."""
    for n in range(5, 400, 5):
        x = np.arange(n, dtype=np.uint64)
        a, b = x[:n - n // 10], np.concatenate([x[:n - n // 5], x[n - n // 10:]])
        for sets in ([a, b], [a, b, a]):
            both = jaccard.intersections(sets)
            assert both.dtype == np.int64 and both[0, 1] == len(np.intersect1d(a, b))

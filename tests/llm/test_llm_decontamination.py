"""Hits against a plain search for every window, for one and several blocks of the benchmark."""
import hashlib
import random
import re

import numpy as np

from erisk.llm import decontamination as d


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text, items):
    own, hit, names = plain_words(text), set(), set()
    for key, item in items:
        words = plain_words(item)
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            for at in range(len(own) - n + 1):
                if own[at:at + n] == words[k:k + n]:
                    hit |= set(range(at, at + n))
                    names |= {key} - {None}
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit)


def rows_of(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def case(prose, hard_texts):
    items = [(k, prose(("item", k), 8 + 3 * k)) for k in range(9)] + [(20, prose(("item", 5), 23)), (21, ""), (22, None), (None, prose("null", 12)), (23, "ÜBER das 9 é")]
    docs = []
    for k in range(30):
        item = prose(("item", k % 9), 8 + 3 * (k % 9)).split()
        start = k % 3
        docs.append((k, f"{prose(('d', k), 20)} {' '.join(item[start:]).upper() if k % 2 else '; '.join(item[start:])}\n{prose(('e', k), 5)}"))
    docs += [(100 + k, t) for k, t in enumerate(hard_texts)] + [(None, prose("null", 12)), (3, docs[3][1]), (200, "x über das 9 é über das 9 é")]
    return docs, items


def test_contamination(spark, documents, prose, hard_texts):
    docs, items = case(prose, hard_texts)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string")
    want = sorted((str(k), *plain(t, items)) for k, t in docs)
    assert rows_of(d.contamination(documents(docs), bench)) == want
    assert rows_of(d.contamination(documents(docs), bench, block_bytes=300)) == want      # several blocks
    clean = d.clean_documents(documents(docs), bench)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(k) for k, t in docs if not plain(t, items)[-1])


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(documents([]), none).count() == 0
    assert rows_of(d.contamination(documents([(1, "a b")]), none))[0][1:4] == (2, 0, 0)


def test_suffix_array_and_longest(prose):
    rng = random.Random(2)
    t = np.array([rng.randrange(4) for _ in range(300)], np.int64)
    sa = d.suffix_array(t, 8)
    assert sorted(sa.tolist()) == np.flatnonzero(t).tolist()
    cut = lambda k: [x if x else -1 for x in t[k:k + 8].tolist()]
    assert all(cut(a) <= cut(b) for a, b in zip(sa, sa[1:], strict=False) if 0 not in t[a:a + 8] and 0 not in t[b:b + 8])
    test = d.TestSuffixes.of([(1, prose("long", 50))], 10)
    v = d.shard_verdicts([f"a {' '.join(prose('long', 50).split()[5:42])} b", "none"], test, None).to_pylist()
    assert [x["longest"] for x in v] == [37, 0]


def plain_longest(text, items):
    """The most words from a hit place on that stand in one item."""
    own, best, bench = plain_words(text), 0, [plain_words(t) for _, t in items]
    for at in range(len(own)):
        if any(own[at:at + min(10, len(w))] == w[k:k + min(10, len(w))] for w in bench if w for k in range(len(w) - min(10, len(w)) + 1)):
            for w in bench:
                for k in range(len(w)):
                    n = 0
                    while k + n < len(w) and at + n < len(own) and w[k + n] == own[at + n]:
                        n += 1
                    best = max(best, n)
    return best


def test_repetitive_texts_against_plain_search():
    """Few different words, so windows repeat within items, between items and within texts."""
    rng = random.Random(4)
    for size in (1, 2, 3):
        draw = lambda n: " ".join(rng.choice("abc"[:size]) for _ in range(n))
        items = [(k, draw(rng.choice([0, 1, 4, 9, 10, 11, 30, 60]))) for k in range(5)] + [(None, draw(25))]
        docs = [f"{draw(rng.randrange(40))} stop {draw(rng.randrange(60))}" for _ in range(12)] + ["", None, "stop"]
        got = d.shard_verdicts(docs, d.TestSuffixes.of(items, 10), None).to_pylist()
        for text, v in zip(docs, got, strict=True):
            n, hit, named, _, _ = plain(text, items)
            assert (v["n_words"], sum(s["end"] - s["start"] for s in v["spans"]), len(v["items"])) == (n, hit, named)
            assert v["longest"] == plain_longest(text, items)


def test_long_repetitions_stay_linear():
    """20,000 equal words against 20,000: one window, a place at most once."""
    test = d.TestSuffixes.of([(1, "same " * 20_000), (2, "same " * 5_000)], 10)
    assert len(test.start) == 1
    v = d.shard_verdicts(["same " * 20_000, "same " * 30_000 + "end"], test, None).to_pylist()
    assert [x["longest"] for x in v] == [20_000, 20_000] and [x["items"] for x in v] == [[1, 2], [1, 2]]
    assert [x["spans"] for x in v] == [[{"start": 0, "end": 20_000}], [{"start": 0, "end": 30_000}]]

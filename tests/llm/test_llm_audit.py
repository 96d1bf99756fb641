"""The transducer against plain counting, and the audit against a replay of every order, document by document."""
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from erisk.llm import audit


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(w), len(set(w)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_transducer(block, hard_texts):
    rng = random.Random(1)
    texts = hard_texts + ["a" * 1000 + " " + "a" * 1000 + " " + "a" * 999 + "b"] if block > 7 else hard_texts[:4] + hard_texts[5:]
    texts = texts + ["".join(rng.choice(["a", "B", "é", "日", " ", "\n", "\t", "#", "\U0001f600", "x", "\x0b", "|", "Z", "\x1c", "\x85"])
                             for _ in range(rng.randrange(300))) for _ in range(200)]
    got = audit.transduce(pa.array(texts, pa.string()), block)
    assert list(zip(*(got[c].tolist() for c in audit.COUNTS), strict=True)) == [plain(t) for t in texts]
    sliced = audit.transduce(pa.array(texts, pa.string())[3:50], block)
    assert list(zip(*(sliced[c].tolist() for c in audit.COUNTS), strict=True)) == [plain(t) for t in texts[3:50]]


def test_table_survives_equal_hashes(monkeypatch):
    """With one hash for all words the byte check alone tells them apart."""
    monkeypatch.setattr(audit.Spans, "hashed", lambda self: np.full(len(self.start), 5, np.uint64))
    texts = [" ".join(f"w{k % 9}" for k in range(60)), "a a b", None]
    assert audit.transduce(pa.array(texts))["n_distinct"].tolist() == [9, 2, 0]


def replay(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    least = {}
    for k, t, *_ in rows:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    docs = []
    for k, t, lang in rows:
        n, distinct, capitals, chars, symbols = plain(t)
        fails = {f for f, bad in zip("ABCDE", (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * chars, symbols > 0,
                                               k is not None and k > least[t or ""]), strict=True) if bad}
        docs.append((lang or "", k, fails))
    out, removed_by = {}, {}
    for order in itertools.permutations("ABCDE"):
        for part in {p for p, _, _ in docs}:
            own = [(k, f) for p, k, f in docs if p == part]
            left = own
            for step, x in enumerate(order, 1):
                hit = [(k, f) for k, f in left if x in f]
                left = [d for d in left if x not in d[1]]
                removed_by[part, x] = removed_by.get((part, x), 0) + len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), sum(x in f for _, f in own) - len(hit), sum(f == {x} for _, f in own),
                                                   sum(k in good for k, _ in hit), sum(k in toxic for k, _ in hit), x]
    return {k: (*v[:-1], removed_by[k[0], v[-1]]) for k, v in out.items()}


def test_audit(spark, documents, hard_texts, prose):
    long = prose("audit", 250)
    texts = hard_texts + [long, long, long + " # ", long.upper(), "x y " * 150, long, "a " * 220, None, "A$" * 40]
    rows = [(k, t, ["en", "de", None, ""][k % 4]) for k, t in enumerate(texts)] + [(None, "", "en"), (None, long, "en"), (3, "word", "de"), (3, "word", "de")]
    marks = [(k, k % 3 % 2, int(k % 5 == 0)) for k in range(0, 16, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"],
                                                        r["toxic_lost"], r["shapley"]) for r in audit.audited(documents(rows), labels).collect()}
    assert got == replay(rows, marks) and len(got) == 3 * 600
    assert audit.audited(documents([]), labels).count() == 0
    assert audit.audited(documents(rows[:2]), labels.limit(0)).count() == 1200

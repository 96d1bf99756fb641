"""Held-out accuracy of the two trained models, their arithmetic, and the defined cases."""
import math
import zlib

import numpy as np

from erisk.llm import classifier, language


def fold(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def test_classifier(spark, documents, prose, hard_texts):
    good = [(k, prose(k, 20 + 13 * k % 200)) for k in range(400)]
    bad = [(1000 + k, prose(k, 60).upper() if k % 2 else " ".join(w + "$$" for w in prose(k, 50).split())) for k in range(200)]
    hard = [(5000 + k, t) for k, t in enumerate(hard_texts)] + [(None, "null id"), (7, good[7][1])]
    table = documents(good + bad + hard)
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad] + [(None, 1, 0), (9999, None, None), (5, 1, 1)], "doc_id long, quality int, text int")
    got = classifier.scored(table, labels).collect()
    assert len(got) == len(good) + len(bad) + len(hard) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"])) for r in got)
    out = [(r["predicted"], r["doc_id"] < 1000) for r in got if r["held_out"] and r["doc_id"] < 2000]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[5000] == scores[5001] == scores[5002]
    left = classifier.accepted(table, labels)
    assert left.columns == table.columns and left.count() == sum(r["predicted"] for r in got)


def test_classifier_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert classifier.scored(documents([(1, "a")]), none).first()["score"] == 0.5
    one = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert classifier.scored(documents([(1, "a"), (2, "b")]), one).first()["predicted"] == 1
    assert classifier.scored(documents([]), one).count() == 0


def test_bound_of_the_sample(spark, documents):
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, quality int")
    x, y = classifier.training_rows(documents([(k, f"t {k}") for k in range(300)] * 2), labels, 50)
    assert len(x) == len(y) == 50


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(classifier.FEATURES)))
    p = 1 / (1 + np.exp(-(x[:, 0] + 3 * np.sign(x[:, 1] * x[:, 2]))))
    y = (rng.random(3000) < p).astype(float)
    model = classifier.AdditiveModel(y.mean()).fit(x, y)
    assert (1, 2) in [(i, j) for i, j, _ in model.pairs]
    row = x[:1]
    f = model.base + sum(t[np.searchsorted(c, row[0, j], side="right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
    for i, j, t in model.pairs:
        f += t[np.searchsorted(model.coarse[i], row[0, i], side="right"), np.searchsorted(model.coarse[j], row[0, j], side="right")]
    assert np.isclose(model.score(row)[0], 1 / (1 + np.exp(-f)))
    fresh = rng.normal(size=(2000, x.shape[1]))
    assert np.mean((model.score(fresh) > 0.5) == (fresh[:, 0] + 3 * np.sign(fresh[:, 1] * fresh[:, 2]) > 0)) > 0.9


def plain_boosting(x, y, rounds, pair_rounds, n_pairs, bins, wide):
    """Scores of the rows themselves by cyclic boosting, with sums over rows instead of tables."""
    n, width = len(x), len(x[0])

    def cuts(j, k):
        v = sorted(row[j] for row in x)
        at = [(n - 1) * q / k for q in range(1, k)]
        return [v[int(p)] + (v[int(p) + 1] - v[int(p)]) * (p - int(p)) for p in at]

    def bin_of(j, k):
        edges = cuts(j, k)
        return [sum(row[j] >= c for c in edges) for row in x]

    fine, coarse = [bin_of(j, bins) for j in range(width)], [bin_of(j, wide) for j in range(width)]
    prior = sum(y) / n
    f = [math.log(prior / (1 - prior))] * n

    def slopes():
        p = [1 / (1 + math.exp(-v)) for v in f]
        return [b - a for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]

    def leaf(rows, g, h):
        return sum(g[r] for r in rows) / (sum(h[r] for r in rows) + 1)

    def explained(rows, g, h):
        return sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + 1)

    def halves(rows, at, g, h):
        """The cut that explains most; None if one bin holds all rows."""
        options = [([r for r in rows if at[r] < c], [r for r in rows if at[r] >= c]) for c in sorted({at[r] for r in rows})[1:]]
        return max(options, key=lambda o: explained(o[0], g, h) + explained(o[1], g, h), default=None)

    def tree(rows, at, g, h, depth):
        cut = halves(rows, at, g, h) if depth else None
        if cut is None:
            return dict.fromkeys(rows, leaf(rows, g, h))
        return tree(cut[0], at, g, h, depth - 1) | tree(cut[1], at, g, h, depth - 1)

    def two_way(i, j, g, h):
        found = []
        for first, second in ((coarse[i], coarse[j]), (coarse[j], coarse[i])):
            sides = halves(range(n), first, g, h)
            steps = {r: v for side in sides for r, v in tree(side, second, g, h, 1).items()}
            found.append((sum(steps[r] * g[r] for r in steps), steps))
        return found[1][1] if found[1][0] > found[0][0] + 1e-12 else found[0][1]

    for _ in range(rounds):
        for j in range(width):
            for r, v in tree(range(n), fine[j], *slopes(), 2).items():
                f[r] += 0.1 * v
    g, h = slopes()

    def cells(*keys):
        groups = {}
        for r in range(n):
            groups.setdefault(tuple(k[r] for k in keys), []).append(r)
        return sum(explained(rows, g, h) for rows in groups.values())

    ranked = sorted(((cells(coarse[i], coarse[j]) - cells(coarse[i]) - cells(coarse[j]), i, j)
                     for i in range(width) for j in range(i + 1, width)), reverse=True)[:n_pairs]
    for _ in range(pair_rounds):
        for _, i, j in ranked:
            for r, v in two_way(i, j, *slopes()).items():
                f[r] += 0.1 * v
    return [1 / (1 + math.exp(-v)) for v in f], [(i, j) for _, i, j in ranked]


def test_fit_against_plain_boosting(monkeypatch):
    for name, value in {"ROUNDS": 4, "PAIR_ROUNDS": 3, "PAIRS": 2, "BINS": 8, "PAIR_BINS": 4}.items():
        monkeypatch.setattr(classifier, name, value)
    rng = np.random.default_rng(2)
    for _ in range(3):
        x = rng.normal(size=(62, 4))
        y = (x[:, 0] + np.sign(x[:, 1] * x[:, 2]) + rng.normal(0, 0.5, 62) > 0).astype(float)
        model = classifier.AdditiveModel(y.mean()).fit(x, y)
        want, pairs = plain_boosting(x.tolist(), y.tolist(), 4, 3, 2, 8, 4)
        assert [(i, j) for i, j, _ in model.pairs] == pairs
        assert np.allclose(model.score(x), want, atol=1e-9)


ALPHABETS = {"aa": "the and with from house water", "bb": "der und mit von haus wasser für", "cc": "el y con de casa agua niño"}


def words(lang, k, n):
    own = ALPHABETS[lang].split()
    return " ".join(own[zlib.crc32(f"{k} {i}".encode()) % len(own)] for i in range(n))


def test_language(documents, hard_texts):
    rows = [(k, words(lang, k, 5 + k % 150), lang) for k in range(450) for lang in [sorted(ALPHABETS)[k % 3]]]
    hard = [(1000 + k, t, None) for k, t in enumerate(hard_texts)] + [(2000, "123 !!", "aa"), (None, words("aa", 1, 9), None), (3, *rows[3][1:])]
    got = language.identified(documents(rows + hard)).collect()
    assert len(got) == len(rows) + len(hard) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [by[k]["lang_pred"] == lang for k, _, lang in rows if fold(k)]
    assert sum(held) >= 0.95 * len(held) and all(r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"])) for r in got)
    assert [by[k]["lang_pred"] for k in (1000, 1001, 1002, 2000)] == ["und"] * 4 and by[1007]["lang_pred"] in ALPHABETS


def test_numbers_are_no_letters(documents):
    rows = [(k, words(lang, k, 30), lang) for k in range(60) for lang in [sorted(ALPHABETS)[k % 3]]]
    odd = [(900, "½ ² ①"), (901, "12 _ 3"), (902, "Ⅷ ٣ 七")]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identified(documents(rows + odd)).collect()}
    assert got[900] == got[901] == "und" and got[902] in ALPHABETS


def test_language_without_rows(documents):
    assert language.identified(documents([])).count() == 0
    assert [r["lang_pred"] for r in language.identified(documents([(1, "a", None)])).collect()] == ["und"]
    one = language.identified(documents([(k, "text", "xx") for k in range(5)])).collect()
    assert {(r["lang_pred"], round(r["score"], 6)) for r in one} == {("xx", 1.0)}


def test_network_gradients():
    """Backward pass against finite differences."""
    net = language.ByteNetwork(["a", "b", "c"])
    net.p = [p.astype(np.float64) for p in net.p]
    net.p[2] += 0.1      # away from the kink at 0
    ids = np.stack([language.windows(t)[0] for t in ("some text", "other words of it", "x")])
    y, rng = np.array([0, 2, 1]), np.random.default_rng(0)
    loss = lambda: -np.log(net.forward(ids)[3][np.arange(3), y]).mean()
    for p, g in zip(net.p, net.gradients(ids, y), strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if p is net.p[0]:
                at = (int(ids[0][rng.integers(0, 9)]), at[1])
            if p is net.p[1] and not net.mask[at]:
                continue
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_predictions_against_plain_loops():
    """Bytes, filters, maxima, softmax and the mean over windows, one number at a time, on whole texts."""
    net = language.ByteNetwork(["a", "b", "c"])
    net.p[2] += np.linspace(-0.2, 0.2, language.ALL).astype(np.float32)
    embed, filters, bias, out, last = (p.astype(float).tolist() for p in net.p)
    texts = ["Ab", "straße und mehr " * 40, "x" * language.WINDOW, "one more " * 29]
    got = net.predict([*texts, None, "12"])
    for k, text in enumerate(texts):
        raw, total = list(text.encode().lower()), [0.0] * 3
        for start in range(0, len(raw), language.WINDOW):
            piece = raw[start:start + language.WINDOW]
            ids = piece + [language.PAD] * (language.WINDOW + language.WIDEST - 1 - len(piece))
            pooled = []
            for f in range(language.ALL):
                width = language.WIDTHS[f // language.FILTERS]
                best = max(sum(embed[ids[i + j]][d] * filters[j * language.DIM + d][f] for j in range(width) for d in range(language.DIM))
                           for i in range(language.WINDOW))
                pooled.append(max(best + bias[f], 0.0))
            e = [math.exp(sum(x * out[f][c] for f, x in enumerate(pooled)) + last[c]) for c in range(3)]
            total = [t + x / sum(e) * len(piece) for t, x in zip(total, e, strict=True)]
        mean = [t / len(raw) for t in total]
        assert got[0][k] == "abc"[mean.index(max(mean))] and abs(got[1][k] - max(mean)) < 1e-4
    assert got[0][4:] == ["und", "und"] and got[1][4:] == [0.0, 0.0]


def test_windows_cover_the_text():
    text = "Äb" * 300
    w = language.windows(text)
    assert bytes(w[w != language.PAD].astype(np.uint8)) == text.encode().lower() and w.shape[1] == language.WINDOW


def test_every_language_is_learned(documents):
    """Also the rarest of many; repeated rows of one language do not crowd out the others."""
    rows = [(k, f"{chr(0x4E00 + k % 230) * 3} {k}", f"l{k % 230:03}") for k in range(1150)]
    rare, crowd = [(7, "rare words", "rare")], [(8, "the same row", "l000")] * 2000
    assert not fold(7) and not fold(8)
    assert language.fitted(documents(rows + rare + crowd), 300).languages == sorted({r[2] for r in rows if not fold(r[0])} | {"rare"})

"""Base rules against a plain reading, the estimate against a planted outlier, and the defined cases."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from erisk.llm import jaccard, rules
from erisk.llm.common import written


def plain(text):
    """The base counts, word by word."""
    text, cut = text or "", " \t\n\x0b\x0c\r"
    words, held = [], ""
    for c in text + " ":
        if c in cut:
            words += [held] if held else []
            held = ""
        else:
            held += c
    hit = set()
    for i in range(len(words) - 4):
        if sum(words[j:j + 5] == words[i:i + 5] for j in range(len(words) - 4)) > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if x.strip(cut)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c d e a b c d e", "x\x1fy z q", "l1 a\nl1 a\n\n\nb #*$%&|<>", "a " * 40, "é 日本 x\ry\x0bz"])
def test_counts(text):
    assert rules.statistics(text)[:5] == plain(text)


def test_random_counts():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", " ", "\n", "# "]) for _ in range(rng.randrange(80)))
        assert rules.statistics(text)[:5] == plain(text)


def test_chi_square():
    assert abs(rules.chi2_cdf(rules.chi2_quantile(0.975, 6), 6) - 0.975) < 1e-9
    assert abs(rules.chi2_quantile(0.95, 2) - 5.991464547) < 1e-6


def test_outliers_and_hard_cases(spark, documents, prose, hard_texts):
    clean = [(k, prose(k, 60 + k % 90), "en" if k % 3 else "de", f"s{k % 2}") for k in range(900)]
    odd = [(2000 + k, " ".join(w + "###" for w in prose(k, 80).split()), "en", "s0") for k in range(60)]
    hard = [(3000 + k, t, None, None) for k, t in enumerate(hard_texts)]
    few = [(4000, prose("few", 50), "fr", None), (None, prose("none", 50), None, "s9")]
    table = documents(clean + odd + hard + few)
    got = {r["doc_id"]: r for r in rules.quality_rules(table).collect()}
    assert len(got) == len(clean) + len(odd) + len(hard) + len(few)
    assert all(got[r[0]]["kept"] for r in clean) and not any(got[r[0]]["kept"] for r in odd)
    assert all(got[3000 + k]["base_failed"] for k in range(4)) and got[4000]["kept"] and got[None]["kept"]
    assert got[3005]["n_words"] == 8 and got[3005]["base_failed"]
    left = rules.kept_documents(table)
    assert left.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(k) for k, r in got.items() if r["kept"])


def test_lines_that_are_nearly_all_repeats_are_out(documents, prose):
    lines = [f"{prose(('line', k), 9)}" for k in range(60)]
    rows = [(k, "\n".join(prose((k, j), 8) for j in range(20)), "en", "s") for k in range(150)]
    echo = "\n".join(x for j, line in enumerate(lines[:30]) for x in (line, "one same line of words here"))
    rows += [(900, "a b\n" * 400, "en", "s"), (901, echo, "en", "s")]
    got = {r["doc_id"]: r for r in rules.quality_rules(documents(rows)).collect()}
    assert all(got[k]["kept"] for k in range(150)) and not got[900]["kept"] and got[901]["n_dup_lines"] == 29


NAMES = ["__s", "__key", "__k", "__p", "__row", "__stays", "__copies", "d", "s", "key", "p", "row", "stays", "copies", "k", "mu", "a.b"]


@pytest.mark.parametrize("stage", [rules.kept_documents, jaccard.one_of_each])
def test_columns_of_any_name_are_handed_on(documents, prose, stage):
    table = documents([(k, prose(k % 20, 60), "en", "s") for k in range(120)] + [(5, prose(5, 60), "en", "s")])
    for name in NAMES:
        table = table.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    left = stage(table)
    assert left.columns == table.columns
    rows = left.collect()
    assert rows and all(r[name] == f"{name} of {r['doc_id']}" for r in rows for name in NAMES)


def test_empty(documents):
    assert rules.quality_rules(documents([])).count() == 0 and rules.kept_documents(documents([])).count() == 0


def test_estimate_is_the_mcd_of_the_group(spark, documents, prose):
    """Concentration steps in Spark against the same steps over all rows in numpy."""
    table = documents([(k, prose(k, 40 + 7 * k % 300) + (" #" * (k % 3)), "en", "s") for k in range(400)])
    vectors = written(rules.vector_table(table), "test")
    row = rules.estimates(vectors).collect()[0]
    x = np.array([[r[c] for c in ("n_words", *rules.DIMS)] for r in vectors.collect() if not r["base_failed"]])
    n, z = x[:, 0], x[:, 1:] - np.array(row["mid"])
    for j, c in enumerate(rules.DIMS):
        if c in rules.NOISE_WORDS:
            z[:, j] *= np.sqrt(n / (n + rules.NOISE_WORDS[c]))
    raw = np.sort(x[:, 1])
    assert abs(row["mid"][0] - raw[len(raw) // 2]) < 0.02
    w = np.zeros((rules.P, rules.P))
    w[np.tril_indices(rules.P)] = row["w"]
    distance = (((z - np.array(row["mu"])) @ w.T) ** 2).sum(1)
    got = {r["doc_id"]: r["distance"] for r in rules.judged(vectors, rules.estimates(vectors)).collect()}
    assert np.allclose(sorted(np.sqrt(distance)), sorted(v for v in got.values() if v is not None))
    near = z[distance <= rules.chi2_quantile(rules.REWEIGHT, rules.P)]
    assert np.allclose(near.mean(0), row["mu"], atol=0.05)


def plain_verdicts(rows):
    """Every verdict of one group by its own reading: exact ranks of distances instead of bins, all in numpy."""
    ids, stats = [k for k, *_ in rows], [rules.statistics(t) for _, t, *_ in rows]
    bad = np.array([s[0] < 10 or 100 * s[4] > 20 * s[0] for s in stats])
    words, x = np.array([s[0] for s in stats], float), np.array([s[len(rules.BASE):] for s in stats])
    floor = np.array(list(rules.FLOOR.values()))
    steps = np.round(x[~bad] / (floor / 50))
    at = lambda q: np.sort(steps, axis=0)[int(np.ceil(q * len(steps))) - 1] * floor / 50
    z = x - at(0.5)
    for j, c in enumerate(rules.DIMS):
        if c in rules.NOISE_WORDS:
            z[:, j] *= np.sqrt(words / (words + rules.NOISE_WORDS[c]))
    good, mu, cov = z[~bad], np.zeros(rules.P), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2 + floor ** 2)
    d2 = lambda v: np.einsum("ni,ij,nj->n", v - mu, np.linalg.inv(cov), v - mu)
    for share in [rules.H_SHARE] * rules.STEPS + [None]:
        if share:
            near = good[np.argsort(d2(good), kind="stable")[:int(np.ceil(share * len(good)))]]
        else:
            near = good[d2(good) <= rules.chi2_quantile(rules.REWEIGHT, rules.P)]
        part = share or rules.REWEIGHT
        factor = part / rules.chi2_cdf(rules.chi2_quantile(part, rules.P), rules.P + 2)
        mu, cov = near.mean(0), factor * np.cov(near.T, bias=True) + np.diag(floor ** 2)
    return {k: (bool(b), None if b else math.sqrt(v)) for k, b, v in zip(ids, bad, d2(z), strict=True)}


def test_whole_result_against_plain_numpy(documents, prose):
    """Two groups with planted outliers and failures of the base rules: distances and verdicts of all rows."""
    rows = []
    for g, source in enumerate(("s", "t")):
        base = 10_000 * g
        rows += [(base + k, prose((g, k), 30 + 11 * k % 400) + (" #" * (k % 3)) + ("\nA Line" * (k % 4 == 0)), "en", source) for k in range(220 + 60 * g)]
        rows += [(base + 900, "#$% |<> " * 3 + prose((g, "o"), 60).upper(), "en", source), (base + 901, "few words", "en", source),
                 (base + 902, "again and again it says " * 30, "en", source), (base + 903, " ".join(w * 9 for w in prose((g, "w"), 80).split()), "en", source)]
    got = {r["doc_id"]: r for r in rules.quality_rules(documents(rows)).collect()}
    limit, close = math.sqrt(rules.chi2_quantile(rules.REJECT, rules.P)), 0
    for source in ("s", "t"):
        for k, (bad, distance) in plain_verdicts([r for r in rows if r[3] == source]).items():
            assert got[k]["base_failed"] == bad
            if bad:
                assert not got[k]["kept"] and got[k]["distance"] is None
                continue
            assert abs(got[k]["distance"] - distance) <= 0.05 * distance + 0.1
            close += abs(distance - limit) < 0.05 * limit + 0.1
            if abs(distance - limit) >= 0.05 * limit + 0.1:
                assert got[k]["kept"] == (distance <= limit)
    assert close == 0 and sum(not r["kept"] for r in got.values()) >= 8 and sum(r["kept"] for r in got.values()) >= 480

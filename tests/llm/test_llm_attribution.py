"""Counts against a character-by-character reading of the same tokens."""
import public_tokenizers
import pytest

from erisk.llm import attribution

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain(text, spans, rule):
    start, end = attribution.token_spans(text, PATH, PATTERN)
    counts = {}
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        inside = [sum(s <= c < e for c in range(a, b)) for s, e in spans]
        touched = [k for k, n in enumerate(inside) if n]
        k = -1 if not touched else touched[0] if rule == "start" else touched[-1] if rule == "end" else max(touched, key=lambda k: (inside[k], -k))
        counts[k] = counts.get(k, 0) + 1
    return counts


@pytest.mark.parametrize("rule", ["most", "start", "end"])
def test_rules(rule):
    for text in ["one two\n\n\nthree   four\n", "日本語 é\n\n 😀😀\nx", "abcdefgh ijklmnop qrst"]:
        for spans in (attribution.lines(text), [(0, 3), (3, 5), (7, 9), (11, len(text))]):
            got = {r["section"]: r["n_tokens"] for r in attribution.counted(text, spans, rule, PATH, PATTERN) if r["n_tokens"]}
            assert got == plain(text, spans, rule)


def test_spans_cover_the_text():
    text = "naïve café\n\n日本 😀 end"
    start, end = attribution.token_spans(text, PATH, PATTERN)
    assert start[0] == 0 and end[-1] == len(text) and all(start[1:] <= end[:-1])


def test_documents(spark, documents, hard_texts):
    import tiktoken  # noqa: F401
    rows = attribution.attributed(documents([(k, t) for k, t in enumerate(hard_texts)] + [(None, "null id"), (5, hard_texts[5])]), PATH, PATTERN).collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    encoding, _ = attribution.byte_pairs(PATH, PATTERN)
    want = {k: len(encoding.encode_ordinary(t or "")) for k, t in enumerate(hard_texts)}
    want[5] *= 2
    assert {k: v for k, v in total.items() if k is not None} == want and total[None] > 0
    assert [(r["section"], r["char_start"], r["char_end"]) for r in rows if r["doc_id"] in (0, 1)] == [(0, 0, 0)] * 2
    assert attribution.attributed(documents([]), PATH, PATTERN).count() == 0


def test_own_spans(spark):
    table = spark.createDataFrame([(1, "title body text", [(0, 5), (6, 15)]), (2, "x y", None)], "doc_id long, text string, fields array<struct<start: int, end: int>>")
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in attribution.attributed(table, PATH, PATTERN, "fields").collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (2, -1): 2}
    with pytest.raises(ValueError):
        attribution.counted("abc", [(0, 2), (1, 3)], "most", PATH, PATTERN)
    with pytest.raises(ValueError):
        attribution.attributed(table, PATH, PATTERN, "fields", "other")


@pytest.mark.parametrize("run", [" " * 5000, "\t" * 5000, "\n" * 4999 + " ", " \u00a0\u3000\n" * 1500, "\r\n" * 3000 + "\t"])
def test_long_runs_of_white_space_are_cut_by_the_rule(run):
    encoding, _ = attribution.byte_pairs(PATH, PATTERN)
    for text in (f"a{run}b", run, f"{run}1", f"x{run}", f"{run}!y{run} z", f"a\x1c{run}\x1cb"):
        assert attribution.token_ids(text, encoding) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("run", [" " * 2_000_000, "\t" * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000])
def test_two_million_equal_characters(run):
    start, end = attribution.token_spans(f"x {run} y", PATH, PATTERN)
    assert start[0] == 0 and end[-1] == len(run) + 4 and (start[1:] == end[:-1]).all()

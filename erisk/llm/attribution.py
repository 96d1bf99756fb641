"""Token counts of fields or sections by offsets: whole documents are encoded once, tokens are attributed afterwards.

Each text is encoded as a whole, so counts are those of training. The bytes of its tokens give their character spans;
these are joined with the spans of sections (sorted, disjoint) by binary search on both ends. A token inside one section
belongs to it. One that crosses a boundary is allocated by `rule`: "most", to the section that holds most of its
characters, the earlier one of equals; "start" or "end", to the first or last section it touches. A token that touches no
section is counted in section -1, which has a row only if there are any. So the counts of a document add up to its tokens.

Sections are the lines of the text, each with its line break, or an own column with an array of (start, end) spans in code
points. Everything happens in the row's own task; nothing is shuffled.

Defined results: a null or empty text has one section without tokens; null or empty own spans leave all tokens outside;
overlapping or unsorted spans are an error; a character cut into several tokens is part of the span of each. Runs of white space may
have any length, if the pattern ends in `\\s+(?!\\S)|\\s+`. Repeated rows give repeated results. Only doc_id, text and the spans' column are read.
"""
from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTION = pa.struct([(c, pa.int32()) for c in ("section", "char_start", "char_end")] + [(c, pa.int64()) for c in ("n_tokens", "n_crossing")])
DDL = "array<struct<section: int, char_start: int, char_end: int, n_tokens: bigint, n_crossing: bigint>>"


@functools.lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str):
    """The tokenizer of a rank file and the byte length of each of its tokens, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        size[k] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


#: The characters that the pattern's white space class takes.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE}]{{4096,}}")


def token_ids(text: str, encoding) -> list[int]:
    """The ids of a whole text. A long run of white space is cut out by the pattern's own rule, since the pattern's engine
    needs stack for each of its characters: it is one piece, but for its last character if a word follows."""
    ids, at = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at:run.start()]) + encoding._encode_single_piece(text[run.start():end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last of each token of the whole text."""
    encoding, size = byte_pairs(path, pattern)
    end = np.cumsum(size[token_ids(text, encoding)])
    start = np.concatenate([end[:0], [0], end[:-1]]) if len(end) else end
    if text.isascii():
        return start, end
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[start], character[end - 1] + 1


def lines(text: str) -> list[tuple[int, int]]:
    ends = [k for k, c in enumerate(text, 1) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def allocate(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses a boundary between sections."""
    a, b = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    if np.any(b < a) or np.any(a[1:] < b[:-1]):
        raise ValueError("sections must be sorted and disjoint")
    first = np.searchsorted(b, start, side="right")
    last = np.searchsorted(a, end, side="left") - 1
    crossing = last > first
    section = np.where(last < first, -1, last if rule == "end" else first)
    if rule == "most":
        for t in np.flatnonzero(crossing):
            own = slice(first[t], last[t] + 1)
            section[t] = first[t] + int(np.argmax(np.minimum(b[own], end[t]) - np.maximum(a[own], start[t])))
    return section, crossing


def counted(text: str | None, spans: list[tuple[int, int]], rule: str, path: str, pattern: str) -> list[dict]:
    start, end = token_spans(text or "", path, pattern)
    section, crossing = allocate(start, end, spans, rule)
    n, x = np.bincount(section + 1, minlength=len(spans) + 1), np.bincount(section + 1, crossing, len(spans) + 1)
    rows = [{"section": k, "char_start": s[0], "char_end": s[1], "n_tokens": int(n[k + 1]), "n_crossing": int(x[k + 1])}
            for k, s in enumerate(spans)]
    outside = [{"section": -1, "char_start": None, "char_end": None, "n_tokens": int(n[0]), "n_crossing": 0}] if n[0] else []
    return outside + rows


def section_counts(text: Column, spans: Column | None, rule: str, path: str, pattern: str) -> Column:
    if rule not in ("most", "start", "end"):
        raise ValueError(f"unknown rule {rule}")

    @F.arrow_udf(DDL)
    def by_lines(texts: pa.Array) -> pa.Array:
        return pa.array([counted(t, lines(t or ""), rule, path, pattern) for t in texts.to_pylist()], pa.list_(SECTION))

    @F.arrow_udf(DDL)
    def by_spans(texts: pa.Array, own: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), own.to_pylist(), strict=True)
        return pa.array([counted(t, [tuple(s.values()) for s in o or []], rule, path, pattern) for t, o in pairs], pa.list_(SECTION))

    return by_lines(text) if spans is None else by_spans(text, spans)


def attributed(documents: DataFrame, path: str, pattern: str, spans: str | None = None, rule: str = "most") -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens and n_crossing (of these, tokens that cross a boundary)."""
    found = section_counts(F.col("text"), None if spans is None else F.col(spans), rule, path, pattern)
    return documents.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")

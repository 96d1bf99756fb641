"""The trie against a dictionary of prefixes, over many tasks, and the defined cases."""
import hashlib
import random
import zlib

import pytest

from erisk.llm import peeling


def brute(rows, group=5):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((t is not None, t or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % group if c >= 0 else -(-c % group))
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves = saved = 0
        stack = [p]
        while stack:
            x = stack.pop()
            leaves += x not in kids
            saved += (len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
            stack += kids.get(x, [])
        return leaves, saved

    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below(p),
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def got(df):
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
                  for r in df.collect())


@pytest.fixture(scope="module")
def talks(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "y", b"z", True) for r in rows],
                                     "conv_id long, turn long, role string, text string, path string, t string, key binary, partial boolean")
    return make


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(7), []
    for c in range(300):
        n = rng.choice([0, 1, 2, 3, 5, 9, 12]) if c % 50 else 40
        same = c % 3 == 0                       # a third of all conversations starts alike, many are copies
        for t in range(n):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", f"é{t}" if same and rng.random() < .95 else f"{rng.randrange(3)}"))
    return out


@pytest.mark.parametrize("tasks", [1, 2, 13])
def test_against_all_prefixes(spark, talks, rows, tasks):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        assert got(peeling.prefix_trie(talks(rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_defined_cases(talks):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (7, 2, "user", "b"), (7, None, "user", "a"),
            (7, 2, "user", "a"), (-3, 0, "u", "x"), (-5, 0, "u", "x"), (-5, 1, "u", "long " * 30_000), (12, 0, "ab", "c"), (13, 0, "a", "bc")]
    assert got(peeling.prefix_trie(talks(rows))) == brute(rows)
    assert got(peeling.prefix_trie(talks([]))) == []
    assert got(peeling.prefix_trie(talks([(None, 1, "user", "a")]))) == []


def test_id_lists_grow_block_by_block(talks, monkeypatch):
    monkeypatch.setattr(peeling, "ID_BLOCK", 4)
    rows = [(c, t, "user", "same") for c in range(200) for t in range(3)]
    assert got(peeling.prefix_trie(talks(rows))) == brute(rows)

"""Slots, movement and balance of the hash tree, and the defined cases."""
from erisk.llm import sharding
from erisk.llm.sharding import GROWN, TREE, Shard


def test_slots_and_growth(documents, hard_texts):
    rows = [(k, f"text {k}") for k in range(700)] + [(5000 + k, t) for k, t in enumerate(hard_texts)] + [(None, "a"), (None, None), (3, "text 3"), (3, "text 3")]
    got = sharding.sharded(documents(rows), range_rows=8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" and 0 <= r["shard"] < 16
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 16
    sizes = {r["doc_id"]: r["size"] for r in got}
    assert sizes[5000] == sizes[5001] == 1 and sizes[5007] == len(hard_texts[7].encode()) + 1
    assert any(r["grown_shard"] == 16 for r in got) and len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    assert sharding.sharded(documents([])).count() == 0


def test_movement_is_confined(documents):
    """A heavier rack takes keys; nothing else moves but into its region, and none leave it."""
    heavy = [Shard(s.shard, s.region, s.rack, 3.0 if s.rack == "rack2" else 1.0) for s in TREE]
    region = {s.shard: s.region for s in TREE}
    moved = 0
    for r in sharding.sharded(documents([(k, "") for k in range(1500)]), TREE, heavy).collect():
        if r["shard"] != r["grown_shard"]:
            moved += 1
            assert region[r["grown_shard"]] == "region1"
            if region[r["shard"]] == "region1":
                assert r["grown_shard"] in (4, 5)
    assert moved > 100


def test_weights(documents):
    tree = [Shard(0, "a", "x", 3.0), Shard(1, "a", "y", 1.0), Shard(2, "b", "z", 4.0), Shard(3, "b", "z", 0.0)]
    n = [0] * 4
    for r in sharding.sharded(documents([(k, "") for k in range(4000)]), tree, tree).collect():
        n[r["shard"]] += 1
    assert abs(n[0] - 1500) < 150 and abs(n[1] - 500) < 100 and abs(n[2] - 2000) < 150 and n[3] == 0 and len(GROWN) == 17

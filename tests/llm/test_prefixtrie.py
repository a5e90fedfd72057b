import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallywise.llm import prefixtrie, queries

COLUMNS = "conv_id bigint, turn bigint, role string, text string"
WORD = r"[^\x20\x09-\x0D]+"


def conversations_of(rows):
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((t, role or "", text or ""))
    own = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()[:16])
    return {c: [x[1:] for x in sorted(turns, key=own)] for c, turns in out.items()}


def rebuilt(rows):
    own = conversations_of(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(conversations):
    """Every node by its whole sequence of turns."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        tokens = (len(of) - 1) * len(re.findall(WORD, node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += tokens
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, of in members.items():
        ends = sorted(c for c in of if len(conversations[c]) == len(node))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(of), len(node), min(members[node[:-1]]) if node else -1, len(of), children[node], leaves[node], saved[node], sha))
    return sorted(out)


def listed(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_hash_is_minimal_perfect_and_knows_its_members(n):
    keys = np.random.default_rng(n).integers(0, 2**63, (n, 2)).astype(np.uint64)
    slots = prefixtrie.MinimalHash(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(n))
    others = keys + np.uint64(1)
    assert (prefixtrie.MinimalHash(keys).slots(others) == -1).all()


def test_a_digest_of_two_parents_is_refused():
    node = np.array([[1, 1], [1, 1]], np.uint64)
    with pytest.raises(ValueError):
        prefixtrie.NodeTable(node, np.array([[2, 2], [3, 3]], np.uint64), np.array([2, 2]))


def test_conversations(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert listed(queries.QUERIES["op11_prefixtrie"](spark, data)) == brute(rebuilt(rows))


def odd(spark):
    rng = random.Random(3)
    rows = []
    for c in list(range(-30, 90)) + [2**61]:
        for t in range(rng.randrange(1, 12)):
            turn = rng.choice([t, t, t, None, 2**60 + t])
            rows.append((c, turn, rng.choice(["user", "user", "assistant", None, ""]), rng.choice(["a", "a", "a b\u00a0c", "", None, "x" * 50 + "1", "x" * 50 + "2"])))
    rows += [(None, 1, "user", "lost"), (500, None, None, None), (501, 1, "user", "long words " * 100_000)] + [(502, 5, "user", "again")] * 9
    return rows, spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_odd_rows_and_long_conversations_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PACK", 20)
    rows, df = odd(spark)
    turns = prefixtrie.numbered(df.selectExpr("*", "1 as at", "'x' as digest", "2 as words"))
    assert listed(prefixtrie.trie(turns, block=block)) == brute(conversations_of(rows))
    turns, ids = prefixtrie.with_shared_heads(turns)
    assert listed(prefixtrie.trie(turns, ids, block)) == brute(rebuilt(rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], COLUMNS)
    turns, ids = prefixtrie.with_shared_heads(prefixtrie.numbered(df))
    assert prefixtrie.trie(turns, ids).count() == 0


def test_rows_of_one_conversation_are_numbered_over_partitions(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, -7, id) conv_id", "id div 2 turn", "'user' role", "'x' text")
    turns = prefixtrie.numbered(df)
    assert sorted(r.at for r in turns.where("conv_id = -7").collect()) == list(range(6667))
    found = prefixtrie.trie(turns, block=64)
    assert found.where("conv_id = -7").selectExpr("max(depth)").first()[0] == 6667
    assert {tuple(r) for r in found.where("depth = 0").select("n_convs", "n_leaves", "n_children").collect()} == {(13334, 1, 1)}


def test_shards_of_few_rows_give_the_same():
    import pandas as pd

    frames = [pd.DataFrame({"a": [1, 1, 2]}), pd.DataFrame({"a": [2, 2]}), pd.DataFrame({"a": [2]}), pd.DataFrame({"a": [3, 4]})]
    runs = [r["a"].tolist() for r in prefixtrie._runs(iter(frames), 2, ("a",))]
    assert runs == [[1, 1, 2, 2, 2, 2], [3, 4]]
    assert [r["a"].tolist() for r in prefixtrie._runs(iter(frames), 2)] == [[1, 1, 2], [2, 2], [2, 3, 4]]

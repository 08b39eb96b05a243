"""The prefix trie against one built with dictionaries, on given and made conversations and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tilewright.llm import queries, trie

SF_DIR = "/root/testdata/sf0.001"


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[: h[c]] + convs[c][h[c] :] for c in convs}


def plain_trie(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    rows = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(held), len(node), parent, len(held), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def found_rows(df):
    assert df.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found_rows(queries.QUERIES["op13_prefix_trie"](spark, SF_DIR)) == plain_trie(plain_rebuilt(rows))


def _made(spark, rows):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, key string")
    return trie.keyed_turns(turns).cache()


ODD = [
    (-7, 0, "user", "é"), (-7, None, None, None), (-5, 1, "user", "a"), (3, 0, "user", "a"), (3, 1, "", "b"), (2**60 + 1, 0, "user", "a"), (2**60 + 3, 0, "user", "a"),
    (None, 0, "user", "lost"), (8, 0, "user", ""), (8, 0, "user", ""), (8, 1, "u", "ser"), (9, 0, "u", ":x"), (11, 0, "u:", "x"), (20, 5, "user", "long " * 40_000),
]


def test_odd_rows(spark):
    turns = _made(spark, ODD)
    assert found_rows(trie.prefix_trie(*trie.rebuilt(turns))) == plain_trie(plain_rebuilt(ODD))
    assert found_rows(trie.prefix_trie(*(x.limit(0) for x in trie.rebuilt(turns)))) == []
    one = spark.createDataFrame([(4, 0), (6, 0)], "conv_id long, n_turns long")
    assert found_rows(trie.prefix_trie(one, turns.limit(0))) == plain_trie({4: [], 6: []})


@pytest.mark.parametrize("deep, few", [(12, 500_000), (2, 500_000), (2, 10)])
def test_deep_shared_turns_and_copies(spark, monkeypatch, deep, few):
    """Copies of conversations, prefixes of others, and late branches; levels by Spark, within tasks, and by Spark as too many turns are left."""
    monkeypatch.setattr(trie, "DEEP", deep)
    monkeypatch.setattr(trie, "FEW_TURNS", few)
    monkeypatch.setattr(trie, "_PIECE", 3)
    r = random.Random(3)
    base = [("user", f"turn {i}") for i in range(6)]
    convs = {c: base for c in range(40, 60)}
    convs |= {c: base[: r.randint(1, 6)] + [("a", str(r.randint(0, 1)))] * r.randint(0, 3) for c in range(100, 130)}
    convs |= {c: [("user", str(r.randint(0, 1))) for _ in range(r.randint(1, 5))] for c in range(200, 240)}
    turns = _made(spark, [(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)])
    assert found_rows(trie.prefix_trie(trie.conversations(turns), turns)) == plain_trie(convs)

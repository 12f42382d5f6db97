import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from loamgraph.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in turns.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        childless = not any(len(full[c]) > len(node) for c in of)
        here = (len(of) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += childless
            saved[node[:d]] += here
    ends = lambda node: ",".join(str(c) for c in sorted(members[node]) if len(full[c]) == len(node))
    return sorted(
        (min(of), len(node), min(members[node[:-1]]) if node else -1, len(of), children[node], leaves[node], saved[node], hashlib.sha256(ends(node).encode()).hexdigest())
        for node, of in members.items()
    )


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), 60):
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bé", ""])) for t in range(rng.choice([0, 1, 2, 5, 9, 17, 33]))]
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_copies_nulls_ties_and_repeated_rows(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(6)]
    rows += [(100, None, None, "x"), (100, 1, "user", None), (100, 1, "user", None), (100, 1, "bot", "b"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS members", "3 AS block")
    # ties are ordered by a digest, so any order among them is compared without their texts
    assert sorted(r[:4] for r in found(df.transform(prefix_trie)) if r[0] < 100) == sorted(r[:4] for r in brute_force(rows) if r[0] < 100)
    assert len(found(prefix_trie(df))) == len(brute_force(rows))


def test_a_long_conversation_and_a_turnless_one(spark):
    rows = [(0, t, "user", str(t % 3)) for t in range(700)] + [(6, t, "user", "y") for t in range(2)] + [(7, 0, "user", "z" * 100_000)]
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_empty(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).count() == 0

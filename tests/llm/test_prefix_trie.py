"""The trie against a plain one, built conversation by conversation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from driftglass.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
GAP = re.compile("[\x20\x09-\x0d]+")


def brute(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv_id].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = turns.get(c - int(c - 20 * int(c / 20)), [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].add(c)
        ends[tuple(whole)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        words = len([x for x in GAP.split(node[-1][1]) if x]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * words
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else -(10**9), len(own), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, own in members.items()
    )


def result(df):
    rows = df.drop("node").collect()
    assert len({bytes(r.node) for r in df.select("node").collect()}) == len(rows)
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows)


def sample(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -1, -7, -20, -25, 1000, 1021, 5_000_000_000]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "a\tb c", "a", "", None, "  "])))
    return rows


def test_equals_a_plain_trie_with_hot_parents_and_short_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "MOST_HOT", 40)
    rows = sample(1, 90) + [(40, t, "user", f"w{t % 3}") for t in range(600)] + [(41, t, "user", f"w{t % 3}") for t in range(300)]
    rows += [(None, 0, "user", "x")] + rows[:3] + [(77, 5, "user", "word " * 200_000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(prefix_trie.trie(frame, hot=2).cache()) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(frame).collect() == []
    rows = [(3, 0, "u", "x y"), (4, 0, "u", "x y"), (4, None, "u", "first")]
    more = spark.createDataFrame([(*r, "n", "d", "p", 1) for r in rows], SCHEMA + ", node string, depth string, place string, n int")
    assert result(prefix_trie.trie(more).cache()) == brute(rows)


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_chunks_hash_as_one(spark, chunk):
    rows = [(bytes([i % 3]), c) for i, c in enumerate([5, -3, 10, 2, 1000, 7, 8])]
    found = {bytes(r.node): r.ends_sha256 for r in prefix_trie.ends_digests(spark.createDataFrame(rows, "node binary, conv_id long"), chunk).collect()}
    ids = {k: sorted(c for n, c in rows if n == k) for k in {n for n, _ in rows}}
    assert found == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}

"""Exact deduplication against grouping by text in plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from driftglass.llm import grace_dedup

SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        out += [(i, top, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def result(df):
    rows = df.collect()
    kept = defaultdict(int)
    for r in rows:
        kept[bytes(r.sha)] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(n == 1 for n in kept.values())  # one row of each group stays
    return sorted([(r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in rows], key=repr)


def sample(seed, n, distinct):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab é\n", k=rng.randrange(12))) for _ in range(distinct)]
    return [(rng.choice([None, *range(n)]), rng.choice([None, "hot", "hot", *texts])) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_grouping_by_text(spark, partitions):
    rows = sample(partitions, 600, 200)
    assert result(grace_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(partitions))) == brute(rows)


def test_buckets_that_do_not_fit_are_dealt_again(spark, monkeypatch):
    rows = sample(3, 400, 150)
    levels = []
    plain = grace_dedup.materialize
    monkeypatch.setattr(grace_dedup, "materialize", lambda df, name: levels.append(name) or plain(df, name))
    assert result(grace_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), bucket=3500, fan=3)) == brute(rows)
    assert levels.count("grace-spill") > 1


def test_equal_hashes_are_told_apart_by_content(spark):
    rows = sample(4, 200, 60)
    assert result(grace_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), hash_of=lambda sha: sha[0] % 2, bucket=9000, fan=2)) == brute(rows)


def test_table_compares_contents():
    table = grace_dedup.Table()
    assert [table.add(7, str(i).encode()) for i in range(3000)] == list(range(3000))  # one chain, grown over and over
    assert table.add(7, b"2999") == 2999 and table.add(8, b"2999") == 3000


def test_very_long_and_odd_texts(spark):
    long = "x" * 3_000_000
    rows = [(1, long), (2, long + "y"), (3, long), (4, None), (5, ""), (6, " "), (7, "A"), (8, "a"), (8, "a"), (None, "n")]
    found = {(r.doc_id, r.keep_id, r.group_size) for r in grace_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 5, 2), (5, 5, 2), (6, 6, 1), (7, 7, 1), (8, 8, 2), (None, None, 1)}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert grace_dedup.exact_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(1, "a", "r", "b", "h", "k"), (2, "a", "r", "b", "h", "k")], "doc_id long, text string, record string, bucket string, hash string, kept string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in grace_dedup.exact_duplicates(rows).collect()} == {(1, 2, False), (2, 2, True)}
    other = rows.withColumnsRenamed({"doc_id": "k1", "text": "body"})
    assert {(r.doc_id, r.keep_id) for r in grace_dedup.exact_duplicates(other, "k1", "body").collect()} == {(1, 2), (2, 2)}

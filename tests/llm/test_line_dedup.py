"""Line dedup against a plain computation; the perfect hash on its own."""

import os
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.llm import line_dedup


def key_of(line):
    key = re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    return key if len(key) >= 10 else None


def plain(rows):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if (k := key_of(line)) is not None:
                held[k].add(line_dedup.NO_ID if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = line_dedup.NO_ID if i is None else i
        kept = [x for x in lines if (k := key_of(x)) is None or len(held[k]) < 2 or min(held[k]) == own]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(plain(rows), key=order)


def test_odd_rows(odd):
    check(odd)


def test_table(small):
    check(small)


def test_empty(none):
    assert line_dedup.dedup_lines(none).count() == 0


def test_clashing_columns(odd):
    done = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("x")).withColumn("h1", F.lit(1)))
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "h1", "n_lines", "n_dropped"]
    assert done.where("doc_id = 1").first()["n_lines"] == 3


def test_many_shards(small, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD", 7)
    check(small)


def test_a_missing_shard_is_an_error(odd, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD", 2)
    built = line_dedup.build_index(odd)
    os.remove(f"{built[0].removeprefix('file://')}/1")
    monkeypatch.setattr(line_dedup, "build_index", lambda docs: built)
    with pytest.raises(Exception, match="No such file"):
        line_dedup.dedup_lines(odd).collect()


def test_very_long_texts_go_in_slices(spark):
    rows = [(i, "\n".join(f"line number {j % 70000} of text {i // 2}" for j in range(100_000))) for i in range(4)] + [(9, "x" * 3_000_000), (10, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))


def test_perfect_hash_finds_members_and_rejects_others():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    h1[1] = h1[0]  # a 64-bit collision goes to the list behind the arrays
    counts, low = np.arange(5000), np.arange(5000) * 3
    shard = line_dedup.Shard(np.frombuffer(line_dedup.build_shard(h1, h2, counts, low), np.uint8))
    at = shard.find(h1, h2)
    assert sorted(at) == list(range(5000))
    assert (shard.counts[at] == np.minimum(counts, 255)).all() and (shard.kept_in(at[counts > 1]) == low[counts > 1]).all()
    assert (shard.find(h1, h2 + np.uint64(1)) == -1).all()
    assert (shard.find(*rng.integers(0, 1 << 63, (2, 1000)).astype(np.uint64)) == -1).all()
    empty = line_dedup.Shard(np.frombuffer(line_dedup.build_shard(*[h1[:0]] * 2, counts[:0], low[:0]), np.uint8))
    assert (empty.find(h1, h2) == -1).all()

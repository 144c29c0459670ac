"""The language model against a dictionary version, and against the base model on held-out texts."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.llm import kneser_ney


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def plain(rows, order):
    train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 != 0]
    padded = lambda t: ["<s>"] * (order - 1) + t
    level = {order: Counter(tuple(x[i : i + order]) for x in map(padded, train) for i in range(len(x) - order + 1))}
    for k in range(order, 1, -1):
        level[k - 1] = Counter(g[1:] for g in level[k])
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    d = {k: kneser_ney.discounts(*(sum(c == i for c in grams.values()) for i in (1, 2, 3, 4))) for k, grams in level.items()}
    total, ones = Counter(), {}
    for grams in level.values():
        for g, c in grams.items():
            if len(g) > 1:
                total[g[:-1]] += c
                ones.setdefault(g[:-1], [0, 0, 0, 0])[min(c, 3)] += 1
    types = sum(level[1].values())
    spare = sum(d[1][min(c, 3)] for c in level[1].values()) / types if types else 1.0

    def probability(g):
        c = level[len(g)][g]
        own = max(c - d[len(g)][min(c, 3)], 0)
        if len(g) == 1:
            return (own / types if types else 0) + spare / (v + 1)
        lower = probability(g[1:])
        h = g[:-1]
        return (own + sum(d[len(g)][k] * ones[h][k] for k in (1, 2, 3)) * lower) / total[h] if total[h] else lower

    out = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        x = padded(own)
        score = sum(math.log10(probability(tuple(x[j : j + order]))) for j in range(len(own)))
        out.append((i, len(own), sum(count[w] > 0 for w in own), n, base, score, i is not None and zlib.crc32(str(i).encode()) % 10 == 0))
    return out


def check(docs, order=kneser_ney.ORDER):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = kneser_ney.language_model_scores(docs, order).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(([r[c] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out")] for r in got), key=key), sorted(plain(rows, order), key=key), strict=True):
        assert a[:4] == list(b[:4]) and a[6] == b[6]
        assert a[4:6] == pytest.approx(b[4:6], rel=1e-9)
    return got


@pytest.mark.parametrize("order", [2, 3, 4])
def test_odd_rows(odd, order):
    check(odd, order)


def test_table_and_gain_on_held_out(small):
    got = {order: [r for r in check(small, order) if r["held_out"]] for order in (2, 3)}
    for held in got.values():
        assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("fan", [1024, 8])
def test_many_shards_spread_histories_and_groups_of_shards(small, monkeypatch, fan):
    monkeypatch.setattr(kneser_ney, "SHARD", 250)
    monkeypatch.setattr(kneser_ney, "RUN", 3000)
    monkeypatch.setattr(kneser_ney, "SCORE_RUN", 700)
    monkeypatch.setattr(kneser_ney, "MOST_SHARE", 0.5)
    monkeypatch.setattr(kneser_ney, "FAN", fan)
    few = small.where("n_chars < 3000").limit(80)
    found = kneser_ney.hot_histories(few, 3, 1e4, 60)
    assert len(found[2][0]) and (found[2][1] > 1).all()
    check(few, 3)


def test_long_texts_go_stretch_by_stretch(odd, monkeypatch):
    monkeypatch.setattr(kneser_ney, "STRETCH", 100)
    monkeypatch.setattr(kneser_ney, "SCORE_RUN", 30)
    assert len(list(kneser_ney.stretches("some words " * 50, 3))) == 6
    check(odd, 3)


def test_counts_over_one_byte(spark):
    docs = spark.createDataFrame([(i, "a b " * 400 + " ".join(f"a w{j}" for j in range(300)), "en", "s", 1) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    check(docs)
    check(docs, 3)


def test_clashing_columns(odd):
    check(odd.withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1)).withColumn("shard", F.lit(2)))


def test_empty(none):
    assert kneser_ney.language_model_scores(none).count() == 0


def test_a_missing_shard_is_an_error(odd):
    spec = kneser_ney.train(odd)
    kneser_ney.score(odd, spec).collect()
    os.remove(f"{spec['folder'].removeprefix('file://')}/grams-2-0")
    with pytest.raises(Exception, match="No such file"):
        kneser_ney.score(odd, spec).collect()


def test_what_a_token_costs_does_not_grow_with_the_shards(monkeypatch, small):
    """Shards opened for each token, over runs of the size that goes with their number."""
    assert [kneser_ney.run_of(n) for n in (1, 100, 1000, 10_000)] == [200_000, 200_000, 2_000_000, 3_000_000]
    assert all(n / kneser_ney.run_of(n) <= 1 / kneser_ney.PER_SHARD for n in (43, 400, 1500))
    monkeypatch.setattr(kneser_ney, "SHARD", 300)
    monkeypatch.setattr(kneser_ney, "SCORE_RUN", 100)
    monkeypatch.setattr(kneser_ney, "PER_SHARD", 30)
    check(small.where("n_chars < 3000").limit(60), 3)


def test_rows_with_many_different_numbers():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 400, (3000, 4)) * rng.integers(0, 2, (3000, 4))
    assert (kneser_ney.decoded(kneser_ney.coded(rows), np.arange(3000), 4) == rows).all()
    rows[5, 0] = 1 << 40
    assert (kneser_ney.decoded(kneser_ney.coded(rows), np.arange(3000), 4) == rows).all()


def test_keys_are_found_and_others_not():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 20000):
        key = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) if n else np.empty(0, np.uint64)
        order, begins, low = kneser_ney.key_file(key)
        assert (kneser_ney.find(begins, low, key[order]) == np.arange(n)).all()
        assert (kneser_ney.find(begins, low, rng.integers(0, 1 << 63, 5000).astype(np.uint64)) == -1).all()

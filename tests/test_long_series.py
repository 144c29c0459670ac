"""Folds, medians by range, quality in blocks, walk-forward analogues and matrix updates against plain versions."""

import datetime as dt
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.operators import analogue, backtest, features, quality

T0 = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(4)
    rows = [(s, T0 + dt.timedelta(days=i), 100 + 10 * rng.random()) for s in "ab" for i in range(60)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").repartition(3).cache()


def test_a_fold_equals_looking_at_the_whole_history(bars):
    def decide(history):
        if len(history) % 7 == 0:
            raise ValueError("odd day")
        return history["close"].iloc[-1] > history["close"].mean()

    def update(state, bar):
        n, total = state
        state[:] = [n + 1, total + bar["close"]]
        if state[0] % 7 == 0:
            raise ValueError("odd day")
        return state, bar["close"] > state[1] / state[0]

    key = lambda df: sorted((r.symbol, r.ts, r.long_x) for r in df.collect())
    got = key(backtest.fold_signal(bars, "x", lambda: [0, 0.0], update))
    assert got == key(backtest.python_signal(bars, "x", decide)) and any(r[2] for r in got)


def test_a_million_bars_in_seconds(spark):
    many = spark.range(1_000_000).select(F.lit("s").alias("symbol"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).cast("double").alias("close"))
    began = time.time()
    found = backtest.fold_signal(many, "x", lambda: 0.0, lambda state, bar: (bar["close"], bar["close"] > state)).where("long_x").count()
    assert found == 1_000_000 - 1_000_000 // 7 - 1 and time.time() - began < 60


@pytest.mark.parametrize("size", [3, 1000])
def test_medians_are_exact(spark, size):
    rng = random.Random(size)
    rows = [("flat", 1.5)] * 300 + [("hot", rng.choice([rng.random(), 0.5, None])) for _ in range(500)] + [("one", 2.0), ("two", 1.0), ("two", 4.0), ("none", None), ("signs", -1.0), ("signs", -0.0), ("signs", 3.0)]
    got = {r.symbol: (r.n, r.median) for r in quality.medians(spark.createDataFrame(rows, "symbol string, v double").repartition(4), ["symbol"], "v", size).collect()}
    want = {k: [v for s, v in rows if s == k and v is not None] for k in {s for s, _ in rows}}
    assert got == {k: (len(v), statistics.median(v)) for k, v in want.items() if v}


def test_quality_in_blocks_equals_whole_series(spark):
    rng = random.Random(9)
    rows, price = [], 100.0
    for i in range(400):
        price *= 1 + rng.gauss(0, 0.01) * (i % 3 > 0)
        rows.append(("s", i, T0 + dt.timedelta(days=i - (i == 50) - 2 * (i == 90)), price if i != 200 else float("nan"), 1.0 if i != 7 else -1.0))
    rows += [("t", i, T0 + dt.timedelta(days=i), 5.0 if i != 30 else 500.0, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, seq long, ts timestamp_ntz, close double, volume double").repartition(4)
    df = df.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    want = {r.symbol: r for r in quality.report(df).collect()}
    for size in (13, 10_000):
        for r in quality.report_in_blocks(df, "seq", size=size).collect():
            own = want[r.symbol].asDict()
            assert {k: v for k, v in r.asDict().items() if k != "sigma"} == {k: own[k] for k in r.asDict() if k != "sigma"} and r.sigma == pytest.approx(own["sigma"])
    found = {f["check"]: f for f in want["s"]["findings"]}
    assert want["s"]["unsorted"] >= 1 and (found["unsorted"]["count"], found["unsorted"]["samples"]) == (0, []) and "unsorted(0)" in want["s"]["reason"]
    assert {f["check"]: f["message"] for f in want["t"]["findings"]}["stale_series"] == "97 % of the steps don't move"


@pytest.mark.parametrize("size", [16, 512])
def test_walk_forward_equals_one_query_at_a_time(spark, size):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(90, 3)).cumsum(0)
    rows = [(T0 + dt.timedelta(days=i), *(None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(x)), True) for i, x in enumerate(z)]
    matrix = spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, c double, complete boolean")
    names = ["a", "b", "c"]
    got = {}
    for r in analogue.walk_forward(matrix, names, top=4, exclusion=5, size=size).collect():
        got.setdefault(r.query_idx, {})[r["rank"]] = (r.row_idx, r.distance, r.n)
    ok = [i for i, r in enumerate(rows) if None not in r[1:4]]
    data = np.array([[x if x is not None else np.nan for x in r[1:4]] for r in rows])
    for q in ok:
        pool = [i for i in ok if i < q - 5]
        if len(pool) < 2:
            assert q not in got
            continue
        inv = analogue.inverse(np.cov(data[pool].T))
        d = sorted((float(np.sqrt(max((data[i] - data[q]) @ inv @ (data[i] - data[q]), 0))), i) for i in pool)[:4]
        assert [got[q][k + 1][0] for k in range(len(d))] == [i for _, i in d] and got[q][1][2] == len(pool)
        assert [got[q][k + 1][1] for k in range(len(d))] == pytest.approx([x for x, _ in d], rel=1e-6, abs=1e-9)


def test_an_update_equals_a_full_build(spark):
    rng = np.random.default_rng(3)
    rows = [("bars", "C", T0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(100 * np.exp(rng.normal(0, 0.02, 160).cumsum()))]
    rows += [("bars", "A", T0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(50 * np.exp(rng.normal(0, 0.02, 160).cumsum())) if i % 5 in (0, 2)]
    rows += [("funding", "F", T0 + dt.timedelta(hours=8 * i), float(v)) for i, v in enumerate(rng.normal(0, 1e-3, 480))]
    f = features.Feature
    spec = features.Spec("C", (f("mom", "C", "log_return", window=9), f("vol", "A", "vol_ratio", window=5, slow_window=20), f("rel", "A", "rel_strength", window=7, vs="C"), f("fz", "F", "expanding_z", "funding"), f("fm", "F", "sma", "funding", 21)), 10)
    frame = spark.createDataFrame(rows, "kind string, symbol string, ts timestamp_ntz, close double")
    late = (F.col("ts") >= F.lit("2020-05-02").cast("timestamp_ntz")) | ((F.col("symbol") == "F") & (F.col("ts") >= F.lit("2020-04-20 16:00:00").cast("timestamp_ntz")))
    known = frame.where(~late)
    first = features.state_vector(known, spec)
    since = features.changed_since(frame.where(late))
    assert since.startswith("2020-04-20 16:00:00") and features.changed_since(frame.limit(0)) is None
    got = features.update(first, features.block_states(first, known, spec), frame, spec, since).orderBy("ts").collect()
    want = features.state_vector(frame, spec).orderBy("ts").collect()
    assert len(got) == len(want) == 160
    for a, b in zip(got, want, strict=True):
        for c in a.asDict():
            assert a[c] == b[c] or a[c] == pytest.approx(b[c], rel=1e-9, abs=1e-12), (c, a, b)


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "ties"])
def test_episodes_in_blocks_equal_the_greedy_loop(spark, kind):
    rng = random.Random(5)
    rows = []
    for i in sorted(rng.sample(range(1000), 700)):
        rows.append((i, {"random": rng.random(), "rising": float(i), "falling": -float(i), "ties": float(rng.randrange(3))}[kind] if i != 500 else None))
    kept = []
    for d, i in sorted((d, i) for i, d in rows if d is not None):
        if all(abs(i - j) > 6 for j, _ in kept):
            kept.append((i, d))
    got = analogue.episodes_in_blocks(spark.createDataFrame(rows, "row_idx long, distance double").repartition(3), 6, block=32).collect()
    assert sorted((r["rank"], r.row_idx, r.distance) for r in got) == [(n + 1, i, d) for n, (i, d) in enumerate(kept)]

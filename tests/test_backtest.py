"""Backtests: compounding, fills, costs, set-aside bars, ledger, metrics, signals, sizing."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftglass.operators import backtest

DAY0 = dt.datetime(2024, 1, 1)
DECIDED = "symbol string, ts timestamp_ntz, open double, close double, strategy string, weight double"


def decided(spark, opens, weights):
    rows = [("s", DAY0 + dt.timedelta(days=i), o, o, "x", w) for i, (o, w) in enumerate(zip(opens, weights, strict=True))]
    return spark.createDataFrame(rows, DECIDED)


def curve(df):
    return [r["equity"] for r in df.orderBy("ts").collect()]


def loop(opens, weights, warmup, bps):
    """The event loop in plain Python, for comparison."""
    n = len(opens)
    ok = lambda x: x is not None and math.isfinite(x)
    equity, prev = {warmup: 1.0, warmup + 1: 1.0}, 0.0
    for t in range(warmup, n - 2):
        if not ok(opens[t + 1]) or not ok(opens[t + 2]):
            equity[t + 2] = equity[t + 1]
            continue
        w = weights[t]
        equity[t + 2] = equity[t + 1] * (1 - abs(w - prev) * bps / 1e4) * (1 + w * (opens[t + 2] / opens[t + 1] - 1))
        prev = w
    return [equity[i] for i in range(warmup, n)]


def test_growth_compounds(spark):
    opens = [100 * 1.01**i for i in range(120)]
    got = curve(backtest.run(decided(spark, opens, [1.0] * 120), 20, 0.0))
    assert len(got) == 100 and got[:2] == [1.0, 1.0] and got[-1] == pytest.approx(1.01**98)


def test_cost_of_one_entry(spark):
    assert curve(backtest.run(decided(spark, [100.0] * 60, [1.0] * 60), 20, 50.0))[-1] == pytest.approx(0.995)


def test_signal_fills_at_next_open(spark):
    opens = [100.0] * 30 + [200.0] + [100.0] * 29
    weights = [0.0] * 60
    weights[28] = 1.0  # fills at 29, earns 29 to 30
    got = curve(backtest.run(decided(spark, opens, weights), 10, 0.0))
    assert got[30 - 10] == pytest.approx(2.0) and got[29 - 10] == 1.0


def test_matches_loop_with_missing_opens(spark):
    rng = np.random.default_rng(1)
    opens = (100 * np.exp(np.cumsum(rng.normal(0, 0.02, 200)))).tolist()
    for i in (40, 77, 78, 150):
        opens[i] = None if i % 2 else float("nan")
    weights = np.where(rng.random(200) < 0.4, 0.0, rng.random(200)).tolist()
    assert curve(backtest.run(decided(spark, opens, weights), 20, 10.0)) == pytest.approx(loop(opens, weights, 20, 10.0))


def test_too_short_gives_no_rows(spark):
    assert backtest.run(decided(spark, [1.0] * 22, [1.0] * 22), 20).count() == 0


def test_ledger(spark):
    opens = [100.0 + i for i in range(40)]
    weights = [0.0] * 40
    weights[12:15] = [0.5, 0.8, 0.5]
    weights[35:] = [1.0] * 5
    rows = backtest.trades(backtest.run(decided(spark, opens, weights), 10)).orderBy("entry_ts").collect()
    assert len(rows) == 2
    assert (rows[0]["entry_price"], rows[0]["exit_price"], rows[0]["weight"]) == (113.0, 116.0, 0.5)
    assert rows[0]["pnl"] == pytest.approx((116 / 113 - 1) * 0.5)
    assert rows[1]["exit_ts"] is None and rows[1]["pnl"] is None


def test_metrics_take_trades_from_the_curve_as_from_the_ledger(spark):
    rng = np.random.default_rng(9)
    opens = (100 * np.exp(np.cumsum(rng.normal(0, 0.02, 200)))).tolist()
    opens[60] = None
    equity = backtest.run(decided(spark, opens, np.where(rng.random(200) < 0.4, 0.0, rng.random(200)).tolist()), 20)
    ledger = backtest.trades(equity)
    assert ledger.where("pnl is not null").count() > 20
    assert backtest.metrics(equity, warmup=20).collect() == backtest.metrics(equity, ledger, 20).collect()


LEDGER = "symbol string, strategy string, pnl double"
EQUITY = "symbol string, strategy string, ts timestamp_ntz, i long, n long, equity double"


def measure(spark, values, pnls=(), n_days=None):
    n = (n_days or len(values) - 1) + 1
    e = spark.createDataFrame([("s", "x", DAY0 + dt.timedelta(days=i), i, n, float(v)) for i, v in enumerate(values)], EQUITY)
    return backtest.metrics(e, spark.createDataFrame([("s", "x", p) for p in pnls], LEDGER), 0).first()


def test_metrics(spark):
    assert measure(spark, [1, 2], n_days=365)["cagr"] == 1.0
    assert measure(spark, [1, 2], n_days=730)["cagr"] == pytest.approx(math.sqrt(2) - 1, abs=1e-4)
    m = measure(spark, [1, 1.2, 0.6, 0.9], [0.1, 0.2, -0.1, -0.05, None])
    assert (m["max_drawdown"], m["win_rate"], m["profit_factor"], m["total_return"], m["n_closed"]) == (-0.5, 0.5, 2.0, -0.1, 4)
    r = [0.2, -0.5, 0.5]
    assert m["annualized_vol"] == pytest.approx(np.std(r, ddof=1) * math.sqrt(365), abs=1e-4)
    assert m["sharpe"] == pytest.approx(np.mean(r) / np.std(r, ddof=1) * math.sqrt(365), abs=1e-3) and m["sortino"] == 0
    flat = measure(spark, [1, 1, 1])
    assert [flat[c] for c in ("cagr", "annualized_vol", "sharpe", "sortino", "calmar", "win_rate", "profit_factor")] == [0] * 7
    assert measure(spark, [1, 2], [0.5])["profit_factor"] is None


def bars(spark, closes):
    return spark.createDataFrame([("s", DAY0 + dt.timedelta(days=i), float(c), float(c)) for i, c in enumerate(closes)], "symbol string, ts timestamp_ntz, open double, close double")


def test_sizing(spark):
    rng = np.random.default_rng(2)
    calm = backtest.weights(bars(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.0005, 60))))).orderBy("ts").collect()
    wild = backtest.weights(bars(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.08, 60))))).orderBy("ts").collect()
    assert calm[20]["size"] == 0 and calm[21]["size"] == 1.0
    assert 0 < wild[-1]["size"] == pytest.approx(0.40 / wild[-1]["vol"])
    assert {r["size"] for r in backtest.weights(bars(spark, [5.0] * 40)).collect()} == {0.0}


def test_signals(spark):
    up = backtest.signals(bars(spark, [100 * 1.01**i for i in range(80)])).orderBy("ts").collect()
    assert [r["long_momentum"] for r in up] == [False] * 63 + [True] * 17
    assert all(r["long_buy_and_hold"] for r in up) and not any(r["long_funding_contrarian"] for r in up)
    rng = np.random.default_rng(3)
    dip = 100 * np.exp(np.cumsum(np.concatenate([rng.normal(0, 0.01, 120), np.full(5, -0.05)])))
    got = backtest.signals(bars(spark, dip)).orderBy("ts").collect()
    assert got[-1]["long_mean_reversion"] and not any(r["long_mean_reversion"] for r in got[:100])


def test_funding_contrarian(spark):
    rng = np.random.default_rng(4)
    level = np.concatenate([rng.normal(1e-4, 5e-5, 230), np.full(6, -0.01)])
    f = spark.createDataFrame([("s", DAY0 + dt.timedelta(hours=8 * i), float(v)) for i, v in enumerate(level)], "symbol string, ts timestamp_ntz, close double")
    other = f.withColumns({"symbol": F.lit("t"), "close": F.lit(1e-4)})
    own = bars(spark, [100.0] * 90)
    both = own.unionByName(own.withColumn("symbol", F.lit("t"))).unionByName(own.withColumn("symbol", F.lit("unpaid")))
    rows = backtest.signals(both, f.unionByName(other)).orderBy("ts").collect()
    got = [r for r in rows if r["symbol"] == "s"]
    assert got[-1]["long_funding_contrarian"] and not any(r["long_funding_contrarian"] for r in got[:60])
    assert not any(r["long_funding_contrarian"] for r in rows if r["symbol"] != "s")


def test_custom_strategy_joins_the_same_job(spark):
    df = backtest.decisions(bars(spark, [100 * 1.01**i for i in range(80)]), custom={"evens": lambda: F.dayofmonth("ts") % 2 == 0})
    assert {r["strategy"] for r in df.select("strategy").distinct().collect()} == {*backtest.STRATEGIES, "evens"}
    assert df.count() == 5 * 80


def test_python_strategy_sees_the_past_and_fails_alone(spark):
    def decide(history):
        if len(history) == 5:
            raise ValueError("no view today")
        return history["close"].iloc[-1] >= history["close"].max()

    got = backtest.python_signal(bars(spark, [1, 2, 3, 2, 5, 6, 1]), "top", decide).orderBy("ts").collect()
    assert [r["long_top"] for r in got] == [True, True, True, False, False, True, False]


def test_decisions_are_causal(spark):
    rng = np.random.default_rng(5)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 260)))
    near = lambda df: [(r["strategy"], r["ts"], round(r["weight"], 9)) for r in df.orderBy("strategy", "ts").collect()]
    part = near(backtest.decisions(bars(spark, closes[:230])))
    whole = near(backtest.decisions(bars(spark, closes)).withColumn("k", F.row_number().over(Window.partitionBy("strategy").orderBy("ts"))).where("k <= 230"))
    assert part == whole

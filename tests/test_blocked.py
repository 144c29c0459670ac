"""Blocks with halos and carried states against the plain windows of whole series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftglass.functions import blocked
from driftglass.functions import indicators as ind
from driftglass.operators import backtest

def whole():
    return Window.partitionBy("symbol").orderBy("ts")


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    rows = [("hot", i, 50 + 10 * rng.random() if rng.random() > 0.03 else None) for i in range(900)] + [("b", i, 7.1) for i in range(100)] + [("c", 0, 1.0)] + [("none", i, None) for i in range(5)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts long, close double").repartition(6).cache()


def close_to(a, b, columns):
    x, y = ({(r.symbol, r.ts): [r[c] for c in columns] for r in df.collect()} for df in (a, b))
    assert x.keys() == y.keys()
    for k in x:
        for p, q in zip(x[k], y[k], strict=True):
            assert (p is None) == (q is None) and (p is None or p == pytest.approx(q, rel=1e-9, abs=1e-12)), (k, p, q)


def test_rows_are_numbered(spark, series):
    got = blocked.placed(series, ["symbol"], ["ts"]).collect()
    assert len(got) == 1006 and all(r[blocked.ROW] == r.ts for r in got)


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_trailing_and_leading_windows(series, size):
    def build(df, w):
        df = ind.rolling_zscore(ind.sma(df, "mean", "close", w, 20), "z", "close", w, 30)
        df = ind.realized_vol(df, "vol", "close", w, 21)
        return ind.forward_return(df, "ahead", "close", w, 9)

    got = blocked.over_blocks(series, ["symbol"], ["ts"], build, before=30, after=9, size=size)
    close_to(got, build(series, whole()), ["mean", "z", "vol", "ahead"])
    assert got.count() == 1006


@pytest.mark.parametrize("size", [1, 13, 10_000])
def test_states_so_far(series, size):
    rows = blocked.placed(series, ["symbol"], ["ts"]).withColumn("factor", F.when(F.col("close").isNotNull(), 1 + (F.col("close") - 55) / 100))
    so_far = whole().rowsBetween(ind.FIRST, 0)
    got = blocked.running(rows, ["symbol"], {"m": ("moments", "close"), "top": ("max", "close"), "grown": ("product", "factor"), "seen": ("last", "close")}, size)
    want = rows.select(
        "symbol", "ts", F.count("close").over(so_far).alias("m_n"), F.avg("close").over(so_far).alias("m_mean"), F.stddev_pop("close").over(so_far).alias("sd"),
        F.max("close").over(so_far).alias("top"), F.product("factor").over(so_far).alias("grown"), F.last("close", ignorenulls=True).over(so_far).alias("seen"),
    )
    close_to(got.withColumn("sd", F.when(F.col("m_n") > 0, F.sqrt(F.col("m_m2") / F.col("m_n")))), want, ["m_n", "m_mean", "sd", "top", "grown", "seen"])


@pytest.mark.parametrize("size", [4, 10_000])
def test_products_end_where_doubles_do(spark, size):
    """A product that overflowed stays infinite, one that vanished stays 0, and a block that leaves the range alone does no harm."""
    factors = {
        "over": [1e200, 1e100, 1e10, 0.1, 1e-5, None, 1e-100, 1e-100, 3.0], "under": [1e-200, 1e-150, 1e10, 1e100, 1e100, 2.0], "apart": [1e-150, 1e-150, 1.0, 1.0, 1e200, 1e200, 1e100, 1e-300, 2.0],
        "deep": [1e150, 1e150, 1.0, 1.0, 1e-200, 1e-200, 1e-100, 1e300, 2.0], "signs": [-2.0, 3.0, -1e300, -1e300, -1.0, 1e-10], "zero": [2.0, 3.0, 0.0, 5.0, 1e300, 1e300], "none": [None, None],
    }
    rows = blocked.placed(spark.createDataFrame([(k, i, v) for k, own in factors.items() for i, v in enumerate(own)], "symbol string, ts long, v double").repartition(3), ["symbol"], ["ts"])
    close_to(blocked.products(rows, ["symbol"], "p", "v", size), rows.withColumn("p", F.product("v").over(whole().rowsBetween(ind.FIRST, 0))), ["p"])


@pytest.mark.parametrize("size", [1, 16, 300, 10_000])
def test_products_are_those_of_sql(spark, size):
    """Bit for bit, also where the order of multiplying decides whether a product is infinite, and whether it is finite again later."""
    import duckdb

    rng = random.Random(8)
    back = [1e300] + [1.0] * 15 + [1e10] + [1.0] * 14 + [1e-10, 2.0]
    factors = {"back": back * 20, "down": [1 / f for f in back] * 9, "long": [rng.lognormvariate(0, 0.3) if rng.random() > 0.1 else None for _ in range(5000)], "late": [None] * 40 + [2.0], "none": [None] * 20}
    table = [(k, i, v) for k, own in factors.items() for i, v in enumerate(own)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (symbol VARCHAR, ts BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", table)
    one = "SELECT symbol, ts, product(v) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) FROM t WHERE symbol = ?"  # DuckDB may lay several series end to end, and multiplies across
    want = sorted(r for k in factors for r in con.execute(one, [k]).fetchall())
    rows = blocked.placed(spark.createDataFrame(table, "symbol string, ts long, v double").repartition(3), ["symbol"], ["ts"])
    got = sorted(map(tuple, blocked.products(rows, ["symbol"], "p", "v", size).select("symbol", "ts", "p").collect()))
    assert got == want
    infinite = [p == float("inf") for k, i, p in got if k == "back"]
    assert infinite[16] and not infinite[31]  # row by row it would stay infinite


def test_scores_and_drawdowns(series):
    got = blocked.drawdown(blocked.expanding_zscore(series, "z", "close", ["symbol"], ["ts"], 60, 50), "dd", "close", ["symbol"], ["ts"], 50)
    close_to(got, ind.drawdown(ind.expanding_zscore(series, "z", "close", whole(), 60), "dd", "close", whole()), ["z", "dd"])
    assert got.where("symbol = 'b' and z is not null").count() == 0  # equal values don't spread, whatever rounding says


def test_unknown_states_are_refused(series):
    with pytest.raises(ValueError):
        blocked.running(series.withColumn(blocked.ROW, F.col("ts")), ["symbol"], {"x": ("median", "close")})


@pytest.mark.parametrize("size", [16, 5000])
def test_backtests_in_blocks_equal_whole_series(spark, series, size):
    bars = series.where("symbol in ('hot', 'c')").withColumn("open", F.when(F.col("ts") % 41 == 0, F.lit(float("nan"))).otherwise(F.coalesce("close", F.lit(50.0))))
    bars = bars.withColumn("close", F.coalesce("close", F.lit(50.0)))
    want = backtest.run(backtest.decisions(bars), warmup=120)
    got = backtest.run_in_blocks(bars, ["ts"], warmup=120, size=size)
    key = lambda df: df.withColumn("symbol", F.concat("symbol", "strategy"))
    close_to(key(got), key(want), ["held", "before", "equity", "i", "n"])
    assert got.count() == 780 * 4


def test_backtests_without_fills_get_them(spark, series):
    bars = series.where("symbol = 'hot'").withColumn("open", F.col("close"))
    decided = backtest.decisions(bars)
    want = backtest.run(decided, warmup=120)
    close_to(backtest.run(decided.select("symbol", "ts", "open", "close", "strategy", "weight"), warmup=120).where("strategy = 'momentum'"), want.where("strategy = 'momentum'"), ["equity", "held"])

"""Hand-computed indicator values, gaps, causality."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftglass.functions import indicators as ind

W = lambda: Window.partitionBy("symbol").orderBy("ts")


def frame(spark, values):
    return spark.createDataFrame([("s", i, None if v is None else float(v)) for i, v in enumerate(values)], "symbol string, ts int, v double").withColumn("v", ind.clean(F.col("v")))


def column(df, name="out"):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_sma(spark):
    assert column(ind.sma(frame(spark, [1.0, 2, 3, 4, 5]), "out", "v", W(), 3)) == [None, None, 2, 3, 4]


def test_sma_recovers_after_gap(spark):
    got = column(ind.sma(frame(spark, [1.0, 2, float("nan"), 4, 5, 6]), "out", "v", W(), 2))
    assert got == [None, 1.5, None, None, 4.5, 5.5]


def test_rolling_std_is_population(spark):
    assert column(ind.rolling_std(frame(spark, [2.0, 4, 4, 4, 5, 5, 7, 9]), "out", "v", W(), 8))[-1] == pytest.approx(2.0)


def test_rolling_z_of_constants_is_missing(spark):
    assert column(ind.rolling_zscore(frame(spark, [3.0] * 6), "out", "v", W(), 3)) == [None] * 6


def test_log_return_diff_drawdown(spark):
    assert column(ind.log_return(frame(spark, [100.0, 110]), "out", "v", W()))[1] == pytest.approx(math.log(1.1))
    assert column(ind.log_return(frame(spark, [0.0, 110, -5]), "out", "v", W())) == [None, None, None]
    assert column(ind.diff(frame(spark, [1.0, 4, 9]), "out", "v", W(), 2)) == [None, None, 8]
    assert column(ind.drawdown(frame(spark, [100.0, 120, 60, 90]), "out", "v", W()))[1:3] == [0, -0.5]


def test_realized_vol_needs_one_more_close(spark):
    got = column(ind.realized_vol(frame(spark, [100.0 * 1.01**i * (1 + 0.01 * (i % 2)) for i in range(8)]), "out", "v", W(), 5))
    assert got[:5] == [None] * 5 and got[5] > 0


def test_vol_ratio_of_flat_series_is_missing(spark):
    assert column(ind.vol_ratio(frame(spark, [5.0] * 12), "out", "v", W(), 2, 4)) == [None] * 12


def test_expanding_z(spark):
    got = column(ind.expanding_zscore(frame(spark, [1.0, None, 3, 5]), "out", "v", W(), 2))
    assert got[:2] == [None, None]
    assert got[2] == pytest.approx(1.0)
    assert got[3] == pytest.approx(2 / math.sqrt(8 / 3))


@pytest.mark.parametrize("name,args", [("sma", (5,)), ("rolling_std", (5,)), ("realized_vol", (5,)), ("vol_ratio", (3, 6)), ("pct_from_sma", (4,)), ("rolling_zscore", (5,)), ("expanding_zscore", (5,)), ("log_return", (3,)), ("diff", (3,)), ("drawdown", ())])
def test_causal_and_aligned(spark, name, args):
    values = [100 + 10 * math.sin(i) + i for i in range(40)]
    whole = column(getattr(ind, name)(frame(spark, values), "out", "v", W(), *args))
    part = column(getattr(ind, name)(frame(spark, values[:25]), "out", "v", W(), *args))
    assert len(whole) == 40
    assert [None if x is None else round(x, 9) for x in whole[:25]] == [None if x is None else round(x, 9) for x in part]

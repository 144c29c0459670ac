"""Time series built from raw tables: bars, funding prints, open interest, context levels.

Long format: ``kind``, ``symbol``, ``ts`` and either open/high/low/close/volume or, for levels, the level as close.
Building is one hash aggregation on (symbol, bucket) with partial sums before the shuffle, so raw events never meet
in one place; everything after works on bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "ALL"


def ohlcv(ticks: DataFrame, symbol: Column, bucket: Column, price: str, order: Column | str, kind: str = "bars") -> DataFrame:
    """Bars of ``price`` per symbol and time bucket; ``order`` must be unique within a bucket."""
    order = F.col(order) if isinstance(order, str) else order
    return ticks.groupBy(symbol.alias("symbol"), bucket.alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")
    ).select(F.lit(kind).alias("kind"), "symbol", "ts", "open", "high", "low", "close", "volume")


def daily_bars(orders: DataFrame) -> DataFrame:
    """One symbol per order priority."""
    return ohlcv(orders, F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"), "o_totalprice", "o_orderkey")


def calendar_bars(orders: DataFrame) -> DataFrame:
    """The calendar series over all orders."""
    return ohlcv(orders, F.lit(ALL), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"), "o_totalprice", "o_orderkey")


def intraday_bars(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Bars of ``value`` per event type."""
    bucket = F.window("ts", f"{minutes} minutes")["start"]
    return ohlcv(events.withColumn("bucket", bucket), F.col("event_type"), F.col("bucket"), "value", F.struct("ts", "event_id"))


def level(kind: str, symbol: Column, ts: Column, value: Column, rows: DataFrame) -> DataFrame:
    """A level series: all four prices are the level, volume is 0."""
    own = rows.groupBy(symbol.alias("symbol"), ts.alias("ts")).agg(value.alias("close"))
    return own.select(F.lit(kind).alias("kind"), "symbol", "ts", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.lit(0.0).alias("volume"))


def funding(lineitem: DataFrame) -> DataFrame:
    """Signed prints three times a day per line status."""
    hours = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 8).otherwise(16)
    ts = F.col("l_shipdate") + F.make_dt_interval(hours=hours)
    return level("funding", F.col("l_linestatus"), ts, F.avg(F.col("l_discount") - F.col("l_tax")), lineitem)


def context(lineitem: DataFrame) -> DataFrame:
    """Three context levels stamped 14:30, from one pass."""
    ts = F.col("l_shipdate") + F.make_dt_interval(hours=F.lit(14), mins=F.lit(30))
    wide = lineitem.groupBy(ts.alias("ts")).agg(F.avg("l_extendedprice").alias("DXY"), F.avg("l_quantity").alias("VIX"), F.avg("l_discount").alias("US10Y"))
    own = wide.select("ts", F.expr("stack(3, 'DXY', DXY, 'VIX', VIX, 'US10Y', US10Y) AS (symbol, close)"))
    return own.select(F.lit("bars").alias("kind"), "symbol", "ts", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.lit(0.0).alias("volume"))


def open_interest(events: DataFrame) -> DataFrame:
    """Daily sum of values per event type."""
    return level("open_interest", F.col("event_type"), F.date_trunc("day", "ts").cast("timestamp_ntz"), F.sum("value"), events)

"""Causal indicators as window plans.

Every function adds one column to a table ordered by ``w`` (a window partitioned by series and ordered by time) and
keeps all rows: warm-up rows are NULL. NULL is the only missing value; ``clean`` turns NaN and infinities into it.
All columns added over one window share a single shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

DAYS_PER_YEAR = 365
FIRST = Window.unboundedPreceding


def clean(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def mean_of(v: str, w: WindowSpec, n: int) -> Column:
    r = trailing(w, n)
    return F.when(F.count(v).over(r) == n, F.avg(v).over(r))


def deviation_of(v: str, w: WindowSpec, n: int) -> Column:
    r = trailing(w, n)
    return F.when(F.count(v).over(r) == n, F.stddev_pop(v).over(r))


def log_return_of(v: str, w: WindowSpec, n: int = 1) -> Column:
    ratio = F.try_divide(F.col(v), F.lag(v, n).over(w))
    return F.when(ratio > 0, F.ln(ratio))


def expanding_zscore_of(v: str, w: WindowSpec, min_periods: int) -> Column:
    r = w.rowsBetween(FIRST, 0)
    seen, mean, sd = F.count(v).over(r), F.avg(v).over(r), F.stddev_pop(v).over(r)
    return F.when((seen >= min_periods) & (sd > 0), (F.col(v) - mean) / sd)


def sma(df: DataFrame, out: str, v: str, w: WindowSpec, n: int) -> DataFrame:
    """Mean of the last n values, NULL while any of them is missing."""
    return df.withColumn(out, mean_of(v, w, n))


def rolling_std(df: DataFrame, out: str, v: str, w: WindowSpec, n: int) -> DataFrame:
    """Population standard deviation of the last n values."""
    return df.withColumn(out, deviation_of(v, w, n))


def log_return(df: DataFrame, out: str, v: str, w: WindowSpec, n: int = 1) -> DataFrame:
    return df.withColumn(out, log_return_of(v, w, n))


def diff(df: DataFrame, out: str, v: str, w: WindowSpec, n: int = 1) -> DataFrame:
    return df.withColumn(out, F.col(v) - F.lag(v, n).over(w))


def realized_vol(df: DataFrame, out: str, v: str, w: WindowSpec, n: int = 21) -> DataFrame:
    """Annualised population deviation of the last n one-step log returns."""
    step = f"__{out}_step"
    return df.withColumn(step, log_return_of(v, w)).withColumn(out, deviation_of(step, w, n) * F.sqrt(F.lit(DAYS_PER_YEAR))).drop(step)


def vol_ratio(df: DataFrame, out: str, v: str, w: WindowSpec, fast: int = 21, slow: int = 90) -> DataFrame:
    step = f"__{out}_step"
    own = deviation_of(step, w, slow)
    return df.withColumn(step, log_return_of(v, w)).withColumn(out, F.when(own > 0, deviation_of(step, w, fast) / own)).drop(step)


def pct_from_sma(df: DataFrame, out: str, v: str, w: WindowSpec, n: int) -> DataFrame:
    mean = mean_of(v, w, n)
    return df.withColumn(out, F.try_divide(F.col(v) - mean, mean))


def rolling_zscore(df: DataFrame, out: str, v: str, w: WindowSpec, n: int) -> DataFrame:
    sd = deviation_of(v, w, n)
    return df.withColumn(out, F.when(sd > 0, (F.col(v) - mean_of(v, w, n)) / sd))


def expanding_zscore(df: DataFrame, out: str, v: str, w: WindowSpec, min_periods: int = 60) -> DataFrame:
    """Standardised by everything up to and including the row; needs min_periods values so far."""
    return df.withColumn(out, expanding_zscore_of(v, w, min_periods))


def drawdown(df: DataFrame, out: str, v: str, w: WindowSpec) -> DataFrame:
    peak = F.max(v).over(w.rowsBetween(FIRST, 0))
    return df.withColumn(out, F.try_divide(F.col(v) - peak, peak))


def simple_return(df: DataFrame, out: str, v: str, w: WindowSpec) -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(v), F.lag(v).over(w)) - 1)


def forward_return(df: DataFrame, out: str, v: str, w: WindowSpec, steps: int) -> DataFrame:
    """Return over the next ``steps`` rows (rows, not days), NULL past the end."""
    return df.withColumn(out, F.try_divide(F.lead(v, steps).over(w), F.col(v)) - 1)

"""Slices of series and lookups of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def slice_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows between two instants, both included, each optional."""
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def tail(df: DataFrame, n: int, by: str = "symbol") -> DataFrame:
    """The last n rows of every series."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts")))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def downsample(df: DataFrame, k: int, by: str = "symbol") -> DataFrame:
    """k rows per series, evenly spread from first to last; series of up to k rows stay whole.

    Row i stays if it is floor(j (n-1) / (k-1)) for some j < k, which a comparison with its neighbours decides without a join.
    """
    w = Window.partitionBy(by)
    numbered = df.withColumn("__i", F.row_number().over(w.orderBy("ts")) - 1).withColumn("__n", F.count("*").over(w))
    if k < 2:
        return numbered.where((F.col("__n") <= k) | (F.col("__i") == 0)).drop("__i", "__n")
    j = F.ceil(F.col("__i") * (k - 1) / F.nullif(F.col("__n") - 1, F.lit(0)))
    hit = F.floor(j * (F.col("__n") - 1) / (k - 1)) == F.col("__i")
    return numbered.where((F.col("__n") <= k) | hit).drop("__i", "__n")


class SymbolNotFound(KeyError):
    """No symbol has this ticker."""


class DuplicateTicker(ValueError):
    """Two symbols have the same ticker."""


def load_universe(spark: SparkSession, config: dict) -> DataFrame:
    """The symbol dimension from a parsed configuration (``symbols``: ticker, asset_class, exchange, optional name, currency, providers)."""
    rows = []
    for x in config.get("symbols") or []:
        try:
            rows.append((x["ticker"], x["exchange"], x["asset_class"], x.get("name", ""), x.get("currency", "USD"), {k: str(v) for k, v in (x.get("providers") or {}).items()}))
        except KeyError as e:
            raise ValueError(f"a symbol lacks {e}: {x!r}") from e
    if not rows:
        raise ValueError("the universe has no symbols")
    found = spark.createDataFrame(rows, "ticker string, exchange string, asset_class string, name string, currency string, provider_tickers map<string,string>")
    return unique_tickers(found)


def unique_tickers(symbols: DataFrame) -> DataFrame:
    """``symbols`` as they are; a ticker that occurs twice is refused."""
    twice = symbols.groupBy("ticker").count().where("count > 1").orderBy("ticker").limit(5).collect()
    if twice:
        raise DuplicateTicker(", ".join(r["ticker"] for r in twice))
    return symbols


def listing(symbols: DataFrame) -> DataFrame:
    """All symbols in order of their tickers."""
    return symbols.orderBy("ticker")


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """One symbol by ticker or EXCHANGE:TICKER."""
    found = symbols.where((F.col("ticker") == name) | (F.concat_ws(":", "exchange", "ticker") == name))
    if not (n := len(found.take(2))):
        raise SymbolNotFound(name)
    if n > 1:
        raise DuplicateTicker(name)
    return found


def by_class(symbols: DataFrame, asset_class: str) -> DataFrame:
    return symbols.where(F.col("asset_class") == asset_class)


def by_provider(symbols: DataFrame, provider: str) -> DataFrame:
    return symbols.where(F.map_contains_key("provider_tickers", provider))


def calendar_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions at which two calendars differ; empty if they are in step."""
    number = lambda df, name: df.select(F.col("ts").alias(name), F.row_number().over(Window.orderBy("ts")).alias("pos"))
    return number(a, "left_ts").join(number(b, "right_ts"), "pos", "full").where(~F.col("left_ts").eqNullSafe(F.col("right_ts")))

"""All registered queries, each with its DuckDB equivalent where SQL can express it.

The market series are built from the raw tables (see ``driftglass.sources.series``). Computed doubles are rounded to
six digits on both sides; days are text, so both engines compare the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftglass.functions import blocked
from driftglass.functions import indicators as ind
from driftglass.operators import analogue, asof, backtest, features, provenance, quality, regime, slicing
from driftglass.plans import oracles as sql
from driftglass.session import derived_path, fresh_path, table, written
from driftglass.sources import lake, series
from driftglass.streaming import asof as streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ALTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql.without_negative_zero(oracle)
        return f

    return register


def r6(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + F.lit(0.0)).alias(name or c)


def day():
    return F.date_format("ts", "yyyy-MM-dd").alias("day")


def at():
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")


def daily(spark, d) -> DataFrame:
    return series.daily_bars(table(spark, d, "orders"))


def calendar(spark, d) -> DataFrame:
    return series.calendar_bars(table(spark, d, "orders"))


def all_series(spark, d) -> DataFrame:
    lineitem = table(spark, d, "lineitem")
    own = daily(spark, d).unionByName(calendar(spark, d)).unionByName(series.context(lineitem)).unionByName(series.funding(lineitem))
    return own.select("kind", "symbol", "ts", "close")


def matrix(spark, d) -> DataFrame:
    return features.state_vector(all_series(spark, d), features.default_spec(ALTS))


def saved_matrix(spark, d) -> DataFrame:
    """The stored state vector of these tables: built when it is first asked for, read from then on, as the services do."""
    path = derived_path(spark, d, ("orders", "lineitem"), "state-vector")
    if not lake.exists(spark, f"{path}/_SUCCESS"):
        matrix(spark, d).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def by_symbol():
    return Window.partitionBy("symbol").orderBy("ts")


# --- sources ---------------------------------------------------------------------------------------------------


@query(sql.with_bars("SELECT symbol, {day}, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, volume FROM bars"))
def ohlcv_daily(spark, d):
    return daily(spark, d).select("symbol", day(), r6("open"), r6("high"), r6("low"), r6("close"), "volume")


@query(sql.OHLCV_HOURLY)
def ohlcv_hourly(spark, d):
    return series.intraday_bars(table(spark, d, "events")).select("symbol", at(), r6("open"), r6("high"), r6("low"), r6("close"), "volume")


@query(sql.with_series("SELECT symbol, {at}, round(close,6) AS rate FROM funding"))
def funding_prints(spark, d):
    return series.funding(table(spark, d, "lineitem")).select("symbol", at(), r6("close", "rate"))


@query(sql.with_series("SELECT symbol, {at}, round(close,6) AS level FROM context"))
def macro_context(spark, d):
    return series.context(table(spark, d, "lineitem")).select("symbol", at(), r6("close", "level"))


@query("SELECT event_type AS symbol, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(sum(value),4) AS level FROM events GROUP BY 1,2")
def open_interest(spark, d):
    return series.open_interest(table(spark, d, "events")).select("symbol", day(), F.round("close", 4).alias("level"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity),2) AS qty FROM lineitem WHERE l_discount > 0.05 GROUP BY 1,2")
def sql_passthrough(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity),2) AS qty FROM lineitem WHERE l_discount > :least GROUP BY 1,2", args={"least": 0.05})


# --- indicators ------------------------------------------------------------------------------------------------


def indicator(name: str, build, expression: str, *inner: str) -> None:
    def run(spark, d):
        return build(daily(spark, d)).select("symbol", day(), r6("v"))

    run.__name__ = name
    query(sql.indicator(expression, *inner))(run)


W = by_symbol
indicator("sma_20", lambda b: ind.sma(b, "v", "close", W(), 20), sql.sma("close", 20))
indicator("rolling_std_20", lambda b: ind.rolling_std(b, "v", "close", W(), 20), sql.std("close", 20))
indicator("realized_vol_21", lambda b: ind.realized_vol(b, "v", "close", W(), 21), f"{sql.std('r', 21)} * sqrt(365)", f"{sql.log_return('close', 1)} AS r")
indicator("vol_ratio_21_90", lambda b: ind.vol_ratio(b, "v", "close", W()), "CASE WHEN b > 0 THEN a / b END", f"{sql.log_return('close', 1)} AS r", f"{sql.std('r', 21)} AS a, {sql.std('r', 90)} AS b")
indicator("pct_from_sma_200", lambda b: ind.pct_from_sma(b, "v", "close", W(), 200), "(close - m) / m", f"{sql.sma('close', 200)} AS m")
indicator("log_return_63", lambda b: ind.log_return(b, "v", "close", W(), 63), sql.log_return("close", 63))
indicator("diff_63", lambda b: ind.diff(b, "v", "close", W(), 63), "close - lag(close, 63) OVER w")
indicator("rolling_z_90", lambda b: ind.rolling_zscore(b, "v", "close", W(), 90), "CASE WHEN s > 0 THEN (close - m) / s END", f"{sql.sma('close', 90)} AS m, {sql.std('close', 90)} AS s")
indicator("expanding_z_180", lambda b: ind.expanding_zscore(b, "v", "close", W(), 180), sql.expanding_z("close", 180))
indicator("drawdown", lambda b: ind.drawdown(b, "v", "close", W()), "close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1")
indicator("daily_returns", lambda b: ind.simple_return(b, "v", "close", W()), "close / lag(close) OVER w - 1")


@query(sql.with_bars("SELECT symbol, {day}, " + ", ".join(f"round(lead(close,{h}) OVER w / close - 1, 6) AS fwd_{h}" for h in analogue.HORIZONS) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)"))
def forward_returns(spark, d):
    return analogue.with_forward_returns(daily(spark, d)).select("symbol", day(), *[r6(f"fwd_{h}") for h in analogue.HORIZONS])


TICK_BLOCK = 512  # rows; small, so that a series is many blocks in small tables too


def ticks(spark, d) -> DataFrame:
    """Raw events as series, a row each, in order of time and id."""
    return table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.col("value").alias("open"), F.col("value").alias("close"))


TICK_ORDER = ["ts", "event_id"]
TICK_INDICATORS = {
    "sma_20": lambda b, w: ind.sma(b, "sma_20", "close", w, 20), "std_20": lambda b, w: ind.rolling_std(b, "std_20", "close", w, 20), "vol_21": lambda b, w: ind.realized_vol(b, "vol_21", "close", w, 21),
    "ratio_21_90": lambda b, w: ind.vol_ratio(b, "ratio_21_90", "close", w), "pct_200": lambda b, w: ind.pct_from_sma(b, "pct_200", "close", w, 200), "return_63": lambda b, w: ind.log_return(b, "return_63", "close", w, 63),
    "diff_63": lambda b, w: ind.diff(b, "diff_63", "close", w, 63), "z_90": lambda b, w: ind.rolling_zscore(b, "z_90", "close", w, 90), "return_1": lambda b, w: ind.simple_return(b, "return_1", "close", w),
}


@query(sql.TICK_INDICATORS)
def tick_indicators(spark, d):
    """Trailing windows over raw events, one series in many tasks."""

    def build(rows, w):
        for add in TICK_INDICATORS.values():
            rows = add(rows, w)
        return rows

    got = blocked.over_blocks(ticks(spark, d), ["symbol"], TICK_ORDER, build, before=199, size=TICK_BLOCK)
    return got.select("symbol", "event_id", *[r6(c) for c in TICK_INDICATORS])


@query(sql.TICK_FORWARD)
def tick_forward_returns(spark, d):
    def build(rows, w):
        for h in analogue.HORIZONS:
            rows = ind.forward_return(rows, f"fwd_{h}", "close", w, h)
        return rows

    got = blocked.over_blocks(ticks(spark, d), ["symbol"], TICK_ORDER, build, before=0, after=max(analogue.HORIZONS), size=TICK_BLOCK)
    return got.select("symbol", "event_id", *[r6(f"fwd_{h}") for h in analogue.HORIZONS])


@query(sql.TICK_FLAGS)
def tick_order_flags(spark, d):
    """Duplicate and unsorted times of events in order of their ids, per row."""
    own = ticks(spark, d).withColumns({"high": F.col("close"), "low": F.col("close"), "volume": F.lit(0.0)})
    got = blocked.over_blocks(own, ["symbol"], ["event_id"], lambda b, w: quality.flags(b, "event_id", w=w, keep=(blocked.BLOCK, blocked.HALO)), before=1, size=TICK_BLOCK)
    return got.select("symbol", F.col("seq").alias("event_id"), F.coalesce("duplicate_timestamps", F.lit(False)).alias("duplicate"), F.coalesce("unsorted", F.lit(False)).alias("unsorted"), r6("r"))


@query(sql.TICK_RUNNING)
def tick_running(spark, d):
    """Expanding scores and drawdowns over raw events: states carried over blocks."""
    rows = blocked.placed(ticks(spark, d), ["symbol"], TICK_ORDER)
    got = blocked.running(rows, ["symbol"], {"m": ("moments", "close"), "peak": ("max", "close")}, TICK_BLOCK)
    return got.select("symbol", "event_id", F.col("m_n").cast("long").alias("n"), r6(F.sqrt(F.col("m_m2") / F.col("m_n")), "deviation"), r6(blocked.zscore("m", "close", 180), "z_180"), r6(F.try_divide(F.col("close") - F.col("peak"), F.col("peak")), "drawdown"))


@query(sql.TICK_EQUITY)
def tick_equity(spark, d):
    """All strategies over raw events, a row each: fills, weights and equity carried over blocks."""
    got = backtest.run_in_blocks(ticks(spark, d), TICK_ORDER, size=TICK_BLOCK)
    return got.select("symbol", "strategy", "event_id", r6("before"), r6(F.ln("equity"), "log_equity"))


@query(sql.REL_STRENGTH)
def rel_strength_63(spark, d):
    base = calendar(spark, d).select("ts", F.col("close").alias("value")).withColumn("symbol", F.explode(F.array(*[F.lit(a) for a in ALTS])))
    own = asof.asof(daily(spark, d).where(F.col("symbol").isin(*ALTS)).select("symbol", "ts", "close"), base, "vs", 5, by=["symbol"])
    w = by_symbol()
    own = ind.log_return(ind.log_return(own, "a", "close", w, 63), "b", "vs", w, 63)
    return own.select("symbol", day(), r6(F.col("a") - F.col("b"), "v"))


# --- as-of joins and slices ------------------------------------------------------------------------------------


@query(sql.ASOF_STALENESS)
def asof_staleness(spark, d):
    source = daily(spark, d).select("symbol", "ts", F.col("close").alias("value"))
    targets = calendar(spark, d).select("ts", F.explode(F.array(*[F.lit(s) for s in PRIORITIES])).alias("symbol"))
    two = asof.asof(targets, source, "within_2d", 2, by=["symbol"])
    both = asof.asof(two, source, "within_5d", 5, by=["symbol"])
    return both.select("symbol", day(), r6("within_2d"), r6("within_5d"))


@query(f"SELECT symbol, day, within_5d FROM ({sql.ASOF_STALENESS})")
def asof_stream(spark, d):
    """The as-of join replayed as a stream in three batches; what one symbol did in a summer comes a batch late."""
    source = daily(spark, d).select("symbol", "ts", F.col("close").alias("value"), F.lit(False).alias("is_target"))
    days = calendar(spark, d).select(F.explode(F.array(*[F.lit(s) for s in PRIORITIES])).alias("symbol"), "ts", F.lit(None).cast("double").alias("value"), F.lit(True).alias("is_target"))
    both = written(source.unionByName(days).withColumn("ts", F.col("ts").cast("timestamp")), "ticks")
    late = ~F.col("is_target") & (F.col("symbol") == "2-HIGH") & F.col("ts").between("1994-06-01", "1994-09-15")
    part = F.when(F.col("ts") < "1994-10-01", 0).when(F.col("ts") < "1996-01-01", 1).otherwise(2) + F.when(late, 1).otherwise(0)
    path = fresh_path(spark, "stream")
    for n in range(3):
        both.where(part == n).coalesce(1).write.mode("append").parquet(f"{path}/in")  # a file, and so a batch
    ticks_in = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = streamed.asof_stream(ticks_in.where("is_target"), ticks_in.where("not is_target"), 5, "600 days")
    streamed.run_available(out, f"{path}/out", f"{path}/checkpoint")
    got = streamed.latest(spark.read.parquet(f"{path}/out"))
    return got.select("symbol", day(), r6("value", "within_5d"))


@query(sql.with_bars("SELECT symbol, {day}, round(close,6) AS close FROM (SELECT * FROM bars WHERE symbol = '1-URGENT' AND ts <= TIMESTAMP '1997-06-15 12:00:00' ORDER BY ts DESC LIMIT 1)"))
def asof_lookup(spark, d):
    return asof.row_on(daily(spark, d).where("symbol = '1-URGENT'"), "1997-06-15 12:00:00").select("symbol", day(), r6("close"))


@query(sql.with_bars("SELECT symbol, {day}, round(close,6) AS close FROM bars WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"))
def slice_range(spark, d):
    return slicing.slice_range(daily(spark, d), "1996-01-01", "1996-12-31").select("symbol", day(), r6("close"))


@query(sql.with_bars("SELECT symbol, {day}, round(close,6) AS close FROM bars WHERE ts <= TIMESTAMP '1995-06-30'"))
def slice_until(spark, d):
    return slicing.slice_range(daily(spark, d), None, "1995-06-30").select("symbol", day(), r6("close"))


@query(sql.with_bars("SELECT symbol, {day}, round(close,6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 30"))
def tail(spark, d):
    return slicing.tail(daily(spark, d), 30).select("symbol", day(), r6("close"))


@query(sql.DOWNSAMPLE)
def downsample(spark, d):
    return slicing.downsample(daily(spark, d), 100).select("symbol", day(), r6("close"))


@query(sql.COHERENT)
def coherent_filter(spark, d):
    return broken_bars(spark, d).where(quality.is_coherent()).select("symbol", day(), r6("close"), F.col("volume"))


@query(sql.CALENDAR_SYNC)
def calendar_sync(spark, d):
    """Positions at which one symbol's days leave the calendar."""
    found = slicing.calendar_difference(calendar(spark, d), daily(spark, d).where("symbol = '2-HIGH'"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return found.select(F.col("pos").cast("long").alias("pos"), text("left_ts").alias("calendar_day"), text("right_ts").alias("symbol_day"))


# --- quality and lake ------------------------------------------------------------------------------------------


def broken_bars(spark, d) -> DataFrame:
    """Daily bars in order of arrival with planted faults: rows whose hash says so lose a price or a sign, some arrive twice."""
    bars = daily(spark, d).withColumn("k", F.dayofyear("ts"))
    bars = bars.withColumn("seq", F.row_number().over(by_symbol()).cast("long") * 2)
    bars = bars.withColumns({
        "close": F.when((F.col("symbol") == "1-URGENT") & (F.col("k") % 97 == 0), F.lit(float("nan"))).when((F.col("symbol") == "2-HIGH") & (F.col("k") % 89 == 0), -F.col("close")).otherwise(F.col("close")),
        "high": F.when((F.col("symbol") == "3-MEDIUM") & (F.col("k") % 83 == 0), F.col("low") - 1).otherwise(F.col("high")),
        "volume": F.when((F.col("symbol") == "3-MEDIUM") & (F.col("k") % 101 == 0), -F.col("volume")).otherwise(F.col("volume")),
    })
    again = bars.where((F.col("symbol") == "5-LOW") & (F.col("k") % 79 == 0)).withColumn("seq", F.col("seq") + 1)
    return bars.unionByName(again)


@query(sql.QUALITY_REPORT)
def quality_report(spark, d):
    got = quality.report(broken_bars(spark, d))
    counts = [F.col(c).cast("long").alias(c) for c in (*quality.ERRORS, *quality.WARNINGS)]
    return got.select("symbol", "n_rows", *counts, r6("sigma"), r6("flat_share"), "passed", "reason")


@query(sql.QUARANTINE)
def quarantine(spark, d):
    bars = broken_bars(spark, d)
    return quality.gate(bars, quality.report(bars)).groupBy("symbol").agg(F.count("*").alias("n_rows"), r6(F.sum("volume"), "volume"))


@query(sql.INGEST_COUNTERS)
def ingest_counters(spark, d):
    """All symbols of the universe are asked for, so those that are never traded fail."""
    asked = universe(spark, d).select(F.col("ticker").alias("symbol"))
    return quality.ingest_counters(quality.report(broken_bars(spark, d), symbols=asked))


@query(sql.QUALITY_FINDINGS)
def quality_findings(spark, d):
    """Findings with their first three times, of one more series that stands still and of symbols without rows."""
    asked = universe(spark, d).select(F.col("ticker").alias("symbol"))
    still = daily(spark, d).where("symbol = '1-URGENT'").withColumns({"symbol": F.lit("STILL"), **{c: F.lit(5.0) for c in quality.PRICES}, "k": F.lit(0), "seq": F.unix_seconds(F.col("ts").cast("timestamp"))})
    got = quality.report(broken_bars(spark, d).unionByName(still), symbols=asked)
    text = F.array_join(F.transform("f.samples", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ",")
    return got.select("symbol", "passed", F.explode_outer("findings").alias("f")).select("symbol", "passed", "f.check", "f.severity", "f.message", "f.count", text.alias("samples"))


@query(sql.TICK_QUALITY)
def tick_quality(spark, d):
    """All checks over raw events in order of their ids, where prices below zero are faults and one type's times are coarse."""
    own = ticks(spark, d).withColumn("close", F.when(F.col("event_id") % 997 == 0, -F.col("close")).when(F.col("event_id") % 991 == 0, F.lit(float("nan"))).otherwise(F.col("close")))
    own = own.withColumns({"ts": F.when(F.col("symbol") == "view", F.date_trunc("day", "ts").cast("timestamp_ntz")).otherwise(F.col("ts")), "open": F.abs("close"), "high": F.abs("close"), "low": F.col("close"), "volume": F.lit(1.0)})
    got = quality.report_in_blocks(own, "event_id", size=TICK_BLOCK)
    counts = [F.col(c).cast("long").alias(c) for c in (*quality.ERRORS, *quality.WARNINGS)]
    return got.select("symbol", "n_rows", *counts, r6("sigma"), r6("flat_share"), "passed")


@query(sql.TICK_FOLD)
def tick_fold(spark, d):
    """A strategy as a fold over events: long while the price is over an average that forgets a tenth at each step."""

    def update(mean, bar):
        mean = bar["close"] if mean is None else 0.9 * mean + 0.1 * bar["close"]
        return mean, bar["close"] > mean

    own = ticks(spark, d).withColumn("ts", F.struct("ts", "event_id"))
    return backtest.fold_signal(own.select("symbol", "ts", "event_id", "close"), "fold", lambda: None, update).groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(F.col("long_fold"), 1)).alias("n_long"))


def two_fetches(spark, d) -> tuple[DataFrame, DataFrame]:
    bars = daily(spark, d).withColumns({"tf": F.lit("1d"), "fetched_at": F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"), "source": F.lit("first")})
    month = F.month("ts")
    later = bars.where(month % 2 == 0).withColumns({
        "close": F.col("close") + 1,
        "fetched_at": F.when(month % 4 == 0, F.lit("2002-02-01 00:00:00").cast("timestamp_ntz")).when(month % 3 == 0, F.col("fetched_at")).otherwise(F.lit("2001-12-01 00:00:00").cast("timestamp_ntz")),
        "source": F.lit("second"),
    })
    return bars, later


@query(sql.UPSERT)
def upsert_latest(spark, d):
    return lake.latest_wins(*two_fetches(spark, d)).select("symbol", day(), r6("close"), "source")


def upserted_lake(spark, d) -> str:
    """A lake to which both fetches are written, the second in three parts; built once per application and set of input files."""
    path = derived_path(spark, d, ("orders",), "lake")
    if not lake.has(spark, path):
        early, later = two_fetches(spark, d)
        stamp = {"source": F.col("source"), "latency": F.lit("EOD")}
        lake.write_bars(early.withColumns(stamp), path, rows_per_file=500)
        for part in (F.col("symbol") < "2", F.col("symbol").between("2", "4"), F.col("symbol") > "4"):
            lake.write_bars(later.where(part).withColumns(stamp), path, rows_per_file=500)
        lake.compact(spark, path, rows_per_file=1000)
    return path


@query(sql.UPSERT)
def lake_upsert(spark, d):
    """The merged rows as the lake's log gives them, after four writes and a compaction."""
    return lake.read_all(spark, upserted_lake(spark, d)).select("symbol", day(), r6("close"), "source")


@query(sql.with_bars("SELECT symbol, {day}, round(close,6) AS close FROM bars WHERE symbol = '2-HIGH' AND ts BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-31'"))
def lake_snapshot(spark, d):
    """A slice of one series as of the first version; files outside it are left out by the log."""
    return lake.read_bars(spark, upserted_lake(spark, d), "2-HIGH", start="1996-03-01", end="1996-05-31", version=1).select("symbol", day(), r6("close"))


@query(sql.with_bars("SELECT symbol, CAST(count(*) AS BIGINT) AS n_rows, strftime(min(ts),'%Y-%m-%d') AS start_day, strftime(max(ts),'%Y-%m-%d') AS end_day FROM bars GROUP BY 1"))
def lake_manifest(spark, d):
    """Rows, first and last day by the log alone."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return lake.stored_manifest(spark, upserted_lake(spark, d)).select("symbol", "n_rows", text("start").alias("start_day"), text("end").alias("end_day"))


@query(sql.with_bars("SELECT symbol, CAST(count(*) AS BIGINT) AS n_rows, strftime(min(ts),'%Y-%m-%d') AS start_day, strftime(max(ts),'%Y-%m-%d') AS end_day FROM bars GROUP BY 1"))
def manifest(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return lake.manifest(daily(spark, d)).select("symbol", "n_rows", text("start").alias("start_day"), text("end").alias("end_day"))


def universe(spark, d) -> DataFrame:
    """A symbol dimension: five traded priorities and one per region that is never traded."""
    traded = table(spark, d, "orders").select(F.col("o_orderpriority").alias("ticker")).distinct().select("ticker", F.lit("ORDERS").alias("exchange"), F.lit("PRIORITY").alias("asset_class"))
    idle = table(spark, d, "region").select(F.col("r_name").alias("ticker"), F.lit("REGIONS").alias("exchange"), F.lit("REGION").alias("asset_class"))
    own = traded.unionByName(idle)
    return own.withColumn("provider_tickers", F.when(F.col("asset_class") == "PRIORITY", F.create_map(F.lit("orders"), F.lower("ticker"))).otherwise(F.create_map(F.lit("geo"), F.col("ticker"))))


@query(sql.COVERAGE)
def coverage(spark, d):
    got = lake.coverage(universe(spark, d), lake.manifest(daily(spark, d)))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return got.select("ticker", "n_rows", text("start").alias("start_day"), text("end").alias("end_day"), "latency")


@query("SELECT ticker, exchange, lower(ticker) AS provider_ticker FROM (SELECT DISTINCT o_orderpriority AS ticker, 'ORDERS' AS exchange FROM orders)")
def symbol_filter(spark, d):
    got = slicing.by_provider(slicing.by_class(universe(spark, d), "PRIORITY"), "orders")
    return got.select("ticker", "exchange", F.element_at("provider_tickers", "orders").alias("provider_ticker"))


def provenance_rows(spark, d) -> DataFrame:
    events = table(spark, d, "events")
    day = F.date_trunc("day", "ts")
    return events.select(
        "event_type", (F.col("user_id") % 6).cast("int").alias("latency"), day.cast("timestamp_ntz").alias("as_of"), F.col("ts").alias("fetched_at"),
        F.array(F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))).alias("sources"), (F.col("event_id") % 1000 == 0).alias("is_cached"),
        F.when(F.col("event_id") % 500 == 0, F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string"))).otherwise("").alias("note"),
    )


@query(sql.PROVENANCE)
def provenance_combine(spark, d):
    got = provenance.combine(provenance_rows(spark, d), ["event_type"])
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return got.select("event_type", provenance.latency_label(F.col("latency")).alias("latency"), text("as_of").alias("as_of"), text("fetched_at").alias("fetched_at"), F.array_join("sources", ",").alias("sources"), "is_cached", "note")


@query(sql.AVAILABILITY)
def availability(spark, d):
    got = provenance.combine(provenance_rows(spark, d).where("latency < 5 or event_type = 'click'"), ["event_type"])
    return got.select("event_type", provenance.is_available(F.lit(1), F.col("latency")).alias("available"))


# --- state vector and regimes ----------------------------------------------------------------------------------


def _matrix_columns(m: DataFrame) -> list:
    return [r6(c) for c in m.columns if c not in ("ts", "complete")]


@query(sql.matrix("SELECT {day}, {rounded}, complete FROM m"))
def state_vector(spark, d):
    m = matrix(spark, d)
    return m.select(day(), *_matrix_columns(m), "complete")


@query(sql.matrix("SELECT {day}, {rounded}, complete FROM m"))
def state_vector_update(spark, d):
    """A matrix of what was known at first, brought up to date: later rows, and two months of levels that came late."""
    spec, rows = features.default_spec(ALTS), written(all_series(spark, d), "series")
    late = (F.col("ts") >= F.lit("1997-03-10").cast("timestamp_ntz")) | (F.col("symbol").isin("VIX", "F") & (F.col("ts") >= F.lit("1997-01-07").cast("timestamp_ntz")))
    known = rows.where(~late)
    first = written(features.state_vector(known, spec), "first")
    states = written(features.block_states(first, known, spec), "first-states")
    m = features.update(first, states, rows, spec, features.changed_since(rows.where(late)))
    return m.select(day(), *_matrix_columns(m), "complete")


@query(sql.matrix("SELECT {day}, {rounded}, complete FROM m WHERE ts <= TIMESTAMP '1997-06-15 12:00:00' ORDER BY ts DESC LIMIT 1"))
def snapshot(spark, d):
    m = asof.row_on(saved_matrix(spark, d), "1997-06-15 12:00:00")
    return m.select(day(), *_matrix_columns(m), "complete")


@query(sql.matrix("SELECT {day} FROM m WHERE usable"))
def usable_rows(spark, d):
    return features.usable(saved_matrix(spark, d)).select(day())


TRACKED_ALTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "NOWHERE")


def tracked_series(spark, d) -> DataFrame:
    """All series with an origin for each row: bars from two sources, late rows of one symbol, levels that come with a delay."""
    own = all_series(spark, d)
    k, level = F.dayofyear("ts"), F.col("symbol").isin("DXY", "VIX", "US10Y")
    latency = F.when(level, "DELAYED").when((F.col("symbol") == "2-HIGH") & (k % 50 == 0) & (F.year("ts") >= 1996), "HISTORICAL").when(F.col("kind") == "funding", "LIVE").otherwise("EOD")
    source = F.when(level, "context").when(F.col("kind") == "funding", "venue").when(k % 2 == 0, "exchange").otherwise("archive")
    return own.withColumns({"source": source, "latency": latency, "fetched_at": F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")})


@query(sql.FEATURE_PROVENANCE)
def state_vector_provenance(spark, d):
    """Where each feature and the matrix came from; one of the other coins isn't there."""
    spec, rows = features.default_spec(TRACKED_ALTS), tracked_series(spark, d)
    found = features.matrix_provenance(rows, features.state_vector(rows, spec), spec)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    note = F.when(F.col("feature") == features.WHOLE, F.substring_index("note", ";", 1)).otherwise(F.col("note"))
    return found.select("feature", provenance.latency_label(F.col("latency")).alias("latency"), text("as_of"), text("fetched_at"), F.array_join("sources", ",").alias("sources"), "is_cached", note.alias("note"))


@query(sql.provenance_by_day("SELECT day, feature, latency, as_of, fetched_at FROM tracked"))
def provenance_by_day(spark, d):
    """For each day, the row that each value was taken from and the worst of what is behind it, and the day as a whole."""
    spec = features.default_spec(ALTS)
    m = features.state_vector(tracked_series(spark, d), spec, tracked=True)
    each = [F.struct(F.lit(n).alias("feature"), F.col(f"{n}__from").alias("p")) for n in spec.names]
    whole = F.struct(F.lit(features.WHOLE).alias("feature"), F.struct("provenance.as_of", "provenance.latency", "provenance.fetched_at").alias("p"))
    long = m.select("ts", F.explode(F.array(*each, whole)).alias("x"))
    text = lambda c: F.date_format(f"x.p.{c}", "yyyy-MM-dd HH:mm:ss").alias(c)
    return long.select(day(), "x.feature", provenance.latency_label(F.col("x.p.latency")).alias("latency"), text("as_of"), text("fetched_at"))


CALL = ("trend", "volatility", "positioning", "alt_rotation", "breadth", "confidence", "label")


@query(sql.regime("SELECT {day}, trend, volatility, positioning, alt_rotation, breadth, confidence, label, n_evidence FROM calls WHERE usable"))
def regime_history(spark, d):
    return regime.history(saved_matrix(spark, d)).select(day(), *CALL, F.size("evidence").cast("long").alias("n_evidence"))


@query(sql.REGIME_EVIDENCE)
def regime_evidence(spark, d):
    """What each call rests on, for every day and not only the usable ones."""
    return regime.classify(saved_matrix(spark, d)).select(day(), F.posexplode("evidence").alias("pos", "e")).select("day", "pos", "e.*")


@query(sql.regime("SELECT {day}, trend, volatility, positioning, alt_rotation, breadth, confidence, label FROM calls WHERE ts <= TIMESTAMP '1998-03-01' ORDER BY ts DESC LIMIT 1"))
def regime_latest(spark, d):
    return regime.latest(saved_matrix(spark, d), "1998-03-01").select(day(), *CALL)


@query(sql.regime("SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(confidence),4) AS mean_confidence FROM calls WHERE usable GROUP BY 1"))
def regime_counts(spark, d):
    return regime.history(saved_matrix(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


# --- analogues -------------------------------------------------------------------------------------------------

TWO = ["btc_trend_200d__z", "btc_mom_63d__z"]
AS_OF = "2001-01-15"


def pool_of_two(spark, d) -> tuple[DataFrame, object]:
    rows = analogue.numbered(saved_matrix(spark, d).select("ts", "complete", *TWO))
    ready = rows.where(" and ".join(f"{c} is not null" for c in TWO))
    q = ready.where(F.col("ts") <= F.lit(AS_OF).cast("timestamp_ntz")).orderBy(F.desc("ts")).limit(1).first()
    return (analogue.candidates(ready, q["row_idx"]) if q is not None else ready.limit(0)), q


def distances_of_two(spark, d) -> DataFrame:
    pool, q = pool_of_two(spark, d)
    if q is None:
        return pool.withColumn("distance", F.lit(None).cast("double"))
    return analogue.distances(pool, TWO, [q[c] for c in TWO])


def anchors_of_two(spark, d) -> DataFrame:
    kept = analogue.episodes(distances_of_two(spark, d))
    m = analogue.numbered(calendar(spark, d))
    with_returns = analogue.with_forward_returns(m)
    return kept.join(with_returns.select("row_idx", "ts", *[f"fwd_{h}" for h in analogue.HORIZONS]), "row_idx")


@query(sql.two("SELECT {day} FROM pool"))
def candidate_guard(spark, d):
    return pool_of_two(spark, d)[0].select(day())


@query(sql.two("SELECT CAST(count(*) AS BIGINT) AS n, round(covar_samp(a,a),6) AS c00, round(covar_samp(a,b),6) AS c01, round(covar_samp(b,b),6) AS c11 FROM pool"))
def cov_saved_matrix(spark, d):
    a, b = TWO
    return pool_of_two(spark, d)[0].agg(F.count("*").alias("n"), r6(F.covar_samp(a, a), "c00"), r6(F.covar_samp(a, b), "c01"), r6(F.covar_samp(b, b), "c11"))


@query(sql.two("SELECT {day}, round(distance,6) AS distance FROM dist"))
def mahalanobis_2f(spark, d):
    return distances_of_two(spark, d).select(day(), r6("distance"))


@query(sql.episodes("SELECT {day}, CAST(row_idx AS BIGINT) AS row_idx, round(distance,6) AS distance, CAST(rank AS INTEGER) AS rank FROM kept"))
def episodes(spark, d):
    return anchors_of_two(spark, d).select(day(), F.col("row_idx").cast("long").alias("row_idx"), r6("distance"), F.col("rank").cast("int").alias("rank"))


@query(sql.WALK_FORWARD)
def walk_forward(spark, d):
    """For every day its five nearest earlier days, each under the covariance of what was known then."""
    got = analogue.walk_forward(saved_matrix(spark, d), TWO)
    return got.select("query_idx", F.col("rank").cast("int").alias("rank"), "row_idx", r6("distance"), "n")


@query(sql.episodes("SELECT {day}, CAST(row_idx AS BIGINT) AS row_idx, round(distance,6) AS distance, CAST(rank AS INTEGER) AS rank FROM kept"))
def episodes_distributed(spark, d):
    """The same episodes, collapsed block by block."""
    kept = analogue.episodes_in_blocks(distances_of_two(spark, d), block=128)
    days = analogue.numbered(calendar(spark, d)).select("row_idx", "ts")
    return kept.join(days, "row_idx").select(day(), "row_idx", r6("distance"), "rank")


@query(sql.HORIZON_QUANTILES)
def horizon_quantiles(spark, d):
    return analogue.horizon_stats(anchors_of_two(spark, d)).select("horizon", "n", r6("p25"), r6("median"), r6("p75"))


@query()
def bootstrap_ci(spark, d):
    """Seeded draws have no SQL equivalent; tested against the same draws in plain Python."""
    return analogue.bootstrap_ci(anchors_of_two(spark, d))


@query(sql.MAHALANOBIS_16)
def mahalanobis_16(spark, d):
    """All sixteen scores."""
    found = analogue.find_analogues(saved_matrix(spark, d), calendar(spark, d), AS_OF)
    return found.select(day(), F.col("row_idx").cast("long").alias("row_idx"), r6("distance"), F.col("rank").cast("int").alias("rank"), *[r6(f"fwd_{h}") for h in analogue.HORIZONS])


# --- backtests -------------------------------------------------------------------------------------------------


FUNDED_BY = {"1-URGENT": "O", "2-HIGH": "O", "3-MEDIUM": "F", "4-NOT SPECIFIED": "F"}


def prints(spark, d) -> DataFrame:
    """Funding by traded symbol: two symbols share each of the two funding series, one has none."""
    own = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(f).alias("funding")) for s, f in FUNDED_BY.items()])
    raw = series.funding(table(spark, d, "lineitem")).withColumnRenamed("symbol", "funding")
    return raw.select("*", F.explode(F.filter(own, lambda x: x["funding"] == F.col("funding"))).alias("x")).select("x.symbol", "ts", "close")


def decided(spark, d) -> DataFrame:
    return backtest.decisions(daily(spark, d), prints(spark, d))


def _signal(name: str):
    def run(spark, d):
        return backtest.signals(daily(spark, d), prints(spark, d)).select("symbol", day(), F.col(f"long_{name}").alias("is_long"))

    run.__name__ = f"sig_{name}"
    query(sql.backtest(f"SELECT symbol, {{day}}, long_{name} AS is_long FROM sig"))(run)


for _name in backtest.STRATEGIES:
    _signal(_name)


@query(sql.backtest("SELECT symbol, {day}, round(vol,6) AS vol, round(size,6) AS size FROM sig"))
def risk_weight(spark, d):
    return backtest.weights(daily(spark, d)).select("symbol", day(), r6("vol"), r6("size"))


@query(sql.backtest("SELECT symbol, strategy, {day}, round(ln(equity),6) AS log_equity FROM eq"))
def backtest_equity(spark, d):
    return backtest.run(decided(spark, d)).select("symbol", "strategy", day(), r6(F.ln("equity"), "log_equity"))


@query(sql.backtest("SELECT symbol, strategy, strftime(entry_ts,'%Y-%m-%d') AS entry_day, strftime(exit_ts,'%Y-%m-%d') AS exit_day, round(weight,6) AS weight, round(pnl,6) AS pnl FROM ledger"))
def trade_ledger(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    got = backtest.trades(backtest.run(decided(spark, d)))
    return got.select("symbol", "strategy", text("entry_ts").alias("entry_day"), text("exit_ts").alias("exit_day"), r6("weight"), r6("pnl"))


@query(sql.BACKTEST_METRICS)
def backtest_metrics(spark, d):
    got = backtest.metrics(backtest.run(decided(spark, d)))
    return got.withColumn("log_growth", F.round(F.ln(F.col("total_return") + 1), 6)).drop("total_return")  # totals here reach 17 digits

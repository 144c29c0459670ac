"""Quality checks on raw bars, and the gate that keeps failing series out of the lake.

Windows over each series compute flags per row, medians and running counts after a single shuffle; one aggregation turns
them into counts. ERROR checks quarantine the whole series; WARNING checks only report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from driftglass.functions import blocked
from driftglass.session import written

ERRORS = ("duplicate_timestamps", "unsorted", "non_finite_close", "non_positive_price", "ohlc_violation", "negative_volume")
WARNINGS = ("extreme_move", "stale_series")
SIGMAS = 12.0
#: What a finding says; the share of stale_series stands before its text.
MESSAGES = {
    "empty": "no rows came", "duplicate_timestamps": "a time occurs more than once", "unsorted": "times go back", "non_finite_close": "closing prices that are no numbers",
    "non_positive_price": "closing prices of zero or less", "ohlc_violation": "high and low leave out open or close", "negative_volume": "volume below zero",
    "extreme_move": f"moves of more than {SIGMAS:g} sigma", "stale_series": " % of the steps don't move",
}
FLAT_SHARE = 0.30
MAD_SCALE = 1.4826
LEAST_RETURNS = 30  # moves and staleness are judged on more returns than this
SAMPLES = 3
PRICES = ("open", "high", "low", "close")


def finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))


def is_coherent() -> Column:
    """All prices finite, low and high around open and close, volume not negative."""
    ok = F.col("volume") >= 0
    for p in PRICES:
        ok = ok & finite(p)
    return F.coalesce(ok & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("high") >= F.col("low")), F.lit(False))


def flags(bars: DataFrame, sequence: str = "seq", allow_negative: Column | bool = False, w: WindowSpec | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per-row flags and ``r``, the one-step log return; ``sequence`` is the order in which rows arrived, ``w`` its window if not the whole series'."""
    w = w or Window.partitionBy("symbol").orderBy(sequence)
    before, close = F.lag("ts").over(w), F.when(finite("close"), F.col("close"))
    ratio = F.try_divide(close, F.lag(close).over(w))
    allowed = allow_negative if isinstance(allow_negative, Column) else F.lit(allow_negative)
    all_finite = F.lit(True)
    for p in PRICES:
        all_finite = all_finite & finite(p)
    broken = (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")) | (F.col("high") < F.col("low"))
    return bars.select(
        "symbol", "ts", F.col(sequence).alias("seq"), *keep,
        (F.col("ts") == before).alias("duplicate_timestamps"), (F.col("ts") < before).alias("unsorted"),
        (~finite("close")).alias("non_finite_close"), (finite("close") & (F.col("close") <= 0) & ~allowed).alias("non_positive_price"),
        (all_finite & broken).alias("ohlc_violation"), (F.col("volume") < 0).alias("negative_volume"),
        F.when(ratio > 0, F.ln(ratio)).alias("r"), before.isNotNull().alias("has_before"),
    )


def with_median(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the exact median of the present values per symbol, from the middle of a sort that may spill, and their number ``n_r``."""
    whole = Window.partitionBy("symbol")
    df = df.withColumn("n_r", F.count(value).over(whole)).withColumn("__k", F.row_number().over(whole.orderBy(F.asc_nulls_last(value))))
    middle = F.col("__k").between(F.floor((F.col("n_r") + 1) / 2), F.floor((F.col("n_r") + 2) / 2)) & F.col(value).isNotNull()
    return df.withColumn(out, F.avg(F.when(middle, F.col(value))).over(whole)).drop("__k")


def medians(df: DataFrame, by: list[str], value: str, size: int = blocked.SIZE) -> DataFrame:
    """Per key the exact ``median`` of the present values and their number ``n``, for series that no task should hold.

    Equal values become one row with their number before the shuffle, distinct ones are sorted by range, and numbers so far run over
    blocks, so a key with most of the rows, or a value with most of a key's, is spread or added up.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__k"))
    so_far = blocked.running(blocked.placed(counted, by, ["__v"]), by, {"__to": ("sum", "__k")}, size)
    whole = counted.groupBy(*by).agg(F.sum("__k").alias("n"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    holds = lambda place: (F.col("__to") >= place) & (F.col("__to") - F.col("__k") < place)
    middle = so_far.join(whole, by).where(holds(low) | holds(high))
    at = lambda place: F.max(F.when(holds(place), F.col("__v")))
    return middle.groupBy(*by, "n").agg(((at(low) + at(high)) / 2).alias("median"))


def report_in_blocks(bars: DataFrame, sequence: str, allow_negative: Column | bool = False, size: int = blocked.SIZE) -> DataFrame:
    """The counts of ``report``, ``n_rows``, ``sigma``, ``flat_share`` and ``passed`` for long series: rows in blocks, medians by range, no task that holds a series."""
    own = blocked.over_blocks(bars, ["symbol"], [sequence], lambda b, w: flags(b, sequence, allow_negative, w, (blocked.BLOCK, blocked.HALO)), 1, 0, size)
    f = written(own, "flags")
    centre = written(medians(f, ["symbol"], "r", size), "centre")
    off = f.join(centre.select("symbol", F.col("median").alias("centre")), "symbol").withColumn("off", F.abs(F.col("r") - F.col("centre")))
    mad = medians(off, ["symbol"], "off", size).select("symbol", F.col("median").alias("mad"))
    spread = f.groupBy("symbol").agg(F.stddev_pop("r").alias("sd"), F.count("r").alias("n_r"))
    sigma = written(spread.join(mad, "symbol", "left").select("symbol", "n_r", F.when(F.col("mad") > 0, F.col("mad") * MAD_SCALE).otherwise(F.col("sd")).alias("sigma")), "sigma")
    f = f.join(sigma, "symbol").withColumn("extreme_move", (F.col("n_r") > LEAST_RETURNS) & (F.col("sigma") > 0) & (F.abs("r") > SIGMAS * F.col("sigma")))
    counts = [F.count(F.when(F.col(c), 1)).alias(c) for c in (*ERRORS, "extreme_move")]
    flat = F.count(F.when(F.abs("r") < 1e-12, 1)) / F.nullif(F.count(F.when(F.col("has_before"), 1)), F.lit(0))
    out = f.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.max("sigma").alias("sigma"), F.max("n_r").alias("n_r"), flat.alias("flat_share"), *counts)
    out = out.withColumn("stale_series", F.when((F.col("n_r") > LEAST_RETURNS) & (F.col("flat_share") > FLAT_SHARE), 1).otherwise(0))
    passed = F.lit(True)
    for c in ERRORS:
        passed = passed & (F.col(c) == 0)
    return out.withColumn("passed", passed).drop("n_r")


def report(bars: DataFrame, sequence: str = "seq", allow_negative: Column | bool = False, symbols: DataFrame | None = None) -> DataFrame:
    """Per symbol: counts of every check, ``n_rows``, ``sigma``, ``flat_share``, ``passed``, ``findings`` with up to three sample times, ``reason``.

    ``symbols`` (column ``symbol``) are those that were asked for: one without rows fails as ``empty``. All windows are
    partitioned by symbol, so the bars are shuffled once; of flagged rows only the first three are gathered.
    """
    whole, w = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    f = with_median(flags(bars, sequence, allow_negative), "r", "centre").withColumn("sd", F.stddev_pop("r").over(whole))
    f = with_median(f.withColumn("__off", F.abs(F.col("r") - F.col("centre"))), "__off", "mad")
    f = f.withColumn("sigma", F.when(F.col("mad") > 0, F.col("mad") * MAD_SCALE).otherwise(F.col("sd")))
    f = f.withColumn("extreme_move", (F.col("n_r") > LEAST_RETURNS) & (F.col("sigma") > 0) & (F.abs("r") > SIGMAS * F.col("sigma")))
    checks = (*ERRORS, "extreme_move")
    f = f.withColumns({f"{c}__n": F.count(F.when(F.col(c), 1)).over(w) for c in checks})
    counts = [F.count(F.when(F.col(c), 1)).alias(c) for c in checks]
    samples = [F.array_sort(F.collect_list(F.when(F.col(c) & (F.col(f"{c}__n") <= SAMPLES), F.struct("seq", "ts")))).alias(f"{c}__at") for c in checks]
    still = F.count(F.when(F.abs("r") < 1e-12, 1))
    flat = still / F.nullif(F.count(F.when(F.col("has_before"), 1)), F.lit(0))
    out = f.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.max("sigma").alias("sigma"), F.max("n_r").alias("n_r"), flat.alias("flat_share"), still.alias("still"), *counts, *samples)
    out = out.withColumn("stale_series", F.when((F.col("n_r") > LEAST_RETURNS) & (F.col("flat_share") > FLAT_SHARE), 1).otherwise(0)).withColumn("empty", F.lit(0))
    if symbols is not None:
        none = F.coalesce("n_rows", F.lit(0)) == 0
        out = symbols.select("symbol").distinct().join(out, "symbol", "full").withColumn("empty", F.when(none, 1).otherwise(0))
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "still", "stale_series", *checks)})
    passed = F.lit(True)
    for c in ("empty", *ERRORS):
        passed = passed & (F.col(c) == 0)
    no_times = F.array().cast("array<timestamp_ntz>")

    def finding(check: str, count: Column, times: Column) -> Column:
        severity = "WARNING" if check in WARNINGS else "ERROR"
        says = F.lit(MESSAGES[check])
        if check == "stale_series":
            says = F.concat(F.floor(F.col("flat_share") * 100 + 0.5).cast("string"), says)
        return F.when(F.col(check) > 0, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), says.alias("message"), count.cast("long").alias("count"), times.alias("samples")))

    found = [finding("empty", F.lit(0), no_times)]
    for c in checks:  # of a series that isn't sorted it is said that it isn't, not where
        count, times = (F.lit(0), no_times) if c == "unsorted" else (F.col(c), F.coalesce(F.transform(f"{c}__at", lambda x: x["ts"]), no_times))
        found.append(finding(c, count, times))
    found.append(finding("stale_series", F.col("still"), no_times))
    reason = F.concat_ws("; ", F.when(F.col("empty") > 0, F.lit("empty(0)")), *[F.when(F.col(c) > 0, F.concat(F.lit(f"{c}("), F.lit("0") if c == "unsorted" else F.col(c).cast("string"), F.lit(")"))) for c in ERRORS])
    kept = [c for c in out.columns if not c.endswith("__at") and c not in ("still", "n_r")]
    return out.withColumns({"passed": passed, "findings": F.array_compact(F.array(*found)), "reason": reason}).select(*kept, "passed", "findings", "reason")


def gate(bars: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of series that passed."""
    return bars.join(verdict.where(~F.col("passed")).select("symbol"), "symbol", "left_anti")


def ingest_counters(verdict: DataFrame) -> DataFrame:
    """Series requested, written, failed (no rows came) and quarantined, and rows written."""
    ok, none = F.when(F.col("passed"), 1).otherwise(0), F.when(F.col("n_rows") == 0, 1).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return verdict.agg(
        F.count("*").alias("requested"), total(ok).alias("succeeded"), total(none).alias("failed"), total(1 - ok - none).alias("quarantined"),
        total(F.when(F.col("passed"), F.col("n_rows")).otherwise(0)).alias("rows_written"),
    )

"""Entry points over a lake: what the services and commands of a market application ask for, as functions that return tables."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.operators import analogue, asof, backtest, features, provenance, quality, regime, slicing
from driftglass.sources import fetch
from driftglass.sources import lake as store
from driftglass.sources.lake import DataUnavailable

KINDS = ("bars", "funding", "open_interest")


def limited(n: int, least: int, most: int) -> int:
    """``n``, refused outside its bounds."""
    if not least <= n <= most:
        raise ValueError(f"max_points is {least} to {most}, not {n}")
    return n


def status(spark: SparkSession, lake: str, breakers: dict | None = None) -> dict:
    """State of the providers' breakers, files and bytes of the lake."""
    return {"breakers": {k: b.state for k, b in (breakers or {}).items()}, "lake": store.stats(spark, lake)}


def stored(spark: SparkSession, lake: str, kind: str = "bars") -> DataFrame:
    """All series of a kind."""
    if kind not in KINDS or not store.has(spark, lake, kind):
        raise DataUnavailable(kind)
    return store.read_all(spark, lake, kind)


def coverage(spark: SparkSession, lake: str, symbols: DataFrame) -> DataFrame:
    """From the log: no data is read."""
    if not store.has(spark, lake):
        raise DataUnavailable("bars")
    listed = store.stored_manifest(spark, lake).groupBy("symbol").agg(F.sum("n_rows").alias("n_rows"), F.min("start").alias("start"), F.max("end").alias("end"))
    return store.coverage(symbols, listed)


def bars(spark: SparkSession, lake: str, symbol: str, kind: str = "bars", tf: str = "1d", start: str | None = None, end: str | None = None, max_points: int = 1000) -> DataFrame:
    """One series, thinned evenly to at most ``max_points`` rows (10 to 20000)."""
    limited(max_points, 10, 20000)
    if kind not in KINDS:
        raise DataUnavailable(kind)
    found = store.read_bars(spark, lake, symbol, tf, kind, start, end)
    if found.isEmpty():
        raise DataUnavailable(symbol)
    return slicing.downsample(found, max_points).orderBy("ts")


def ingest(incoming: DataFrame, lake: str, kind: str = "bars", sequence: str = "seq", symbols: DataFrame | None = None) -> DataFrame:
    """Check, quarantine, upsert. Returns the verdict per symbol, which is stored beside the series; failing series are not written.

    ``symbols`` are those that were asked for; one without rows fails as empty.
    """
    spark = incoming.sparkSession
    path = f"{lake}/quality/{kind}/run={uuid.uuid4().hex}"
    quality.report(incoming, sequence, allow_negative=kind != "bars", symbols=symbols).write.parquet(path)
    verdict = spark.read.parquet(path)
    if not verdict.where("passed").isEmpty():
        store.write_bars(quality.gate(incoming, verdict), lake, kind)
    return verdict


@dataclass(frozen=True)
class Provider:
    """A provider that is asked if those before it gave nothing. ``options`` has its ``url``, maybe ``limit`` and ``time``."""

    name: str
    symbols: dict[str, str]
    parse: Callable[[DataFrame], DataFrame]
    options: dict = field(default_factory=dict)
    latency: str = "EOD"


@dataclass(frozen=True)
class Backfill:
    """One kind of series of several symbols from one provider, or from ``fallbacks`` where it fails. ``symbols`` maps tickers to the provider's spelling."""

    kind: str
    provider: str
    symbols: dict[str, str]
    parse: Callable[[DataFrame], DataFrame]
    options: dict = field(default_factory=dict)
    years: int = 15
    latency: str = "EOD"
    tf: str = "1d"
    fallbacks: tuple[Provider, ...] = ()


def window(end: dt.datetime, years: int) -> tuple[int, int]:
    """The time a backfill covers, in milliseconds: so many years and ten days."""
    start = end - dt.timedelta(days=365 * years + 10)
    return tuple(int(t.replace(tzinfo=t.tzinfo or dt.UTC).timestamp() * 1000) for t in (start, end))


CHOICE = ("url", "limit", "time")


def backfill(spark: SparkSession, lake: str, jobs: list[Backfill], end: dt.datetime) -> DataFrame:
    """Fetch, check and store all jobs. Per job and symbol: ``job``, ``kind``, ``symbol``, ``status``, ``n_rows``, ``reason``, ``provider``, ``note``, ``attempts``.

    ``status`` is succeeded, quarantined (a check failed) or failed (the provider's error, or no rows); one symbol's failure leaves the others alone.
    A series from a fallback has that provider's name and latency, and ``note`` says whom it stands in for; ``attempts`` lists all that were asked, in
    order. Pages are stored before they are parsed, so nothing is fetched twice.
    """
    spark.dataSource.register(fetch.ProviderPages)
    fetched = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    results = None
    for number, job in enumerate(jobs):
        start_ms, end_ms = window(end, job.years)
        choices = [Provider(job.provider, job.symbols, job.parse, job.options, job.latency), *job.fallbacks]
        tickers = list(dict.fromkeys(t for c in choices for t in c.symbols))
        asked = spark.createDataFrame([(t,) for t in tickers], "symbol string")
        path = f"{lake}/raw/{job.kind}/run={uuid.uuid4().hex}"
        listed = json.dumps([{"name": c.name, "symbols": c.symbols} | {k: v for k, v in c.options.items() if k in CHOICE} for c in choices])
        rest = {k: v for k, v in job.options.items() if k not in CHOICE}
        options = {"start": start_ms, "end": end_ms, **rest, "providers": listed, "symbols": ",".join(tickers), "errors": "keep"}
        spark.read.format("provider_pages").options(**options).load().write.parquet(path)
        pages = spark.read.parquet(path)
        places = F.array(*[F.lit(c.name) for c in choices])
        tried = F.struct(F.array_position(places, F.col("provider")).alias("place"), "provider", "ok", F.col("error").alias("reason"))
        attempts = pages.where("ok is not null").groupBy("symbol").agg(F.array_sort(F.collect_list(tried)).alias("attempts"))
        served = pages.where("ok").select("symbol", "provider")
        good = pages.where("payload is not null").join(served, ["symbol", "provider"])
        rows = None
        for c in choices:
            stamp = {"source": F.lit(c.name), "latency": F.lit(c.latency), "fetched_at": F.lit(fetched).cast("timestamp_ntz"), "tf": F.lit(job.tf)}
            own = c.parse(good.where(F.col("provider") == c.name).select("symbol", "start", "payload")).withColumns(stamp).withColumn("seq", F.struct("start", "pos"))
            rows = own if rows is None else rows.unionByName(own)
        verdict = ingest(rows, lake, job.kind, symbols=asked)
        failed = F.array_join(F.transform(F.filter("attempts", lambda a: ~a["ok"]), lambda a: F.concat(a["provider"], F.lit(": "), a["reason"])), "; ")
        before = F.array_join(F.transform(F.filter("attempts", lambda a: ~a["ok"]), lambda a: a["provider"]), ", ")
        by = F.element_at(F.transform(F.filter("attempts", lambda a: a["ok"]), lambda a: a["provider"]), 1)
        whole = verdict.join(attempts, "symbol", "left").withColumns({"failed": failed, "before": before, "provider": F.when(F.exists("attempts", lambda a: a["ok"]), by)})
        state = F.when(F.col("provider").isNull() | (F.col("n_rows") == 0), "failed").when(F.col("passed"), "succeeded").otherwise("quarantined")
        why = F.when(F.col("provider").isNull(), F.col("failed")).when(F.col("n_rows") == 0, "no rows").when(~F.col("passed"), F.concat(F.lit("quarantined: "), "reason")).otherwise("")
        note = F.when(F.col("provider").isNotNull() & (F.col("before") != ""), F.concat(F.lit("stands in for "), "before")).otherwise("")
        own = whole.select(F.lit(number).alias("job"), F.lit(job.kind).alias("kind"), "symbol", state.alias("status"), F.col("n_rows").cast("long").alias("n_rows"), why.alias("reason"), "provider", note.alias("note"), "attempts")
        results = own if results is None else results.unionByName(own)
    return results


def backfill_counters(results: DataFrame) -> DataFrame:
    """Per job: symbols requested, succeeded, failed and quarantined, and rows written."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    written = F.coalesce(F.sum(F.when(F.col("status") == "succeeded", F.col("n_rows"))), F.lit(0).cast("long"))
    return results.groupBy("job", "kind").agg(F.count("*").alias("requested"), n("succeeded"), n("failed"), n("quarantined"), written.alias("rows_written"))


def symbols(universe: DataFrame) -> DataFrame:
    return slicing.listing(universe)


def build_features(spark: SparkSession, lake: str, spec: features.Spec, tf: str = "1d") -> DataFrame:
    """Compute, save and reload the state vector."""
    series = None
    for kind in KINDS:
        if store.has(spark, lake, kind):
            own = stored(spark, lake, kind).where(F.col("tf") == tf).select(F.lit(kind).alias("kind"), "symbol", "ts", "close", "source", "latency", "fetched_at")
            series = own if series is None else series.unionByName(own)
    if series is None or series.where((F.col("kind") == "bars") & (F.col("symbol") == spec.calendar)).isEmpty():
        raise DataUnavailable(spec.calendar)
    path = features.save_matrix(features.state_vector(series, spec, tracked=True), lake, spec.version)
    features.save_provenance(features.matrix_provenance(series, spark.read.parquet(path), spec), lake, spec.version)
    return features.load_matrix(spark, lake, spec.version)


def state_vector_provenance(spark: SparkSession, lake: str, version: int) -> DataFrame:
    """Where the stored matrix and each of its features came from, with labels of latency."""
    if not store.exists(spark, f"{lake}/provenance/version={version}"):
        raise DataUnavailable(f"version {version}")
    found = features.load_provenance(spark, lake, version)
    return found.withColumn("latency", provenance.latency_label(F.col("latency")))


def state_vector_latest(matrix: DataFrame, when: str) -> DataFrame:
    """The row known at an instant, values rounded to six digits."""
    rounded = [F.round(c, 6).alias(c) for c, kind in matrix.dtypes if kind == "double"]
    return asof.row_on(matrix, when).select("ts", *rounded, "complete")


def regime_latest(matrix: DataFrame, when: str) -> DataFrame:
    return regime.latest(matrix, when)


def regime_history(matrix: DataFrame, max_points: int = 500) -> DataFrame:
    calls = regime.history(matrix).withColumn("series", F.lit("regime"))
    return slicing.downsample(calls, limited(max_points, 10, 5000), "series").drop("series").orderBy("ts")


def analogues_latest(matrix: DataFrame, calendar: DataFrame, when: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes, statistics per horizon and intervals; refuses if matrix and calendar are out of step."""
    known = F.col("ts") <= F.lit(when).cast("timestamp_ntz")
    if not slicing.calendar_difference(matrix.where(known), calendar.where(known)).isEmpty():
        raise DataUnavailable("the state vector and the calendar are out of step")
    found = analogue.find_analogues(matrix, calendar, when)
    kept = matrix.sparkSession.createDataFrame(found.collect(), found.schema)  # at most one row for each separation's length of days
    return kept, analogue.horizon_stats(kept), analogue.bootstrap_ci(kept)


def run_backtests(bars: DataFrame, lake: str, funding: DataFrame | None = None, warmup: int = backtest.WARMUP) -> tuple[DataFrame, DataFrame]:
    """All strategies of all symbols in one job; whole curves and thinned results are saved, metrics and ledger come back."""
    spark, path = bars.sparkSession, f"{lake}/equity/run={uuid.uuid4().hex}"
    backtest.run(backtest.decisions(bars, funding), warmup).write.parquet(path)
    equity = spark.read.parquet(path)
    store.save_results(equity.select("symbol", "strategy", "ts", "i", "equity"), lake)
    return backtest.metrics(equity, warmup=warmup), backtest.trades(equity)


def backtest_strategies(spark: SparkSession, lake: str, symbol: str) -> DataFrame:
    """Saved results; nothing is computed here."""
    found = store.load_results(spark, lake, symbol)
    if found is None:
        raise DataUnavailable(symbol)
    return found

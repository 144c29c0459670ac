"""Bars from a stream of ticks, upserted into the lake as windows close or correct themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftglass.sources import lake as store


def windowed_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours", price: str = "value", symbol: str = "event_type") -> DataFrame:
    """OHLCV per symbol and tumbling window; ticks later than the watermark are left out."""
    order = F.struct("ts", "event_id")
    own = ticks.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col(symbol).alias("symbol"))
    bars = own.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def upsert_stream(bars: DataFrame, lake: str, checkpoint: str, tf: str = "1h", source: str = "stream") -> StreamingQuery:
    """Write each micro-batch with the latest-wins merge; a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            now = F.current_timestamp().cast("timestamp_ntz")
            rows = batch.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "source": F.lit(source), "latency": F.lit("LIVE"), "fetched_at": now, "tf": F.lit(tf)})
            store.write_bars(rows, lake)

    return bars.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""As-of joins over a stream: late source rows correct what was emitted, staleness ends by event time.

Targets and sources come as one stream of ``symbol``, ``ts``, ``value`` and ``is_target``. Per symbol the state has the source rows and
targets that a row within the watermark can still change; what is older goes, but for the one source row that later targets may hit. Every
batch emits the targets that came or changed, so the last row of each (symbol, ts) is what the batch plan gives. A timer at the end of the last
source row's validity emits ``expired`` if nothing newer came by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "symbol string, ts timestamp, value double, what string"
DAY_US = 86_400_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hits(targets: np.ndarray, at: np.ndarray, values: np.ndarray, max_days: int) -> np.ndarray:
    """For each target the value of the last source row at or before it, NaN where none is or it is over ``max_days`` old. Times in microseconds."""
    found = np.full(len(targets), np.nan)
    place = np.searchsorted(at, targets, side="right") - 1
    known = place >= 0
    fresh = (targets[known] - at[place[known]]) // DAY_US <= max_days
    found[known] = np.where(fresh, values[place[known]], np.nan)
    return found


class Asof(StatefulProcessor):
    """The machine of one symbol."""

    def __init__(self, max_days: int):
        self.max_days = max_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at binary, value binary, target binary")

    def load(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, values, targets = self.held.get() if self.held.exists() else (b"", b"", b"")
        return np.frombuffer(at, np.int64), np.frombuffer(values, np.float64), np.frombuffer(targets, np.int64)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, values, targets = self.load()
        new = pd.concat(list(rows))
        us = new["ts"].to_numpy("datetime64[us]").astype(np.int64)
        is_target = new["is_target"].to_numpy(bool)
        before = hits(targets, at, values, self.max_days)
        come, order = np.unique(np.concatenate([us[~is_target][::-1], at]), return_index=True)  # of equal times the one that came last
        values = np.concatenate([new["value"].to_numpy(float)[~is_target][::-1], values])[order]
        now = hits(targets, come, values, self.max_days)
        changed = ~((before == now) | (np.isnan(before) & np.isnan(now)))
        fresh = np.setdiff1d(us[is_target], targets)
        out = np.concatenate([targets[changed], fresh])
        found = np.concatenate([now[changed], hits(fresh, come, values, self.max_days)])
        low = timerValues.getCurrentWatermarkInMs() * 1000
        targets = np.union1d(targets, fresh)
        first = max(int(np.searchsorted(come, low, side="right")) - 1, 0)  # what targets from the watermark on can hit
        if len(come):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(come[-1] // 1000 + (self.max_days + 1) * DAY_US // 1000))
        self.held.update((come[first:].tobytes(), values[first:].tobytes(), targets[targets >= low].tobytes()))
        if len(out):
            yield pd.DataFrame({"symbol": key[0], "ts": pd.to_datetime(out, unit="us"), "value": found, "what": "hit"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _, targets = self.load()
        low = timerValues.getCurrentWatermarkInMs() * 1000
        self.held.update((b"", b"", targets[targets >= low].tobytes()))
        yield pd.DataFrame({"symbol": [key[0]], "ts": pd.to_datetime([expiredTimerInfo.getExpiryTimeInMs()], unit="ms"), "value": [np.nan], "what": ["expired"]})

    def close(self) -> None:
        pass


def asof_stream(targets: DataFrame, sources: DataFrame, max_days: int, late: str = "10 days") -> DataFrame:
    """``symbol``, ``ts``, ``value``, ``what`` as they come and change; both inputs have ``symbol`` and ``ts``, ``sources`` also ``value``."""
    left = targets.select("symbol", "ts", F.lit(None).cast("double").alias("value"), F.lit(True).alias("is_target"))
    both = left.unionByName(sources.select("symbol", "ts", "value", F.lit(False).alias("is_target")))
    done = both.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(Asof(max_days), OUT, "Update", "EventTime")
    return done.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def latest(emitted: DataFrame) -> DataFrame:
    """What stands, from emitted rows with their ``batch``: per target the value that came last."""
    return emitted.where("what = 'hit'").groupBy("symbol", "ts").agg(F.max_by("value", "batch").alias("value"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what is there, batch by batch, into a Parquet table with ``batch``; a repeated batch replaces itself."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)

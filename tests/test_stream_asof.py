"""The streamed as-of join, replayed in batches with late rows, against the batch plan."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from driftglass.operators.asof import asof
from driftglass.streaming import asof as stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, value double, is_target boolean"


def test_hits():
    day = stream.DAY_US
    at, values = np.array([0, 4 * day]), np.array([1.0, np.nan])
    got = stream.hits(np.array([-1, 0, 2 * day, 3 * day, 4 * day, 9 * day]), at, values, 2)
    assert np.isnan(got[[0, 3, 4, 5]]).all() and got[[1, 2]].tolist() == [1.0, 1.0]


def test_late_rows_correct_what_was_emitted(spark, tmp_path):
    day = lambda d, h=0: T0 + dt.timedelta(days=d, hours=h)
    targets = [(s, day(d), None, True) for s in "ab" for d in range(12)]
    sources = [("a", day(0), 1.0), ("a", day(3, 5), 2.0), ("a", day(4), None), ("a", day(9), 4.0), ("b", day(2), 7.0), ("b", day(5, 1), 8.0)]
    sources = [(*s, False) for s in sources]
    batches = [
        [t for t in targets if t[1] < day(5)] + [sources[0], sources[4]],
        [t for t in targets if day(5) <= t[1] < day(9)] + [sources[1], sources[3]],  # the second source row comes late
        [t for t in targets if t[1] >= day(9)] + [sources[2], sources[5], ("a", day(3, 5), 2.5, False)],  # so do these, and one again with another value
    ]
    top = tmp_path / "in"
    whole = None
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA)
        whole = df if whole is None else whole.unionByName(df)
        df.coalesce(1).write.mode("append").parquet(str(top))
    ticks = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(top))
    out = stream.asof_stream(ticks.where("is_target"), ticks.where("not is_target"), 3, "30 days")
    stream.run_available(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    emitted = spark.read.parquet(str(tmp_path / "out"))
    assert emitted.select("batch").distinct().count() >= 3
    once = whole.where("not is_target").where("value is distinct from 2.0D")
    plain = lambda df: df.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *(["value"] if "value" in df.columns else []))
    want = asof(plain(whole.where("is_target")).drop("value"), plain(once), "value", 3, by=["symbol"])
    key = lambda df: sorted((r.symbol, r.ts, -1.0 if r.value is None else r.value) for r in df.collect())
    assert key(plain(stream.latest(emitted))) == key(want)
    assert emitted.where("symbol = 'a' and what = 'hit'").count() > 12  # corrections came on top

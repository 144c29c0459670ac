"""Lake, provider payloads, fallback, streaming bars, and every registered query on the smallest tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from driftglass.sources import lake, providers
from driftglass.streaming import ohlcv

T0 = dt.datetime(2024, 1, 1)


def rows(spark, closes, fetched, symbol="s", source="a"):
    data = [(T0 + dt.timedelta(days=i), c, c, c, c, 1.0, source, "EOD", fetched, symbol, "1d") for i, c in closes.items()]
    return spark.createDataFrame(data, lake.STORED)


def test_upsert_is_idempotent_and_latest_wins(spark, tmp_path):
    at = str(tmp_path / "lake")
    first = rows(spark, {0: 1.0, 1: 2.0}, T0)
    lake.write_bars(first, at)
    lake.write_bars(first, at)
    lake.write_bars(rows(spark, {5: 9.0}, T0, symbol="t"), at)
    assert lake.read_bars(spark, at, "s").count() == 2
    lake.write_bars(rows(spark, {1: 3.0, 2: 4.0}, T0 + dt.timedelta(days=1), source="b"), at)
    lake.write_bars(rows(spark, {0: 7.0}, T0 - dt.timedelta(days=1)), at)
    lake.write_bars(rows(spark, {0: 8.0}, T0), at)  # a tie: what is there stays
    assert [r["close"] for r in lake.read_bars(spark, at, "s").collect()] == [1.0, 3.0, 4.0]
    assert lake.read_bars(spark, at, "s", start="2024-01-02", end="2024-01-02").count() == 1
    p = lake.series_provenance(lake.read_bars(spark, at, "s")).first()
    assert (p["sources"], p["latency"], p["n_rows"]) == (["a", "b"], 2, 3)
    assert lake.stats(spark, at)["files"] >= 2 and [r["n_rows"] for r in lake.manifest(lake.read_bars(spark, at, "t")).collect()] == [1]


def test_missing_series_is_unavailable(spark, tmp_path):
    none = lake.read_bars(spark, str(tmp_path / "no"), "s")
    assert none.count() == 0 and lake.series_provenance(none).first()["latency"] == 5
    assert lake.load_results(spark, str(tmp_path / "no"), "s") is None and lake.stats(spark, str(tmp_path / "no")) == {"files": 0, "bytes": 0}


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", "x", T0 + dt.timedelta(days=i), i, 1.0 + i) for i in range(700)], "symbol string, strategy string, ts timestamp_ntz, i long, equity double")
    lake.save_results(df, str(tmp_path))
    got = lake.load_results(spark, str(tmp_path), "s")
    assert got.count() == 500 and got.agg(F.max("equity")).first()[0] == 700.0 and lake.load_results(spark, str(tmp_path), "t") is None
    lake.save_results(df.limit(20).withColumn("symbol", F.lit("t")), str(tmp_path))
    lake.save_results(df.limit(30).withColumn("symbol", F.lit("t")), str(tmp_path))
    assert lake.load_results(spark, str(tmp_path), "s").count() == 500 and lake.load_results(spark, str(tmp_path), "t").count() == 30


def test_upsert_reads_only_what_comes_in(spark, tmp_path):
    at = str(tmp_path / "lake")
    lake.write_bars(rows(spark, {0: 1.0}, T0).unionByName(rows(spark, {0: 2.0}, T0, symbol="t")), at)
    broken = next((tmp_path / "lake" / "bars" / "data").glob("commit=*/symbol=t/tf=1d/*.parquet"))
    broken.write_bytes(b"not parquet")  # would fail if it were read
    (broken.parent / f".{broken.name}.crc").unlink()
    lake.write_bars(rows(spark, {1: 3.0}, T0), at)
    assert lake.read_bars(spark, at, "s").count() == 2 and not list((tmp_path / "lake" / "bars").glob("_staged*"))


def test_upsert_of_many_series(spark, tmp_path):
    at = str(tmp_path / "lake")
    both = rows(spark, {0: 1.0, 1: 2.0}, T0).unionByName(rows(spark, {0: 2.0}, T0, symbol="t"))
    for _ in range(2):
        lake.write_bars(both, at, rows_per_file=1)
    lake.write_bars(rows(spark, {0: 4.0}, T0, symbol="odd name/50%=x:y"), at)
    assert lake.read_bars(spark, at, "odd name/50%=x:y").count() == 1
    assert lake.read_bars(spark, at, "s").count() == 2 and lake.read_bars(spark, at, "t").count() == 1


def test_description_and_records(spark):
    df = rows(spark, {0: 1.0, 1: 2.0, 2: 3.0}, T0)
    r = lake.describe(df).first()
    assert (r["symbol"], r["n_rows"], r["start"], r["sources"], r["latency"]) == ("s", 3, T0, ["a"], "EOD")
    got = lake.to_records(df, 2).orderBy("ts").collect()
    assert [(r["ts"], r["close"]) for r in got] == [("2024-01-01T00:00:00+00:00", 1.0), ("2024-01-03T00:00:00+00:00", 3.0)]


def payload(spark, x):
    return spark.createDataFrame([("S", json.dumps(x))], "symbol string, payload string")


def test_payloads(spark):
    ms = 1704067200000
    k = providers.parse_klines(payload(spark, [[ms, "1", "2", "0.5", "1.5", "10", 0], [ms + 1, "x", "2", "0.5", "1.5", "10"], [ms + 2, "1", "0.1", "0.5", "1.5", "10"]])).collect()
    assert [(r["ts"], r["close"], r["symbol"]) for r in k] == [(T0, 1.5, "S")]
    assert [r["close"] for r in providers.parse_funding(payload(spark, [{"fundingTime": ms, "fundingRate": "-0.01"}, {"fundingTime": ms}])).collect()] == [-0.01]
    assert [r["close"] for r in providers.parse_open_interest(payload(spark, [{"timestamp": ms, "sumOpenInterestValue": "5"}])).collect()] == [5.0]
    chart = lambda t, **q: {"chart": {"result": [{"timestamp": t, "indicators": {"quote": [q]}}]}}
    own = dict(open=[1.0, None], high=[2.0, 2.0], low=[0.5, 1.0], close=[1.5, 1.5], volume=[None, 1.0])
    assert [(r["ts"], r["volume"]) for r in providers.parse_chart(payload(spark, chart([1704067200, 1704153600], **own))).collect()] == [(T0, 0.0)]
    assert providers.parse_chart(payload(spark, chart([1704067200], **own))).count() == 0
    assert providers.parse_chart(payload(spark, {"chart": {"result": None}})).count() == 0


def test_chain_falls_back_and_opens(spark):
    now = [0.0]
    one = spark.range(1)

    def fail(**_):
        raise OSError("down")

    chain = providers.Chain([("a", fail), ("b", lambda **_: one.limit(0)), ("c", lambda **_: one)], {"a": providers.Breaker(clock=lambda: now[0])})
    for _ in range(3):
        found, name, note = chain.get()
        assert name == "c" and "a: down" in note and "b: no data" in note
    assert "a: circuit open" in chain.get()[2]
    now[0] = 301
    assert chain.breakers["a"].state == "HALF_OPEN" and "a: down" in chain.get()[2] and chain.breakers["a"].state == "OPEN"
    assert providers.Chain([("a", fail)]).get()[0] is None


def test_first_available(spark):
    df = spark.createDataFrame([("k", 2, "b", 1.0), ("k", 1, "a", 2.0), ("j", 2, "b", 3.0)], "key string, priority int, provider string, v double")
    assert sorted((r["key"], r["provider"]) for r in providers.first_available(df, ["key"]).collect()) == [("j", "b"), ("k", "a")]


def test_stream_to_lake(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    query = ohlcv.upsert_stream(ohlcv.windowed_bars(ticks), str(tmp_path / "lake"), str(tmp_path / "check"))
    assert query.awaitTermination(120)
    got = lake.read_bars(spark, str(tmp_path / "lake"), events.first()["event_type"], "1h")
    kind = events.first()["event_type"]
    want = events.where(F.col("event_type") == kind).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.sum(F.lit(1.0)).alias("n"))
    assert got.count() == want.count() and got.agg(F.sum("volume")).first()[0] == want.agg(F.sum("n")).first()[0]


def test_entry(spark):
    assert "label" in __spark_entry__.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


MARKET = [n for n in __spark_entry__.catalog.QUERIES if n in __spark_entry__.catalog.ORACLES]


@pytest.mark.parametrize("name", MARKET)
def test_query_equals_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda rs: sorted(str(tuple(r)) for r in rs)
    assert text(got.select(columns).collect()) == text(want.select(*columns).fetchall())


def test_derived_tables_follow_their_inputs(spark, tmp_path):
    from driftglass.session import derived_path

    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    first = derived_path(spark, str(tmp_path), ("a",), "x")
    assert first == derived_path(spark, str(tmp_path), ("a",), "x") != derived_path(spark, str(tmp_path), ("a",), "y")
    spark.range(6).write.mode("overwrite").parquet(str(tmp_path / "a.parquet"))
    assert derived_path(spark, str(tmp_path), ("a",), "x") != first

"""From provider pages to a served answer: fetch, parse, check, store, features, regimes, analogues, backtests."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.operators import features
from driftglass.plans import endpoints
from driftglass.sources import fetch, lake, providers

DAY_MS = 86_400_000
START = 1577836800000  # 2020-01-01


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """A lake filled from paged JSON files, one symbol of which is broken."""
    top = tmp_path_factory.mktemp("market")
    rng = np.random.default_rng(1)
    n, step = 420, 100
    for symbol in ("ALL", "A", "BAD"):
        (top / symbol).mkdir()
        close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
        for at in range(0, n, step):
            page = [[START + i * DAY_MS, str(close[i]), str(close[i] * 1.01), str(close[i] * 0.99), str(close[i]), "5"] for i in range(at, min(at + step, n))]
            (top / symbol / f"{START + max(0, (at - 1) * DAY_MS + 1)}.json").write_text(json.dumps(page))  # a page is asked for from the last row's time plus one
    spark.dataSource.register(fetch.ProviderPages)
    raw = spark.read.format("provider_pages").options(url=f"file://{top}/{{symbol}}/{{start}}.json", symbols="ALL,A,BAD", start=START, end=START + n * DAY_MS, limit=step, lanes=2, interval_s=0).load()
    bars = providers.parse_klines(raw.select("symbol", "payload")).withColumns({"source": F.lit("files"), "latency": F.lit("EOD"), "fetched_at": F.lit(dt.datetime(2022, 1, 1)).cast("timestamp_ntz"), "tf": F.lit("1d")})
    bars = bars.withColumn("seq", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("close", F.when((F.col("symbol") == "BAD") & (F.col("seq") % 7 == 0), -F.col("close")).otherwise(F.col("close")))
    at = str(top / "lake")
    verdict = {r["symbol"]: r["passed"] for r in endpoints.ingest(bars, at).collect()}
    return at, verdict, n


def test_ingest_quarantines_the_broken_series(spark, filled):
    at, verdict, n = filled
    assert verdict == {"ALL": True, "A": True, "BAD": False}
    assert {r["symbol"]: r["n_rows"] for r in lake.manifest(endpoints.stored(spark, at)).collect()} == {"ALL": n, "A": n}
    symbols = spark.createDataFrame([("ALL",), ("BAD",)], "ticker string")
    assert {r["ticker"]: r["latency"] for r in endpoints.coverage(spark, at, symbols).collect()} == {"ALL": "EOD", "BAD": "UNAVAILABLE"}


def test_backfill_isolates_failures(spark, filled, tmp_path):
    at, _, n = filled
    top = at.removesuffix("/lake")
    end = dt.datetime.fromtimestamp(START / 1000, dt.UTC) + dt.timedelta(days=375)
    assert endpoints.window(end, 1) == (START, START + 375 * DAY_MS)
    for name, rows in (("NEG", [[START + i * DAY_MS, "1", "1", "1", "1", "-1"] for i in range(30)]), ("NONE", [])):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{START}.json").write_text(json.dumps(rows))
    (tmp_path / "A").symlink_to(f"{top}/A")
    (tmp_path / "HALF").mkdir()
    (tmp_path / "HALF" / f"{START}.json").write_text((tmp_path / "A" / f"{START}.json").read_text())  # its second page is missing
    options = {"url": f"file://{tmp_path}/{{symbol}}/{{start}}.json", "limit": 100, "interval_s": 0}
    symbols = {"a": "A", "none": "NONE", "gone": "GONE", "half": "HALF"}
    (tmp_path / "F").mkdir()
    (tmp_path / "F" / f"{START}.json").write_text(json.dumps([{"fundingTime": START + i * DAY_MS // 3, "fundingRate": "-0.01"} for i in range(50)]))
    lake_at = str(tmp_path / "lake")
    jobs = [
        endpoints.Backfill("bars", "files", symbols, providers.parse_klines, options, years=1),
        endpoints.Backfill("funding", "files", {"a": "F"}, providers.parse_funding, options | {"time": "fundingTime"}, years=1),
    ]
    got = {(r["kind"], r["symbol"]): r for r in endpoints.backfill(spark, lake_at, jobs, end).collect()}
    assert {k: (r["status"], r["n_rows"]) for k, r in got.items()} == {
        ("bars", "a"): ("succeeded", 400), ("bars", "none"): ("failed", 0), ("bars", "gone"): ("failed", 0), ("bars", "half"): ("failed", 0), ("funding", "a"): ("succeeded", 50),
    }
    assert "ProviderError" in got["bars", "half"]["reason"] and got["bars", "none"]["reason"] == "files: no data"
    assert {r["symbol"] for r in lake.manifest(endpoints.stored(spark, lake_at)).collect()} == {"a"}
    counted = {r["kind"]: r for r in endpoints.backfill_counters(endpoints.backfill(spark, lake_at, jobs, end)).collect()}
    assert (counted["bars"]["requested"], counted["bars"]["succeeded"], counted["bars"]["failed"], counted["bars"]["rows_written"]) == (4, 1, 3, 400)


def test_backfill_falls_back(spark, filled, tmp_path):
    """The first provider fails for one symbol, has nothing for another and no name for a third; its breaker opens; attempts and notes say so."""
    top = filled[0].removesuffix("/lake")
    (tmp_path / "first" / "EMPTY").mkdir(parents=True)
    (tmp_path / "first" / "EMPTY" / f"{START}.json").write_text("[]")
    (tmp_path / "first" / "A").symlink_to(f"{top}/A")
    end = dt.datetime.fromtimestamp(START / 1000, dt.UTC) + dt.timedelta(days=375)
    url = lambda at: {"url": f"file://{at}/{{symbol}}/{{start}}.json", "limit": 100}
    second = endpoints.Provider("second", {t: "A" for t in ("fine", "gone", "empty", "unnamed", "late")}, providers.parse_klines, url(top), "DELAYED")
    first = {"fine": "A", "empty": "EMPTY", "gone": "X1", "alone": "X2", "late": "X3"}
    job = endpoints.Backfill("bars", "first", first, providers.parse_klines, url(tmp_path / "first") | {"interval_s": 0, "lanes": 1, "failures": 2}, years=1, fallbacks=(second,))
    at = str(tmp_path / "lake")
    got = {r["symbol"]: r for r in endpoints.backfill(spark, at, [job], end).collect()}
    assert {k: (r["status"], r["provider"], r["n_rows"], r["note"]) for k, r in got.items()} == {
        "fine": ("succeeded", "first", 400, ""), "empty": ("succeeded", "second", 400, "stands in for first"), "gone": ("succeeded", "second", 400, "stands in for first"),
        "unnamed": ("succeeded", "second", 400, "stands in for first"), "alone": ("failed", None, 0, ""), "late": ("succeeded", "second", 400, "stands in for first"),
    }
    tried = {k: [(a["provider"], a["ok"], (a["reason"] or "").split(":")[0]) for a in r["attempts"]] for k, r in got.items()}
    assert tried["fine"] == [("first", True, "")] and tried["empty"] == [("first", False, "no data"), ("second", True, "")]
    assert tried["unnamed"][0][2] == "not mapped" and tried["gone"][0][2] == "ProviderError" and tried["late"][0][2] == "circuit open"
    assert tried["alone"] == [("first", False, "ProviderError"), ("second", False, "not mapped")] and "second: not mapped" in got["alone"]["reason"]
    by = {r["symbol"]: (r["sources"], r["latency"]) for r in lake.describe(endpoints.stored(spark, at)).collect()}
    assert by["fine"] == (["first"], "EOD") and by["gone"] == (["second"], "DELAYED")


def test_a_lane_without_any_provider_raises(spark, tmp_path):
    listed = json.dumps([{"name": "x", "url": f"file://{tmp_path}/{{symbol}}.json", "symbols": {}}])
    spark.dataSource.register(fetch.ProviderPages)
    with pytest.raises(Exception, match="not mapped"):
        spark.read.format("provider_pages").options(providers=listed, symbols="a", start=0, end=1, interval_s=0).load().collect()
    with pytest.raises(Exception, match="url or a list"):
        spark.read.format("provider_pages").options(symbols="a", start=0, end=1).load().collect()


def test_points_out_of_bounds_are_refused(spark, filled):
    for points in (9, 20001):
        with pytest.raises(ValueError):
            endpoints.bars(spark, filled[0], "A", max_points=points)


def test_bars(spark, filled):
    at, _, n = filled
    assert endpoints.bars(spark, at, "A", max_points=50).count() == 50
    assert endpoints.bars(spark, at, "A", start="2020-02-01", end="2020-02-10").count() == 10
    for bad in ({"symbol": "BAD"}, {"symbol": "A", "kind": "nope"}):
        with pytest.raises(lake.DataUnavailable):
            endpoints.bars(spark, at, **bad)


def test_features_regime_analogues(spark, filled):
    at, _, n = filled
    f = features.Feature
    names = ("btc_trend_200d", "btc_mom_63d", "btc_vol_ratio", "btc_funding_z", "eth_vs_btc_63d", "sol_vs_btc_63d", "bnb_vs_btc_63d", "xrp_vs_btc_63d", "dxy_mom_63d", "vix_level", "us10y_chg_63d")
    spec = features.Spec("ALL", (f(names[0], "ALL", "pct_from_sma", window=20), f(names[1], "ALL", "log_return", window=10), f(names[2], "ALL", "vol_ratio", window=5, slow_window=20), *(f(x, "A", "log_return", window=7) for x in names[3:])), 30)
    m = endpoints.build_features(spark, at, spec).cache()
    assert m.count() == n
    when = "2021-02-20"
    assert endpoints.state_vector_latest(m, when).first()["complete"]
    assert endpoints.regime_latest(m, when).count() == 1 and endpoints.regime_history(m, 40).count() == 40
    calendar = lake.read_bars(spark, at, "ALL")
    kept, stats, ci = endpoints.analogues_latest(m, calendar, when)
    assert kept.count() > 3 and stats.count() == 4 and ci.count() == 4
    with pytest.raises(lake.DataUnavailable):
        endpoints.analogues_latest(m, calendar.where("ts <> timestamp_ntz'2020-05-05'"), when)


def test_backtests_are_saved_and_served(spark, filled):
    at, _, n = filled
    metrics, ledger = endpoints.run_backtests(endpoints.stored(spark, at), at)
    assert metrics.count() == 8 and ledger.count() > 0
    assert endpoints.backtest_strategies(spark, at, "A").select("strategy").distinct().count() == 4
    with pytest.raises(lake.DataUnavailable):
        endpoints.backtest_strategies(spark, at, "BAD")
    assert endpoints.status(spark, at)["lake"]["files"] > 0


def test_pages_are_followed_to_the_end():
    rows = [[1000 * i, "1"] for i in range(2500)]
    asked = []

    def get(url):
        start, end, limit = map(int, url.split("/"))
        asked.append(start)
        return json.dumps([r for r in rows if start <= r[0] <= end][:limit])

    pages = list(fetch.follow(get, "{start}/{end}/{limit}", "s", 0, 2_500_000, 1000, "0"))
    assert [r for _, p in pages for r in json.loads(p)] == rows and asked == [0, 999_001, 1_999_001]
    asked.clear()
    list(fetch.follow(get, "{start}/{end}/{limit}", "s", 0, 999_001, 1000, "0"))
    assert asked == [0]  # the end is reached by a full page
    with pytest.raises(fetch.ProviderError, match="followed"):
        list(fetch.follow(get, "{start}/{end}/{limit}", "s", 0, 2_500_000, 1000, "when"))
    assert len(list(fetch.follow(get, "{start}/{end}/{limit}", "s", 0, 2_500_000, 1000, ""))) == 1
    stuck = json.dumps([[5, "1"]] * 10)
    assert len(list(fetch.follow(lambda url: stuck, "{start}", "s", 6, 100, 10, "0"))) == 1


def test_a_lane_waits_between_requests(monkeypatch):
    now, at = [0.0], []
    monkeypatch.setattr(fetch, "read_url", lambda url: at.append(now[0]) or json.dumps([[int(url), "1"]] * 2))
    monkeypatch.setattr(fetch, "Limiter", lambda s: Real(s, lambda: now[0], lambda x: now.__setitem__(0, now[0] + x)))
    reader = fetch._Reader({"url": "{start}", "symbols": "a,b,c", "start": "0", "end": "3", "limit": "2", "lanes": "2", "interval_s": "0.5"})
    lanes = reader.partitions()
    assert [x.symbols for x in lanes] == [["a", "c"], ["b"]]
    assert len(list(reader.read(lanes[0]))) == 6
    assert at == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


Real = fetch.Limiter


def test_timeouts_are_retried(monkeypatch):
    calls = []

    def late(*_, **__):
        calls.append(1)
        raise TimeoutError("late")

    monkeypatch.setattr(fetch.urllib.request, "urlopen", late)
    with pytest.raises(fetch.ProviderError):
        fetch.with_retry(lambda: fetch.read_url("u"), sleep=lambda s: None)
    assert len(calls) == 3


def test_retry_and_limits():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise fetch.typed(503, "u")
        return "ok"

    assert fetch.with_retry(flaky, sleep=pauses.append) == "ok" and pauses == [0.5, 1.0]
    with pytest.raises(fetch.Forbidden):
        fetch.with_retry(lambda: (_ for _ in ()).throw(fetch.typed(451, "u")), sleep=pauses.append)
    assert isinstance(fetch.typed(429, "u"), fetch.RateLimited) and len(pauses) == 2
    now, slept = [0.0], []
    limiter = fetch.Limiter(1.0, lambda: now[0], slept.append)
    limiter.wait()
    now[0] = 0.4
    limiter.wait()
    assert slept == [pytest.approx(0.6)]

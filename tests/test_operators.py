"""As-of joins, state vector, regimes, analogues, quality, slices, provenance on hand-made rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.operators import analogue, asof, features, provenance, quality, regime, slicing

DAY0 = dt.datetime(2024, 1, 1)


def days(n, step=1):
    return [DAY0 + dt.timedelta(days=i * step) for i in range(n)]


def series(spark, symbol, closes, kind="bars", step=1):
    return spark.createDataFrame([(kind, symbol, t, float(c)) for t, c in zip(days(len(closes), step), closes, strict=True)], "kind string, symbol string, ts timestamp_ntz, close double")


def asof_values(spark, targets, source, max_days):
    t = spark.createDataFrame([(x,) for x in targets], "ts timestamp_ntz")
    s = spark.createDataFrame(source, "ts timestamp_ntz, value double")
    return [r["out"] for r in asof.asof(t, s, "out", max_days).orderBy("ts").collect()]


def test_asof_takes_last_known(spark):
    assert asof_values(spark, days(5), list(zip(days(3, 2), [10.0, 20.0, 30.0], strict=True)), 5) == [10, 10, 20, 20, 30]


def test_asof_goes_stale_and_counts_whole_days(spark):
    got = asof_values(spark, days(14), [(DAY0, 7.0)], 10)
    assert got[10] == 7 and got[11:] == [None] * 3
    assert asof_values(spark, [DAY0 + dt.timedelta(days=1)], [(DAY0 + dt.timedelta(hours=14), 1.0)], 0) == [1.0]


def test_asof_keeps_a_missing_hit_and_empty_source(spark):
    assert asof_values(spark, days(2), [(DAY0, 1.0), (DAY0 + dt.timedelta(hours=5), None)], 5) == [1.0, None]
    assert asof_values(spark, days(2), [], 5) == [None, None]


def test_asof_by_key(spark):
    t = spark.createDataFrame([(s, x, 1) for s in "ab" for x in days(2)], "symbol string, ts timestamp_ntz, own int")
    s = spark.createDataFrame([("a", DAY0, 1.0), ("b", days(2)[1], 2.0)], "symbol string, ts timestamp_ntz, value double")
    got = asof.asof(t, s, "out", None, by=["symbol"]).orderBy("symbol", "ts").collect()
    assert [(r["symbol"], r["own"], r["out"]) for r in got] == [("a", 1, 1.0), ("a", 1, 1.0), ("b", 1, None), ("b", 1, 2.0)]


def spec(*fs, min_history=3):
    return features.Spec("C", tuple(fs), min_history)


def test_state_vector_aligns_relative_strength_on_own_rows(spark):
    c = series(spark, "C", [100 * 1.01**i for i in range(30)])
    a = series(spark, "A", [100 * 1.02**i for i in range(15)], step=2)
    m = features.state_vector(c.unionByName(a), spec(features.Feature("rel", "A", "rel_strength", window=5, vs="C")))
    rows = m.orderBy("ts").collect()
    assert len(rows) == 30
    assert rows[28]["rel"] == pytest.approx(5 * np.log(1.02) - 10 * np.log(1.01))
    assert rows[29]["rel"] == rows[28]["rel"]


def test_missing_source_makes_every_row_incomplete(spark):
    m = features.state_vector(series(spark, "C", range(1, 20)), spec(features.Feature("own", "C", "level"), features.Feature("gone", "X", "level")))
    assert m.where("complete").count() == 0 and m.where("gone is not null").count() == 0 and m.where("own is null").count() == 0


def test_state_vector_is_causal(spark):
    values = [100 + 7 * np.sin(i) + i for i in range(60)]
    fs = (features.Feature("z", "C", "expanding_z"), features.Feature("v", "C", "vol_ratio", window=3, slow_window=6), features.Feature("t", "C", "pct_from_sma", window=5))
    whole = features.state_vector(series(spark, "C", values), spec(*fs)).orderBy("ts").collect()
    part = features.state_vector(series(spark, "C", values[:40]), spec(*fs)).orderBy("ts").collect()
    near = lambda r: [None if x is None else round(x, 9) if isinstance(x, float) else x for x in r]
    assert [near(r) for r in whole[:40]] == [near(r) for r in part]


def test_funding_goes_stale_sooner(spark):
    m = features.state_vector(series(spark, "C", range(1, 11)).unionByName(series(spark, "C", [5.0], kind="funding")), spec(features.Feature("f", "C", "level", kind="funding")))
    assert [r["f"] for r in m.orderBy("ts").collect()] == [5.0] * 4 + [None] * 6


def test_config_errors():
    with pytest.raises(features.ConfigError):
        features.Feature("x", "C", "nope")
    with pytest.raises(features.ConfigError):
        features.Feature("x", "C", "sma")
    with pytest.raises(features.ConfigError):
        features.parse_spec({"features": [{"name": "x"}]})
    got = features.parse_spec({"calendar_symbol": "C", "guards": {"min_history_days": 9}, "features": [{"name": "x", "source": "C", "transform": "level"}]})
    assert got.min_history == 9 and got.names == ["x"]


REGIME = ["btc_trend_200d", "btc_mom_63d", "btc_vol_ratio", "btc_funding_z", *regime.ALTS, "dxy_mom_63d", "vix_level", "us10y_chg_63d"]


def call(spark, raw, z):
    cols = {**{n: raw.get(n) for n in REGIME}, **{f"{n}__z": z.get(n) for n in REGIME}}
    schema = "ts timestamp_ntz, complete boolean, " + ", ".join(f"{c} double" for c in cols)
    return regime.classify(spark.createDataFrame([(DAY0, True, *cols.values())], schema)).first()


@pytest.mark.parametrize("trend_z,mom,label", [(1.0, 0.2, "UP"), (0.3, 0.2, "SIDEWAYS"), (-1.0, -0.2, "DOWN"), (1.0, -0.2, "SIDEWAYS"), (None, 0.2, "SIDEWAYS")])
def test_trend(spark, trend_z, mom, label):
    assert call(spark, {"btc_mom_63d": mom}, {"btc_trend_200d": trend_z, "btc_mom_63d": 1.0})["trend"] == label


def test_labels_confidence_and_evidence(spark):
    r = call(spark, {"btc_trend_200d": 0.15, "btc_mom_63d": 0.2, "btc_vol_ratio": 1.5}, {"btc_trend_200d": 1.0, "btc_mom_63d": 1.0, "btc_funding_z": 1.5, "eth_vs_btc_63d": 0.5})
    assert (r["label"], r["positioning"], r["alt_rotation"]) == ("UP_HIGH", "CROWDED_LONG", "ALT_SEASON")
    assert r["confidence"] == pytest.approx((1 + 0.5 / 0.3) / 2 / 1.5, abs=1e-4)
    assert [(e["feature"], e["raw"], e["z"], e["reads_as"]) for e in r["evidence"]] == [
        ("btc_trend_200d", 0.15, 1.0, "above its 200d average, z=+1.00"), ("btc_mom_63d", 0.2, 1.0, "63d return +20.0%"), ("btc_vol_ratio", 1.5, None, "21d/90d realized vol ratio = 1.50"),
        ("btc_funding_z", None, 1.5, "funding unusually elevated (crowded longs)"), ("alt_breadth_avg_z", None, 0.5, "average of 1/4 altcoins' relative strength vs BTC"),
        ("dxy_mom_63d", None, None, "macro context"), ("vix_level", None, None, "macro context"), ("us10y_chg_63d", None, None, "macro context"),
    ]
    empty = call(spark, {}, {})
    assert (empty["label"], empty["confidence"], empty["breadth"]) == ("SIDEWAYS_NORMAL", 0.0, None)
    assert [e["reads_as"] for e in empty["evidence"]][:5] == ["below its 200d average", "unavailable", "unavailable", "funding within normal range", "average of 0/4 altcoins' relative strength vs BTC"]


def test_episode_collapse_matches_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), float(d)) for i, d in zip(rng.permutation(400)[:200], rng.random(200).round(2), strict=True)]
    kept = []
    for i, d in sorted(rows, key=lambda r: (r[1], r[0])):
        if all(abs(i - k) > 21 for k, _ in kept):
            kept.append((i, d))
    got = analogue.episodes(spark.createDataFrame(rows, "row_idx long, distance double")).orderBy("rank").collect()
    assert [(r["row_idx"], r["distance"]) for r in got] == kept


def test_distances_match_numpy_and_single_candidate_is_null(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_idx long, a double, b double, c double")
    got = [r["distance"] for r in analogue.distances(df, ["a", "b", "c"], [0.1, 0.2, 0.3]).orderBy("row_idx").collect()]
    cov = np.cov(x, rowvar=False)
    inv = np.linalg.pinv(cov + 0.1 * np.trace(cov) / 3 * np.eye(3))
    d = x - [0.1, 0.2, 0.3]
    assert got == pytest.approx(np.sqrt(np.einsum("ij,jk,ik->i", d, inv, d)))
    assert analogue.distances(df.limit(1), ["a", "b"], [0.0, 0.0]).first()["distance"] is None


def test_bootstrap_interval_and_floor(spark):
    rng = np.random.default_rng(6)
    r = rng.normal(size=12)
    df = spark.createDataFrame([(i + 1, float(v), None) for i, v in enumerate(r)], "rank int, fwd_1 double, fwd_3 double")
    got = {x["horizon"]: x for x in analogue.bootstrap_ci(df, (1, 3)).collect()}
    draws = np.random.default_rng(42).integers(0, 12, (2000, 12))
    assert [got[1]["ci_low"], got[1]["ci_high"]] == pytest.approx(np.percentile(np.median(r[draws], axis=1), [10, 90]).tolist())
    assert got[3]["n"] == 0 and got[3]["ci_low"] is None


def test_find_analogues_excludes_the_near_past_and_needs_a_complete_query(spark):
    rng = np.random.default_rng(7)
    rows = [(t, True, *map(float, z)) for t, z in zip(days(120), rng.normal(size=(120, 2)), strict=True)]
    m = spark.createDataFrame(rows, "ts timestamp_ntz, complete boolean, a__z double, b__z double")
    bars = series(spark, "C", [100 * 1.001**i for i in range(120)])
    got = analogue.find_analogues(m, bars, str(days(120)[-1])).collect()
    assert got and max(r["row_idx"] for r in got) < 119 - 21
    assert all(r["fwd_21"] == pytest.approx(1.001**21 - 1) for r in got)
    assert analogue.find_analogues(m.withColumn("complete", F.col("ts") < F.lit(days(120)[-1])), bars, str(days(120)[-1])).count() == 0


BAR = "symbol string, seq long, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, closes, symbol="s", **change):
    rows = [(symbol, i, t, c, c + 1, c - 1, c, 10.0) for i, (t, c) in enumerate(zip(days(len(closes)), map(float, closes), strict=True))]
    df = spark.createDataFrame(rows, BAR)
    for c, expression in change.items():
        df = df.withColumn(c, F.expr(expression))
    return df


@pytest.mark.parametrize("change,check", [({"close": "if(seq = 3, double('nan'), close)"}, "non_finite_close"), ({"ts": "if(seq = 3, timestamp_ntz'2024-01-03', ts)"}, "duplicate_timestamps"),
                                           ({"ts": "if(seq = 3, timestamp_ntz'2023-01-03', ts)"}, "unsorted"), ({"high": "if(seq = 3, low - 1, high)"}, "ohlc_violation"), ({"volume": "-1D"}, "negative_volume"), ({"close": "-close", "open": "-open", "low": "-200D"}, "non_positive_price")])
def test_errors_quarantine(spark, change, check):
    df = bars(spark, [100, 101, 102, 103, 104], **change)
    verdict = quality.report(df)
    r = verdict.first()
    assert r[check] > 0 and not r["passed"] and check in r["reason"]
    assert quality.gate(df, verdict).count() == 0


def test_crash_warns_only(spark):
    rng = np.random.default_rng(8)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))
    closes[80:] *= 0.55
    r = quality.report(bars(spark, closes)).first()
    assert r["extreme_move"] == 1 and r["passed"] and r["findings"][0]["severity"] == "WARNING" and len(r["findings"][0]["samples"]) == 1


def test_flat_series_warns(spark):
    assert quality.report(bars(spark, [5.0] * 20)).first()["stale_series"] == 0  # too short to tell
    r = quality.report(bars(spark, [5.0] * 40)).first()
    assert r["stale_series"] == 1 and r["passed"] and [(f["check"], f["severity"], f["count"], f["samples"]) for f in r["findings"]] == [("stale_series", "WARNING", 39, [])]


def test_series_without_rows_fails_and_samples_are_the_first_three(spark):
    asked = spark.createDataFrame([("s",), ("none",)], "symbol string")
    got = {r["symbol"]: r for r in quality.report(bars(spark, [100] * 10, volume="-1D"), symbols=asked).collect()}
    assert not got["none"]["passed"] and got["none"]["n_rows"] == 0 and got["none"]["reason"] == "empty(0)" and [f["check"] for f in got["none"]["findings"]] == ["empty"]
    negative = got["s"]["findings"][0]
    assert (negative["check"], negative["count"], negative["samples"]) == ("negative_volume", 10, days(3))
    c = quality.ingest_counters(quality.report(bars(spark, [100] * 10), symbols=asked)).first()
    assert (c["requested"], c["succeeded"], c["failed"], c["quarantined"], c["rows_written"]) == (2, 1, 1, 0, 10)


def test_median_by_sorting(spark):
    for values in ([3.0], [3.0, 1.0], [5.0, None, 1.0, 2.0], [1.0, 2.0, 2.0, 9.0], [None]):
        df = spark.createDataFrame([("s", v) for v in values], "symbol string, v double")
        there = [v for v in values if v is not None]
        r = quality.with_median(df, "v", "m").first()
        assert r["n_r"] == len(there) and r["m"] == (np.median(there) if there else None)


def test_state_vector_carries_over_blocks(spark):
    c = series(spark, "C", range(1, 201))
    f = spark.createDataFrame([("bars", "F", DAY0 + dt.timedelta(days=d, hours=14), v) for d, v in ((0, 1.0), (31, 2.0), (70, None), (100, 4.0), (100, 4.0), (190, 5.0))], c.schema)
    m = features.state_vector(c.unionByName(f), spec(features.Feature("f", "F", "level"))).orderBy("ts").collect()
    want = [None] * 200
    for day in range(200):
        hit = [(d, v) for d, v in ((0, 1.0), (31, 2.0), (70, None), (100, 4.0), (190, 5.0)) if d < day]
        if hit and day - hit[-1][0] <= 6 and (day - hit[-1][0]) * 24 - 14 < 6 * 24:
            want[day] = hit[-1][1]
    assert [r["f"] for r in m] == want


def test_notes_name_what_is_missing(spark):
    own = spec(features.Feature("own", "C", "level"), features.Feature("gone", "X", "level"), features.Feature("rel", "C", "rel_strength", window=2, vs="Y"), features.Feature("long", "C", "sma", window=99), features.Feature("odd", "C", "level", vs="Y"))
    rows = series(spark, "C", range(1, 20))
    m = features.state_vector(rows, own)
    assert features.notes(rows, m, own) == {
        "gone": "X has no bars", "rel": "Y has no bars", "odd": "Y has no bars", "long": "C (bars) is too short or never finite under sma, window 99",
    }
    assert m.where("odd is not null or rel is not null").count() == 0 and m.where("own is null").count() == 0


def test_configuration_files(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"calendar_symbol": "C", "features": [{"name": "x", "source": "C", "transform": "level"}]}')
    assert features.load_spec(str(tmp_path / "f.json")).names == ["x"]
    one = {"ticker": "T", "exchange": "X", "asset_class": "C", "providers": {"p": "t"}}
    got = slicing.load_universe(spark, {"symbols": [one, one | {"ticker": "A"}]})
    assert [r["ticker"] for r in slicing.listing(got).collect()] == ["A", "T"] and slicing.by_provider(got, "p").count() == 2
    with pytest.raises(slicing.DuplicateTicker):
        slicing.load_universe(spark, {"symbols": [one, one]})
    for bad in ({}, {"symbols": [{"ticker": "T"}]}):
        with pytest.raises(ValueError):
            slicing.load_universe(spark, bad)


def test_slices(spark):
    df = series(spark, "s", range(101))
    assert slicing.slice_range(df, "2024-01-02", "2024-01-04").count() == 3
    assert [r["close"] for r in slicing.tail(df, 2).orderBy("ts").collect()] == [99, 100]
    for k in (2, 7, 10, 100, 500):
        want = sorted(set(np.linspace(0, 100, k).astype(int).tolist())) if k < 101 else list(range(101))
        assert [int(r["close"]) for r in slicing.downsample(df, k).orderBy("ts").collect()] == want


def test_provenance_worst_wins(spark):
    rows = [("k", 0, DAY0, DAY0, ["b", "a"], False, "x"), ("k", 3, days(2)[1], DAY0, ["a"], True, ""), ("k", 1, None, None, ["c"], False, "w")]
    df = spark.createDataFrame(rows, "k string, latency int, as_of timestamp_ntz, fetched_at timestamp_ntz, sources array<string>, is_cached boolean, note string")
    r = provenance.combine(df, ["k"]).first()
    assert (r["latency"], r["as_of"], r["sources"], r["is_cached"], r["note"]) == (3, DAY0, ["a", "b", "c"], True, "w; x")


def test_unknown_symbol(spark):
    symbols = spark.createDataFrame([("T", "X", "C", {"p": "t"})], "ticker string, exchange string, asset_class string, provider_tickers map<string,string>")
    assert slicing.find_symbol(symbols, "X:T").count() == 1 and slicing.by_provider(symbols, "p").count() == 1 and slicing.by_provider(symbols, "q").count() == 0
    with pytest.raises(slicing.SymbolNotFound):
        slicing.find_symbol(symbols, "U")

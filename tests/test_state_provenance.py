"""Where the state vector came from: worst wins per feature and matrix, from the as-of hit to the stored table."""

import datetime as dt

from driftglass.operators import features
from driftglass.operators import provenance as prov
from driftglass.plans import endpoints
from driftglass.sources import lake

T0 = dt.datetime(2026, 1, 1)
COLUMNS = "kind string, symbol string, ts timestamp_ntz, close double, source string, latency string, fetched_at timestamp_ntz"


def series(spark, symbol, latencies, source="p", step=1, late=0):
    rows = [("bars", symbol, T0 + dt.timedelta(days=i * step), 100.0 + i * i, source, x, T0 + dt.timedelta(days=i * step, hours=1 + late)) for i, x in enumerate(latencies)]
    return spark.createDataFrame(rows, COLUMNS)


def spec(*parts):
    return features.Spec("C", parts, 2, version=7)


def test_labels_and_ranks(spark):
    assert prov.LATENCY == ("LIVE", "DELAYED", "EOD", "HISTORICAL", "SIMULATED", "UNAVAILABLE")
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("LIVE",), ("SIMULATED",), ("odd",), (None,)], "x string")
    assert [r.r for r in df.select(prov.latency_rank(F.col("x")).alias("r")).collect()] == [0, 4, prov.HISTORICAL, None]


def test_a_value_carries_its_hit_and_the_worst_so_far(spark):
    own = series(spark, "C", ["LIVE"] * 12).unionByName(series(spark, "A", ["LIVE", "DELAYED", "LIVE", "LIVE"], "q", 2))
    m = features.state_vector(own, spec(features.Feature("a", "A", "level"), features.Feature("rel", "A", "rel_strength", window=1, vs="C")), tracked=True)
    rows = m.orderBy("ts").collect()
    day = lambda n: T0 + dt.timedelta(days=n)
    assert [r["a__from"]["as_of"] for r in rows] == [day(0), day(0), day(2), day(2), day(4), day(4), *[day(6)] * 6]
    assert [r["a__from"]["latency"] for r in rows] == [0, 0, *[1] * 10]  # DELAYED stays once it was in
    assert [r["rel__from"]["latency"] for r in rows] == [5, 5, *[1] * 10]  # no return on the first row: UNAVAILABLE
    assert [r["provenance"]["latency"] for r in rows] == [5, 5, *[2] * 10]  # at best EOD
    assert rows[11]["provenance"]["as_of"] == day(6) and rows[11]["a__from"]["fetched_at"] == day(0) + dt.timedelta(hours=1)


def test_a_stale_value_is_unavailable(spark):
    own = series(spark, "C", ["LIVE"] * 12).unionByName(series(spark, "A", ["LIVE"]))
    rows = features.state_vector(own, spec(features.Feature("a", "A", "level")), tracked=True).orderBy("ts").collect()
    assert [r["a__from"]["latency"] for r in rows] == [*[0] * 6, *[5] * 6] and [r["a"] is None for r in rows] == [*[False] * 6, *[True] * 6]


def test_features_combine_worst_wins_and_one_missing_spoils_the_matrix(spark):
    own = series(spark, "C", ["LIVE"] * 9, "p").unionByName(series(spark, "A", ["EOD", "HISTORICAL", "EOD"], "q", late=5))
    s = spec(features.Feature("c", "C", "level"), features.Feature("rel", "A", "rel_strength", window=1, vs="C"), features.Feature("gone", "X", "level"))
    got = {r.feature: r for r in features.matrix_provenance(own, features.state_vector(own, s), s).collect()}
    assert (got["c"].latency, got["c"].sources, got["c"].as_of, got["c"].note) == (0, ["p"], T0 + dt.timedelta(days=8), "")
    assert (got["rel"].latency, got["rel"].sources, got["rel"].as_of, got["rel"].fetched_at) == (prov.HISTORICAL, ["p", "q"], T0 + dt.timedelta(days=2), T0 + dt.timedelta(hours=1))
    assert (got["gone"].latency, got["gone"].as_of, got["gone"].note, got["gone"].is_cached) == (prov.UNAVAILABLE, None, "X has no bars", False)
    whole = got[features.WHOLE]
    assert (whole.latency, whole.is_cached, whole.sources) == (prov.UNAVAILABLE, True, ["none", "p", "q"]) and whole.note == "version 7; missing gone: X has no bars"
    fine = features.matrix_provenance(own, features.state_vector(own, spec(s.features[0])), spec(s.features[0])).where(f"feature = '{features.WHOLE}'").first()
    assert (fine.latency, fine.note) == (prov.EOD, "version 7")  # at best EOD


def test_kept_through_save_and_load(spark, tmp_path):
    at = str(tmp_path)
    rows = series(spark, "C", ["EOD"] * 6).drop("kind").withColumnsRenamed({}).selectExpr("ts", "close open", "close high", "close low", "close", "1D volume", "source", "latency", "fetched_at", "symbol", "'1d' tf")
    lake.write_bars(rows, at)
    s = spec(features.Feature("c", "C", "level"))
    m = endpoints.build_features(spark, at, s)
    assert {r.version for r in m.collect()} == {7} and {r["c__from"]["latency"] for r in m.collect()} == {prov.EOD}
    got = {r.feature: (r.latency, r.version) for r in endpoints.state_vector_provenance(spark, at, 7).collect()}
    assert got == {"c": ("EOD", 7), features.WHOLE: ("EOD", 7)}

"""The lake's log: versions, faults, conflicts, pruning, compaction."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftglass.sources import lake

T0 = dt.datetime(2024, 1, 1)


def rows(spark, closes, fetched=0, symbol="s"):
    at = T0 + dt.timedelta(days=fetched)
    return spark.createDataFrame([(T0 + dt.timedelta(days=i), c, c, c, c, 1.0, "a", "EOD", at, symbol, "1d") for i, c in closes.items()], lake.STORED)


def closes(spark, at, symbol="s", **more):
    return [r["close"] for r in lake.read_bars(spark, at, symbol, **more).collect()]


def test_versions_stay_readable(spark, tmp_path):
    at = str(tmp_path)
    assert lake.snapshot(spark, at) == (0, []) and not lake.has(spark, at)
    assert lake.write_bars(rows(spark, {0: 1.0, 1: 2.0}), at) == 1
    assert lake.write_bars(rows(spark, {1: 3.0}, 1), at) == 2 and lake.write_bars(rows(spark, {0: 9.0}, symbol="t"), at) == 3
    assert [closes(spark, at, version=v) for v in (1, 2, None)] == [[1.0, 2.0], [1.0, 3.0], [1.0, 3.0]]
    with pytest.raises(lake.DataUnavailable):
        lake.snapshot(spark, at, version=4)
    assert {(r.symbol, r.n_rows) for r in lake.stored_manifest(spark, at).collect()} == {("s", 2), ("t", 1)}
    assert lake.write_bars(rows(spark, {}), at) == 3  # nothing came in
    assert lake.vacuum(spark, at, keep=1) == 1 and closes(spark, at) == [1.0, 3.0]


def test_a_fault_before_the_commit_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    lake.write_bars(rows(spark, {0: 1.0}), at)
    monkeypatch.setattr(lake, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        lake.write_bars(rows(spark, {0: 5.0, 1: 6.0}, 1), at)
    monkeypatch.undo()
    assert closes(spark, at) == [1.0] and lake.read_all(spark, at).count() == 1  # staged files are there, but no version names them
    assert len(list(tmp_path.glob("bars/data/commit=*"))) == 2 and lake.vacuum(spark, at) == 1
    assert lake.write_bars(rows(spark, {1: 6.0}), at) == 2 and closes(spark, at) == [1.0, 6.0]


def test_of_two_writers_the_second_starts_again(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    lake.write_bars(rows(spark, {0: 1.0}), at)
    plain, first = lake.commit, []

    def late(*a):
        if not first:
            first.append(1)
            lake.write_bars(rows(spark, {1: 2.0}), at)
        return plain(*a)

    monkeypatch.setattr(lake, "commit", late)
    assert lake.write_bars(rows(spark, {2: 3.0}), at) == 3
    assert closes(spark, at) == [1.0, 2.0, 3.0] and not list(tmp_path.glob("bars/_log/*.tmp"))
    with pytest.raises(lake.Conflict):
        plain(spark, at, "bars", 1, [], [])


def test_the_log_prunes_files(spark, tmp_path):
    at = str(tmp_path)
    lake.write_bars(rows(spark, {i: float(i) for i in range(40)}), at, rows_per_file=10)
    own = sorted(lake.snapshot(spark, at)[1], key=lambda f: f.first)
    assert [f.rows for f in own] == [10] * 4
    for f in own[1:]:  # would fail if they were read
        broken = tmp_path / "bars" / "data" / f.path
        broken.write_bytes(b"not parquet")
        (broken.parent / f".{broken.name}.crc").unlink()
    assert closes(spark, at, start="2024-01-03", end="2024-01-05") == [2.0, 3.0, 4.0]
    assert lake.stored_manifest(spark, at).first()["n_rows"] == 40
    assert lake.read_bars(spark, at, "s", end="2024-01-10").where(F.col("close") > 8).count() == 1


def test_whole_versions_and_compaction(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    monkeypatch.setattr(lake, "COMPACT", 3)
    lake.write_bars(rows(spark, {0: 0.0, 1: 1.0, 2: 2.0}), at, rows_per_file=1)
    for i in range(3, 7):
        lake.write_bars(rows(spark, {i: float(i)}, symbol="t"), at)
    assert {p.name[18:] for p in tmp_path.glob("bars/_log/*.whole")} == {"03.whole"}
    (tmp_path / "bars" / "_log" / f"{1:020d}.json").unlink()  # what a whole version holds isn't read from the changes before
    version, files = lake.snapshot(spark, at)
    assert version == 5 and len(files) == 4
    assert lake.compact(spark, at) == 6 and lake.compact(spark, at) == 6
    assert len(lake.snapshot(spark, at)[1]) == 2 and closes(spark, at) == [0.0, 1.0, 2.0] and len(closes(spark, at, "t")) == 4
    change = json.loads((tmp_path / "bars" / "_log" / f"{6:020d}.json").read_text())
    assert len(change["gone"]) == 3 and sum(f["rows"] for f in change["come"]) == 3

"""Shared folders, slices and components."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from driftglass.llm import common


def context(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: default)
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: folder, setCheckpointDir=lambda x: None, master=master))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        common.shared_root(context(master))
    assert common.shared_root(context(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_one_process_may_use_a_temporary_folder():
    assert all(common.shared_root(context(m)).startswith("file://") for m in ("local", "local[*]", "local[4]"))


def test_slices_are_bounded_and_complete():
    texts = ["a" * n for n in (5, 0, 100, 3, 3, 3, 3, 200, 1)] + [None, "b"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    for rows, size in ((256, 1 << 22), (2, 1 << 22), (256, 10), (3, 1), (1, 1)):
        parts = list(common.slices(batch, "text", rows, size))
        assert [t for p in parts for t in p.column("text").to_pylist()] == texts
        assert all(0 < p.num_rows <= rows and sum(len(t or "") for t in p.column("text").to_pylist()[:-1]) <= size for p in parts)
    assert list(common.slices(batch.slice(0, 0), "text")) == []


def test_components_leave_no_rounds_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_root", lambda s: f"file://{tmp_path}")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 1)], "u long, v long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert len(list(tmp_path.iterdir())) == 1

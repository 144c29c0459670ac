"""The pivot index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.llm import pivot_index


def brute(rows):
    ok = [(i, np.array(x, float)) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    links = {i: set() for i, _ in rows}
    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i].add(j)
                links[j].add(i)
    return links


def result(df):
    return {r["vec_id"]: r for r in pivot_index.near_vectors(df).collect()}


def test_recall_on_table(spark):
    """The table has no near pairs of its own, so noisy copies are planted: cosines from about 0.85 to 0.99."""
    own = [(r["vec_id"], list(map(float, r["embedding"]))) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(11)
    noisy = lambda x, s: (np.array(x) + rng.normal(0, s * np.linalg.norm(x) / len(x) ** 0.5, len(x))).tolist()
    rows = own + [(10_000 + 10 * i + k, noisy(x, s)) for i, (_, x) in enumerate(own[:150]) for k, s in enumerate((0.1, 0.3, 0.45))]
    links = brute(rows)
    assert sum(map(len, links.values())) > 600
    got = result(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(got) == len(links)
    assert all(got[i]["n_links"] <= len(x) for i, x in links.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(map(len, links.values()))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]),
            (10, [2.0, 0.0]), (11, [0.0, 1.0]), (12, [1e-30, 0.0]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, x, "q") for i, x in rows], "vec_id long, embedding array<double>, near string")
    got = result(df)
    links = brute(rows)
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert [i for i, r in got.items() if not r["kept"]] == [2, 10, 12]
    assert {got[i]["component_id"] for i in (1, 2, 10, 12)} == {1}


def test_chain_and_hot_group_in_blocks(spark, monkeypatch):
    """Components follow chains of links; a hot list split in blocks counts every link once."""
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    rng = np.random.default_rng(3)
    angle = np.arange(12) * 0.3
    chain = [[float(np.cos(a)), float(np.sin(a)), 0.0] for a in angle]
    hot = (np.array([0, 0, 1.0]) + rng.normal(0, 0.05, (120, 3))).tolist()
    rows = list(enumerate(chain + hot))
    links = brute(rows)
    got = result(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(map(len, links.values()))
    assert all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert {got[i]["component_id"] for i in range(12, 132)} == {12}
    assert {got[i]["component_id"] for i in range(12)} == {0}


def test_pairs_and_products_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    own = rng.normal(0, 1, (150, 16))
    rows = list(enumerate(np.concatenate([own, own + rng.normal(0, 0.2, own.shape), own[:20] * 3]).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = []
    for dense in (1, 1 << 40):
        monkeypatch.setattr(pivot_index, "DENSE", dense)
        found.append(sorted(map(tuple, result(df).values())))
    assert found[0] == found[1]
    links = brute(rows)
    assert 0.9 * sum(map(len, links.values())) <= sum(r[1] for r in found[0]) <= sum(map(len, links.values()))


def test_candidates_by_counting_shared_pivots():
    rng = np.random.default_rng(4)
    for width, pivot in ((8, 5), (8, 0), (3, 7), (1, 2)):
        names = np.array([rng.choice([p for p in range(12) if p != pivot], width, replace=False) for _ in range(60)])
        names[:, 0] = pivot
        least = min(2, width)
        found = pivot_index.candidates(names, pivot, least)
        sets = [set(r.tolist()) for r in names]
        want = [[i != j and len(a & b) >= least and min(a & b) == pivot for j, b in enumerate(sets)] for i, a in enumerate(sets)]
        assert (found == np.array(want)).all()


def test_repeated_ids_have_one_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.0]), (2, None), (3, [1.0, 0.1]), (4, [0.0, 2.0])]
    got = [pivot_index.near_vectors(spark.createDataFrame(x, "vec_id long, embedding array<double>")).orderBy("vec_id").collect() for x in (rows, rows[::-1])]
    assert got[0] == got[1] and [r["n_links"] for r in got[0]] == [1, 1, 1, 1, 1, 1]


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_index.near_vectors(df).count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, None)], "vec_id long, embedding array<float>").withColumn("own", F.lit(1))
    assert [(r["vec_id"], r["n_links"], r["component_id"]) for r in pivot_index.near_vectors(df).collect()] == [(None, 0, None)] * 2


@pytest.mark.parametrize("n", [1, 2])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(n)], "vec_id long, embedding array<double>")
    assert {r["n_links"] for r in pivot_index.near_vectors(df).collect()} == {n - 1}

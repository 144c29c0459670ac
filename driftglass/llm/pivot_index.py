"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its ``PREFIX`` nearest reference points (pivots) in order of nearness. Inverted lists map a
pivot to the vectors that name it. Inside a list, counting shared pivots retrieves the candidates, pairs that share at
least ``SHARED``; only these are verified by cosine in double precision (where a strip's pairs are nearly all candidates, by
one matrix product). A pair that meets in several lists belongs to the shared pivot
of the lowest number, so each link is counted once. Lists give back, per vector, a link count and the smallest
vector of its component within the list; pairs are never written out.

The pivots are a bounded sample of the vectors (at most ``MOST_PIVOTS``, about four times the root of the row count,
farthest apart first from a hash-ordered sample); every vector is indexed. Lists longer than ``BLOCK`` are dealt into
blocks, and each pair of blocks is a group of its own, so no task holds a whole hot list.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep
themselves; vectors of different length never link; equal vectors link; rows that share an id count as one vector, the
one that sorts first among those that can link, and each gets its result; ties in nearness go to the pivot of the lower number; a vector's length is
bounded by what an executor holds ``BLOCK`` of; an empty table gives no rows; a null id is left out of the links and has null as its component. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftglass.llm.common import connected_components, materialize

LEAST = 0.9
PREFIX = 8
SHARED = 2
BLOCK = 2048
MOST_PIVOTS = 4096
SAMPLE = 4
APART = 0.7  # pivots are no nearer to each other: a dense group gets one, so that its members agree on their order
STRIP = 512
DENSE = 16  # from this share of candidates on, a matrix product is cheaper than pair by pair
PAIRS = 1 << 15


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x`` of the vectors that can link."""
    return (
        vectors.where("vec_id is not null and embedding is not null")
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"))
        .where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    )


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_rows(rows: list | np.ndarray) -> np.ndarray:
    """Rows of equal length, scaled to length one in double precision."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, rows: int, most: int = MOST_PIVOTS) -> dict[int, np.ndarray]:
    """Pivots by vector length: a hash-ordered sample of at most ``SAMPLE`` * ``most`` vectors, thinned to at most ``most`` far from each other."""
    wanted = int(min(most, max(16, 4 * np.sqrt(rows))))
    share = min(1.0, 2.0 * SAMPLE * wanted / max(rows, 1))
    h = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 40))
    some = vectors.where(h < int(share * (1 << 40))).orderBy(h, "vec_id").limit(SAMPLE * wanted).collect()
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r["x"]), []).append(r["x"])
    pivots = {}
    for size, own in by_size.items():
        own = np.unique(unit_rows(own), axis=0)
        k = max(1, wanted * len(own) // max(len(some), 1))
        nearest = np.full(len(own), -2.0)
        chosen = []
        at = 0
        while len(chosen) < k and nearest[at] < APART:
            chosen.append(at)
            nearest = np.maximum(nearest, own @ own[at])
            at = int(nearest.argmin())
        pivots[size] = own[np.unique(chosen)]
    return pivots


def permutations(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id``, ``x``, and ``near``: the PREFIX nearest pivots, nearest first. Lengths without a pivot get one list of their own."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    start = dict(zip(sorted(pivots), np.cumsum([0, *(len(pivots[k]) for k in sorted(pivots))]).tolist(), strict=False))
    schema = T.StructType([*vectors.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            length = pc.list_value_length(batch.column(1)).to_numpy()
            near: list = [[-n] for n in length.tolist()]
            for size, own in shared.value.items():
                at = np.flatnonzero(length == size)
                for i in range(0, len(at), 1024):
                    some = at[i : i + 1024]
                    s = unit_rows(matrix_of(batch.column(1).take(pa.array(some)))) @ own.T
                    k = min(PREFIX, s.shape[1])
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
                    for j, named in zip(some.tolist(), (np.take_along_axis(top, order, 1) + start[size]).tolist(), strict=True):
                        near[j] = named
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "x": batch.column(1), "near": pa.array(near, pa.list_(pa.int32()))})

    return vectors.mapInArrow(run, schema)


def candidates(names: np.ndarray, pivot: int, least: int) -> np.ndarray:
    """Which rows of a list are candidate pairs that belong to it: they share ``least`` pivots or more and none below ``pivot``.

    Each further pivot that rows name is a short list inside this one; counting goes from list to list, so pairs that share only ``pivot`` aren't touched.
    """
    flat = names.ravel()
    order = np.argsort(flat, kind="stable")
    known, begins = np.unique(flat[order], return_index=True)
    rows = np.split(order // names.shape[1], begins[1:])
    shared, below = np.zeros((len(names),) * 2, np.uint8), np.zeros((len(names),) * 2, bool)
    for name, own in zip(known.tolist(), rows, strict=True):
        if len(own) > 1 and name != pivot:
            if name < pivot:
                below[np.ix_(own, own)] = True
            else:
                shared[np.ix_(own, own)] += 1
    found = (shared >= least - 1) & ~below
    np.fill_diagonal(found, False)
    return found


def _verify_list(table: pa.Table) -> pa.Table:
    """One inverted list, or one pair of its blocks: link counts and stars of the pairs that belong here."""
    pivot = table.column("pivot")[0].as_py()
    one, other = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")  # ids are distinct
    ids = table.column("vec_id").to_numpy()[order]
    block = table.column("own").to_numpy()[order]
    x = unit_rows(matrix_of(table.column("x")))[order]  # vectors of one list have one length, and so as many pivots
    names = matrix_of(table.column("near"))[order]
    ok = candidates(names, pivot, min(SHARED, names.shape[1]) if pivot >= 0 else 1)
    if one != other:
        ok &= block[:, None] != block[None, :]
    linked = []
    for at in range(0, len(ids), STRIP):
        part = ok[at : at + STRIP]
        a, b = np.nonzero(part)
        if len(a) > part.size // DENSE:
            part &= x[at : at + STRIP] @ x.T >= LEAST
        else:
            for first in range(0, len(a), PAIRS):
                i, j = a[first : first + PAIRS], b[first : first + PAIRS]
                part[i, j] = np.einsum("ij,ij->i", x[at + i], x[j]) >= LEAST
        own = np.flatnonzero(part.any(axis=1))
        if len(own):
            linked.append((own + at, part[own]))
    n_links = ok.sum(axis=1)
    star = np.arange(len(ids))
    while True:
        before = star.copy()
        for own, found in linked:
            star[own] = np.minimum(star[own], np.where(found, star[None, :], len(ids)).min(1))
        star = star[star]
        if np.array_equal(before, star):
            break
    kept = n_links > 0
    return pa.table({"vec_id": ids[kept], "n_links": n_links[kept], "star": ids[star[kept]]})


def near_vectors(vectors: DataFrame, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` (smallest vec_id reachable) and ``kept``.

    ``most_pivots`` bounds the sample that the driver sees and what is broadcast; lists get longer once four times the root of the rows passes it.
    """
    own = materialize(usable(vectors).groupBy("vec_id").agg(F.min("x").alias("x")), "pivot-vectors")
    described = materialize(permutations(own, choose_pivots(own, own.count(), most_pivots)), "pivot-permutations")
    sizes = described.select(F.explode("near").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    lists = described.select("vec_id", "x", "near", F.explode("near").alias("pivot"))
    # sizes has at most one row per pivot, and pivots are bounded
    dealt = lists.join(F.broadcast(sizes.where("blocks > 1")), "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("pivot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "vec_id", "x", "near")
    found = materialize(met.groupBy("pivot", "low", "high").applyInArrow(_verify_list, "vec_id long, n_links long, star long"), "pivot-links")
    parts = connected_components(found.select(F.col("vec_id").alias("u"), F.col("star").alias("v")), "pivot-components")
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    linked = counts.join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )

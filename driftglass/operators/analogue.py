"""Historical analogues: guarded candidates, Mahalanobis distance, episode collapse, forward-return statistics.

The covariance is one aggregation over the candidate pool; only the k x k matrix (k features) reaches the driver,
where it is inverted, and distances are computed back on the executors as one flat expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftglass.functions import blocked
from driftglass.functions import indicators as ind
from driftglass.session import written

EXCLUSION = 21
SEPARATION = 21
RIDGE = 0.10
HORIZONS = (1, 3, 7, 21)
MIN_EPISODES = 8
ITERATIONS = 2000
SEED = 42
INTERVAL = (10, 90)
WALK_BLOCK = 512


def numbered(matrix: DataFrame) -> DataFrame:
    """Add ``row_idx``, the position on the calendar."""
    return matrix.withColumn("row_idx", F.row_number().over(Window.orderBy("ts")) - 1)


def candidates(rows: DataFrame, query_idx: int, exclusion: int = EXCLUSION) -> DataFrame:
    """Rows before the query by more than the exclusion window."""
    return rows.where(F.col("row_idx") < query_idx - exclusion)


def covariance(pool: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """Sample covariance of all pairs of columns in one aggregation keyed by the pair, and the pool's size.

    A row becomes one short row for each pair, added up before the shuffle, so plans stay small however many features there are.
    """
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = f"array({', '.join(f'`{c}`' for c in columns)})"
    each = f"explode(array({', '.join(f'named_struct(\'i\', {i}, \'j\', {j})' for i, j in pairs)})) AS p"
    long = pool.selectExpr(f"{x} AS x", each).selectExpr("p.i AS i", "p.j AS j", "x[p.i] AS a", "x[p.j] AS b")
    rows = long.groupBy("i", "j").agg(F.count("*").alias("n"), F.covar_samp("a", "b").alias("c")).collect()
    found = np.full((k, k), np.nan)
    for r in rows:
        if r["c"] is not None:
            found[r["i"], r["j"]] = found[r["j"], r["i"]] = r["c"]
    return found, rows[0]["n"] if rows else 0


def inverse(cov: np.ndarray, ridge: float = RIDGE) -> np.ndarray | None:
    """Pseudo-inverse after shrinking towards the diagonal; None where the covariance is undefined."""
    if not np.isfinite(cov).all():
        return None
    return np.linalg.pinv(cov + ridge * (np.trace(cov) / len(cov)) * np.eye(len(cov)))


def mahalanobis(columns: list[str], query: list[float], inv: np.ndarray | None) -> Column:
    """Distance of each row to the query point as one flat sum, NULL where the covariance is undefined.

    The inverse is symmetric, so a pair of features is one term; zero terms go.
    """
    if inv is None:
        return F.lit(None).cast("double")
    d = [f"(`{c}` - {float(q)!r}D)" for c, q in zip(columns, query, strict=True)]
    rows = []
    for i, x in enumerate(d):
        inner = [f"{float(inv[i][j] * (1 if i == j else 2))!r}D * {d[j]}" for j in range(i, len(d)) if inv[i][j]]
        if inner:
            rows.append(f"{x} * ({' + '.join(inner)})")
    return F.expr(f"sqrt(greatest({' + '.join(rows) or '0D'}, 0D))")


def distances(pool: DataFrame, columns: list[str], query: list[float], ridge: float = RIDGE) -> DataFrame:
    """The pool with ``distance`` to the query."""
    return pool.withColumn("distance", mahalanobis(columns, query, inverse(covariance(pool, columns)[0], ridge)))


def episodes(ranked: DataFrame, separation: int = SEPARATION, by: list[str] | None = None) -> DataFrame:
    """Nearest first, keep a row unless one within ``separation`` rows is kept already. One array per query, so for pools of one calendar.

    Returns ``row_idx``, ``distance`` and ``rank`` per kept row (and the key columns).
    """
    by = by or []
    order = F.array_sort(F.collect_list(F.struct("distance", "row_idx")))
    empty = F.array().cast("array<struct<distance:double,row_idx:bigint>>")
    taken = F.aggregate("x", empty, lambda acc, e: F.when(F.exists(acc, lambda a: F.abs(a["row_idx"] - e["row_idx"]) <= separation), acc).otherwise(F.array_append(acc, e)))
    own = ranked.where("distance is not null").withColumn("row_idx", F.col("row_idx").cast("long")).groupBy(*by).agg(order.alias("x")).withColumn("kept", taken)
    return own.select(*by, F.posexplode("kept").alias("pos", "e")).select(*by, F.col("e.row_idx").alias("row_idx"), F.col("e.distance").alias("distance"), (F.col("pos") + 1).alias("rank"))


def episodes_in_blocks(ranked: DataFrame, separation: int = SEPARATION, block: int = 1 << 12, most: int = 1 << 20) -> DataFrame:
    """As ``episodes`` of one query, for pools that no task should hold: ``row_idx``, ``distance``, ``rank``.

    A row is kept once it is known that nothing nearer within ``separation`` rows is kept, and goes once something is. Blocks of rows, each with what
    lies within the separation of it, decide what they can, nearest first; a row that hangs on an undecided one outside waits. Rounds
    go on over what waits, with blocks twice as long up to ``most``, so chains over many blocks (distances that rise with time) end too.
    """
    kinds = pa.schema([("row_idx", pa.int64()), ("distance", pa.float64()), ("kept", pa.bool_())])
    ddl = "row_idx long, distance double, kept boolean"
    rows = ranked.where("distance is not null").select(F.col("row_idx").cast("long").alias("row_idx"), "distance", F.lit(False).alias("kept"))

    def decide(size: int):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("distance", "ascending"), ("row_idx", "ascending")])
            at, number = table.column("row_idx").to_numpy(), table.column("block")[0].as_py()
            low = number * size
            own, was_kept = at // size == number, table.column("kept").to_numpy(zero_copy_only=False)
            place = at - low + 2 * separation  # room on both sides
            kept, waits = np.zeros((2, size + 4 * separation + 1), bool)
            kept[place[was_kept]] = True
            state = np.zeros(len(at), np.int8)  # 0 goes, 1 waits, 2 kept
            state[was_kept] = 2
            for i in np.flatnonzero(~was_kept).tolist():
                p = int(place[i])
                near = slice(p - separation, p + separation + 1)
                if kept[near].any():
                    continue
                if own[i] and not waits[near].any():
                    kept[p], state[i] = True, 2
                else:
                    waits[p], state[i] = True, 1
            found = np.flatnonzero(own & (state > 0))
            return pa.table([pa.array(at[found]), table.column("distance").take(pa.array(found)), pa.array(state[found] == 2)], schema=kinds)

        return run

    size = block
    while True:
        reached = F.explode(F.sequence(F.expr(f"(row_idx - {separation}) div {size}"), F.expr(f"(row_idx + {separation}) div {size}"))).alias("block")
        after = written(rows.select("*", reached).groupBy("block").applyInArrow(decide(size), ddl), "episodes")
        if after.where("not kept").isEmpty():
            break
        rows, size = after, min(2 * size, most)
    order = blocked.placed(after.select("row_idx", "distance"), [], ["distance", "row_idx"])
    return order.select("row_idx", "distance", (F.col(blocked.ROW) + 1).cast("int").alias("rank"))


def causal_covariances(rows: DataFrame, columns: list[str], exclusion: int = EXCLUSION, size: int = WALK_BLOCK) -> DataFrame:
    """Per ``row_idx`` the size ``n`` of its pool (rows that have all columns, more than ``exclusion`` before it) and ``cov``, the pool's sample covariances row by row of the lower triangle.

    All pools at once: sums of outer products run over blocks of rows, around the mean of everything so that little cancels, and a row takes
    the sums of the row ``exclusion`` and one before it. Pools of less than two rows have none.
    """
    k, ok = len(columns), " and ".join(f"`{c}` is not null" for c in columns)
    centre = rows.where(ok).agg(*[F.avg(c).alias(c) for c in columns]).first()
    x = [F.when(F.expr(ok), F.col(c) - F.lit(centre[c] or 0.0)) for c in columns]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    terms = {"n": F.when(F.expr(ok), 1.0).otherwise(0.0)} | {f"s{i}": F.coalesce(x[i], F.lit(0.0)) for i in range(k)} | {f"s{i}_{j}": F.coalesce(x[i] * x[j], F.lit(0.0)) for i, j in pairs}
    own = rows.select(F.col("row_idx").cast("long").alias(blocked.ROW), *[c.alias(f"__{n}") for n, c in terms.items()])
    sums = blocked.running(own, [], {n: ("sum", f"__{n}") for n in terms}, size)
    n = F.col("n")
    cov = F.array(*[(F.col(f"s{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / n) / (n - 1) for i, j in pairs])
    return sums.where(n >= 2).select((F.col(blocked.ROW) + exclusion + 1).alias("row_idx"), n.cast("long").alias("n"), cov.alias("cov"))


def walk_forward(matrix: DataFrame, columns: list[str], top: int = 5, exclusion: int = EXCLUSION, ridge: float = RIDGE, size: int = WALK_BLOCK) -> DataFrame:
    """For every row that has all columns, its ``top`` nearest earlier rows under the covariance of its own pool: ``query_idx``, ``rank``, ``row_idx``, ``distance``, ``n`` (pool).

    Differences are whitened by the Cholesky factor of the covariance with its ridge, block of queries against block of
    rows, so a task holds two blocks; each block passes on its nearest, of which the nearest are kept.
    """
    rows = written(numbered(matrix.select("ts", *columns)), "walk")
    ready = rows.where(" and ".join(f"`{c}` is not null" for c in columns)).select(F.col("row_idx").cast("long").alias("row_idx"), F.array(*columns).alias("x"))
    block = F.expr(f"row_idx div {size}")
    asked = ready.join(causal_covariances(rows, columns, exclusion, size), "row_idx").withColumn("own", block)
    queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("other"), "own", "row_idx", "x", "n", "cov")
    last = rows.agg(F.max("row_idx")).first()[0] or 0
    pool = ready.withColumn("other", block).select("other", F.explode(F.sequence(F.col("other"), F.lit(last // size).cast("long"))).alias("own"), "row_idx", "x", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("cov"))
    k = len(columns)

    def nearest(table: pa.Table) -> pa.Table:
        is_query = table.column("cov").is_valid()
        q, p = table.filter(is_query), table.filter(pa.compute.invert(is_query))
        found = {"query_idx": [], "row_idx": [], "distance": [], "n": []}
        if q.num_rows and p.num_rows:
            flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
            qi, pi = q.column("row_idx").to_numpy(), p.column("row_idx").to_numpy()
            qx, px, low = flat(q, "x").reshape(-1, k), flat(p, "x").reshape(-1, k), flat(q, "cov").reshape(q.num_rows, -1)
            cov = np.zeros((len(qi), k, k))
            i, j = np.tril_indices(k)
            cov[:, i, j] = cov[:, j, i] = low
            cov += (ridge * np.trace(cov, axis1=1, axis2=2) / k)[:, None, None] * np.eye(k)
            sizes = q.column("n").to_numpy()
            for a, (c, at, n) in enumerate(zip(cov, qi, sizes, strict=True)):
                near = np.flatnonzero(pi < at - exclusion)
                if not len(near):
                    continue
                off = (px[near] - qx[a]).T
                try:
                    d = np.sqrt((np.linalg.solve(np.linalg.cholesky(c), off) ** 2).sum(0))
                except np.linalg.LinAlgError:  # not positive: equal rows, as the single query has it
                    d = np.sqrt(np.maximum((off * (np.linalg.pinv(c) @ off)).sum(0), 0))
                best = np.lexsort((pi[near], d))[:top]
                found["query_idx"] += [at] * len(best)
                found["row_idx"] += pi[near][best].tolist()
                found["distance"] += d[best].tolist()
                found["n"] += [n] * len(best)
        return pa.table(found, schema=pa.schema([("query_idx", pa.int64()), ("row_idx", pa.int64()), ("distance", pa.float64()), ("n", pa.int64())]))

    near = queries.select(pool.columns).unionByName(pool).groupBy("own", "other").applyInArrow(nearest, "query_idx long, row_idx long, distance double, n long")
    rank = F.row_number().over(Window.partitionBy("query_idx").orderBy("distance", "row_idx"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top)


def with_forward_returns(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """``ts``, ``close`` and ``fwd_<h>`` by row offset."""
    w = Window.partitionBy("symbol").orderBy("ts")
    for h in horizons:
        bars = ind.forward_return(bars, f"fwd_{h}", "close", w, h)
    return bars


def horizon_stats(anchors: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Per horizon: count, median and quartiles (linear interpolation) of the present forward returns."""
    long = anchors.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("r")) for h in horizons])).alias("x")).select("x.*")
    q = F.expr("percentile(r, array(0.25, 0.5, 0.75))")
    return long.groupBy("horizon").agg(F.count("r").alias("n"), q.alias("q")).select("horizon", "n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))


def bootstrap_ci(anchors: DataFrame, horizons: tuple[int, ...] = HORIZONS, least: int = MIN_EPISODES) -> DataFrame:
    """Per horizon the seeded bootstrap interval of the median of anchors in order of ``rank``; NULL below ``least`` episodes. Anchors are few by construction."""
    names = [f"fwd_{h}" for h in horizons]

    def run(table: pa.Table) -> pa.Table:
        r = np.array(table.sort_by("rank").column("r").drop_null().to_pylist())
        low = high = None
        if len(r) >= least:
            draws = np.random.default_rng(SEED).integers(0, len(r), (ITERATIONS, len(r)))
            low, high = np.percentile(np.median(r[draws], axis=1), INTERVAL).tolist()
        return pa.table({"horizon": pa.array([table.column("horizon")[0].as_py()], pa.int32()), "n": pa.array([len(r)], pa.int64()), "ci_low": pa.array([low], pa.float64()), "ci_high": pa.array([high], pa.float64())})

    parts = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col("rank"), F.col(n).alias("r")) for h, n in zip(horizons, names, strict=True)]))
    return anchors.select(parts.alias("x")).select("x.*").groupBy("horizon").applyInArrow(run, "horizon int, n long, ci_low double, ci_high double")


def find_analogues(matrix: DataFrame, bars: DataFrame, when: str, exclusion: int = EXCLUSION, separation: int = SEPARATION, top: int | None = None) -> DataFrame:
    """Kept episodes for the row at or before ``when``: ``row_idx``, ``ts``, ``distance``, ``rank`` and forward returns.

    Empty where the query row is incomplete or lacks a score, or where nothing precedes it by more than the exclusion.
    """
    zs = [c for c in matrix.columns if c.endswith("__z")]
    rows = numbered(matrix)  # read for the query row, the covariance and the distances: a saved matrix is cheapest
    query = rows.where(F.col("ts") <= F.lit(when).cast("timestamp_ntz")).orderBy(F.desc("ts")).limit(1).first()
    bars = with_forward_returns(bars)
    names = [f"fwd_{h}" for h in HORIZONS]
    ok = F.col("complete")
    for z in zs:
        ok = ok & F.col(z).isNotNull()
    if query is None or not query["complete"] or any(query[z] is None for z in zs):
        pool = rows.limit(0).withColumn("distance", F.lit(None).cast("double"))
    else:
        pool = distances(candidates(rows.where(ok), query["row_idx"], exclusion), zs, [query[z] for z in zs])
    kept = episodes(pool, separation)
    if top is not None:
        kept = kept.where(F.col("rank") <= top)
    return kept.join(rows.select("row_idx", "ts"), "row_idx").join(bars.select("ts", *names), "ts", "left").select("row_idx", "ts", "distance", "rank", *names)

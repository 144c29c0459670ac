"""Windows over one long series in many tasks.

``placed`` numbers the rows of each series by a range-partitioned sort, ``in_blocks`` cuts a series into blocks of rows, each with
the halo rows that its windows reach back (or ahead) to, and ``running`` carries states over blocks: count, mean and
sum of squares, maximum, product and last value merge, so a row needs its own block and one row with the state of all blocks before.
A series that holds most of the rows spreads over as many tasks as it has blocks; what is left per series is one row per block.

``by`` are the key columns, ``order`` the columns that put a series in order; rows that tie in all of them may change places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from driftglass.session import written

SIZE = 1 << 16
ROW, BLOCK, HALO = "__row", "__block", "__halo"
#: A spread below this share of the mean is rounding: a series of equal values has none.
ROUNDING = 1e-14
#: So many values, and so many of their products, are multiplied in one go.
FAN = 16


def placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ROW, the position in its series from 0. Nothing but one row per series and partition meets in a window."""
    if not by:  # one series: a key that is the same for all rows
        return placed(df.withColumn("__one", F.lit(0)), ["__one"], order).drop("__one")
    own = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__id", F.monotonically_increasing_id())
    rows = written(own.withColumns({"__place": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"), "placed")
    parts = rows.groupBy(*by, "__place").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    starts = parts.select(*by, "__place", (F.sum("__n").over(earlier) - F.col("__n") - F.col("__first")).alias("__start"))
    return rows.join(starts, [*by, "__place"]).withColumn(ROW, F.col("__start") + F.col("__at")).drop("__place", "__at", "__start")


def in_blocks(rows: DataFrame, by: list[str], before: int, after: int = 0, size: int = SIZE) -> tuple[DataFrame, WindowSpec]:
    """Rows of ``placed`` once for each block that needs them, and the window of a block. HALO marks rows that are only there to be looked at."""
    own = F.expr(f"{ROW} div {size}")
    reached = F.sequence(F.expr(f"greatest({ROW} - {after}, 0L) div {size}"), F.expr(f"({ROW} + {before}) div {size}"))
    return rows.withColumn(BLOCK, F.explode(reached)).withColumn(HALO, F.col(BLOCK) != own), Window.partitionBy(*by, BLOCK).orderBy(ROW)


def over_blocks(df: DataFrame, by: list[str], order: list[str], build: Callable[[DataFrame, WindowSpec], DataFrame], before: int, after: int = 0, size: int = SIZE) -> DataFrame:
    """``build(df, w)`` as if ``w`` were the window of whole series, for row frames that reach at most ``before`` rows back and ``after`` ahead."""
    rows, w = in_blocks(df if ROW in df.columns else placed(df, by, order), by, before, after, size)
    return build(rows, w).where(~F.col(HALO)).drop(BLOCK, HALO)


def merged(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squared deviations of two parts together; a spread that is only rounding is none."""
    (n0, mean0, m0), (n1, mean1, m1) = a, b
    step, n = mean1 - mean0, n0 + n1
    either = lambda both, x, y: F.when(n0 == 0, y).when(n1 == 0, x).otherwise(both)
    mean, m2 = either(mean0 + step * n1 / n, mean0, mean1), either(m0 + m1 + step * step * n0 * n1 / n, m0, m1)
    return n, mean, F.when(m2 > n * F.pow(mean * ROUNDING, F.lit(2)), m2).when(m2.isNotNull(), 0.0)


def state_of(v: str) -> list[Column]:
    """Aggregates ``n``, ``mean``, ``m2`` of a column."""
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")]


def merge_states(states: DataFrame, by: list[str]) -> DataFrame:
    """Rows ``n``, ``mean``, ``m2`` of parts, added up per key around the mean of all, so nothing large cancels."""
    every = Window.partitionBy(*by)
    off = F.col("mean") - F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every)
    parts = states.where("n > 0").withColumn("__off", off)
    summed = parts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("m2") + F.col("n") * F.col("__off") * F.col("__off")).alias("m2"))
    return summed.select(*by, "n", "mean", "m2")


#: States of one number: how rows of a block give it, and how two of them merge.
KINDS = {"max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "product": (F.product, lambda a, b: F.coalesce(a * b, a, b))}


def running(rows: DataFrame, by: list[str], states: dict[str, tuple[str, str]], size: int = SIZE, block: str | None = None, at: str = ROW) -> DataFrame:
    """Add states of all rows so far, the row included: ``states`` maps a name to a kind and a column.

    ``moments`` gives ``<name>_n``, ``<name>_mean`` and ``<name>_m2`` (sum of squared deviations), ``max``, ``sum``, ``product`` and ``last`` (value
    that isn't missing) give ``<name>``; missing values are left out. A product near the end of the doubles is ``products``' to tell. ``rows`` come from ``placed``, or have a column ``block`` of their own whose order agrees with ``at``'s.
    """
    if block is None:
        block = BLOCK
        rows = rows.withColumn(BLOCK, F.expr(f"{ROW} div {size}"))
    inside = Window.partitionBy(*by, block).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    earlier = every.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals, carried, own, found = [], {}, {}, {}
    for name, (kind, v) in states.items():
        t, p, i = f"__t_{name}", f"__p_{name}", f"__i_{name}"
        if kind == "moments":
            totals += [F.count(v).alias(f"{t}_n"), F.avg(v).alias(f"{t}_mean"), (F.var_pop(v) * F.count(v)).alias(f"{t}_m2")]
            n, mean = F.col(f"{t}_n"), F.col(f"{t}_mean")
            centre = F.sum(n * mean).over(every) / F.sum(n).over(every)
            off = mean - centre
            count, first, second = F.sum(n).over(earlier), F.sum(n * off).over(earlier), F.sum(n * off * off + F.col(f"{t}_m2")).over(earlier)
            carried |= {f"{p}_n": F.coalesce(count, F.lit(0)), f"{p}_mean": centre + F.try_divide(first, count), f"{p}_m2": F.greatest(second - F.try_divide(first * first, count), F.lit(0.0))}
            own |= {f"{i}_n": F.count(v).over(inside), f"{i}_mean": F.avg(v).over(inside), f"{i}_m2": F.var_pop(v).over(inside) * F.count(v).over(inside)}
            n, mean, m2 = merged(*(tuple(F.col(f"{x}_{c}") for c in ("n", "mean", "m2")) for x in (p, i)))
            found |= {f"{name}_n": n, f"{name}_mean": mean, f"{name}_m2": m2}
        elif kind == "last":
            seen = F.when(F.col(v).isNotNull(), F.struct(at, F.col(v).alias("v")))
            totals.append(F.max(seen).alias(t))
            carried[p] = F.max(t).over(earlier)["v"]
            own[i] = F.last(v, ignorenulls=True).over(inside)
            found[name] = F.coalesce(i, p)
        elif kind in KINDS:
            f, both = KINDS[kind]
            totals.append(f(v).alias(t))
            carried[p] = f(t).over(earlier)
            own[i] = f(v).over(inside)
            found[name] = both(F.col(p), F.col(i))
        else:
            raise ValueError(f"no state is called {kind}")
    prefix = rows.groupBy(*by, block).agg(*totals).select(*by, block, *[c.alias(k) for k, c in carried.items()])
    out = rows.withColumns(own).join(prefix, [*by, block])
    return out.withColumns(found).drop(*own, *carried, *([BLOCK] if block == BLOCK else []))


def multiplied(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of FAN ** m ``values``: what the ``start`` of each comes to after 0, 1, ... of them, and the product of all.

    FAN values in order make a product, FAN of those the next; what comes to a place is multiplied from the largest products of what lies before it to the single values.
    """
    levels = [values]
    while levels[-1].shape[1] > 1:
        levels.append(np.multiply.accumulate(levels[-1].reshape(len(values), -1, FAN), axis=2)[:, :, -1])
    so_far = start[:, None]
    for own in levels[-2::-1]:
        own = own.reshape(len(values), -1, FAN)[:, :, :-1]
        so_far = np.multiply.accumulate(np.concatenate([so_far[:, :, None], own], axis=2), axis=2).reshape(len(values), -1)
    return so_far, levels[-1][:, 0]


def products(rows: DataFrame, by: list[str], out: str, v: str, size: int = SIZE) -> DataFrame:
    """Add the product of all rows so far, NULL before the first value, multiplied in the order of SQL's window product: FAN by FAN, as ``multiplied`` has it.

    Where doubles end the order decides: a product may be infinite on one row and finite again on a later one whose rows are multiplied in other parts. Blocks are of
    the power of FAN up to ``size``, so each has the product of whole parts, and one row a block says what comes before it.
    """
    depth = next(m for m in range(1, 16) if FAN ** (m + 1) > size)
    block, before, after = FAN**depth, "__before", "__after"
    dealt = rows.withColumn(BLOCK, F.expr(f"{ROW} div {block}"))

    def whole(batches):
        """Tables that end where a block does."""
        held = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(ROW).to_numpy() % block == 0)
            if len(starts):
                if done := [*held, batch.slice(0, starts[-1])]:
                    yield pa.Table.from_batches(done)
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def laid(table):
        """Values block by block, 1 where there are none, their places, and whether there are any so far."""
        row, column = table[ROW].to_numpy(), table[v].cast(pa.float64())
        at, place = np.cumsum(row % block == 0) - 1, row % block
        values, any_ = np.ones((at[-1] + 1, block)), np.zeros((at[-1] + 1, block), bool)
        values[at, place] = column.fill_null(1.0).to_numpy()
        any_[at, place] = column.is_valid().to_numpy()
        return values, np.logical_or.accumulate(any_, axis=1), at, place

    def parts(batches):
        with np.errstate(all="ignore"):
            for table in whole(batches):
                if table.num_rows:
                    values, any_, _, place = laid(table)
                    own = multiplied(values, np.ones(len(values)))[1]
                    yield from table.select([*by, BLOCK]).filter(place == 0).append_column("__part", pa.array(own, mask=~any_[:, -1])).to_batches()

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by(BLOCK)
        n, values = len(table), np.ones(FAN ** next(m for m in range(1, 16) if FAN**m > len(table)))
        values[:n] = table["__part"].fill_null(1.0).to_numpy()
        any_ = np.concatenate([[False], np.logical_or.accumulate(table["__part"].is_valid().to_numpy())])
        with np.errstate(all="ignore"):
            so_far = multiplied(values[None], np.ones(1))[0][0, : n + 1]
        return table.select([*by, BLOCK]).append_column(before, pa.array(so_far[:-1], mask=~any_[:-1])).append_column(after, pa.array(so_far[1:], mask=~any_[1:]))

    def run(batches):
        with np.errstate(all="ignore"):
            for table in whole(batches):
                if table.num_rows:
                    values, any_, at, place = laid(table)
                    first = place == 0
                    start, end = (table[c].filter(first) for c in (before, after))
                    so_far = multiplied(values, start.fill_null(1.0).to_numpy())[0]
                    found = np.concatenate([so_far[:, 1:], end.fill_null(1.0).to_numpy()[:, None]], axis=1)[at, place]
                    missing = ~(any_ | start.is_valid().to_numpy()[:, None])[at, place]
                    yield from table.drop([BLOCK, before, after]).append_column(out, pa.array(found, mask=missing)).to_batches()

    def types(df: DataFrame, names: list[str]) -> str:
        return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    ordered = lambda df: df.repartition(*by, BLOCK).sortWithinPartitions(*by, ROW)
    keys = types(dealt, [*by, BLOCK])
    own = ordered(dealt.select(*by, BLOCK, ROW, v)).mapInArrow(parts, f"{keys}, __part double")
    carried = own.groupBy(*by).applyInArrow(ends, f"{keys}, {before} double, {after} double")
    return ordered(dealt.join(carried, [*by, BLOCK]).select(*dealt.columns, before, after)).mapInArrow(run, f"{types(rows, rows.columns)}, `{out}` double")


def zscore(name: str, v: str, min_periods: int) -> Column:
    """A value against the moments ``name`` so far, where there are enough and they spread."""
    n, m2 = F.col(f"{name}_n"), F.col(f"{name}_m2")
    return F.when((n >= min_periods) & (m2 > 0), (F.col(v) - F.col(f"{name}_mean")) / F.sqrt(m2 / n))


def expanding_zscore(df: DataFrame, out: str, v: str, by: list[str], order: list[str], min_periods: int = 60, size: int = SIZE) -> DataFrame:
    """As ``indicators.expanding_zscore``, series in blocks."""
    rows = df if ROW in df.columns else placed(df, by, order)
    return running(rows, by, {"__z": ("moments", v)}, size).withColumn(out, zscore("__z", v, min_periods)).drop("__z_n", "__z_mean", "__z_m2")


def drawdown(df: DataFrame, out: str, v: str, by: list[str], order: list[str], size: int = SIZE) -> DataFrame:
    """As ``indicators.drawdown``, series in blocks."""
    rows = df if ROW in df.columns else placed(df, by, order)
    return running(rows, by, {"__peak": ("max", v)}, size).withColumn(out, F.try_divide(F.col(v) - F.col("__peak"), F.col("__peak"))).drop("__peak")

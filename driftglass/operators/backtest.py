"""Backtests without look-ahead, as window plans: signals, volatility-targeted weights, equity, trades, metrics.

A decision at row t fills at open[t+1] and earns open[t+1] to open[t+2]. Since weights never depend on equity, the
whole run is a handful of windows per (symbol, strategy): all strategies of all symbols are one job.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from driftglass.functions import blocked
from driftglass.functions import indicators as ind
from driftglass.operators.asof import asof

TARGET_VOL = 0.40
MAX_WEIGHT = 1.0
VOL_WINDOW = 21
COST_BPS = 10.0
WARMUP = 200
STRATEGIES = ("buy_and_hold", "momentum", "mean_reversion", "funding_contrarian")
KEY = ("symbol", "strategy")
RUNNING = (Window.unboundedPreceding, 0)
LOOKBACK = 110  # rows: 90 scores of returns over 10 rows
BLOCK = 1 << 16


def _series(by: tuple[str, ...] = ("symbol",)):
    return Window.partitionBy(*by).orderBy("ts")


def funding_score(funding: DataFrame, window: int = 21, z_window: int = 180) -> DataFrame:
    """``ts``, ``value``: score of the trailing mean funding, NULL before there are enough prints."""
    w = _series()
    df = ind.rolling_zscore(ind.sma(funding, "mean", "close", w, window), "z", "mean", w, z_window)
    enough = F.row_number().over(w) >= z_window + window + 1
    return df.select("symbol", "ts", F.when(enough, F.col("z")).alias("value"))


def signals(bars: DataFrame, funding: DataFrame | None = None, w: WindowSpec | None = None, i: Column | None = None) -> DataFrame:
    """Bars with ``long_<strategy>`` for the four strategies (true, false; missing inputs are false). ``funding`` goes by symbol.

    ``w`` and ``i`` are the window and the row's place in its series, where they aren't the whole series'; what is needed lies in the LOOKBACK rows before.
    """
    w = w or _series()
    df = bars.withColumn("__i", F.row_number().over(w) - 1 if i is None else i)
    df = ind.log_return(df, "__mom", "close", w, 63)
    df = ind.rolling_zscore(ind.log_return(df, "__r10", "close", w, 10), "__mr", "__r10", w, 90)
    if funding is not None:
        scored = asof(df, funding_score(funding), "__fund", None, by=["symbol"])
    else:
        scored = df.withColumn("__fund", F.lit(None).cast("double"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return scored.withColumns({
        "long_buy_and_hold": F.lit(True),
        "long_momentum": yes(F.col("__mom") > 0),
        "long_mean_reversion": yes((F.col("__mr") < -1.5) & (F.col("__i") >= 100)),
        "long_funding_contrarian": yes(F.col("__fund") < -1.0),
    }).drop("__i", "__mom", "__r10", "__mr", "__fund")


def weights(bars: DataFrame, target: float = TARGET_VOL, most: float = MAX_WEIGHT, n: int = VOL_WINDOW, w: WindowSpec | None = None) -> DataFrame:
    """Add ``vol`` and ``size``: the weight of a long position, 0 where volatility is missing or zero."""
    df = ind.realized_vol(bars, "vol", "close", w or _series(), n)
    return df.withColumn("size", F.when(F.col("vol") > 0, F.least(F.lit(target) / F.col("vol"), F.lit(most))).otherwise(0.0))


def placed(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Add ``entry`` and ``exit``, the next two openings, NULL where a price can't be traded at."""
    price = F.when((F.col("open") > 0) & (F.abs("open") < float("inf")) & ~F.isnan("open"), F.col("open"))
    return df.withColumn("__price", price).withColumns({"entry": F.lead("__price", 1).over(w), "exit": F.lead("__price", 2).over(w)}).drop("__price")


def each_strategy(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """One row per bar and strategy with its ``weight``."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.when(F.col(f"long_{n}"), F.col("size")).otherwise(0.0).alias("weight")) for n in names]))
    return df.select("symbol", "ts", "open", "close", *keep, each.alias("s")).select("symbol", "ts", "open", "close", *keep, "s.*")


def decisions(bars: DataFrame, funding: DataFrame | None = None, custom: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """One row per bar and strategy with ``weight``; what strategies share (place, number of bars, fills) is computed once per bar.

    ``custom`` adds strategies as boolean column builders over the signal table.
    """
    w = _series()
    df = placed(weights(signals(bars, funding)), w).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("symbol"))})
    names = list(STRATEGIES)
    for name, build in (custom or {}).items():
        df = df.withColumn(f"long_{name}", F.coalesce(build(), F.lit(False)))
        names.append(name)
    return each_strategy(df, names, "i", "n", "entry", "exit")


def python_signal(bars: DataFrame, name: str, decide: Callable) -> DataFrame:
    """Bars with ``long_<name>`` from a Python function of the history up to each bar (a pandas frame, last row: the bar).

    For strategies that no expression states; one series per task. A bar on which the function fails is not long. As each bar sees all before
    it, time grows with the square of a series; ``fold_signal`` is linear.
    """
    out = f"long_{name}"

    def each(history):
        history = history.sort_values("ts")
        found = []
        for i in range(len(history)):
            try:
                found.append(bool(decide(history.iloc[: i + 1])))
            except Exception:  # the strategy's own failure, on this bar alone
                found.append(False)
        return history.assign(**{out: found})

    return bars.groupBy("symbol").applyInPandas(each, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + f", `{out}` boolean")


def fold_signal(bars: DataFrame, name: str, init: Callable[[], object], update: Callable[[object, dict], tuple[object, bool]]) -> DataFrame:
    """Bars with ``long_<name>`` from a strategy that carries a state from bar to bar: ``update(state, bar)`` gives the next state and whether to be long.

    Series stream through tasks in order, Arrow batch by batch, so a series of any length is one pass and holds one batch and its state. On a bar
    on which ``update`` fails the strategy isn't long, and goes on with the state it had.
    """
    out, names = f"long_{name}", bars.columns
    symbol = names.index("symbol")

    def run(batches):
        now, state, begun = None, None, False
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            found = []
            for values in zip(*columns, strict=True):
                if not begun or values[symbol] != now:
                    now, state, begun = values[symbol], init(), True
                try:
                    state, yes = update(state, dict(zip(names, values, strict=True)))
                    found.append(bool(yes))
                except Exception:  # the strategy's own failure, on this bar alone
                    found.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], names=[*names, out])

    ordered = bars.repartition("symbol").sortWithinPartitions("symbol", "ts")
    return ordered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + f", `{out}` boolean")


def live(warmup: int) -> Column:
    return (F.col("i") >= warmup) & F.col("entry").isNotNull() & F.col("exit").isNotNull()


def growth(cost_bps: float) -> Column:
    """What a bar's decision makes of the equity: the cost of the change, then the move between the two fills."""
    factor = (1 - F.abs(F.col("held") - F.col("before")) * cost_bps / 1e4) * (1 + F.col("held") * (F.col("exit") / F.col("entry") - 1))
    return F.when(F.col("held").isNotNull(), factor).otherwise(1.0)


def run(decided: DataFrame, warmup: int = WARMUP, cost_bps: float = COST_BPS) -> DataFrame:
    """Per bar from the warm-up on: ``i``, ``n``, the applied ``held`` weight, ``before``, and ``equity`` as of that bar.

    Where open[t+1] or open[t+2] is missing the decision is set aside: equity stays, the weight is carried.
    Series shorter than warm-up plus three bars give no rows. A table without fills (``entry``) gets them here.
    """
    w = _series(KEY)
    df = decided
    if "entry" not in df.columns:
        df = placed(df.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(*KEY))}), w)
    df = df.where(F.col("n") >= warmup + 3).withColumn("held", F.when(live(warmup), F.col("weight")))
    df = df.withColumn("before", F.coalesce(F.last("held", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("factor", growth(cost_bps)).withColumn("grown", F.product("factor").over(w.rowsBetween(Window.unboundedPreceding, -2)))
    return df.withColumn("equity", F.coalesce("grown", F.lit(1.0))).where(F.col("i") >= warmup).drop("factor", "grown", "weight")


def run_in_blocks(bars: DataFrame, order: list[str], warmup: int = WARMUP, cost_bps: float = COST_BPS, size: int = BLOCK) -> DataFrame:
    """``decisions`` and ``run`` of long series (ticks): blocks of rows with halos, weights and growth carried over them.

    ``bars`` has ``symbol``, ``ts``, ``open``, ``close`` and the columns of ``order``, which put a series in order and are kept.
    """
    by, keys = ["symbol"], list(KEY)

    def decide(df: DataFrame, w: WindowSpec) -> DataFrame:
        return placed(weights(signals(df, None, w, F.col(blocked.ROW)), w=w), w)

    rows = blocked.placed(bars, by, order)
    count = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    decided = blocked.over_blocks(rows, by, order, decide, LOOKBACK, 2, size).join(count.where(F.col("n") >= warmup + 3), "symbol").withColumn("i", F.col(blocked.ROW))
    more = [c for c in order if c not in ("symbol", "ts")]
    df = each_strategy(decided, list(STRATEGIES), "i", "n", "entry", "exit", blocked.ROW, *more).withColumn("held", F.when(live(warmup), F.col("weight")))
    df = blocked.over_blocks(df, keys, order, lambda x, w: x.withColumn("__earlier", F.lag("held").over(w)), 1, 0, size)
    df = blocked.running(df, keys, {"before": ("last", "__earlier")}, size).withColumn("before", F.coalesce("before", F.lit(0.0))).withColumn("factor", growth(cost_bps))
    df = blocked.products(df.drop("weight", "__earlier"), keys, "__grown", "factor", size)
    df = blocked.over_blocks(df, keys, order, lambda x, w: x.withColumn("equity", F.coalesce(F.lag("__grown", 2).over(w), F.lit(1.0))), 2, 0, size)
    return df.where(F.col("i") >= warmup).drop("factor", "__grown", blocked.ROW)


def trades(equity: DataFrame) -> DataFrame:
    """The ledger: one row per holding, entered and left at the open after the decision; an open holding has no exit."""
    w = _series(KEY)
    fills = F.lead("ts", 1).over(w)
    df = equity.withColumn("fill_ts", fills).where("held is not null")
    df = df.withColumn("opens", ((F.col("before") <= 0) & (F.col("held") > 0)).cast("int")).withColumn("closes", (F.col("before") > 0) & (F.col("held") <= 0))
    df = df.withColumn("trade_id", F.sum("opens").over(w.rowsBetween(*RUNNING))).where("opens = 1 or closes")
    pick = lambda flag, c: F.max(F.when(F.col(flag).cast("boolean"), F.col(c)))
    out = df.groupBy(*KEY, "trade_id").agg(
        pick("opens", "fill_ts").alias("entry_ts"), pick("opens", "entry").alias("entry_price"), pick("opens", "held").alias("weight"),
        pick("closes", "fill_ts").alias("exit_ts"), pick("closes", "entry").alias("exit_price"),
    )
    return out.withColumn("pnl", (F.col("exit_price") / F.col("entry_price") - 1) * F.col("weight"))


def with_pnl(equity: DataFrame) -> DataFrame:
    """Add ``pnl`` of the trade that a row's decision closes, what the ledger has, without leaving the series' window."""
    opens, closes = (F.col("before") <= 0) & (F.col("held") > 0), (F.col("before") > 0) & (F.col("held") <= 0)
    earlier = _series(KEY).rowsBetween(Window.unboundedPreceding, -1)
    df = equity.withColumn("__opened", F.last(F.when(opens, F.struct("entry", "held")), ignorenulls=True).over(earlier))
    return df.withColumn("pnl", F.when(closes, (F.col("entry") / F.col("__opened.entry") - 1) * F.col("__opened.held"))).drop("__opened")


def metrics(equity: DataFrame, ledger: DataFrame | None = None, warmup: int = WARMUP) -> DataFrame:
    """The bundle per symbol and strategy, over the whole equity curve including its two leading ones.

    Trades come from ``ledger``, or where that is left out from the curve itself, in the same pass.
    """
    w = _series(KEY)
    df = ind.simple_return(equity if ledger is not None else with_pnl(equity), "r", "equity", w)
    df = df.withColumn("dd", F.try_divide(F.col("equity"), F.max("equity").over(w.rowsBetween(*RUNNING))) - 1)
    year = F.sqrt(F.lit(float(ind.DAYS_PER_YEAR)))
    neg = F.when(F.col("r") < 0, F.col("r"))
    closed = [
        F.count("pnl").alias("n_closed"), F.avg((F.col("pnl") > 0).cast("double")).alias("win"), F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("gain"), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl"))).alias("loss")
    ]
    agg = df.groupBy(*KEY).agg(
        F.min_by("equity", "i").alias("first"), F.max_by("equity", "i").alias("last"), (F.max("n") - 1 - warmup).alias("n_days"),
        F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"), F.count("r").alias("n_r"), F.count(neg).alias("n_neg"), F.avg(neg * neg).alias("neg2"), F.min("dd").alias("mdd"),
        *(closed if ledger is None else []),
    )
    if ledger is not None:
        agg = agg.join(ledger.where("pnl is not null").groupBy(*KEY).agg(*closed), list(KEY), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    grow = F.try_divide(F.col("last"), F.col("first"))
    cagr = zero(F.when((F.col("n_days") > 0) & (grow > 0), F.pow(grow, F.lit(float(ind.DAYS_PER_YEAR)) / F.col("n_days")) - 1))
    df = agg.withColumn("cagr", cagr)
    pf = F.when(F.coalesce("n_closed", F.lit(0)) == 0, 0.0).when(zero(F.col("loss")) > 0, zero(F.col("gain")) / F.col("loss")).when(zero(F.col("gain")) > 0, F.lit(None)).otherwise(0.0)
    return df.select(
        *KEY, F.round(zero(grow - 1), 4).alias("total_return"), F.round("cagr", 4).alias("cagr"),
        F.round(zero(F.when(F.col("n_r") >= 2, F.col("sd") * year)), 4).alias("annualized_vol"),
        F.round(zero(F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * year)), 3).alias("sharpe"),
        F.round(zero(F.when((F.col("n_neg") >= 2) & (F.col("neg2") > 0), F.col("mean") / F.sqrt("neg2") * year)), 3).alias("sortino"),
        F.round(zero(F.col("mdd")), 4).alias("max_drawdown"), F.round(zero(F.when(F.col("mdd") < 0, F.col("cagr") / F.abs("mdd"))), 3).alias("calmar"),
        F.round(zero(F.col("win")), 4).alias("win_rate"), F.round(pf, 3).alias("profit_factor"), F.coalesce("n_closed", F.lit(0)).cast("long").alias("n_closed"),
    )

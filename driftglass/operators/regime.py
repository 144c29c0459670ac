"""Rule-based regime labels with evidence. Missing inputs never fire a rule: NULL comparisons are false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass.operators.asof import row_on
from driftglass.operators.features import usable

ALTS = ("eth_vs_btc_63d", "sol_vs_btc_63d", "bnb_vs_btc_63d", "xrp_vs_btc_63d")
DIGITS = 6


def _z(name: str) -> Column:
    return F.round(F.col(f"{name}__z"), DIGITS)


def _raw(name: str) -> Column:
    return F.round(F.col(name), DIGITS)


def mean_present(*values: Column) -> Column:
    """Mean of the values that are there, NULL if none is."""
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.when(n > 0, total / n)


def classify(matrix: DataFrame) -> DataFrame:
    """``ts``, the four labels, ``breadth``, ``confidence``, ``label`` and the ``evidence`` array for every row."""
    trend_z, mom, mom_z, vol = _z("btc_trend_200d"), _raw("btc_mom_63d"), _z("btc_mom_63d"), _raw("btc_vol_ratio")
    ready = mom_z.isNotNull()
    trend = F.when(ready & (trend_z > 0.3) & (mom > 0), "UP").when(ready & (trend_z < -0.3) & (mom < 0), "DOWN").otherwise("SIDEWAYS")
    volatility = F.when(vol > 1.25, "HIGH").when(vol < 0.80, "LOW").otherwise("NORMAL")
    crowd = _z("btc_funding_z")
    positioning = F.when(crowd > 1, "CROWDED_LONG").when(crowd < -1, "CROWDED_SHORT").otherwise("NEUTRAL")
    breadth = F.round(mean_present(*(F.col(f"{a}__z") for a in ALTS)), DIGITS)
    rotation = F.when(breadth > 0.3, "ALT_SEASON").when(breadth < -0.3, "BTC_DOMINANCE").otherwise("NEUTRAL")
    stretch = F.when(vol == 0.0, 0.0).otherwise(F.abs((vol - 1) / 0.3))
    strength = mean_present(F.abs(trend_z), stretch)
    confidence = F.when(strength.isNotNull(), F.least(F.lit(1.0), strength / 1.5)).otherwise(0.0)

    def item(name: str, reads: Column) -> Column:
        return F.struct(F.lit(name).alias("feature"), _raw(name).alias("raw"), _z(name).alias("z"), reads.alias("reads_as"))

    def told(value: Column, how: str, missing: str = "unavailable") -> Column:
        return F.when(value.isNull(), missing).otherwise(F.format_string(how, value))

    # fixed texts and names, in the order in which they are served
    side = F.concat(F.when(F.coalesce(F.col("btc_trend_200d"), F.lit(0.0)) > 0, "above").otherwise("below"), F.lit(" its 200d average"), told(F.col("btc_trend_200d__z"), ", z=%+.2f", ""))
    crowding = (
        F.when(positioning == "CROWDED_LONG", "funding unusually elevated (crowded longs)")
        .when(positioning == "CROWDED_SHORT", "funding unusually negative (crowded shorts)").otherwise("funding within normal range")
    )
    n_alts = sum((F.when(F.col(f"{a}__z").isNotNull(), 1).otherwise(0) for a in ALTS), F.lit(0))
    evidence = F.array(
        item("btc_trend_200d", side), item("btc_mom_63d", told(F.col("btc_mom_63d") * 100, "63d return %+.1f%%")), item("btc_vol_ratio", told(F.col("btc_vol_ratio"), "21d/90d realized vol ratio = %.2f")),
        item("btc_funding_z", crowding),
        F.struct(
            F.lit("alt_breadth_avg_z").alias("feature"), F.lit(None).cast("double").alias("raw"), breadth.alias("z"),
            F.format_string("average of %d/4 altcoins' relative strength vs BTC", n_alts).alias("reads_as"),
        ),
        *[item(name, F.lit("macro context")) for name in ("dxy_mom_63d", "vix_level", "us10y_chg_63d")],
    )
    return matrix.select(
        "ts", trend.alias("trend"), volatility.alias("volatility"), positioning.alias("positioning"), rotation.alias("alt_rotation"),
        breadth.alias("breadth"), F.round(confidence, 4).alias("confidence"), F.concat_ws("_", trend, volatility).alias("label"), "complete", evidence.alias("evidence"),
    )


def history(matrix: DataFrame) -> DataFrame:
    return classify(usable(matrix))


def latest(matrix: DataFrame, when: str) -> DataFrame:
    """The call for the last row at or before an instant."""
    return classify(row_on(matrix, when))

"""As-of joins with bounded staleness, as one union and one window instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(targets: DataFrame, sources: DataFrame, out: str, max_days: int | None, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """For each target row the value of the last source row at or before its ``ts``.

    A NULL in the hit row is kept, not skipped. ``by`` names key columns that both sides share; without keys the
    window is one partition, meant for a calendar of days.
    """
    by = by or []
    extra = [c for c in targets.columns if c not in (*by, "ts")]
    left = targets.select(*by, "ts", F.lit(1).alias("__target"), F.struct(*extra).alias("__row") if extra else F.lit(None).alias("__row"), F.lit(None).cast("struct<ts:timestamp_ntz,value:double>").alias("__own"))
    right = sources.select(*by, "ts", F.lit(0).alias("__target"), F.lit(None).alias("__row"), F.struct("ts", F.col(value).cast("double").alias("value")).alias("__own"))
    w = Window.partitionBy(*by).orderBy("ts", "__target").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("__own", ignorenulls=True).over(w)
    found = left.unionByName(right).withColumn("__hit", hit).where("__target = 1")
    age_ok = F.lit(True) if max_days is None else F.timestamp_diff("DAY", F.col("__hit.ts"), F.col("ts")) <= max_days
    return found.select(*by, "ts", *[F.col(f"__row.{c}").alias(c) for c in extra], F.when(age_ok, F.col("__hit.value")).alias(out))


def row_on(df: DataFrame, when: str) -> DataFrame:
    """The last row at or before an instant."""
    return df.where(F.col("ts") <= F.lit(when).cast("timestamp_ntz")).orderBy(F.desc("ts")).limit(1)

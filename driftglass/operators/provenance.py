"""Provenance that travels with values and combines worst-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of latency classes, best first.
LATENCY = ("LIVE", "DELAYED", "EOD", "HISTORICAL", "SIMULATED", "UNAVAILABLE")
EOD, HISTORICAL, UNAVAILABLE = (LATENCY.index(x) for x in ("EOD", "HISTORICAL", "UNAVAILABLE"))


def latency_label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LATENCY]), rank.cast("int") + 1)


def latency_rank(label: Column) -> Column:
    """The rank of a label; a label that isn't one counts as HISTORICAL, a missing one stays missing."""
    place = F.array_position(F.array(*[F.lit(x) for x in LATENCY]), label) - 1
    return F.when(label.isNotNull(), F.when(place < 0, HISTORICAL).otherwise(place)).cast("int")


def degraded(rows: DataFrame, note: Column, latency: int) -> DataFrame:
    """The same provenance, marked as cached, at best ``latency``, with one more note."""
    more = F.when(F.col("note") == "", note).otherwise(F.concat("note", F.lit("; "), note))
    return rows.withColumns({"latency": F.greatest("latency", F.lit(latency)), "is_cached": F.lit(True), "note": more})


def combine(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per key: the worst ``latency``, earliest times, sorted union of ``sources``, any ``is_cached``, joined distinct notes."""
    notes = F.array_sort(F.collect_set(F.when(F.col("note") != "", F.col("note"))))
    return rows.groupBy(*by).agg(
        F.max("latency").alias("latency"), F.min("as_of").alias("as_of"), F.min("fetched_at").alias("fetched_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.bool_or("is_cached").alias("is_cached"), F.array_join(notes, "; ").alias("note"),
    )


def is_available(count: Column, latency: Column) -> Column:
    """A series is available if it has rows and its latency isn't UNAVAILABLE."""
    return (F.coalesce(count, F.lit(0)) > 0) & (F.coalesce(latency, F.lit(UNAVAILABLE)) < UNAVAILABLE)

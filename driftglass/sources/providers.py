"""Provider payloads as tables, and fallback between providers.

Payloads land as JSON text (one row per response); parsing is from_json and explode, so a backfill of any size is a
scan. Fetching itself is left to the caller: ``Chain`` takes functions that return tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.operators.quality import is_coherent
from driftglass.sources.breaker import Breaker


def _instant(ms):
    return F.timestamp_millis(ms.cast("long")).cast("timestamp_ntz")


def parse_klines(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Arrays [open_ms, open, high, low, close, volume, ...] to bars; unparsable or incoherent bars go. ``pos`` is a row's place in its page."""
    bar = F.posexplode(F.from_json(payload, "array<array<string>>")).alias("pos", "b")
    keep = [c for c in raw.columns if c != payload]
    rows = raw.select(*keep, bar).where(F.size("b") >= 6)
    keep = [*keep, "pos"]
    num = lambda i: F.col("b")[i].try_cast("double")
    out = rows.select(*keep, _instant(F.col("b")[0].try_cast("long")).alias("ts"), num(1).alias("open"), num(2).alias("high"), num(3).alias("low"), num(4).alias("close"), num(5).alias("volume"))
    return out.where(F.col("ts").isNotNull() & is_coherent())


def _levels(rows: DataFrame, keep: list[str]) -> DataFrame:
    v = F.col("v")
    return rows.where("ts is not null and v is not null").select(*keep, "ts", v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.lit(0.0).alias("volume"))


def parse_funding(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Objects {fundingTime, fundingRate} to levels; negative rates are legal."""
    keep = [c for c in raw.columns if c != payload]
    e = raw.select(*keep, F.posexplode(F.from_json(payload, "array<struct<fundingTime:bigint,fundingRate:string>>")).alias("pos", "e"))
    keep = [*keep, "pos"]
    return _levels(e.select(*keep, _instant(F.col("e.fundingTime")).alias("ts"), F.col("e.fundingRate").try_cast("double").alias("v")), keep)


def parse_open_interest(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Objects {timestamp, sumOpenInterestValue} to levels."""
    keep = [c for c in raw.columns if c != payload]
    e = raw.select(*keep, F.posexplode(F.from_json(payload, "array<struct<timestamp:bigint,sumOpenInterestValue:string>>")).alias("pos", "e"))
    keep = [*keep, "pos"]
    return _levels(e.select(*keep, _instant(F.col("e.timestamp")).alias("ts"), F.col("e.sumOpenInterestValue").try_cast("double").alias("v")), keep)


CHART = "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>>"


def parse_chart(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Parallel arrays to bars: rows with a missing price go, arrays of different length give no rows."""
    keep = [c for c in raw.columns if c != payload]
    r = raw.select(*keep, F.from_json(payload, CHART)["chart"]["result"][0].alias("r"))
    q = r.select(*keep, F.col("r.timestamp").alias("t"), F.get(F.col("r.indicators.quote"), F.lit(0)).alias("q"))
    prices = ("open", "high", "low", "close")
    same = F.lit(True)
    for p in prices:
        same = same & (F.size(F.col(f"q.{p}")) == F.size("t"))
    z = q.where(same).select(*keep, F.posexplode(F.arrays_zip(F.col("t"), *[F.col(f"q.{p}").alias(p) for p in prices], F.col("q.volume").alias("volume"))).alias("pos", "z"))
    keep = [*keep, "pos"]
    some = F.lit(True)
    for p in prices:
        some = some & F.col(f"z.{p}").isNotNull()
    return z.where(some).select(*keep, F.timestamp_seconds("z.t").cast("timestamp_ntz").alias("ts"), *[F.col(f"z.{p}").alias(p) for p in prices], F.coalesce("z.volume", F.lit(0.0)).alias("volume"))


def first_available(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """From prioritised rows of several providers, per key the row of the lowest ``priority``: fallback within one plan."""
    best = F.min_by(F.struct(*candidates.columns), F.struct("priority", *[c for c in ("provider",) if c in candidates.columns]))
    return candidates.groupBy(*keys).agg(best.alias("__best")).select("__best.*")


@dataclass
class Chain:
    """Providers by priority. ``get`` returns the first table with rows, its provider's name, and a note on what failed before."""

    providers: list[tuple[str, Callable[..., DataFrame]]]
    breakers: dict[str, Breaker] = field(default_factory=dict)

    def get(self, **request) -> tuple[DataFrame | None, str | None, str]:
        missed = []
        for name, fetch in self.providers:
            breaker = self.breakers.setdefault(name, Breaker())
            if breaker.state == "OPEN":
                missed.append(f"{name}: circuit open")
                continue
            try:
                found = fetch(**request)
                empty = found.isEmpty()
            except Exception as e:  # a provider may fail in any way; the next one is asked
                breaker.failed()
                missed.append(f"{name}: {e}")
                continue
            breaker.ok()
            if not empty:
                return found, name, "; ".join(missed)
            missed.append(f"{name}: no data")
        return None, None, "; ".join(missed)

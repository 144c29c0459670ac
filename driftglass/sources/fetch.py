"""Fetching provider pages as a Spark data source: symbols dealt over lanes, one task per lane, pages followed to the end.

``spark.dataSource.register(ProviderPages)`` once, then
``spark.read.format("provider_pages").option("url", "https://host/klines?symbol={symbol}&startTime={start}&endTime={end}&limit={limit}")...load()``
gives ``symbol``, ``start``, ``payload``, ``error``, ``provider`` and ``ok`` rows for the parsers in ``providers``. Options:

* ``symbols`` (comma-separated), ``start``, ``end`` in milliseconds, ``end`` excluded
* ``limit``: rows of a full page, 1000 by default. A full page is followed from its last row's time plus one.
* ``time``: where a row has its time: a field's name, or a position in a list (0 by default). Empty: one page is all.
* ``lanes`` (4 by default) and ``interval_s``: a lane's requests are ``lanes`` times the interval apart, so that all
  lanes together keep the interval. A lane works in order with one limiter.
* ``errors``: ``raise`` (default) fails the job; ``keep`` gives a row with the error and goes on with the next symbol.
* ``providers`` instead of ``url``: a JSON list of objects with ``name``, ``url``, ``symbols`` (tickers to spellings) and maybe ``limit`` and ``time``,
  first choice first; ``symbols`` are tickers then. For each ticker a lane asks one after the other until one gives rows. A lane keeps a breaker for each
  provider: after ``failures`` (3) failures in a row it isn't asked for ``rest_s`` (300) seconds. Every attempt is a row with ``ok`` and, if it failed, ``error``; pages
  count only where their provider's attempt is ``ok``.

Requests are retried with doubling pauses; errors that a retry can't mend are raised at once.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftglass.sources.breaker import Breaker


class ProviderError(RuntimeError):
    """A provider answered with an error."""


class RateLimited(ProviderError):
    """A provider asks for fewer requests."""


class Forbidden(ProviderError):
    """A provider refuses this client (by place or by request), so a retry is useless."""


def typed(status: int, url: str) -> ProviderError:
    if status == 429:
        return RateLimited(f"rate limited: {url}")
    if status == 451 or 400 <= status < 500:
        return Forbidden(f"status {status}: {url}")
    return ProviderError(f"status {status}: {url}")


class Limiter:
    """Keeps calls at least ``interval_s`` apart."""

    def __init__(self, interval_s: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval_s, self.clock, self.sleep, self.last = interval_s, clock, sleep, float("-inf")

    def wait(self) -> None:
        if (pause := self.last + self.interval_s - self.clock()) > 0:
            self.sleep(pause)
        self.last = self.clock()


def read_url(url: str, timeout_s: float = 20.0) -> str:
    try:
        with urllib.request.urlopen(url, timeout=timeout_s) as answer:
            return answer.read().decode()
    except urllib.error.HTTPError as e:
        raise typed(e.code, url) from e
    except OSError as e:  # no connection, or none in time
        raise ProviderError(f"{getattr(e, 'reason', e)}: {url}") from e


def with_retry(call: Callable[[], str], attempts: int = 3, pause_s: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(attempts):
        try:
            return call()
        except Forbidden:
            raise
        except ProviderError:
            if attempt == attempts - 1:
                raise
            sleep(pause_s * 2**attempt)
    raise ProviderError("no attempts")


def last_time(rows: list, where: str, url: str) -> int:
    """The time of a page's last row."""
    try:
        return int(rows[-1][int(where)] if where.lstrip("-").isdigit() else rows[-1][where])
    except (KeyError, IndexError, TypeError, ValueError) as e:
        raise ProviderError(f"a full page can't be followed, its last row has no time: {url}") from e


def follow(get: Callable[[str], str], url: str, symbol: str, start: int, end: int, limit: int, where: str) -> Iterator[tuple[int, str]]:
    """Start and payload of each page of a symbol, until one isn't full, doesn't advance, or reaches the end."""
    cursor = start
    while cursor < end:
        at = url.format(symbol=symbol, start=cursor, end=end - 1, limit=limit)
        payload = get(at)
        yield cursor, payload
        if not where:
            return
        try:
            rows = json.loads(payload)
        except ValueError as e:
            raise ProviderError(f"not JSON: {at}") from e
        if not isinstance(rows, list) or len(rows) < limit:
            return
        after = last_time(rows, where, at) + 1
        if after <= cursor:
            return
        cursor = after


class Lane(InputPartition):
    def __init__(self, symbols: list[str]):
        self.symbols = symbols


def has_rows(payload: str) -> bool:
    """Whether a page has something: a list that isn't empty, or anything else than a list."""
    try:
        found = json.loads(payload)
    except ValueError:
        return False
    return found != [] and found is not None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options.get("url")
        self.choices = json.loads(options["providers"]) if "providers" in options else None
        if self.url is None and not self.choices:
            raise ValueError("a url or a list of providers is needed")
        self.failures, self.rest_s = int(options.get("failures", 3)), float(options.get("rest_s", 300))
        self.symbols = [s for s in options["symbols"].split(",") if s]
        self.start, self.end = int(options["start"]), int(options["end"])
        self.limit, self.time = int(options.get("limit", 1000)), options.get("time", "0")
        self.lanes = max(1, min(int(options.get("lanes", 4)), len(self.symbols)))
        self.interval_s = float(options.get("interval_s", 0.1))
        self.keep = options.get("errors", "raise") == "keep"

    def partitions(self):
        return [Lane(self.symbols[i :: self.lanes]) for i in range(self.lanes)]

    def read(self, lane: Lane) -> Iterator[tuple]:
        limiter = Limiter(self.interval_s * self.lanes)

        def get(url: str) -> str:
            def once() -> str:
                limiter.wait()
                return read_url(url)

            return with_retry(once)

        if self.choices:
            yield from self.with_fallback(lane, get)
            return
        for symbol in lane.symbols:
            start = self.start
            try:
                for start, payload in follow(get, self.url, symbol, self.start, self.end, self.limit, self.time):
                    yield symbol, start, payload, None, None, None
            except ProviderError as e:
                if not self.keep:
                    raise
                yield symbol, start, None, f"{type(e).__name__}: {e}", None, None

    def with_fallback(self, lane: Lane, get: Callable[[str], str]) -> Iterator[tuple]:
        breakers = {c["name"]: Breaker(self.failures, self.rest_s) for c in self.choices}
        for ticker in lane.symbols:
            missed = []
            for choice in self.choices:
                name, spelled, breaker = choice["name"], choice["symbols"].get(ticker), breakers[choice["name"]]
                some, why = False, None
                if spelled is None:
                    why = "not mapped"
                elif breaker.state == "OPEN":
                    why = "circuit open"
                else:
                    try:
                        for start, payload in follow(get, choice["url"], spelled, self.start, self.end, int(choice.get("limit", self.limit)), str(choice.get("time", self.time))):
                            some = some or has_rows(payload)
                            yield ticker, start, payload, None, name, None
                        breaker.ok()
                        why = None if some else "no data"
                    except ProviderError as e:
                        breaker.failed()
                        why = f"{type(e).__name__}: {e}"
                yield ticker, self.start, None, why, name, why is None
                if why is None:
                    break
                missed.append(f"{name}: {why}")
            else:
                if not self.keep:
                    raise ProviderError(f"{ticker}: " + "; ".join(missed))


class ProviderPages(DataSource):
    """Batch source of raw provider responses."""

    @classmethod
    def name(cls) -> str:
        return "provider_pages"

    def schema(self) -> str:
        return "symbol string, start long, payload string, error string, provider string, ok boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

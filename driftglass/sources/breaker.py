"""A circuit breaker for one provider."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class Breaker:
    """Opens after ``limit`` failures for ``rest_s`` seconds, then lets one attempt through."""

    limit: int = 3
    rest_s: float = 300.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: float | None = None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "CLOSED"
        return "HALF_OPEN" if self.clock() - self.opened >= self.rest_s else "OPEN"

    def ok(self) -> None:
        self.failures, self.opened = 0, None

    def failed(self) -> None:
        self.failures += 1
        if self.failures >= self.limit or self.opened is not None:
            self.opened = self.clock()

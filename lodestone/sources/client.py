"""Asking services: retries with backoff, a breaker for a service that is down, pacing, and label lookups by lots."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: Attempts, step and longest wait in seconds, and statuses worth another try (fixed values).
ATTEMPTS, STEP, LONGEST = 3, 1.0, 60.0
RETRIED = frozenset({408, 409, 425, 429, 500, 502, 503, 504})


class Refused(Exception):
    """An answer that is no success: its status, and how long the service asks to wait, if it does."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


def worth_another_try(error: Exception) -> bool:
    return error.status in RETRIED if isinstance(error, Refused) else isinstance(error, (ConnectionError, TimeoutError))


def backoff(attempt: int, base: float = STEP, longest: float = LONGEST, jitter: float = 0.0) -> float:
    """Seconds to wait after the n-th attempt (from 1): twice as long each time, at most `longest`, and up to `jitter` more."""
    return min(longest, base * 2 ** (attempt - 1)) + random.uniform(0, jitter)


def linear(attempt: int, base: float = STEP) -> float:
    return base * attempt


def ask(call: Callable, attempts: int = ATTEMPTS, wait: Callable[[int], float] = linear, accepted: frozenset[int] = frozenset(), sleep: Callable = time.sleep):
    """What a call returns, tried again after failures that may pass; a wait that the service names goes first. A refusal
    with an accepted status is None."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if isinstance(e, Refused) and e.status in accepted:
                return None
            if attempt == attempts or not worth_another_try(e):
                raise
            named = e.wait if isinstance(e, Refused) else None
            sleep(wait(attempt) if named is None else named)


@dataclass
class Breaker:
    """Opens after so many failures in a row; a success closes it."""

    most: int = 3
    failures: int = 0

    def open(self) -> bool:
        return self.failures >= self.most

    def note(self, ok: bool) -> None:
        self.failures = 0 if ok else self.failures + 1


@dataclass
class Pace:
    """At least `gap` seconds between calls."""

    gap: float
    clock: Callable = time.monotonic
    sleep: Callable = time.sleep
    last: float | None = field(default=None)

    def __call__(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.gap:
            self.sleep(self.gap - (now - self.last))
            now = self.clock()
        self.last = now


def lots(ids: list, size: int) -> Iterator[list]:
    for a in range(0, len(ids), size):
        yield ids[a:a + size]


def looked_up(ids: list[str], fetch: Callable[[list[str]], dict], size: int = 200, breaker: Breaker | None = None) -> tuple[dict, list[str]]:
    """What a service knows of some ids, in lots, and the ids left unresolved: those of failed lots, of lots after the breaker
    opened, and those it does not answer. Answers to ids that were not asked for are passed over."""
    known, open_ = {}, []
    breaker = breaker or Breaker(most=1 << 30)
    for lot in lots(ids, size):
        if breaker.open():
            open_ += lot
            continue
        try:
            got, ok = fetch(lot), True
        except Exception:  # the lot stays unresolved
            got, ok = {}, False
        breaker.note(ok)
        known |= {i: got[i] for i in lot if i in got}
        open_ += [i for i in lot if i not in got]
    return known, open_


def fraction(done: int, total: int) -> float:
    """Progress between 0 and 1."""
    return max(0.0, min(1.0, done / total)) if total > 0 else 0.0


def scaled(part: float, low: float, high: float) -> float:
    """A fraction of the stretch from low to high."""
    return low + (high - low) * max(0.0, min(1.0, part))

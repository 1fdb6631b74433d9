"""What a card's next payment is compared with: totals, a day of seconds, devices and domains."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from typing import NamedTuple

from paysift.operators.features import DAY, NO_HISTORY

HOUR = 3600
Second = tuple[int, int, float]  # a second, its payments, their amount


class Payment(NamedTuple):
    second: int
    transaction_id: int
    micros: int
    amount: float
    device: str | None
    domain: str | None
    identity: bool
    payload: str | None


class Day:
    """Seconds in order with running counts and amounts: a window takes two binary searches."""

    def __init__(self, seconds: Iterable[Second] = ()) -> None:
        self.seconds: list[int] = []
        self.counts, self.amounts, self.first = [0], [0.0], 0
        for second, n, amount in sorted(seconds):
            self.add(second, amount, n)

    def add(self, second: int, amount: float, n: int = 1) -> None:
        at = bisect_right(self.seconds, second)
        if at and self.seconds[at - 1] == second:
            at -= 1
        else:
            self.seconds.insert(at, second)
            self.counts.insert(at + 1, self.counts[at])
            self.amounts.insert(at + 1, self.amounts[at])
        for i in range(at + 1, len(self.counts)):  # more than one only after a late payment
            self.counts[i] += n
            self.amounts[i] += amount

    def forget(self, before: int) -> None:
        self.first = bisect_left(self.seconds, before, self.first)
        if self.first > 1000 and 2 * self.first > len(self.seconds):
            del self.seconds[: self.first]
            self.counts = [c - self.counts[self.first] for c in self.counts[self.first :]]
            self.amounts = [a - self.amounts[self.first] for a in self.amounts[self.first :]]
            self.first = 0

    def within(self, second: int, span: int) -> tuple[int, float]:
        """Number and amount of what is kept from second - span to second."""
        low = max(self.first, bisect_left(self.seconds, second - span))
        high = max(low, bisect_right(self.seconds, second))
        return self.counts[high] - self.counts[low], self.amounts[high] - self.amounts[low]

    def hour(self, hour: int) -> list[Second]:
        """The kept seconds of an hour."""
        low = max(self.first, bisect_left(self.seconds, hour * HOUR))
        high = max(low, bisect_left(self.seconds, (hour + 1) * HOUR))
        return self._between(low, high)

    def kept(self) -> list[Second]:
        return self._between(self.first, len(self.seconds))

    def _between(self, low: int, high: int) -> list[Second]:
        return [(self.seconds[i], self.counts[i + 1] - self.counts[i], self.amounts[i + 1] - self.amounts[i]) for i in range(low, high)]


class Seen:
    """The last `tracked` values that were new when they came, each with its place."""

    def __init__(self, tracked: int, known: Iterable[tuple[str, int]] = (), place: int = 0) -> None:
        self.tracked, self.place = tracked, place
        self.known = dict(sorted(known, key=lambda k: k[1]))
        self.added: set[str] = set()
        self.dropped: set[str] = set()

    def note(self, value: str | None) -> None:
        if value is None or value in self.known:
            return
        self.known[value] = self.place = self.place + 1
        self.added.add(value)
        if len(self.known) > self.tracked:
            oldest = next(iter(self.known))
            del self.known[oldest]
            self.dropped.add(oldest)

    def is_new(self, value: str | None) -> float:
        return float(value is not None and value not in self.known)


class CardMemory:
    """A card's past, and which parts of it a run of payments has changed."""

    def __init__(self, tracked: int, n: int = 0, total: float = 0.0, last: int | None = None, seconds: Iterable[Second] = (), devices: Seen | None = None, domains: Seen | None = None) -> None:
        self.tracked, self.n, self.total, self.last = tracked, n, total, last
        self.day, self.devices, self.domains = Day(seconds), devices or Seen(tracked), domains or Seen(tracked)
        self.hours: set[int] = set()
        self.until: int | None = None  # when the clock forgets what was read

    @classmethod
    def from_parts(cls, tracked: int, n: int, total: float, last: int | None, seconds: list, devices: list, domains: list) -> CardMemory:
        """The memory that parts() gave."""
        return cls(tracked, n, total, last, seconds, *(Seen(tracked, known, place) for place, known in (devices, domains)))

    def parts(self) -> tuple:
        """All of the memory as plain values: at most a day of seconds, and the known devices and domains."""
        return self.n, self.total, self.last, self.day.kept(), *((s.place, list(s.known.items())) for s in (self.devices, self.domains))

    def clear(self) -> None:
        self.__init__(self.tracked)

    def around(self, second: int, n: int, amount: float) -> tuple[list[float], float]:
        """Payments of the 10 minutes, hour and day that end with a second, and the day's amount: what is kept, and n payments of that
        second that are about to be folded in."""
        kept = [self.day.within(second, span) for span in (600, HOUR, DAY)]
        return [float(k + n) for k, _ in kept], kept[-1][1] + amount

    def features(self, p: Payment, windows: tuple[list[float], float] | None = None) -> tuple[float, ...]:
        """FEATURES of a payment before it is folded in. Windows end with the payment's second, so what came early counts for
        nothing and a late payment still finds its own. `windows` are those of around() with all payments of the second; without
        them the payment is the only one that comes."""
        counts, amount = windows or self.around(p.second, 1, p.amount)
        mean = self.total / self.n if self.n else 0.0
        hour = p.second % DAY // HOUR
        old = self.n > 0
        return (
            p.amount, math.log1p(max(p.amount, 0.0)), float(hour), float((p.second // DAY + 3) % 7), float(hour < 6), float(p.identity), *counts,
            amount, NO_HISTORY if self.last is None else float(max(0, p.second - self.last)), mean, p.amount / mean if mean > 0 else 1.0,
            float(self.n), float(not old), old * self.devices.is_new(p.device), old * self.domains.is_new(p.domain), float(len(self.devices.known)),
        )

    def fold(self, p: Payment) -> None:
        """Takes the payment in. The clock never goes back, and what is a day behind it is forgotten."""
        self.n, self.total = self.n + 1, self.total + p.amount
        self.last = p.second if self.last is None else max(self.last, p.second)
        self.devices.note(p.device)
        self.domains.note(p.domain)
        if p.second >= self.last - DAY:
            self.day.add(p.second, p.amount)
            self.hours.add(p.second // HOUR)
        self.day.forget(self.last - DAY)

"""Search-parameter optimisation: batch plans, tolerance updates, convergence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doubling_batches(total: int, first: int, *, from_start: bool = False) -> list[tuple[int, int]]:
    """Ranges whose sizes double until all are covered; all begin at 0 if ``from_start``."""
    out, at, size = [], 0, first
    while at < total:
        stop = min(at + size, total)
        out.append((0 if from_start else at, stop))
        at, size = stop, size * 2
    return out


def batch_of(library: DataFrame, group: str, start: int, stop: int, total: int, seed: int = 772) -> DataFrame:
    """Library rows of the groups whose hashed place lies in [start, stop) of ``total``."""
    place = F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(total))
    return library.where((place >= start) & (place < stop))


@dataclass
class Lock:
    """The part of a library that a search is tuned on: grown until enough is found, then as small as will do.

    Batches are ranges of the groups' hashed places. While too little is found, each round adds
    the next, twice as large; once ``target`` rows are found, the lock is the first range whose
    share of the finds still reaches it.
    """

    groups: int
    first: int
    target: int
    step: int = 0
    reached: bool = False

    def __post_init__(self) -> None:
        self.plan = doubling_batches(self.groups, self.first)

    @property
    def span(self) -> tuple[int, int]:
        """Places of the round: the new ones, or all of them once the target was reached."""
        start, stop = self.plan[self.step]
        return (0 if self.reached else start), stop

    def update(self, found: int) -> bool:
        """Take the number of finds; false if there is nothing left to add."""
        stop = self.span[1]
        self.reached = found >= self.target
        if self.reached:
            self.step = next(i for i, (_, end) in enumerate(self.plan) if end >= min(stop * self.target / found, self.groups))
            return True
        self.step += 1
        return self.step < len(self.plan)


@dataclass
class Targeted:
    """Shrinks a tolerance to the residuals' interval until it reaches its target."""

    value: float
    target: float
    factor: float = 1.1
    history: list[float] = field(default_factory=list)

    def update(self, interval: float) -> bool:
        """Take the next value; true once the target is reached and the interval fits it."""
        self.history.append(self.value)
        done = self.value <= self.target and interval * self.factor <= self.value
        self.value = max(self.target, interval * self.factor)
        return done


@dataclass
class Automatic:
    """Follows a score until three values in a row bring no gain, then takes the best."""

    value: float
    factor: float = 1.1
    margin: float = 0.0
    history: list[tuple[float, float]] = field(default_factory=list)

    def update(self, score: float, interval: float) -> bool:
        """Record the score of the current value and propose the next one."""
        self.history.append((self.value, score))
        self.value = interval * self.factor
        recent = [s for _, s in self.history[-3:]]
        done = len(recent) == 3 and recent[1] <= recent[0] * (1 + self.margin) and recent[2] <= recent[0] * (1 + self.margin)
        if done:
            self.value = max(self.history, key=lambda h: h[1])[0]
        return done


def optimise(step, optimisers: dict[str, Targeted | Automatic], *, most: int = 20) -> dict[str, float]:
    """Run ``step(values)`` -> {name: (score, interval)} until every optimiser is done."""
    open_ = dict(optimisers)
    for _ in range(most):
        if not open_:
            break
        found = step({k: o.value for k, o in optimisers.items()})
        for name in list(open_):
            score, interval = found[name]
            o = open_[name]
            if o.update(interval) if isinstance(o, Targeted) else o.update(score, interval):
                del open_[name]
    return {k: o.value for k, o in optimisers.items()}

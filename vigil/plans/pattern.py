"""Event patterns: an immutable description that batch and streaming jobs share.

    Pattern.begin("probes").where("amount <= 2").times(4, 20).followed_by("strike").where("amount >= 250").within(600_000)

A condition in SQL is evaluated by Spark before the shuffle; ``where_match`` adds one that reads what the match has
captured so far and runs in the matcher. A step may have both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

Event = dict
Captures = dict[str, list[Event]]


@dataclass(frozen=True)
class Step:
    name: str
    condition: str = "true"
    check: Callable[[Event, Captures], bool] | None = None
    least: int = 1
    most: int = 1
    negative: bool = False


@dataclass(frozen=True)
class Pattern:
    steps: tuple[Step, ...] = ()
    window_ms: int | None = None
    skip_past_last: bool = False
    _names: frozenset[str] = field(default=frozenset())

    @classmethod
    def begin(cls, name: str) -> Pattern:
        return cls()._add(Step(name))

    def _add(self, step: Step) -> Pattern:
        if step.name in self._names:
            raise ValueError(f"two steps are named {step.name}")
        return replace(self, steps=(*self.steps, step), _names=self._names | {step.name})

    def _last(self, **changes: object) -> Pattern:
        return replace(self, steps=(*self.steps[:-1], replace(self.steps[-1], **changes)))

    def followed_by(self, name: str) -> Pattern:
        """The next step, at any later event (others in between are skipped)."""
        return self._add(Step(name))

    def not_followed_by(self, name: str) -> Pattern:
        """An event that must not occur before the step that comes next."""
        return self._add(Step(name, negative=True))

    def where(self, condition: str) -> Pattern:
        return self._last(condition=condition)

    def where_match(self, check: Callable[[Event, Captures], bool]) -> Pattern:
        return self._last(check=check)

    def times(self, least: int, most: int) -> Pattern:
        if not 1 <= least <= most:
            raise ValueError("times needs 1 <= least <= most")
        return self._last(least=least, most=most)

    def within(self, ms: int) -> Pattern:
        """The span from the first captured event to the last, both ends included."""
        return replace(self, window_ms=ms)

    def after_match_skip_past_last(self) -> Pattern:
        """A match discards what overlaps it; else every start can have its own match."""
        return replace(self, skip_past_last=True)

    def checked(self) -> Pattern:
        if not self.steps or self.steps[0].negative or self.steps[-1].negative:
            raise ValueError("a pattern begins and ends with a step that captures")
        return self

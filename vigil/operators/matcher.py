"""The pattern matcher for the events of one key, in order of (time, id). Free of Spark.

For each event: partial matches whose window it lies beyond expire; the others, oldest first, are offered it; then it
may open one of its own. A partial whose step can still take events takes it (greedy); else, once the step has its
least number, an event of a forbidden step kills it, and an event of the next step is captured. A complete match under
skip-past-last is that of the oldest partial, and every partial that it overlaps goes, the ending event included.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from vigil.plans.pattern import Captures, Event, Pattern, Step


@dataclass
class Partial:
    start: int
    step: int
    captures: Captures = field(default_factory=dict)


class Matcher:
    """``on_event`` and ``advance`` return pairs of channel ("match" or "timed_out") and captures."""

    def __init__(self, pattern: Pattern, partials: list[Partial] | None = None):
        self.pattern, self.partials = pattern.checked(), partials or []
        steps = pattern.steps
        self.positive = [i for i, s in enumerate(steps) if not s.negative]
        self.gap: dict[int, list[int]] = {i: [] for i in self.positive}  # forbidden steps after a step
        for k, i in enumerate(self.positive[:-1]):
            self.gap[i] = list(range(i + 1, self.positive[k + 1]))
        self.after = dict(zip(self.positive, self.positive[1:]))
        # what a partial at a step may take or die of, as a mask
        self.wanted = {i: sum(1 << k for k in (i, *self.gap[i], *([self.after[i]] if i in self.after else []))) for i in self.positive}
        self._look()

    def _look(self) -> None:
        """``mask``: an event none of whose bits is in it neither changes a partial nor opens one."""
        self.mask = 1
        for p in self.partials:
            self.mask |= self.wanted[p.step]

    def reset(self) -> None:
        """Begin with another key."""
        self.partials, self.mask = [], 1

    def _holds(self, i: int, event: Event, bits: int, captures: Captures) -> bool:
        step: Step = self.pattern.steps[i]
        return bool(bits >> i & 1) and (step.check is None or step.check(event, captures))

    def _expired(self, ts: int, inclusive: bool) -> list[tuple[str, Captures]]:
        window = self.pattern.window_ms
        if window is None or not self.partials:
            return []
        out, left = [], []
        for p in self.partials:
            over = ts - p.start
            if over > window or inclusive and over == window:
                out.append(("timed_out", p.captures))
            else:
                left.append(p)
        self.partials = left
        return out

    def _offer(self, p: Partial, event: Event, bits: int) -> str:
        """What the event does to a partial: "kept", "killed" or "done"."""
        step = self.pattern.steps[p.step]
        taken = p.captures.setdefault(step.name, [])
        if len(taken) < step.most and self._holds(p.step, event, bits, p.captures):
            taken.append(event)
            return "done" if p.step == self.positive[-1] and len(taken) >= step.least else "kept"
        if len(taken) < step.least:
            return "kept"
        if any(self._holds(i, event, bits, p.captures) for i in self.gap[p.step]):
            return "killed"
        following = self.after.get(p.step)
        if following is not None and self._holds(following, event, bits, p.captures):
            p.captures[self.pattern.steps[following].name] = [event]
            p.step = following
            last = following == self.positive[-1]
            return "done" if last and self.pattern.steps[following].least == 1 else "kept"
        return "kept"

    def on_event(self, event: Event, ts: int, bits: int) -> list[tuple[str, Captures]]:
        """``bits``: bit i says whether the SQL condition of step i holds."""
        out = self._expired(ts, inclusive=False)
        done, left = [], []
        for p in self.partials:
            what = self._offer(p, event, bits)
            if what == "done":
                done.append(p)
            elif what == "kept":
                left.append(p)
        self.partials = left
        ended = False
        if done and self.pattern.skip_past_last:
            out.append(("match", done[0].captures))
            self.partials, ended = [], True  # all of them started no later than this event
        else:
            out += [("match", p.captures) for p in done]
        if not ended and self._holds(0, event, bits, {}):
            own = Partial(ts, 0, {self.pattern.steps[0].name: [event]})
            if len(self.positive) == 1 and self.pattern.steps[0].least == 1:
                out.append(("match", own.captures))
            else:
                self.partials.append(own)
        self._look()
        return out

    def pass_time(self, ts: int) -> list[tuple[str, Captures]]:
        """An event that no step wants still tells the time."""
        return self._expired(ts, inclusive=False)

    def advance(self, watermark: int) -> list[tuple[str, Captures]]:
        """All events up to the watermark have come: what can no longer be completed expires."""
        out = self._expired(watermark, inclusive=True)
        self._look()
        return out

    def next_expiry(self) -> int | None:
        """When the oldest partial expires."""
        window = self.pattern.window_ms
        return None if window is None or not self.partials else min(p.start for p in self.partials) + window

"""Versions of persisted state: registered migrations between them and a check before a restore."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.schema import PROFILE_V1

Migration = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Incompatible:
    state_type: str
    from_version: int
    to_version: int


@dataclass
class Migrations:
    _edges: dict[tuple[str, int, int], Migration] = field(default_factory=dict)

    def register(self, state_type: str, from_version: int, to_version: int, step: Migration) -> None:
        """Registering an edge again leaves the first."""
        self._edges.setdefault((state_type, from_version, to_version), step)

    def path(self, state_type: str, start: int, end: int) -> list[Migration] | None:
        """The shortest chain of migrations; None if there is none."""
        queue, seen = deque([(start, [])]), {start}
        while queue:
            at, steps = queue.popleft()
            if at == end:
                return steps
            for (name, a, b), step in self._edges.items():
                if name == state_type and a == at and b not in seen:
                    seen.add(b)
                    queue.append((b, [*steps, step]))
        return None

    def migrate(self, state_type: str, rows: DataFrame, start: int, end: int) -> DataFrame:
        steps = self.path(state_type, start, end)
        if steps is None:
            raise ValueError(f"no migration of {state_type} from version {start} to {end}")
        for step in steps:
            rows = step(rows)
        return rows


def check_restore(stored: dict[str, int], expected: dict[str, int], migrations: Migrations) -> list[Incompatible]:
    """The states that can't be restored; empty if all can."""
    return [Incompatible(k, v, expected[k]) for k, v in sorted(stored.items()) if k in expected and migrations.path(k, v, expected[k]) is None]


def profile_v1_to_v2(rows: DataFrame) -> DataFrame:
    """``first_ts`` starts as ``last_ts``; rows that aren't version 1 are refused."""
    missing = [f.name for f in PROFILE_V1 if f.name not in rows.columns or rows.schema[f.name].dataType != f.dataType]
    if missing:
        raise ValueError(f"not profiles of version 1: {missing}")
    return rows.withColumn("first_ts", F.col("last_ts"))


def default_migrations() -> Migrations:
    out = Migrations()
    out.register("cs-risk-profile.profile", 1, 2, profile_v1_to_v2)
    return out

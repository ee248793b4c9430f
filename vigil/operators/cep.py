"""Running detectors over a DataFrame of events.

All detectors share one scan and one shuffle: Spark evaluates every step's SQL condition into a bit mask, rows that
satisfy none are dropped and only the columns that detectors name are kept; the rest is partitioned by entity and sorted
by (entity, time, id). A task then streams through its rows, holding the partial matches of one entity at a time, so an
entity with very many events needs no more memory than one with few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.matcher import Matcher
from vigil.plans.pattern import Captures, Pattern
from vigil.plans.shipping import ship
from vigil.schema import ALERT

FOREVER = 1 << 62


@dataclass(frozen=True)
class Detector:
    """A pattern over the events of each entity and the alert that a match (or a timeout) becomes: (ts, detail)."""

    name: str
    entity_kind: str
    key: str
    pattern: Pattern
    columns: tuple[str, ...]
    on_match: Callable[[Captures], tuple[int, str]] | None = None
    on_timeout: Callable[[Captures], tuple[int, str]] | None = None
    match_name: str | None = None  # the pattern name of match alerts, if another


def masked(events: DataFrame, detectors: list[Detector]) -> DataFrame:
    """One row per event and entity that wants it: vg_kind, vg_entity, vg_bits (a mask per detector), ts, id, and the
    columns that detectors name. Events are exploded and not unioned, so the source is read once."""
    columns = sorted({c for d in detectors for c in d.columns} | {"ts", "id"})
    each = []
    for kind, key in sorted({(d.entity_kind, d.key) for d in detectors}):
        masks = []
        for d in detectors:
            mask = F.lit(0).cast("long")
            for i, s in enumerate(d.pattern.steps if d.entity_kind == kind else ()):
                mask = mask + F.when(F.expr(s.condition), F.lit(1 << i)).otherwise(F.lit(0))
            masks.append(mask)
        each.append(F.struct(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("entity"), F.array(*masks).alias("bits")))
    rows = events.select(*columns, F.explode(F.array(*each)).alias("vg_x"))
    rows = rows.select(F.col("vg_x.kind").alias("vg_kind"), F.col("vg_x.entity").alias("vg_entity"), F.col("vg_x.bits").alias("vg_bits"), *columns)
    return rows.filter(F.exists("vg_bits", lambda b: b != 0))


def alerts_of(detector: Detector, kind: str, entity: int, found: list[tuple[str, Captures]]) -> list[tuple]:
    out = []
    for channel, captures in found:
        make = detector.on_match if channel == "match" else detector.on_timeout
        if make is not None:
            name = detector.match_name or detector.name if channel == "match" else detector.name
            out.append((name, kind, entity, *make(captures)))
    return out


def detect(events: DataFrame, detectors: list[Detector], order: str = "event_time", complete_to: int | None = None) -> DataFrame:
    """Alerts of all detectors. ``order``: "event_time" by (ts, id), or "arrival" by id. ``complete_to``: the time up to
    which the input is known to be complete, so that windows that end by then expire; ``FOREVER`` for all of them.
    Without it, only an entity's own later events let its windows expire."""
    ship(events.sparkSession)
    rows = masked(events, detectors)
    by = ["id"] if order == "arrival" else ["ts", "id"]
    rows = rows.repartition("vg_kind", "vg_entity").sortWithinPartitions("vg_kind", "vg_entity", *by)
    names = [c for c in rows.columns if not c.startswith("vg_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # matchers are made once for each kind of entity and begin anew with each entity
        of_kind = {k: [(i, d, Matcher(d.pattern)) for i, d in enumerate(detectors) if d.entity_kind == k] for k in {d.entity_kind for d in detectors}}
        entity, matchers = None, []

        def finish() -> list[tuple]:
            if entity is None or complete_to is None:
                return []
            return [a for _, d, m in matchers for a in alerts_of(d, *entity, m.advance(complete_to))]

        for batch in batches:
            out, columns = [], [batch.column(c).to_pylist() for c in names]
            times = columns[names.index("ts")]
            for k, own in enumerate(zip(*(batch.column(c).to_pylist() for c in ("vg_kind", "vg_entity", "vg_bits")), strict=True)):
                if own[:2] != entity:
                    out += finish()
                    entity, matchers = own[:2], of_kind[own[0]]
                    for _, _, m in matchers:
                        m.reset()
                bits, ts, event = own[2], times[k], None
                for i, d, m in matchers:
                    if bits[i] & m.mask:
                        if event is None:  # only of events that some match may want
                            event = {c: v[k] for c, v in zip(names, columns, strict=True)}
                        if found := m.on_event(event, ts, bits[i]):
                            out += alerts_of(d, *entity, found)
                    elif m.partials and d.on_timeout and (found := m.pass_time(ts)):
                        out += alerts_of(d, *entity, found)
            yield _batch(out)
        yield _batch(finish())

    return rows.mapInArrow(run, ALERT)


def _batch(alerts: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*alerts, strict=True)) if alerts else [()] * 5
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ALERT.names)

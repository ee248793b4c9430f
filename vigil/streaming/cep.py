"""Detectors on a stream, with event-time timers.

Rows of a micro-batch come in no order, so each entity buffers its rows until the watermark has passed them and then
hands them to the matcher by (ts, id); windows expire after that. The alerts thus don't depend on how the stream is cut
into batches. A row at or before the time that its entity has already been advanced to is late and dropped.

What waits and what is open is map state, one entry a row and one an open match, so a micro-batch writes the entries that
it adds, changes or removes and not what merely stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import vigil
from vigil.operators.cep import Detector, alerts_of, masked
from vigil.operators.matcher import Matcher, Partial
from vigil.plans.shipping import ship
from vigil.schema import ALERT


def _size(p: Partial) -> int:
    """Grows with whatever happens to an open match."""
    return sum(map(len, p.captures.values()))


class _Detect(StatefulProcessor):
    def __init__(self, detectors: list[Detector]):
        self.detectors = detectors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "ts long")
        self.rows = handle.getMapState("rows", "ts long, id long, copy int", "row string")
        self.open = handle.getMapState("open", "detector int, number long", "partial string")

    def _load(self) -> tuple[int, dict[tuple[int, int], Partial], list[Matcher]]:
        """The time that is done, the open matches by their keys, and the matchers that hold them."""
        done = self.done.get()[0] if self.done.exists() else -(1 << 62)
        found = {tuple(k): Partial(*json.loads(v[0])) for k, v in self.open.iterator()}
        own = [[found[k] for k in sorted(found) if k[0] == i] for i in range(len(self.detectors))]
        return done, found, [Matcher(d.pattern, partials) for d, partials in zip(self.detectors, own, strict=True)]

    def _save(self, done: int, found: dict[tuple[int, int], Partial], before: dict[tuple[int, int], int], matchers: list[Matcher]) -> None:
        """Write what has changed and ask to be woken when the next row is complete or the next window ends."""
        known = {id(p): k for k, p in found.items()}
        kept = {known[id(p)] for m in matchers for p in m.partials if id(p) in known}
        for k in found.keys() - kept:
            self.open.removeKey(k)
        for i, m in enumerate(matchers):
            number = max((k[1] for k in found if k[0] == i), default=-1)
            for p in m.partials:
                k = known.get(id(p))
                if k is None:
                    k = (i, number := number + 1)
                elif before[k] == _size(p):
                    continue
                self.open.updateValue(k, (json.dumps([p.start, p.step, p.captures]),))
        times = [k[0] for k in self.rows.keys()] + [t for m in matchers if (t := m.next_expiry()) is not None]
        if times:
            self.done.update((done,))
            self.handle.registerTimer(max(min(times), done + 1))
        else:
            self.done.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        done = self.done.get()[0] if self.done.exists() else -(1 << 62)
        for frame in rows:
            for r in json.loads(frame.drop(columns=["event_time", "vg_kind", "vg_entity"], errors="ignore").to_json(orient="records", double_precision=15)):
                if r["ts"] > done:
                    k = (r["ts"], r["id"], 0)
                    while self.rows.containsKey(k):
                        k = (*k[:2], k[2] + 1)
                    self.rows.updateValue(k, (json.dumps(r),))
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, now: int) -> pd.DataFrame:
        done, found, matchers = self._load()
        before = {k: _size(p) for k, p in found.items()}
        ready = sorted((tuple(k), v[0]) for k, v in self.rows.iterator() if k[0] <= now)
        out = []
        for k, row in ready:
            self.rows.removeKey(k)
            r = json.loads(row)
            bits = r.pop("vg_bits")
            for d, m, b in zip(self.detectors, matchers, bits, strict=True):
                if d.entity_kind == key[0]:
                    out += alerts_of(d, key[0], int(key[1]), m.on_event(r, r["ts"], b) if b else m.pass_time(r["ts"]))
        for d, m in zip(self.detectors, matchers, strict=True):
            if d.entity_kind == key[0]:
                out += alerts_of(d, key[0], int(key[1]), m.advance(now))
        self._save(max(done, now), found, before, matchers)
        return pd.DataFrame(out, columns=ALERT.names)

    def close(self) -> None:
        pass


def detect_stream(events: DataFrame, detectors: list[Detector]) -> DataFrame:
    """Alerts of a stream of events with a watermark on ``event_time``. Needs the RocksDB state store."""
    ship(events.sparkSession)
    with_time = [Detector(d.name, d.entity_kind, d.key, d.pattern, (*d.columns, "event_time"), d.on_match, d.on_timeout, d.match_name) for d in detectors]
    rows = masked(events, with_time)
    # the worker that prepares the state on the driver doesn't get shipped files, so the processor goes by value
    cloudpickle.register_pickle_by_value(vigil)
    try:
        return rows.groupBy("vg_kind", "vg_entity").transformWithStateInPandas(_Detect(with_time), outputStructType=ALERT, outputMode="Append", timeMode="EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(vigil)

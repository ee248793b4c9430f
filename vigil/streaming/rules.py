"""Dated rules and profiles on a stream of events, in the stream's own state.

Rules are broadcast state: events are keyed by a hash of the card into ``KEYS`` groups, and a rule or a seal goes to
every group, so a merchant with very many events is no hot key. A group keeps the rules by merchant in map state. Until
the seal comes its events wait in list state; the seal releases and clears them. A rule that comes after the seal acts
on events from its own micro-batch on (within one, rules come before events). State and input offsets are committed
together, so a restart neither loses nor repeats a hit.

Profiles are folded in update mode: a micro-batch gives the whole profile of the cards that it touched and of no others.
They are appended as a delta; readers take the newest row of each card, and ``compact`` merges deltas into a base that is
sorted by card, so that a lookup reads little of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import vigil
from vigil.plans.shipping import ship
from vigil.schema import ALERT

#: Groups of cards; each has all rules. Not to be changed between runs from one checkpoint.
KEYS = 64
_RULE = ["kind", "merchant", "activate_at", "cap"]
_EVENT = ["card", "ts", "amount", "merchant"]
_ALL = "kind string, merchant string, activate_at long, cap double, card long, ts long, amount double"


class _Rules(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sealed = handle.getValueState("sealed", "sealed boolean")
        self.rules = handle.getMapState("rules", "merchant string", "kinds array<string>, activate_at array<long>, caps array<double>")
        self.waiting = handle.getListState("waiting", "card long, ts long, amount double, merchant string")

    def handleInitialState(self, key: tuple, rows: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        self._learn(rows)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        events = []
        for frame in rows:
            is_rule = frame["kind"].notna()
            if is_rule.any():
                self._learn(frame[is_rule])
            own = frame.loc[~is_rule, _EVENT]
            if len(own):
                events.append(own)
        if not self.sealed.exists():
            for own in events:
                self.waiting.appendList([(int(c), int(t), float(a), m) for c, t, a, m in own.itertuples(index=False)])
            return
        if self.waiting.exists():
            events.insert(0, pd.DataFrame(list(self.waiting.get()), columns=_EVENT))
            self.waiting.clear()
        for own in events:
            yield self._hits(own)

    def _learn(self, rows: pd.DataFrame) -> None:
        for kind, merchant, since, cap in rows[_RULE].itertuples(index=False):
            if kind == "end_of_rules":
                self.sealed.update((True,))
                continue
            kinds, dates, caps = self.rules.getValue((merchant,)) if self.rules.containsKey((merchant,)) else ([], [], [])
            self.rules.updateValue((merchant,), ([*kinds, kind], [*map(int, dates), int(since)], [*map(float, caps), float(cap)]))

    def _hits(self, events: pd.DataFrame) -> pd.DataFrame:
        out = []
        for merchant, own in events.groupby("merchant"):
            if not self.rules.containsKey((merchant,)):
                continue
            for kind, since, cap in zip(*self.rules.getValue((merchant,)), strict=True):
                hit = own[own["ts"] >= since]
                if kind == "merchant_watchlist":
                    out += [("watchlist_hit", "card", c, t, f"auth at watchlisted {merchant} for {a:.2f}") for c, t, a, _ in hit.itertuples(index=False)]
                else:
                    out += [("cap_exceeded", "card", c, t, f"auth at {merchant} for {a:.2f} over cap {cap:.2f}") for c, t, a, _ in hit[hit["amount"] > cap].itertuples(index=False)]
        return pd.DataFrame(out, columns=ALERT.names)

    def close(self) -> None:
        pass


def _to_all(rules: DataFrame) -> DataFrame:
    """Rules, once for each group, as rows of the tagged union."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("card", "long"), ("ts", "long"), ("amount", "double"))]
    return rules.select(F.explode(F.sequence(F.lit(0), F.lit(KEYS - 1))).alias("group"), *_RULE, *none)


def rule_hits_stream(events: DataFrame, rules: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Alerts of a stream of EVENT rows by a stream of RULE rows. ``known``: rules, as a table, that hold from the first
    micro-batch of a new checkpoint on. Needs the RocksDB state store."""
    spark = events.sparkSession
    ship(spark)
    group = F.pmod(F.xxhash64("card"), F.lit(KEYS)).cast("int").alias("group")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("activate_at", "long"), ("cap", "double"))]
    rows = events.filter(F.col("type") == "auth").select(group, *none, *_EVENT).unionByName(_to_all(rules))
    start = None if known is None else _to_all(known).groupBy("group")
    cloudpickle.register_pickle_by_value(vigil)
    try:
        return rows.groupBy("group").transformWithStateInPandas(_Rules(), outputStructType=ALERT, outputMode="Append", timeMode="None", initialState=start)
    finally:
        cloudpickle.unregister_pickle_by_value(vigil)


def _written(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folders ``kind=...`` below ``path`` that are written in full."""
    path_ = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path_(path))] if fs.exists(path_(path)) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(path_(f"{path}/{n}/_SUCCESS")))


def profile_table(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch on an update-mode stream of profiles that adds the changed ones below ``path``. A batch
    that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _folders(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last micro-batch, and the folders that have all profiles as of then."""
    base = (_written(spark, path, "base") or [-1])[-1]
    deltas = [n for n in _written(spark, path, "batch") if n > base]
    return max([base, *deltas]), [*([f"{path}/base={base}"] if base >= 0 else []), *[f"{path}/batch={n}" for n in deltas]]


def latest_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The newest profile of each card, for ``profile.lookup``, ``profile.scan`` and ``profile.server``. Folders that
    are still being written don't count."""
    _, folders = _folders(spark, path)
    parts = [spark.read.parquet(f).withColumn("vg_n", F.lit(i)) for i, f in enumerate(folders)]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    columns = [c for c in rows.columns if c != "vg_n"]
    newest = rows.groupBy("card").agg(F.max_by(F.struct(*columns), "vg_n").alias("x"))
    return newest.select("x.*")


def compact(spark: SparkSession, path: str) -> None:
    """Merge all profiles below ``path`` into one base, sorted by card, and delete what it replaces. Readers and the
    stream may go on meanwhile, but a reader that began before should end before the next one."""
    last, folders = _folders(spark, path)
    if folders in ([], [f"{path}/base={last}"]):
        return
    latest_profiles(spark, path).repartitionByRange("card").sortWithinPartitions("card").write.mode("overwrite").parquet(f"{path}/base={last}")
    for old in folders:
        if old != f"{path}/base={last}":
            at = spark._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

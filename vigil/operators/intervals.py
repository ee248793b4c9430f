"""Which of many possible matches are reported, in built-in functions: skip past the last event, without a task per entity.

A candidate is an entity with the places (time, id) of a first event and of the event that first completes a match begun
there. The first end of all is reported, with its oldest beginning; whatever began up to that end is void, and so on
from there. Done event by event that is a loop over an entity; here the end that follows each end is looked up at once,
and the ends that are reached from the first are found by pointer doubling: a round doubles the length of all jumps.

Running values are taken in two steps, within spans of time and over the spans, so that an entity with very many events
is dealt to many tasks. Where no candidate reaches from before a candidate into it, a chain starts anew whatever came
before; such starts are all reached at once, which leaves few rounds: the logarithm of the longest chain of candidates
that overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.plans import scratch


def span(ts: str, width: int) -> Column:
    """The number of the span of time that a moment is in."""
    return F.expr(f"({ts} - pmod({ts}, {width})) div {width}")


def place() -> Column:
    """Where an event is in its entity's order."""
    return F.struct("ts", "id")


def _over_spans(rows: DataFrame, value: Column, back: bool) -> DataFrame:
    """(entity, span, carried): the greatest value of all spans before, or, ``back``, the least of all after."""
    each = rows.groupBy("entity", "span").agg((F.min(value) if back else F.max(value)).alias("v"))
    order = F.desc("span") if back else F.asc("span")
    w = Window.partitionBy("entity").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = (F.min("v") if back else F.max("v")).over(w)
    return scratch.table(each.select("entity", "span", own.alias("carried")).filter("carried is not null"))


def reported(candidates: DataFrame, width: int) -> DataFrame:
    """The candidates (entity, s, e and more) that are reported, as a table. ``s`` and ``e`` are places; of several rows
    with one ``s`` the one with the first end counts. ``width``: the spans' length, best that of the pattern's window."""
    return scratch.settled(lambda: _reported(candidates, width))


def _reported(candidates: DataFrame, width: int) -> DataFrame:
    more = [c for c in candidates.columns if c not in ("entity", "s", "e")]
    one = candidates.groupBy("entity", "s").agg(F.min(F.struct("e", *more)).alias("x")).select("entity", "s", "x.*")
    one = scratch.table(one.withColumn("span", span("s.ts", width)))

    before = Window.partitionBy("entity", "span").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    carried = _over_spans(one, F.col("e"), back=False)
    last = F.greatest(F.max("e").over(before), F.col("carried"))
    starts = one.join(carried, ["entity", "span"], "left").select("entity", F.col("s").alias("at"), F.col("e").alias("end"), (last.isNull() | (last < F.col("s"))).alias("opens"))
    ends = one.select("entity", F.col("e").alias("at")).distinct()
    ends = ends.select("entity", "at", F.lit(None).cast(one.schema["e"].dataType).alias("end"), F.lit(None).cast("boolean").alias("opens"))
    rows = scratch.table(starts.unionByName(ends).withColumn("span", span("at.ts", width)))

    # from the latest back: the first end of all candidates that begin here or later; an end comes before a start in its place
    after = Window.partitionBy("entity", "span").orderBy(F.desc("at"), F.col("opens").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    later = _over_spans(rows, F.col("end"), back=True)
    rows = rows.join(later, ["entity", "span"], "left").select("entity", "at", "opens", F.least(F.min("end").over(after), F.col("carried")).alias("next"))
    rows = scratch.table(rows)
    roots = rows.filter("opens").select("entity", F.col("next").alias("e"))
    links = rows.filter("opens is null and next is not null").select("entity", F.col("at").alias("e"), "next")
    links = scratch.table(links.join(roots.withColumnRenamed("e", "next"), ["entity", "next"], "left_anti"))
    reached, jumps = scratch.table(roots), links
    while not jumps.isEmpty():
        further = reached.join(jumps, ["entity", "e"]).select("entity", F.col("next").alias("e"))
        reached = scratch.table(reached.unionByName(further))  # what a round finds is as far away as no earlier one reached
        onward = jumps.select("entity", F.col("e").alias("next"), F.col("next").alias("beyond"))
        jumps = scratch.table(jumps.join(onward, ["entity", "next"]).select("entity", "e", F.col("beyond").alias("next")))
    previous = reached.join(links, ["entity", "e"]).select("entity", F.col("next").alias("e"), F.col("e").alias("previous"))
    kept = one.join(reached.join(previous, ["entity", "e"], "left"), ["entity", "e"]).filter("previous is null or s > previous")
    return kept.groupBy("entity", "e").agg(F.min(F.struct("s", *more)).alias("x")).select("entity", "e", "x.*")

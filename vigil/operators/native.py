"""The card-fraud detectors in built-in functions: windows and equi-joins, no Python worker.

They report what ``detectors`` reports by the matcher, for input that is complete. Each event is copied into two spans of
time as long as the pattern's window, so that a span has all that a match which begins (or ends) in it can hold; rows
are dealt by (entity, span), never by entity alone. What a match that begins at an event first leads to follows from
windows within the span; ``intervals`` then picks the matches that are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import haversine_km, two_decimals
from vigil.operators.detectors import DRAIN_MIN, PROBE_MAX, STRIKE_MIN, STRIKE_VS_PROBE, STRUCT_HIGH, STRUCT_LOW, STRUCT_TOTAL, TRAVEL_KMH, TRAVEL_MIN_KM
from vigil.operators.intervals import place, reported, span
from vigil.schema import ALERT, HOUR, MINUTE

#: Least and most events of the repeated steps.
PROBES, FAILS, PARTS = (4, 20), (3, 8), (2, 12)
OTP_WITHIN = 5 * MINUTE


def _spanned(events: DataFrame, key: str, width: int, ahead: bool) -> DataFrame:
    """Each event in its own span and in the one before (``ahead``: a span then holds what follows its events) or after;
    ``home`` tells its own."""
    shift = F.explode(F.array(F.lit(0), F.lit(-1 if ahead else 1))).alias("shift")
    rows = events.withColumn("entity", F.col(key)).select("*", shift)
    return rows.withColumns({"span": span("ts", width) + F.col("shift"), "home": F.col("shift") == 0, "at": place()}).drop("shift")


def _order(desc: bool = False) -> Window:
    w = Window.partitionBy("entity", "span")
    return w.orderBy(F.desc("ts"), F.desc("id")) if desc else w.orderBy("ts", "id")


def _next(what: Column) -> Column:
    """The least of ``what`` among the events after this one: from the latest back."""
    return F.min(what).over(_order(desc=True).rowsBetween(Window.unboundedPreceding, -1))


def _alerts(found: DataFrame, pattern: str, kind: str, detail: Column) -> DataFrame:
    return found.select(F.lit(pattern).alias("pattern"), F.lit(kind).alias("entity_kind"), F.col("entity").cast("long").alias("entity_id"), F.col("e.ts").alias("ts"), detail.alias("detail")).to(ALERT)


def impossible_travel(events: DataFrame) -> DataFrame:
    """D2: a join of purchases by card and span; of those too far away for the time between, the first."""
    width = 6 * HOUR
    seen = events.filter("type = 'auth' and approved and present").select("card", "id", "ts", "lat", "lon", "country")
    a = seen.withColumns({"entity": F.col("card"), "span": span("ts", width), "s": place()}).alias("a")
    b = _spanned(seen, "card", width, ahead=True).alias("b")
    km = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    kmh = F.col("km") / (F.greatest(F.col("b.ts") - F.col("a.ts"), F.lit(1)) / HOUR)
    after = (F.col("b.at") > F.col("a.s")) & (F.col("b.ts") - F.col("a.ts") <= width)
    pairs = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.span") == F.col("b.span")) & after).withColumn("km", km).withColumn("kmh", kmh)
    far = pairs.filter((F.col("km") >= TRAVEL_MIN_KM) & (F.col("kmh") > TRAVEL_KMH))
    found = reported(far.select("a.entity", "a.s", F.col("b.at").alias("e"), F.col("a.country").alias("from"), F.col("b.country").alias("to"), "km", "kmh"), width)
    detail = F.concat("from", F.lit(" to "), "to", F.lit(", "), two_decimals(F.col("km")), F.lit(" km at "), two_decimals(F.col("kmh")), F.lit(" km/h"))
    return _alerts(found, "impossible_travel", "card", detail)


def card_testing(events: DataFrame) -> DataFrame:
    """D1: a match from a probe holds the probes up to the strike, the first ``PROBES[1]`` of them. A strike is compared
    with the runs of probes that end at it, by their number; runs that are full before it, which take that many probes in
    the window, by the greatest of their first ones."""
    width, (least, most) = 10 * MINUTE, PROBES
    probe, strike = F.expr(f"not approved and amount <= {PROBE_MAX}"), F.expr(f"approved and amount >= {STRIKE_MIN}")
    rows = events.filter("type = 'auth'").withColumn("probe", probe).filter(F.col("probe") | strike).select("card", "id", "ts", "amount", "probe")
    rows = _spanned(rows, "card", width, ahead=False)
    own = Window.partitionBy("entity", "span", "probe").orderBy("ts", "id")
    first = own.rowsBetween(0, most - 1)
    rows = rows.withColumns({"k": F.count_if("probe").over(_order()), "top": F.max("amount").over(first), "full": F.lead("ts", most - 1).over(own)})
    probes = rows.filter("probe").select("entity", "span", "k", F.col("at").alias("s"), F.col("amount").alias("probe_amount"), "top", "full")
    strikes = rows.filter(~F.col("probe") & F.col("home") & (F.col("k") >= least)).select("entity", "span", F.col("k").alias("before"), F.col("at").alias("e"), "amount")
    back = strikes.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(most).cast("long"), F.col("before")))).alias("n"))
    near = back.withColumn("k", F.col("before") - F.col("n") + 1).join(probes, ["entity", "span", "k"])
    run = Window.partitionBy("entity", "e").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("highest", F.max("probe_amount").over(run)).filter(F.col("n") >= least).select("entity", "s", "e", "n", "amount", "highest")
    filled = probes.filter(F.col("full") - F.col("s.ts") <= width)
    far = filled.join(strikes, ["entity", "span"]).filter(F.col("before") - F.col("k") >= most)
    far = far.select("entity", "s", "e", F.lit(most).cast("long").alias("n"), "amount", F.col("top").alias("highest"))
    pairs = near.unionByName(far).filter((F.col("e.ts") - F.col("s.ts") <= width) & (F.col("amount") >= STRIKE_VS_PROBE * F.col("highest")))
    detail = F.concat(F.col("n").cast("string"), F.lit(" probes then "), two_decimals(F.col("amount")), F.lit(" approved"))
    return _alerts(reported(pairs.select("entity", "s", "e", "n", "amount"), width), "card_testing", "card", detail)


def account_takeover(events: DataFrame) -> DataFrame:
    """D3: from the failure that makes enough of them the next change and from that the next drain, unless a verification
    comes after that failure and before the drain, which covers both zones."""
    width, (least, most) = 30 * MINUTE, FAILS
    is_ = lambda name: F.col("type") == name
    rows = events.filter(F.col("type").isin("login_fail", "otp_verify", "password_change") | (is_("transfer") & (F.col("amount") >= DRAIN_MIN)))
    rows = _spanned(rows.select("account", "id", "ts", "type", "amount"), "account", width, ahead=True)
    rows = rows.withColumns({"fails": F.count_if(is_("login_fail")).over(_order()), "drain": _next(F.when(is_("transfer"), F.struct("ts", "id", "amount")))})
    rows = rows.withColumns({"change": _next(F.when(is_("password_change"), F.struct("ts", "id", "fails", "drain"))), "verify": _next(F.when(is_("otp_verify"), place()))})
    own = Window.partitionBy("entity", "span", "type").orderBy("ts", "id")
    rows = rows.withColumns({c: F.lead(c, least - 1).over(own) for c in ("change", "verify")})
    drain = F.col("change.drain")
    e = F.struct(drain["ts"].alias("ts"), drain["id"].alias("id"))
    rows = rows.filter(is_("login_fail") & F.col("home") & drain.isNotNull()).withColumns({"e": e, "s": F.col("at")})
    rows = rows.filter((F.col("e.ts") - F.col("ts") <= width) & (F.col("verify").isNull() | (F.col("verify") > F.col("e"))))
    n = F.least(F.lit(most).cast("long"), F.col("change.fails") - F.col("fails") + 1)
    found = reported(rows.select("entity", "s", "e", n.alias("n"), drain["amount"].alias("amount")), width)
    detail = F.concat(F.col("n").cast("string"), F.lit(" failed logins, password change, then "), two_decimals(F.col("amount")), F.lit(" out, no OTP"))
    return _alerts(found, "account_takeover", "account", detail)


def otp_requests(events: DataFrame) -> DataFrame:
    """D4: every request with what became of it: ``otp_verified_ok``, or ``otp_never_verified`` in time. Both channels
    come from one pass."""
    rows = events.filter(F.col("type").isin("otp_request", "otp_verify")).select("account", "id", "ts", "type")
    rows = _spanned(rows, "account", OTP_WITHIN, ahead=True).withColumn("verify", _next(F.when(F.col("type") == "otp_verify", F.col("ts"))))
    ok = F.coalesce(F.col("verify") - F.col("ts") <= OTP_WITHIN, F.lit(False))
    return rows.filter("home and type = 'otp_request'").select(
        F.when(ok, "otp_verified_ok").otherwise("otp_never_verified").alias("pattern"), F.lit("account").alias("entity_kind"), F.col("entity").cast("long").alias("entity_id"), "ts",
        F.when(ok, "").otherwise("otp requested, never verified within 5 min").alias("detail"),
    ).to(ALERT)


def structuring(events: DataFrame) -> DataFrame:
    """D5: prefix sums within the span; the transfer that trips is the first at which the sum from a beginning reaches
    the total. As the band bounds a transfer from both sides, that is among the next few, found by ``lead``. Sums are
    exact decimals. The bounds must be such that a match can neither trip too early nor fill up."""
    if PARTS[0] * STRUCT_HIGH > STRUCT_TOTAL or PARTS[1] * STRUCT_LOW < STRUCT_TOTAL:
        raise ValueError("the band doesn't bound the number of transfers")
    width, furthest = 24 * HOUR, int(-(-STRUCT_TOTAL // STRUCT_LOW)) - 1
    rows = events.filter(f"type = 'transfer' and amount >= {STRUCT_LOW} and amount < {STRUCT_HIGH}").select("account", "id", "ts", F.col("amount").cast("decimal(18,6)").alias("amount"))
    rows = _spanned(rows, "account", width, ahead=True).withColumn("sum", F.sum("amount").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    trip = F.lit(None)
    for k in range(furthest, 0, -1):
        total = F.lead("sum", k).over(_order()) - F.col("sum") + F.col("amount")
        here = F.struct(F.lead("at", k).over(_order()).alias("e"), F.lit(k + 1).alias("n"), total.alias("total"))
        trip = F.when(total >= STRUCT_TOTAL, here).otherwise(trip)
    rows = rows.withColumn("trip", trip).filter(F.col("home") & (F.col("trip.e.ts") - F.col("ts") <= width))
    found = reported(rows.select("entity", F.col("at").alias("s"), "trip.e", "trip.n", F.col("trip.total").alias("total")), width)
    detail = F.concat(F.col("n").cast("string"), F.lit(" sub-threshold transfers totalling "), two_decimals(F.col("total").cast("double")))
    return _alerts(found, "structuring", "account", detail)


def all_alerts(events: DataFrame, healthy: bool = False) -> DataFrame:
    """Alerts of all five detectors; ``healthy`` adds the requests that were verified."""
    otp = otp_requests(events)
    out = otp if healthy else otp.filter("pattern = 'otp_never_verified'")
    for detector in (card_testing, impossible_travel, account_takeover, structuring):
        out = out.unionByName(detector(events))
    return out

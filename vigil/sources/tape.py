"""A labelled tape of card and account events: noise that no detector should report, and campaigns that they should.

Noise keeps clear of every threshold: purchases of a card are 10 to 90 minutes apart, with amounts from 8 to 420 near its
home city and declines at least 45 minutes apart; accounts act in slots of four hours, with at most two failed logins in
a slot, passwords changed only after a verification, verifications 45 to 120 seconds after their request, and transfers
outside the structuring band. Everything follows from hashes of (seed, entity, number), so the tape is made by Spark in
parallel and is the same for a seed.

``id`` grows with the time of arrival, which is the event time plus a lateness of at most 40 seconds.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.schema import EVENT, HOUR, MINUTE, RULE

DAY = 24 * HOUR
#: The tape's first moment and the cities of cards.
BASE_TS = 1_753_920_000_000
CITIES = (("London", 51.5074, -0.1278, "GB"), ("Singapore", 1.3521, 103.8198, "SG"), ("Paris", 48.8566, 2.3522, "FR"), ("Madrid", 40.4168, -3.7038, "ES"), ("Oslo", 59.9139, 10.7522, "NO"))
MERCHANTS = ("corner-espresso", "metro-tickets", "harbour-dutyfree", "green-grocer", "book-barn")


def _u(seed: int, *of: Column | int) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.lit(x) if isinstance(x, int) else x for x in of]), F.lit(1_000_003)) / 1_000_003.0


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    """EVENT rows but for ``id``; columns that aren't given are empty."""
    empty = {"long": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False), "string": F.lit(""), "bigint": F.lit(0)}
    return df.select(*[columns.get(f.name, empty[f.dataType.simpleString()]).cast(f.dataType).alias(f.name) for f in EVENT if f.name != "id"])


def _pick(values: tuple, number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number + 1).cast("int"))


def card_noise(spark: SparkSession, seed: int, days: int, cards: int) -> DataFrame:
    """Purchases 50 minutes apart, give or take 20."""
    per_card = days * DAY // (50 * MINUTE)
    df = spark.range(cards * per_card).select((F.floor(F.col("id") / per_card) + 1000).alias("c"), (F.col("id") % per_card).alias("k"))
    city = F.floor(_u(seed, 1, F.col("c")) * len(CITIES))
    return _rows(
        df,
        ts=BASE_TS + F.col("k") * 50 * MINUTE + F.floor(_u(seed, 2, F.col("c"), F.col("k")) * 40 * MINUTE),
        type=F.lit("auth"),
        card=F.col("c"),
        amount=F.round(8 + _u(seed, 3, F.col("c"), F.col("k")) * 412, 2),
        approved=(F.col("k") + F.col("c")) % 33 != 5,
        present=_u(seed, 4, F.col("c"), F.col("k")) < 0.7,
        lat=F.round(_pick(tuple(x[1] for x in CITIES), city) + (_u(seed, 5, F.col("c"), F.col("k")) - 0.5) * 0.3, 6),
        lon=F.round(_pick(tuple(x[2] for x in CITIES), city) + (_u(seed, 6, F.col("c"), F.col("k")) - 0.5) * 0.3, 6),
        merchant=_pick(MERCHANTS, F.floor(_u(seed, 7, F.col("c"), F.col("k")) * len(MERCHANTS))),
        country=_pick(tuple(x[3] for x in CITIES), city),
    )


def account_noise(spark: SparkSession, seed: int, days: int, accounts: int) -> DataFrame:
    """One activity in each slot of four hours: a list of (delay, type, amount) steps."""
    per_account = days * DAY // (4 * HOUR)
    df = spark.range(accounts * per_account).select((F.floor(F.col("id") / per_account) + 2000).alias("a"), (F.col("id") % per_account).alias("k"))
    gap = 45_000 + F.floor(_u(seed, 12, F.col("a"), F.col("k")) * 75_000)
    amount = F.round(F.when(_u(seed, 13, F.col("a"), F.col("k")) < 0.6, 40 + _u(seed, 14, F.col("a"), F.col("k")) * 660).otherwise(1200 + _u(seed, 14, F.col("a"), F.col("k")) * 4000), 2)

    def step(delay: Column | int, kind: str, of: Column | float = 0.0) -> Column:
        return F.struct((F.lit(delay) if isinstance(delay, int) else delay).cast("long").alias("delay"), F.lit(kind).alias("kind"), (F.lit(of) if isinstance(of, float) else of).cast("double").alias("amount"))

    verified = [step(0, "otp_request"), step(gap, "otp_verify")]
    activity = F.floor(_u(seed, 11, F.col("a"), F.col("k")) * 5)
    steps = (
        F.when(activity == 0, F.array(step(0, "login_fail"), step(20_000, "login_fail"), step(60_000, "login_ok")))
        .when(activity == 1, F.array(*verified))
        .when(activity == 2, F.array(*verified, step(gap + 60_000, "password_change")))
        .otherwise(F.array(step(0, "login_ok"), step(30_000, "transfer", amount)))
    )
    start = BASE_TS + F.col("k") * 4 * HOUR + F.floor(_u(seed, 15, F.col("a"), F.col("k")) * HOUR)
    df = df.select("a", start.alias("start"), F.explode(steps).alias("s"))
    return _rows(df, ts=F.col("start") + F.col("s.delay"), type=F.col("s.kind"), account=F.col("a"), amount=F.col("s.amount"))


#: Planted entities have numbers from here on, beyond those of the noise.
PLANTED = 50_000
#: Own merchants of the rules: (kind, merchant, active from this share of the tape on, cap).
PLANTED_RULES = (("merchant_watchlist", "attic-auctions", 0.0, 0.0), ("merchant_watchlist", "lantern-lounge", 0.5, 0.0), ("merchant_watchlist", "never-yet", 1.0, 0.0), ("merchant_cap", "marble-arcade", 0.0, 350.0))


def _event(minute: float, kind: str, **more: object) -> dict:
    return dict.fromkeys(("card", "account"), 0) | {"minute": minute, "type": kind, "amount": 0.0, "approved": False, "present": False, "lat": 0.0, "lon": 0.0, "merchant": "", "country": ""} | more


def _auth(minute: float, amount: float, approved: bool = True, city: str = "Oslo", merchant: str = MERCHANTS[-1], present: bool = False) -> dict:
    lat, lon, country = next(c[1:] for c in CITIES if c[0] == city)
    return _event(minute, "auth", amount=amount, approved=approved, present=present, lat=lat, lon=lon, merchant=merchant, country=country)


def _probes(n: int, strike: float, rng: random.Random) -> list[dict]:
    """n declined purchases of small change, 70 seconds apart at most, and one of ``strike``."""
    every = min(70, 540 // n) / 60
    return [_auth(k * every, round(rng.uniform(0.1, 2.0), 2), approved=False) for k in range(n)] + [_auth(n * every, strike)]


def _trip(a: str, b: str, minutes: float, present: bool = True) -> list[dict]:
    return [_auth(0, 31.4, city=a, present=present), _auth(minutes, 27.18, city=b, present=present)]


def _drain(fails: int, amount: float, verified: float | None = None) -> list[dict]:
    """Failed logins every half minute, a new password after 12 minutes, money out after 20."""
    steps = [_event(k / 2, "login_fail") for k in range(fails)] + [_event(12, "password_change"), _event(20, "transfer", amount=amount)]
    return steps + ([] if verified is None else [_event(verified, "otp_verify")])


def _request(verified: float | None = None) -> list[dict]:
    return [_event(0, "otp_request")] + ([] if verified is None else [_event(verified, "otp_verify")])


def _slices(every: float, *amounts: float) -> list[dict]:
    return [_event(k * every * 60, "transfer", amount=x) for k, x in enumerate(amounts)]


def _purchases(merchant: str, *of: tuple[float, float]) -> list[dict]:
    """(hour, amount) each."""
    return [_auth(hour * 60, amount, merchant=merchant) for hour, amount in of]


def campaigns(seed: int, days: int) -> tuple[list[dict], list[tuple], list[tuple]]:
    """Events, rules, and (pattern, entity_kind, entity_id, number of alerts) of each campaign; 0 marks a control.

    Each detector gets campaigns just inside its conditions and controls just outside of one of them. Scripts of several
    hours start at the tape's beginning, the others at even distances over it."""
    rng = random.Random(seed)
    half = days * DAY / HOUR / 2
    short = [
        ("card_testing", 1, _probes(4, 251.0, rng)), ("card_testing", 1, _probes(18, 777.0, rng)), ("card_testing", 0, _probes(3, 777.0, rng)), ("card_testing", 0, _probes(9, 249.0, rng)),
        ("impossible_travel", 1, _trip("Oslo", "Madrid", 100)), ("impossible_travel", 0, _trip("Paris", "Madrid", 75)), ("impossible_travel", 0, _trip("Oslo", "Singapore", 20, present=False)),
        ("account_takeover", 1, _drain(3, 1500.0)), ("account_takeover", 1, _drain(8, 9000.0)), ("account_takeover", 0, _drain(2, 9000.0)), ("account_takeover", 0, _drain(5, 9000.0, verified=15)), ("account_takeover", 0, _drain(5, 1499.0)),
        ("otp_never_verified", 1, _request()), ("otp_never_verified", 1, _request(verified=5.5)), ("otp_never_verified", 0, _request(verified=4.5)),
    ]
    long = [
        ("structuring", 1, _slices(5, 999.0, 801.0, 960.0, 840.0)), ("structuring", 1, _slices(2, 805.0, 810.0, 815.0, 820.0)), ("structuring", 0, _slices(9, 999.0, 999.0, 999.0, 999.0)), ("structuring", 0, _slices(3, 1000.0, 1000.0, 799.0, 1000.0)),
        ("watchlist_hit", 3, _purchases("attic-auctions", (2, 18.0), (20, 33.5), (41, 7.25))), ("watchlist_hit", 1, _purchases("lantern-lounge", (half - 12, 52.0), (half + 12, 64.0))), ("watchlist_hit", 0, _purchases("never-yet", (6, 91.0), (30, 12.0))),
        ("cap_exceeded", 2, _purchases("marble-arcade", (1, 350.0), (15, 350.01), (33, 120.0), (50, 400.0))),
    ]
    events, expected = [], []
    for i, (pattern, alerts, script) in enumerate(short + long):
        kind = "account" if pattern in ("account_takeover", "otp_never_verified", "structuring") else "card"
        start = BASE_TS + ((i + 1) * days * DAY // (len(short) + 2) if i < len(short) else 0)
        events += [e | {kind: PLANTED + i, "ts": int(start + e["minute"] * MINUTE)} for e in script]
        expected.append((pattern, kind, PLANTED + i, alerts))
    rules = [(kind, merchant, int(BASE_TS + share * days * DAY), cap) for kind, merchant, share, cap in PLANTED_RULES]
    return events, [*rules, ("end_of_rules", "", 0, 0.0)], expected


def tape(spark: SparkSession, seed: int = 7, days: int = 3, cards: int = 220, accounts: int = 160) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EVENT rows, RULE rows and the campaigns (pattern, entity_kind, entity_id, alerts)."""
    planted, rules, expected = campaigns(seed, days)
    names = [f.name for f in EVENT if f.name != "id"]
    own = _rows(spark.createDataFrame([tuple(e[n] for n in names) for e in planted], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT if f.name != "id")), **{n: F.col(n) for n in names})
    rows = card_noise(spark, seed, days, cards).unionByName(account_noise(spark, seed, days, accounts))
    late = _u(seed, 21, F.col("ts"), F.col("card"), F.col("account"))
    span = _u(seed, 22, F.col("ts"), F.col("card"), F.col("account"))
    delay = F.when(late < 0.9, span * 3000).when(late < 0.99, 3000 + span * 5000).otherwise(8000 + span * 32_000)
    rows = rows.withColumn("late", delay).unionByName(own.withColumn("late", span * 1000))
    arrival = (F.col("ts") - BASE_TS + F.floor("late")).cast("long")
    number = F.shiftleft(arrival, 20) + F.pmod(F.xxhash64("ts", "type", "card", "account"), F.lit(1 << 20))
    events = rows.withColumn("id", number).select(*EVENT.names)
    return events, spark.createDataFrame(rules, RULE), spark.createDataFrame(expected, "pattern string, entity_kind string, entity_id long, alerts long")

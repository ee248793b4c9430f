"""The registered queries over the ``events`` table and the SQL that each should equal.

``events`` has users instead of cards and windows of days instead of minutes; the patterns are those of the detectors,
scaled to it: errors stand for declined probes and failed logins, purchases for strikes, drains and transfers, sign-ups
for requests and changes, views for verifications.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import haversine_km, in_band
from vigil.operators import checks, native, profile
from vigil.operators.cep import FOREVER, Detector, detect
from vigil.operators.rules import rule_hits
from vigil.plans.evolution import default_migrations
from vigil.plans.pattern import Pattern
from vigil.schema import HOUR, PROFILE_V1, RULE
from vigil.sources import records

MS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 1000"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts (ms), type, user_id, amount, k."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.expr(MS).alias("ts"), F.col("event_type").alias("type"), "user_id", F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as EVENT rows: every event is a purchase at a merchant named by its type, errors declined."""
    e = _events(spark, sf_dir)
    return e.select(
        "id", "ts", F.lit("auth").alias("type"), F.col("user_id").alias("card"), F.col("user_id").alias("account"), "amount",
        (F.col("type") != "error").alias("approved"), (F.col("type") == "view").alias("present"),
        (F.col("k") / 2.0).alias("lat"), (F.col("k") * 1.5).alias("lon"), F.col("type").alias("merchant"), F.concat(F.lit("C"), F.col("k").cast("string")).alias("country"),
    )


def _detector(name: str, pattern: Pattern, columns: tuple[str, ...], last: str) -> Detector:
    return Detector(name, "user", "user_id", pattern, columns, on_match=lambda c: (c[last][0]["ts"], str(sum(map(len, c.values())))))


def _burst() -> Detector:
    p = Pattern.begin("errors").where("type = 'error'").times(2, 20).followed_by("strike").where("type = 'purchase' and amount >= 100")
    return _detector("burst_then_strike", p.within(72 * HOUR).after_match_skip_past_last(), (), "strike")


def _negation() -> Detector:
    p = (
        Pattern.begin("errors").where("type = 'error'").times(2, 8)
        .not_followed_by("view").where("type = 'view'").followed_by("change").where("type = 'signup'")
        .not_followed_by("view_later").where("type = 'view'").followed_by("drain").where("type = 'purchase' and amount >= 50")
    )
    return _detector("sequence_with_negation", p.within(168 * HOUR).after_match_skip_past_last(), (), "drain")


def _running() -> Detector:
    band = "type = 'purchase' and amount >= 30 and amount < 90"
    total = lambda e, c: sum(x["amount"] for x in c.get("parts", ())) + e["amount"]
    p = Pattern.begin("parts").where(band).where_match(lambda e, c: total(e, c) < 150).times(2, 12)
    p = p.followed_by("trip").where(band).where_match(lambda e, c: total(e, c) >= 150)
    return _detector("running_total_trip", p.within(72 * HOUR).after_match_skip_past_last(), ("amount",), "trip")


def _pairwise() -> Detector:
    p = Pattern.begin("a").where("type = 'view'").followed_by("b").where("type = 'view'")
    p = p.where_match(lambda e, c: abs(e["amount"] - c["a"][0]["amount"]) >= 50)
    return _detector("pairwise_rate", p.within(6 * HOUR).after_match_skip_past_last(), ("amount",), "b")


def _found(e: DataFrame, *detectors: Detector) -> DataFrame:
    return detect(e, list(detectors)).select("pattern", "entity_id", "ts", F.col("detail").cast("long").alias("n_events"))


def burst_then_strike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_events(spark, sf_dir), _burst())


def sequence_with_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_events(spark, sf_dir), _negation())


def running_total_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_events(spark, sf_dir), _running())


def pairwise_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_events(spark, sf_dir), _pairwise())


def _next_purchase(e: DataFrame) -> DataFrame:
    """Sign-ups with the time of the user's next purchase: a running minimum from the latest event backwards."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = e.filter(F.col("type").isin("signup", "purchase")).withColumn("next", F.min(F.when(F.col("type") == "purchase", F.col("ts"))).over(w))
    return rows.filter(F.col("type") == "signup")


def absence_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups that no purchase follows within 24 hours, in built-in functions."""
    late = F.col("next").isNull() | (F.col("next") > F.col("ts") + 24 * HOUR)
    return _next_purchase(_events(spark, sf_dir)).filter(late).select(F.col("user_id").alias("entity_id"), "ts")


def sequence_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("next") <= F.col("ts") + 24 * HOUR
    return _next_purchase(_events(spark, sf_dir)).filter(done).select(F.col("user_id").alias("entity_id"), "ts")


def absence_by_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``absence_timeout``, from the matcher's timed-out channel."""
    p = Pattern.begin("request").where("type = 'signup'").followed_by("verify").where("type = 'purchase'").within(24 * HOUR)
    d = Detector("absence", "user", "user_id", p, (), on_timeout=lambda c: (c["request"][0]["ts"], ""))
    return detect(_events(spark, sf_dir), [d], complete_to=FOREVER).select("entity_id", "ts")


RULES = [("merchant_watchlist", "signup", 1704067200000 + 240 * HOUR, 0.0), ("merchant_cap", "purchase", 1704067200000 + 120 * HOUR, 75.0), ("end_of_rules", "", 0, 0.0)]


def _hits(spark: SparkSession, sf_dir: str, rules: list[tuple], pattern: str) -> DataFrame:
    hits = rule_hits(_cards(spark, sf_dir), spark.createDataFrame(rules, RULE))
    return hits.filter(F.col("pattern") == pattern).select("pattern", "entity_id", "ts")


def effective_dated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, RULES, "watchlist_hit")


def cap_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, RULES, "cap_exceeded")


def rules_unsealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a set without its seal (none) beside those of the sealed set."""
    hits = [rule_hits(_cards(spark, sf_dir), spark.createDataFrame(r, RULE)).agg(F.count("*").alias("hits")).select(F.lit(n).alias("rules"), "hits") for n, r in (("sealed", RULES), ("unsealed", RULES[:-1]))]
    return hits[0].unionByName(hits[1])


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profiles(_cards(spark, sf_dir)).withColumn("total", F.round("total", 2))


def keyed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).drop("first_ts")


def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_profile(spark, sf_dir).filter("card = 7")


def profile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five smallest cards: a bounded scan is the feature."""
    return keyed_profile(spark, sf_dir).orderBy("card").limit(5)


def profile_v2_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v1 = _profiles(spark, sf_dir).select("card", *PROFILE_V1.names)
    return default_migrations().migrate(profile.STATE_TYPE, v1, 1, 2)


def _all_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_events(spark, sf_dir), _burst(), _negation(), _running(), _pairwise())


def alert_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.counts(_all_found(spark, sf_dir))


def alert_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchlist hits against purchases at or over the cap, as multisets of users."""
    hits = _hits(spark, sf_dir, RULES, "watchlist_hit").select("entity_id")
    caps = _hits(spark, sf_dir, RULES, "cap_exceeded").select("entity_id")
    return checks.multiset_difference(hits, caps).groupBy("side").agg(F.count("*").alias("n"))


def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burst alerts of users that never view: controls that should be silent, and those that aren't."""
    e = _events(spark, sf_dir)
    controls = e.groupBy("user_id").agg(F.count_if(F.col("type") == "view").alias("views")).filter("views < 10")
    controls = controls.select(F.lit("burst_then_strike").alias("pattern"), F.lit("user").alias("entity_kind"), F.col("user_id").alias("entity_id"))
    return checks.loud_controls(detect(e, [_burst()]), controls).select("entity_id", "ts")


def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event written as a JSON line, some of them spoiled, and parsed again."""
    lines = _cards(spark, sf_dir).select(F.when(F.col("id") % 10 == 3, F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit("}"))).otherwise(records.event_json()).alias("value"))
    return records.parse_events(lines).select("id", "ts", "card", "amount", "approved", "merchant")


def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter(F.col("type").isin("error", "purchase") & in_band(F.col("amount"), 30, 90)).select("id", "user_id", "ts")


def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cards(spark, sf_dir)
    return c.select("id", F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(-0.1)), 3).alias("km"))


#: How often time passes faster for the detectors, whose windows are of minutes and hours.
QUICK, BRISK, SLOW = 400, 20, 10
_START = 1704067200000


def _fraud(spark: SparkSession, sf_dir: str, faster: int) -> DataFrame:
    """The events as EVENT rows twice: as purchases of a card and, with larger ids, as actions of an account."""
    e = _events(spark, sf_dir).withColumn("ts", F.expr(f"{_START} + (ts - {_START}) div {faster}"))
    kind = F.create_map(*[F.lit(x) for pair in (("error", "login_fail"), ("signup", "password_change"), ("view", "otp_verify"), ("click", "otp_request"), ("purchase", "transfer")) for x in pair])
    error, purchase = F.col("type") == "error", F.col("type") == "purchase"
    transfer = F.when(F.col("id") % 2 == 0, 790 + F.col("amount")).otherwise(1000 + 30 * F.col("amount"))
    both = F.inline(
        F.array(
            F.struct(F.col("id").alias("event"), F.lit("auth").alias("what"), F.col("user_id").alias("card"), F.lit(0).cast("long").alias("account"), F.when(error, F.col("amount") / 100).when(purchase, F.col("amount") * 10).otherwise(F.col("amount")).alias("sum")),
            F.struct((F.col("id") + 10**12).alias("event"), kind[F.col("type")].alias("what"), F.lit(0).cast("long").alias("card"), F.col("user_id").alias("account"), transfer.alias("sum")),
        )
    )
    return e.select("ts", "type", "k", both).select(
        F.col("event").alias("id"), "ts", F.col("what").alias("type"), "card", "account", F.round("sum", 2).alias("amount"), (~error).alias("approved"), (F.col("type") == "view").alias("present"),
        (F.col("k") / 2.0).alias("lat"), (F.col("k") * 1.5).alias("lon"), F.lit("m").alias("merchant"), F.concat(F.lit("C"), F.col("k").cast("string")).alias("country"),
    )


def card_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.card_testing(_fraud(spark, sf_dir, QUICK))


def impossible_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the detail, whose kilometres come from trigonometry."""
    return native.impossible_travel(_fraud(spark, sf_dir, BRISK)).drop("detail")


def account_takeover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.account_takeover(_fraud(spark, sf_dir, QUICK))


def otp_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels of the pattern: requests verified in time and those never verified."""
    return native.otp_requests(_fraud(spark, sf_dir, QUICK))


def structuring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.structuring(_fraud(spark, sf_dir, SLOW))


def queries() -> dict:
    named = [
        burst_then_strike, sequence_with_negation, running_total_trip, pairwise_rate, absence_timeout, sequence_completed, absence_by_matcher,
        effective_dated_rules, cap_rules, rules_unsealed, keyed_profile, profile_lookup, profile_scan, profile_v2_migrate, alert_union_counts,
        alert_multiset_diff, negative_controls, parse_events, type_filter, haversine,
        card_testing, impossible_travel, account_takeover, otp_requests, structuring,
    ]
    return {f.__name__: f for f in named}


_E = "e AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS ts, event_type AS type, user_id, value AS amount, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
#: From candidates (user_id, s, e, n): the match of a user is that which ends first, of these the one that starts
#: first; the next one starts after its end.
_CHAIN = """
m AS (
  SELECT user_id, min(e) AS e FROM cand GROUP BY user_id
  UNION ALL
  SELECT m.user_id, min(c.e) AS e FROM m JOIN cand c ON c.user_id = m.user_id AND c.s > m.e GROUP BY m.user_id, m.e
),
ends AS (SELECT user_id, e, lag(e) OVER (PARTITION BY user_id ORDER BY e) AS prev FROM m),
found AS (
  SELECT ends.user_id, ends.e, min_by(c.n, c.s) AS n FROM ends
  JOIN cand c ON c.user_id = ends.user_id AND c.e = ends.e AND (ends.prev IS NULL OR c.s > ends.prev) GROUP BY ALL
)"""
_BURST = f"""
two AS (SELECT a.user_id, a.ts AS s, lead(a.ts) OVER (PARTITION BY a.user_id ORDER BY a.ts) AS e2 FROM e a WHERE type = 'error'),
ends0 AS (SELECT t.user_id, t.s, min(p.ts) AS e FROM two t JOIN e p ON p.user_id = t.user_id AND p.type = 'purchase' AND p.amount >= 100 AND p.ts > t.e2 GROUP BY ALL),
cand AS (
  SELECT z.user_id, z.s, z.e, least(20, (SELECT count(*) FROM e x WHERE x.user_id = z.user_id AND x.type = 'error' AND x.ts >= z.s AND x.ts < z.e)) + 1 AS n
  FROM ends0 z WHERE z.e - z.s <= {72 * HOUR}
),{_CHAIN}"""
_NEGATION = f"""
two AS (SELECT a.user_id, a.ts AS s, lead(a.ts) OVER (PARTITION BY a.user_id ORDER BY a.ts) AS e2 FROM e a WHERE type = 'error'),
sig AS (SELECT t.user_id, t.s, t.e2, min(x.ts) AS g FROM two t JOIN e x ON x.user_id = t.user_id AND x.type = 'signup' AND x.ts > t.e2 GROUP BY ALL),
pur AS (SELECT t.user_id, t.s, t.e2, t.g, min(x.ts) AS e FROM sig t JOIN e x ON x.user_id = t.user_id AND x.type = 'purchase' AND x.amount >= 50 AND x.ts > t.g GROUP BY ALL),
cand AS (
  SELECT z.user_id, z.s, z.e, least(8, (SELECT count(*) FROM e x WHERE x.user_id = z.user_id AND x.type = 'error' AND x.ts >= z.s AND x.ts < z.g)) + 2 AS n
  FROM pur z WHERE z.e - z.s <= {168 * HOUR}
  AND NOT EXISTS (SELECT 1 FROM e v WHERE v.user_id = z.user_id AND v.type = 'view' AND v.ts > z.e2 AND v.ts < z.e)
),{_CHAIN}"""
_RUNNING = f"""
b AS (SELECT user_id, ts, amount, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM e WHERE type = 'purchase' AND amount >= 30 AND amount < 90),
walk AS (
  SELECT user_id, ts AS s, i, amount AS total, 1 AS parts, CAST(NULL AS BIGINT) AS e FROM b
  UNION ALL
  SELECT w.user_id, w.s, b.i, CASE WHEN w.total + b.amount < 150 THEN w.total + b.amount ELSE w.total END,
    CASE WHEN w.total + b.amount < 150 THEN w.parts + 1 ELSE w.parts END,
    CASE WHEN w.total + b.amount >= 150 AND w.parts >= 2 THEN b.ts END
  FROM walk w JOIN b ON b.user_id = w.user_id AND b.i = w.i + 1 AND b.ts - w.s <= {72 * HOUR} WHERE w.e IS NULL
),
cand AS (SELECT user_id, s, e, parts + 1 AS n FROM walk WHERE e IS NOT NULL),{_CHAIN}"""
_PAIRWISE = f"""
cand AS (
  SELECT a.user_id, a.ts AS s, min(b.ts) AS e, 2 AS n FROM e a JOIN e b
  ON a.user_id = b.user_id AND a.type = 'view' AND b.type = 'view' AND b.ts > a.ts AND b.ts - a.ts <= {6 * HOUR} AND abs(b.amount - a.amount) >= 50 GROUP BY a.user_id, a.ts
),{_CHAIN}"""
_PROFILE = f"""
p AS (
  SELECT user_id AS card, count(*) AS auths, count(*) FILTER (WHERE type = 'error') AS declines, round(sum(amount), 2) AS total, greatest(0.0, max(amount)) AS max_amount,
    greatest(0, max(ts)) AS last_ts, arg_max('C' || CAST(k AS VARCHAR), ROW(ts, id)) AS last_country FROM e GROUP BY user_id
),
q AS (SELECT *, CAST(least(100, 25 * least(declines, 4) + CASE WHEN max_amount >= 400 THEN 15 ELSE 0 END) AS BIGINT) AS score FROM p)"""
_HITS = f"""
h AS (
  SELECT 'watchlist_hit' AS pattern, user_id AS entity_id, ts FROM e WHERE type = 'signup' AND ts >= {RULES[0][2]}
  UNION ALL SELECT 'cap_exceeded', user_id, ts FROM e WHERE type = 'purchase' AND ts >= {RULES[1][2]} AND amount > {RULES[1][3]}
)"""
_FOLLOWED = f"EXISTS (SELECT 1 FROM e p WHERE p.user_id = s.user_id AND p.type = 'purchase' AND p.ts > s.ts AND p.ts <= s.ts + {24 * HOUR})"


def _fraud_sql(faster: int) -> str:
    """The events of cards (c) and accounts (a). Their ids are in order of time."""
    return f"""{_E},
q AS (SELECT id, {_START} + (ts - {_START}) // {faster} AS ts, type, user_id, amount AS v, k FROM e),
c AS (SELECT *, round(CASE type WHEN 'error' THEN v / 100 WHEN 'purchase' THEN v * 10 ELSE v END, 2) AS amount FROM q),
a AS (SELECT *, round(CASE WHEN id % 2 = 0 THEN 790 + v ELSE 1000 + 30 * v END, 2) AS amount FROM q)"""


def _alert_sql(name: str, kind: str, faster: int, body: str, detail: str) -> str:
    columns = f", {detail} AS detail" if detail else ""
    return f"""WITH RECURSIVE {_fraud_sql(faster)},{body}
SELECT '{name}' AS pattern, '{kind}' AS entity_kind, f.user_id AS entity_id, q.ts{columns} FROM found f JOIN {kind[0]} q ON q.id = f.e"""


_PROBES = f"""
pr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS i FROM c WHERE type = 'error' AND amount <= 2),
pairs AS (
  SELECT s.user_id, s.id AS s, t.id AS t, t.amount, count(*) AS n, max(x.amount) AS top
  FROM pr s JOIN c t ON t.user_id = s.user_id AND t.type <> 'error' AND t.amount >= 250 AND t.id > s.id AND t.ts - s.ts <= {10 * 60000}
  JOIN pr x ON x.user_id = s.user_id AND x.i >= s.i AND x.i < s.i + 20 AND x.id < t.id GROUP BY ALL
),
cand AS (SELECT user_id, s, min(t) AS e, arg_min(n, t) AS n FROM pairs WHERE n >= 4 AND amount >= 20 * top GROUP BY user_id, s),{_CHAIN}"""
_FAR = f"""
v AS (SELECT *, k / 2.0 AS lat, k * 1.5 AS lon FROM c WHERE type = 'view'),
pairs AS (
  SELECT s.user_id, s.id AS s, t.id AS t, greatest(t.ts - s.ts, 1) / {HOUR}.0 AS hours,
    2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(t.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - s.lon) / 2), 2)))) AS km
  FROM v s JOIN v t ON t.user_id = s.user_id AND t.id > s.id AND t.ts - s.ts <= {6 * HOUR}
),
cand AS (SELECT user_id, s, min(t) AS e, 2 AS n FROM pairs WHERE km >= 200 AND km / hours > 900 GROUP BY user_id, s),{_CHAIN}"""
_TAKEN = f"""
fl AS (SELECT *, lead(id, 2) OVER (PARTITION BY user_id ORDER BY id) AS third FROM a WHERE type = 'error'),
g AS (SELECT f.user_id, f.id AS s, f.ts, f.third, min(x.id) AS g FROM fl f JOIN a x ON x.user_id = f.user_id AND x.type = 'signup' AND x.id > f.third GROUP BY ALL),
d AS (SELECT g.user_id, g.s, g.ts, g.third, g.g, min(x.id) AS e FROM g JOIN a x ON x.user_id = g.user_id AND x.type = 'purchase' AND x.amount >= 1500 AND x.id > g.g GROUP BY ALL),
cand AS (
  SELECT d.user_id, d.s, d.e, least(8, (SELECT count(*) FROM fl x WHERE x.user_id = d.user_id AND x.id >= d.s AND x.id < d.g)) AS n
  FROM d JOIN a z ON z.id = d.e WHERE z.ts - d.ts <= {30 * 60000}
  AND NOT EXISTS (SELECT 1 FROM a x WHERE x.user_id = d.user_id AND x.type = 'view' AND x.id > d.third AND x.id < d.e)
),{_CHAIN}"""
_TRIPPED = f"""
b AS (SELECT *, CAST(amount AS DECIMAL(18, 2)) AS m, row_number() OVER (PARTITION BY user_id ORDER BY id) AS i FROM a WHERE type = 'purchase' AND amount >= 800 AND amount < 1000),
walk AS (
  SELECT user_id, id AS s, ts, i, m AS total, 1 AS parts, CAST(NULL AS BIGINT) AS e FROM b
  UNION ALL
  SELECT w.user_id, w.s, w.ts, b.i, CAST(w.total + b.m AS DECIMAL(18, 2)), w.parts + 1, CASE WHEN w.total + b.m >= 3000 THEN b.id END
  FROM walk w JOIN b ON b.user_id = w.user_id AND b.i = w.i + 1 AND b.ts - w.ts <= {24 * HOUR} WHERE w.e IS NULL AND w.parts < 13
),
cand AS (SELECT user_id, s, e, {{'n': parts, 'total': total}} AS n FROM walk WHERE e IS NOT NULL AND parts > 2),{_CHAIN}"""
_ASKED = f"""WITH {_fraud_sql(QUICK)},
r AS (SELECT user_id, ts, EXISTS (SELECT 1 FROM a v WHERE v.user_id = a.user_id AND v.type = 'view' AND v.id > a.id AND v.ts - a.ts <= {5 * 60000}) AS ok FROM a WHERE type = 'click')
SELECT CASE WHEN ok THEN 'otp_verified_ok' ELSE 'otp_never_verified' END AS pattern, 'account' AS entity_kind, user_id AS entity_id, ts,
  CASE WHEN ok THEN '' ELSE 'otp requested, never verified within 5 min' END AS detail FROM r"""


def _found_sql(name: str, body: str) -> str:
    return f"WITH RECURSIVE {_E},{body} SELECT '{name}' AS pattern, user_id AS entity_id, e AS ts, CAST(n AS BIGINT) AS n_events FROM found"


def oracle_sql() -> dict[str, str]:
    found = {n: _found_sql(n, b) for n, b in (("burst_then_strike", _BURST), ("sequence_with_negation", _NEGATION), ("running_total_trip", _RUNNING), ("pairwise_rate", _PAIRWISE))}
    absent = f"WITH {_E} SELECT user_id AS entity_id, ts FROM e s WHERE type = 'signup' AND NOT {_FOLLOWED}"
    columns = "card, auths, declines, total, max_amount, last_ts, last_country"
    found_by = {
        "card_testing": _alert_sql("card_testing", "card", QUICK, _PROBES, "format('{} probes then {:.2f} approved', f.n, q.amount)"),
        "impossible_travel": _alert_sql("impossible_travel", "card", BRISK, _FAR, ""),
        "account_takeover": _alert_sql("account_takeover", "account", QUICK, _TAKEN, "format('{} failed logins, password change, then {:.2f} out, no OTP', f.n, q.amount)"),
        "otp_requests": _ASKED,
        "structuring": _alert_sql("structuring", "account", SLOW, _TRIPPED, "format('{} sub-threshold transfers totalling {:.2f}', f.n.n, CAST(f.n.total AS DOUBLE))"),
    }
    return found | found_by | {
        "absence_timeout": absent,
        "absence_by_matcher": absent,
        "sequence_completed": f"WITH {_E} SELECT user_id AS entity_id, ts FROM e s WHERE type = 'signup' AND {_FOLLOWED}",
        "effective_dated_rules": f"WITH {_E},{_HITS} SELECT * FROM h WHERE pattern = 'watchlist_hit'",
        "cap_rules": f"WITH {_E},{_HITS} SELECT * FROM h WHERE pattern = 'cap_exceeded'",
        "rules_unsealed": f"WITH {_E},{_HITS} SELECT 'sealed' AS rules, count(*) AS hits FROM h UNION ALL SELECT 'unsealed', 0",
        "keyed_profile": f"WITH {_E},{_PROFILE} SELECT {columns}, score FROM q",
        "profile_lookup": f"WITH {_E},{_PROFILE} SELECT {columns}, score FROM q WHERE card = 7",
        "profile_scan": f"WITH {_E},{_PROFILE} SELECT {columns}, score FROM q ORDER BY card LIMIT 5",
        "profile_v2_migrate": f"WITH {_E},{_PROFILE} SELECT {columns}, last_ts AS first_ts FROM q",
        "alert_union_counts": " UNION ALL ".join(f"SELECT pattern, count(*) AS alerts FROM ({sql}) GROUP BY pattern" for sql in found.values()),
        "alert_multiset_diff": f"""WITH {_E},{_HITS}, n AS (SELECT entity_id, count(*) FILTER (WHERE pattern = 'watchlist_hit') - count(*) FILTER (WHERE pattern = 'cap_exceeded') AS d FROM h GROUP BY 1)
            SELECT 'left' AS side, CAST(sum(d) AS BIGINT) AS n FROM n WHERE d > 0 HAVING sum(d) > 0 UNION ALL SELECT 'right', CAST(-sum(d) AS BIGINT) FROM n WHERE d < 0 HAVING sum(d) < 0""",
        "negative_controls": f"""SELECT entity_id, ts FROM ({found["burst_then_strike"]}) WHERE entity_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'view') < 10)""",
        "parse_events": f"WITH {_E} SELECT id, ts, user_id AS card, amount, type <> 'error' AS approved, type AS merchant FROM e WHERE id % 10 <> 3",
        "type_filter": f"WITH {_E} SELECT id, user_id, ts FROM e WHERE type IN ('error', 'purchase') AND amount >= 30 AND amount < 90",
        "haversine": f"""WITH {_E} SELECT id, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(51.5 - k / 2.0) / 2), 2) + cos(radians(k / 2.0)) * cos(radians(51.5)) * pow(sin(radians(-0.1 - k * 1.5) / 2), 2)))), 3) AS km FROM e""",
    }

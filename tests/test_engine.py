"""Detectors on Spark: the labelled tape in batch, in arrival order and as a stream; rules, profiles, state and sinks."""

import json
import os
import random
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from vigil.__main__ import main
from vigil.functions.scalars import two_decimals
from vigil.operators import checks, detectors, profile
from vigil.operators.cep import FOREVER, detect
from vigil.operators.rules import rule_hits
from vigil.plans.evolution import Incompatible, Migrations, check_restore, default_migrations
from vigil.schema import ALERT, EVENT, PROFILE_V1, RULE
from vigil.sources import records
from vigil.sources.tape import tape
from vigil.streaming.cep import _Detect, detect_stream
from vigil.streaming.rules import compact, latest_profiles, profile_table, rule_hits_stream
from vigil.streaming.sinks import captured, case_store, emit_bundle, read_cases, replay

T0 = 1_753_920_000_000


@pytest.fixture(scope="module")
def small_tape(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tape"))
    events, rules, campaigns = tape(spark, days=3, cards=20, accounts=20)
    events.orderBy("id").select(records.event_json().alias("value")).coalesce(3).write.text(f"{root}/events")
    rules.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{root}/rules")
    return root, campaigns


def expected_of(campaigns):
    return campaigns.filter("alerts > 0").select("pattern", "entity_kind", "entity_id", F.explode(F.sequence(F.lit(1), "alerts")).alias("k")).drop("k")


def test_tape_gives_exactly_the_expected_alerts(spark, small_tape):
    root, campaigns = small_tape
    rows = records.read_events(spark, f"{root}/events")
    assert rows.select("id").distinct().count() == rows.count()
    hits = rule_hits(rows, records.read_rules(spark, f"{root}/rules"))
    for order in ("event_time", "arrival"):
        alerts = detect(rows, detectors.all_detectors(), order, FOREVER).unionByName(hits)
        assert checks.differences(alerts, expected_of(campaigns)).collect() == []
        assert alerts.count() == 15
        assert checks.loud_controls(alerts, campaigns.filter("alerts = 0")).count() == 0
        assert alerts.schema == ALERT


def test_stream_equals_batch(spark, small_tape, tmp_path):
    root, _ = small_tape
    rows = records.read_events(spark, f"{root}/events").filter("account > 8000 or card > 9000")
    last = rows.agg(F.max("ts")).first()[0]
    # the stream knows what its watermark has passed
    want = sorted(map(tuple, detect(rows.filter(F.col("ts") <= last - 60_000), detectors.all_detectors(True), complete_to=last - 60_000).collect()))
    for n in (1, 4):
        rows.select(records.event_json().alias("value"), "id").repartitionByRange(n, "id").sortWithinPartitions("id").select("value").write.text(f"{tmp_path}/in{n}")
        for i, part in enumerate(sorted((tmp_path / f"in{n}").glob("part-*"))):  # files arrive by their time, which parallel tasks leave open
            os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
        stream = records.stream_events(spark, f"{tmp_path}/in{n}", maxFilesPerTrigger=1)
        store, start = f"{tmp_path}/store{n}", f"{tmp_path}/check{n}"
        for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
            q = detect_stream(stream, detectors.all_detectors(True)).writeStream.foreachBatch(case_store(store, "alerts")).option("checkpointLocation", start).trigger(availableNow=True).start()
            q.awaitTermination()
        assert sorted(tuple(r) for r in read_cases(spark, store).select(*ALERT.names).collect()) == want


class _Map(dict):
    """Map state that counts what is written."""

    def __init__(self):
        super().__init__()
        self.bytes = 0

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v
        self.bytes += len(v[0])

    def getValue(self, k):  # noqa: N802
        return self[k]

    containsKey = dict.__contains__  # noqa: N815
    removeKey = dict.__delitem__  # noqa: N815

    def iterator(self):
        return iter(list(self.items()))


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


class _Handle:
    def getValueState(self, *_):  # noqa: N802
        return _Value()

    def getMapState(self, *_):  # noqa: N802
        return _Map()

    def registerTimer(self, _):  # noqa: N802
        pass


def test_what_a_micro_batch_writes_does_not_grow_with_what_waits():
    """A thousand rows wait and as many matches are open; each further row writes about as much as the first."""
    import pandas as pd

    p = _Detect([detectors.otp_never_verified()])
    p.init(_Handle())
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: self.at})()
    written = []
    for i in range(1000):
        now.at = T0 + i * 10 - 5000  # the last 500 rows wait, the others are open requests
        p.open.bytes = p.rows.bytes = 0
        list(p.handleInputRows(("account", 1), iter([pd.DataFrame({"vg_bits": [[1]], "ts": [T0 + i * 10], "id": [i]})]), now))
        written.append(p.open.bytes + p.rows.bytes)
    assert len(p.rows) == 500 and len(p.open) == 500
    assert max(written[600:]) <= 2 * max(written[:10]) + 200
    now.at = T0 + 10_000_000
    assert len(pd.concat(p.handleExpiredTimer(("account", 1), now, None))) == 1000
    assert not p.rows and not p.open and not p.done.exists()


def test_rules_are_dated_and_need_a_seal(spark):
    def auth(card, merchant, amount, ts):
        return (ts, T0 + ts, "auth", card, 0, amount, True, False, 0.0, 0.0, merchant, "GB")

    events = spark.createDataFrame([auth(9301, "grey-imports", 95.0, 500), auth(9301, "grey-imports", 140.0, 1000), auth(9303, "grand-casino", 500.0, 2000), auth(9303, "grand-casino", 650.0, 2500), auth(1001, "corner-espresso", 900.0, 3000)], EVENT)
    rules = [("merchant_watchlist", "grey-imports", T0 + 1000, 0.0), ("merchant_cap", "grand-casino", T0, 500.0)]
    seal = ("end_of_rules", "", 0, 0.0)
    hits = rule_hits(events, spark.createDataFrame([*rules, seal], RULE)).collect()
    assert {tuple(r)[:4] for r in hits} == {("watchlist_hit", "card", 9301, T0 + 1000), ("cap_exceeded", "card", 9303, T0 + 2500)}
    assert {r["detail"] for r in hits} == {"auth at watchlisted grey-imports for 140.00", "auth at grand-casino for 650.00 over cap 500.00"}
    assert rule_hits(events, spark.createDataFrame(rules, RULE)).count() == 0
    assert rule_hits(events, spark.createDataFrame([*rules, rules[0], seal], RULE)).count() == 3  # one for each rule


def test_parser_drops_what_is_not_whole(spark):
    good = '{"id":1,"ts":2,"type":"auth","card":3,"account":0,"amount":1.5,"approved":1,"present":0,"lat":0.5,"lon":0.1,"merchant":"m","country":"GB"}'
    whole = json.loads(good)
    bad = [json.dumps({k: v for k, v in whole.items() if k != gone}) for gone in whole]
    bad += [good.replace("auth", "other"), good.replace('"ts":2', '"ts":5.0'), good.replace('"ts":2', '"ts":"x"'), good[:40], ""]
    rows = records.parse_events(spark.createDataFrame([(x,) for x in [good, *bad]], "value string"))
    assert [tuple(r) for r in rows.collect()] == [(1, 2, "auth", 3, 0, 1.5, True, False, 0.5, 0.1, "m", "GB")]
    odd = [good.replace('"ts":2', '"ts":"2"'), good.replace('"ts":2', '"ts":2,"ts":9'), good.replace('"amount":1.5', '"amount": 1.5'), good.replace('"ts":2', '"ts": 2'), good.replace("1.5", "1.5d"), good.replace('"id":1', '"id":99999999999999999999'), good.replace('"approved":1', '"approved":true'), None]
    assert [r["ts"] for r in records.parse_events(spark.createDataFrame([(x,) for x in odd], "value string")).collect()] == [2, 2, 2]
    plan = rows.filter("amount > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2  # a line is searched once for names and once for values
    assert rows.schema == EVENT or [f.dataType for f in rows.schema] == [f.dataType for f in EVENT]
    lines = ['{"kind":"merchant_cap","merchant":"m","activate_at":1,"cap":2.0}', '{"kind":"x","merchant":"m","activate_at":1,"cap":2.0}', '{"kind":"merchant_cap"}']
    assert records.parse_rules(spark.createDataFrame([(x,) for x in lines], "value string")).count() == 1


def test_parser_takes_the_first_key_and_numbers_of_c(spark):
    good = '{"id":1,"ts":2,"type":"auth","card":3,"account":0,"amount":1.5,"approved":1,"present":0,"lat":0.5,"lon":0.1,"merchant":"m","country":"GB"}'
    amounts = {"0x1A": 26.0, "0x1.8p3": 12.0, "-0X.8": -0.5, '"0x10"': 16.0, "\t7": 7.0, "1e2": 100.0, ".5": 0.5, "inf": float("inf"), "0x": None, "0x1p": None, "1.5f": None, "1 ": None, "": None, "0x1 p0": None}
    lines = [(good.replace('"amount":1.5', f'"amount":{a}'),) for a in amounts]
    got = [r["amount"] for r in records.parse_events(spark.createDataFrame(lines, "value string").coalesce(1)).collect()]
    assert got == [v for v in amounts.values() if v is not None]
    # a malformed first key counts; an empty bare text is a text; a key may begin with the quote that ends a value
    odd = [good.replace('"ts":2', '"ts":x,"ts":2'), good.replace('"id":1', '"card":"z","id":1'), good.replace('"merchant":"m"', '"merchant":'), good.replace('"m","country":"GB"}', '"m"country":"GB"'), good[:-1]]
    rows = records.parse_events(spark.createDataFrame([(x,) for x in odd], "value string").coalesce(1)).collect()
    assert [(r["merchant"], r["country"]) for r in rows] == [("", "GB"), ("m", "GB"), ("m", "GB")]


def arrive(spark, tmp_path, rows, schema, json, folder, number):
    """A file of JSON lines that a stream finds next."""
    spark.createDataFrame(rows, schema).select(json.alias("value")).coalesce(1).write.text(f"{tmp_path}/made-{folder}-{number}")
    (part,) = (tmp_path / f"made-{folder}-{number}").glob("part-*")
    os.makedirs(tmp_path / folder, exist_ok=True)
    os.utime(part, (1_700_000_000 + number, 1_700_000_000 + number))
    os.rename(part, tmp_path / folder / f"{number}.json")


@pytest.mark.parametrize("from_start", [False, True])
def test_rules_on_a_stream(spark, tmp_path, from_start):
    """Auths come before the rules and their seal, and a rule comes after it. Every step is a restart."""
    auth = lambda i, ts, merchant, amount, card=9301: (i, T0 + ts, "auth", card, 0, amount, True, False, 0.0, 0.0, merchant, "GB")
    first = [("merchant_watchlist", "m", T0 + 1000, 0.0), ("merchant_cap", "c", T0, 10.0)]
    steps = [
        ([auth(1, 500, "m", 1.005), auth(2, 1000, "m", 0.125), auth(7, 1200, "c", 10.01, 5), auth(8, 1300, "c", 10.0, 6)], [] if from_start else first),
        ([auth(3, 2000, "late", 9.0)], [("end_of_rules", "", 0, 0.0)]),
        ([auth(4, 3000, "late", 8.0), auth(5, 3500, "m", 2.675)], [("merchant_watchlist", "late", T0, 0.0)]),
        ([auth(6, 3600, "late", 7.0)], [("merchant_watchlist", "late", T0, 0.0)]),
    ]
    known = spark.createDataFrame(first, RULE) if from_start else None
    rule_json = F.to_json(F.struct("*"))
    for folder in ("events", "rules"):
        os.makedirs(tmp_path / folder)
    seen = []
    for i, (events, rules) in enumerate(steps):
        arrive(spark, tmp_path, events, EVENT, records.event_json(), "events", i)
        if rules:
            arrive(spark, tmp_path, rules, RULE, rule_json, "rules", i)
        hits = rule_hits_stream(records.parse_events(spark.readStream.text(f"{tmp_path}/events")), records.parse_rules(spark.readStream.text(f"{tmp_path}/rules")), known)
        hits.writeStream.foreachBatch(case_store(f"{tmp_path}/s", "hits")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(tuple(r) for r in read_cases(spark, f"{tmp_path}/s").select("ts", "detail").collect()))
    m, c = (T0 + 1000, "auth at watchlisted m for 0.12"), (T0 + 1200, "auth at c for 10.01 over cap 10.00")
    third = [(T0 + 3000, "auth at watchlisted late for 8.00"), (T0 + 3500, "auth at watchlisted m for 2.67")]
    assert seen == [[], [m, c], [m, c, *third], [m, c, *third, *[(T0 + 3600, "auth at watchlisted late for 7.00")] * 2]]


def test_profiles_on_a_stream(spark, tmp_path):
    rows = [(i, T0 + (37 * i) % 11 * 1000, "auth", i % 3, 0, i / 4, i % 4 > 0, False, 0.0, 0.0, "m", f"C{i}") for i in range(40)]
    rows += [(100, T0 + 20_000, "auth", 7, 0, 1.0, True, False, 0.0, 0.0, "m", "NEW"), (101, T0 + 5, "auth", 7, 0, 2.0, True, False, 0.0, 0.0, "m", "LATE")]
    table, cuts = f"{tmp_path}/p", (0, 20, 40, 41, 42)
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        arrive(spark, tmp_path, rows[lo:hi], EVENT, records.event_json(), "in", i)
        folded = profile.profiles(records.stream_events(spark, f"{tmp_path}/in"))
        folded.writeStream.outputMode("update").foreachBatch(profile_table(table)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        now, want = latest_profiles(spark, table), profile.profiles(spark.createDataFrame(rows[:hi], EVENT))
        assert sorted(map(tuple, now.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        if i == 1:
            compact(spark, table)
            compact(spark, table)
            assert [f for f in os.listdir(table) if f.startswith("batch")] == [] and latest_profiles(spark, table).count() == 3
        if i == 2:  # only the touched card is written, and what is half written doesn't count
            deltas = [f"{table}/{f}" for f in os.listdir(table) if f.startswith("batch")]
            assert [r["card"] for r in spark.read.parquet(*deltas).collect()] == [7]
            os.makedirs(f"{table}/batch=999")
    assert profile.lookup(now, "7")["last_country"] == "NEW"
    states = profile.in_state(spark, f"{tmp_path}/c")
    assert sorted(map(tuple, states.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    for key, card in (("2", 2), (" +2 cards", 2), ("-2", None), ("x2", None), ("", None), ("9" * 30, None)):
        assert (profile.lookup(states, key) or {}).get("card") == card
    assert [r["card"] for r in profile.scan(states, 2)[0]] == [0, 1] and profile.scan(states, 2)[1] and not profile.scan(states, 9)[1]


def test_two_decimals_round_as_c_does(spark):
    rng = random.Random(1)
    xs = [2.675, 0.125, 1.005, 1.115, 8.345, 0.0, -0.125, 0.005, 1e-9, 99.995, 999.995, 0.375, 1e14 + 0.125, 3e15] + [rng.randrange(10**7) / 1000 for _ in range(3000)] + [rng.random() * 10 ** rng.randint(-4, 9) for _ in range(2000)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(two_decimals(F.col("x"))).collect()]
    assert got == [f"{x:.2f}" for x in xs]


@pytest.fixture(scope="module")
def one_profile(spark):
    rows = [(1, T0, 1.2, False, "GB"), (2, T0 + 120_000, 486.31, True, "SG"), (3, T0 + 60_000, 0.8, False, "FR")]
    events = spark.createDataFrame([(i, ts, "auth", 9001, 0, a, ok, False, 0.0, 0.0, "m", c) for i, ts, a, ok, c in rows], EVENT)
    return profile.profiles(events).cache()


def test_profile_of_a_late_event(one_profile):
    p = profile.lookup(one_profile, "9001")
    assert (p["auths"], p["declines"], round(p["total"], 2), p["max_amount"], p["last_ts"], p["last_country"], p["score"], p["first_ts"]) == (3, 2, 488.31, 486.31, T0 + 120_000, "SG", 65, T0)
    assert profile.to_json(p) == f'{{"card":9001,"auths":3,"declines":2,"total":488.31,"max_amount":486.31,"last_ts":{T0 + 120_000},"last_country":"SG","score":65}}'
    assert profile.lookup(one_profile, "424242") is None and profile.lookup(one_profile, "x") is None
    assert profile.scan(one_profile, 5)[1] is False and profile.scan(one_profile, 0) == ([], True)


def test_profile_server(one_profile):
    http = profile.server(one_profile)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"
    assert json.load(urllib.request.urlopen(f"{base}/profile?key=9001"))["score"] == 65
    assert len(json.load(urllib.request.urlopen(f"{base}/scan?limit=5"))["entries"]) == 1
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(f"{base}/profile?key=424242")
    assert e.value.code == 404
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(f"{base}/scan?limit=many")
    assert e.value.code == 400
    http.shutdown()


def test_state_migration(spark):
    v1 = spark.createDataFrame([(7, 6, 492.31, 486.31, 1753920123000, "SG")], PROFILE_V1)
    moved = default_migrations().migrate(profile.STATE_TYPE, v1, 1, 2).first()
    assert tuple(moved) == (7, 6, 492.31, 486.31, 1753920123000, "SG", 1753920123000)
    stored, wanted = {profile.STATE_TYPE: 1}, {profile.STATE_TYPE: profile.VERSION}
    assert check_restore(stored, wanted, default_migrations()) == []
    assert check_restore(stored, wanted, Migrations()) == [Incompatible("cs-risk-profile.profile", 1, 2)]
    with pytest.raises(ValueError):
        default_migrations().migrate(profile.STATE_TYPE, v1.drop("total"), 1, 2)
    chain = Migrations()
    for a, b in ((1, 2), (2, 3), (2, 3)):
        chain.register("t", a, b, lambda df, b=b: df.withColumn(f"v{b}", F.lit(b)))
    assert chain.migrate("t", v1, 1, 3).columns[-2:] == ["v2", "v3"]


def test_checks(spark):
    row = lambda *x: spark.createDataFrame(list(x), "pattern string, entity_kind string, entity_id long")
    a, b = row(("p", "card", 1), ("p", "card", 1), ("q", "card", 2)), row(("p", "card", 1), ("q", "card", 2))
    assert [tuple(r) for r in checks.differences(a, b).collect()] == [("p", "card", 1, 2, 1)]
    assert checks.differences(a, b, only_patterns=["q"]).count() == 0
    assert [r["side"] for r in checks.multiset_difference(a, b).collect()] == ["left"]


def test_store_capture_and_replay(spark, tmp_path):
    batch = spark.createDataFrame([("p", "card", 1, 2, "d")], ALERT)
    store = case_store(f"{tmp_path}/s", "a")
    for number in (0, 1, 1):  # a batch that runs again
        store(batch, number)
    batch.write.parquet(f"{tmp_path}/s/cases/sink=a/batch=9")  # an attempt that never got into the ledger
    assert read_cases(spark, f"{tmp_path}/s").count() == 2
    captured(f"{tmp_path}/c", store)(batch, 4)
    _, same = replay(spark, f"{tmp_path}/c", 4, lambda df: df.filter("entity_id = 1"), batch)
    assert same.count() == 0
    _, differs = replay(spark, f"{tmp_path}/c", 4, lambda df: df.limit(0), batch)
    assert differs.count() == 1
    emit_bundle(spark, f"{tmp_path}/c", 4, lambda df: df, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b/expected").count() == 1


def test_command_line(small_tape, tmp_path, capsys):
    root, _ = small_tape
    assert main([]) == 2 and main(["--in", f"{tmp_path}/none"]) == 2
    assert main(["--in", f"{root}/events", "--rules", f"{root}/rules", "--out", f"{tmp_path}/out"]) == 0
    assert "watchlist_hit: 4" in capsys.readouterr().out

"""The detectors in built-in functions report what the matcher reports."""

import random

import pytest

from vigil.operators import detectors, native
from vigil.operators.cep import FOREVER, detect
from vigil.operators.intervals import reported
from vigil.schema import EVENT
from vigil.sources.tape import tape

T0 = 1_753_920_000_000
MINUTE = 60_000


def plain(df):
    return sorted((r["pattern"], r["entity_kind"], r["entity_id"], r["ts"], r["detail"]) for r in df.collect())


def test_tape(spark):
    events, _, _ = tape(spark, days=3, cards=20, accounts=20)
    events = events.cache()
    want = plain(detect(events, detectors.all_detectors(True), complete_to=FOREVER))
    assert plain(native.all_alerts(events, healthy=True)) == want
    assert len({w[0] for w in want}) == 6


def dense(seed, step):
    """Events close together, some at the same time, with values at the thresholds."""
    rng = random.Random(seed)
    rows, ts = [], T0
    for i in range(1500):
        ts += rng.choice([0, 1, step // 3, step, step, 2 * step])
        if rng.random() < 0.01:
            ts += 40 * step
        who = rng.choice([1, 1, 1, 2, 3])
        if rng.random() < 0.5:
            probe = rng.random() < 0.8
            amount = rng.choice([0.5, 1.0, 2.0, 2.01, 12.5]) if probe else rng.choice([20.0, 249.99, 250.0, 300.0, 600.0])
            city = rng.choice([(51.5, -0.1), (1.35, 103.8), (48.9, 2.35)])
            rows.append((i, ts, "auth", who, 0, amount, not probe, rng.random() < 0.5, *city, "m", "GB"))
        else:
            kind = rng.choice(["login_fail"] * 4 + ["otp_verify", "otp_request", "password_change", "transfer", "transfer"])
            amount = rng.choice([799.99, 800.0, 850.25, 999.99, 1000.0, 1499.99, 1500.0]) if kind == "transfer" else 0.0
            rows.append((i, ts, kind, 0, who, amount, False, False, 0.0, 0.0, "", ""))
    return rows


@pytest.mark.parametrize(("seed", "step"), [(1, 2 * MINUTE), (2, MINUTE // 6), (3, 20 * MINUTE)])
def test_dense_events(spark, seed, step):
    events = spark.createDataFrame(dense(seed, step), EVENT).cache()
    want = plain(detect(events, detectors.all_detectors(True), complete_to=FOREVER))
    assert plain(native.all_alerts(events, healthy=True)) == want
    assert len(want) > 50


@pytest.mark.parametrize("detector", [native.card_testing, native.impossible_travel, native.account_takeover, native.otp_requests, native.structuring])
def test_no_python_worker_and_empty_input(spark, detector):
    out = detector(spark.createDataFrame([], EVENT))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_reported_is_the_greedy_choice(spark):
    """Against a loop over each entity, with chains of many overlapping candidates."""
    rng = random.Random(4)
    rows = []
    for entity, reach, n in ((1, 40, 400), (2, 3, 100), (3, 400, 100), (4, 1, 1)):
        starts = sorted(rng.sample(range(1000), n))
        rows += [(entity, (s, s), (e := s + rng.randint(1, reach), e), f"{s}-{e}") for s in starts]
    df = spark.createDataFrame(rows, "entity long, s struct<ts:long,id:long>, e struct<ts:long,id:long>, note string")
    want = []
    for entity in (1, 2, 3, 4):
        own, last = [r for r in rows if r[0] == entity], (-1, -1)
        while left := [r for r in own if r[1] > last]:
            first = min(left, key=lambda r: (r[2], r[1]))
            want.append((entity, first[3]))
            last = first[2]
    assert sorted((r["entity"], r["note"]) for r in reported(df, 50).collect()) == sorted(want)
    assert sum(e == 1 for e, _ in want) > 16  # more than four rounds of doubling

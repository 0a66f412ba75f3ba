"""Streams with state over several batches: what they give, and what their state store holds in the end."""

import datetime

import pytest
from pyspark.sql import functions as F

from labelloom.streaming import jobs, timed

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def run(spark, tmp_path, batches, schema, job, **kw):
    """job over the batches, one file each, in their order."""
    import os
    import time

    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{i}"))
    for i, name in enumerate(sorted(source.glob("*/*.parquet"))):
        os.utime(name, (time.time() - 1000 + i, time.time() - 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    return jobs.replayed(job(stream), f"file://{tmp_path}/run", **kw, **timed.SETTINGS)


def state(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"file://{tmp_path}/run/state")


ATTEMPTS = "event_id long, key long, ts timestamp, failure boolean, success boolean"


def test_attempts_and_idle_keys(spark, tmp_path):
    fail = lambda e, k, m: (e, k, at(m), True, False)
    batches = [[fail(2, 1, 1), fail(1, 1, 0), fail(3, 2, 2)], [fail(4, 1, 3), (5, 2, at(4), False, True), fail(6, 2, 5)], [fail(7, 3, 100)]]
    out = run(spark, tmp_path, batches, ATTEMPTS, lambda s: timed.limiter(s, 600, 3))
    assert {r.event_id: (r.failures, r.blocked) for r in out.collect()} == {1: (1, False), 2: (2, False), 3: (1, False), 4: (3, True), 6: (1, False), 7: (1, False)}
    left = state(spark, tmp_path, "times").select("key.key").collect()
    assert {r.key for r in left} == {3}  # the others were idle for longer than the window


def test_late_rows_are_dropped(spark, tmp_path):
    fail = lambda e, m: (e, 1, at(m), True, False)
    out = run(spark, tmp_path, [[fail(1, 60)], [fail(2, 61)], [fail(3, 0)]], ATTEMPTS, lambda s: timed.limiter(s, 600, 3))
    assert {r.event_id for r in out.collect()} == {1, 2}


ROWS = "event_id long, identifier_type string, identifier_value string, cached_at timestamp, ttl long"


def test_cached_rows_expire(spark, tmp_path):
    batches = [[(1, "A", "x", at(0), 60), (2, "A", "y", at(0), 6000), (3, "A", "x", at(0), 60)], [(4, "A", "y", at(5), 120)], [(5, "B", "z", at(30), 999)]]
    out = run(spark, tmp_path, batches, ROWS, timed.cache)
    assert sorted((r.event_id, r.expired) for r in out.collect()) == [(2, False), (3, False), (3, True), (4, False), (4, True), (5, False)]
    assert [r.v for r in state(spark, tmp_path, "entry").select(F.col("key.identifier_value").alias("v")).collect()] == ["z"]


def test_rejects_are_never_the_next_state(spark, tmp_path):
    log = [[(1, 1, at(0), "PENDING_REVIEW"), (2, 1, at(1), "RESCAN_REQUESTED")], [(3, 1, at(2), "UNDER_REVIEW"), (4, 1, at(3), "PENDING_REVIEW"), (5, 1, at(4), "VERIFIED_COMPLIANT")]]
    out = run(spark, tmp_path, log, "event_id long, review_id long, ts timestamp, status string", timed.review_workflow, parts={"accepted": "legal", "rejected": "NOT legal"})
    good, bad = (sorted((r.event_id, r.before) for r in out[k].collect()) for k in ("accepted", "rejected"))
    legal = {(a, b) for a, to in timed.MOVES.items() for b in to}
    now, want = None, ([], [])
    for e, _, _, s in sum(log, []):
        fine = now is None or now == s or (now, s) in legal
        want[not fine].append((e, now))
        now = s if fine else now
    assert (good, bad) == want and bad


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_days_of_several_batches(spark, tmp_path, mode):
    rows = [[(at(0), "error"), (at(10), "view")], [(at(20), "error")], [(at(3000), "view")]]
    out = run(spark, tmp_path, rows, "ts timestamp, event_type string", jobs.daily_trend, mode=mode, last=("day",))
    assert sorted((str(r.day), r.n, r.errors) for r in out.collect()) == [("2024-01-01", 3, 2), ("2024-01-03", 1, 0)]

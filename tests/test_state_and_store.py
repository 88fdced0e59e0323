"""Silent sensors as state with timers, a poll store that is not rescanned, and features on two time axes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hydrolith.operators import bitemporal
from hydrolith.sources.store import PollStore
from hydrolith.streaming import live, state

H = 3_600_000_000
SCHEMA = "sensor string, time timestamp, retrieved timestamp, value double"
BASE = dt.datetime(2024, 1, 1)


@pytest.fixture
def watched(spark, tmp_path):
    def put(*rows):
        made = [(s, None if m is None else BASE + dt.timedelta(minutes=m), BASE + dt.timedelta(minutes=(m or 0) + lag), v) for s, m, lag, v in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def run():
        stream = live.file_stream(spark, f"file://{tmp_path}/in", SCHEMA, files_per_poll=1)
        got = live.drain(state.sensor_transitions(stream, 60, "10 minutes", 10), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        minute = lambda t: int((t - BASE).total_seconds() // 60)
        return sorted((r["sensor"], minute(r["at"]), r["state"], minute(r["last_seen"]), r["rows"], r["late"], r["failed"]) for r in got.collect())

    return put, run


def test_a_silent_sensor_goes_stale_over_restarts(watched):
    put, run = watched
    put(("a", 0, 1, 1.0), ("a", 10, 1, 1.0), ("b", 0, 1, 1.0), ("b", 5, 1, float("nan")), ("c", None, 1, 1.0), ("d", 50, -49, 1.0))
    first = run()
    assert first == [("a", 0, "ACTIVE", 0, 1, 0, 0), ("b", 0, "ACTIVE", 0, 1, 0, 1)]  # c has no instant, d lies in the future: neither is seen
    put(("a", 100, 1, 1.0))
    put(("a", 95, 1, 2.0), ("a", 130, 1, 1.0))  # the checkpoint knows a and b; 95 is late, but not behind the watermark
    second = run()
    assert set(second) - set(first) == {("b", 60, "STALE", 0, 1, 0, 1), ("a", 70, "STALE", 10, 2, 0, 0), ("a", 100, "ACTIVE", 100, 3, 0, 0)}
    put(("b", 140, 1, 1.0))
    put(("a", 400, 1, 1.0))
    third = run()
    assert set(third) - set(second) == {("b", 140, "ACTIVE", 140, 2, 0, 1), ("a", 190, "STALE", 130, 5, 1, 0), ("b", 200, "STALE", 140, 2, 0, 1), ("a", 400, "ACTIVE", 400, 6, 1, 0)}
    assert run() == third


KEYED = "k string, t bigint, v double, seen bigint"


def test_a_poll_opens_only_files_that_may_hold_its_keys(spark, tmp_path):
    store = PollStore(spark, f"file://{tmp_path}/s", ["k", "t"], "t", ["v"], buckets=2, fan=4)
    assert store.read(KEYED).count() == 0 and store.vacuum() == 0
    opened, standing = [], {}
    rng = random.Random(1)
    for poll in range(10):
        rows = [(f"s{s}", poll * H + m, float(s), poll) for s in range(20) for m in range(5)]
        for r in rows:
            standing[r[:2]] = r[2]
        if poll:  # one row again, one changed
            rows += [(f"s{rng.randrange(20)}", (poll - 1) * H, None, poll)]
            again = rows[-1][:2]
            rows[-1] = (*again, standing[again], poll)
            k = ("s3", (poll - 1) * H + 1)
            rows.append((*k, 100.0 + poll, poll))
            standing[k] = 100.0 + poll
        got = store.merge(spark.createDataFrame(rows, KEYED), poll, F.col("new.seen") > F.col("old.seen"))
        assert got == {"inserted": 100, "updated": int(poll > 0), "unchanged": int(poll > 0), "conflict": 0, "files": got["files"], "opened": got["opened"]}
        opened.append(got["opened"])
        if poll == 8:
            assert store.compact() >= 8
    assert opened[0] == 0 and max(opened[1:9]) <= 4 and got["files"] < 8  # flat, while 2 files come with each poll
    read = lambda: {(r["k"], r["t"]): r["v"] for r in store.read(KEYED).collect()}
    assert read() == standing
    assert store.vacuum() > 0 and read() == standing
    old = spark.createDataFrame([("s3", 1, 7.0, -1)], KEYED)
    assert store.merge(old, 10, F.col("new.seen") > F.col("old.seen"))["conflict"] == 1 and read() == standing
    row = spark.createDataFrame([("new", 5, 7.0, 11)], KEYED)
    assert store.merge(row, 11)["inserted"] == store.merge(row, 11)["inserted"] == 1 and len(read()) == len(standing) + 1


def known(spark, rows):
    return spark.createDataFrame(rows, "sensor string, t bigint, known bigint, value double, usable boolean, id int")


def test_features_as_they_were_known(spark):
    rng = random.Random(4)
    rows = [(s, t * H, t * H + rng.choice([0, 1, 2, 40]) * H, None if rng.random() < 0.1 else round(rng.uniform(0, 9), 2), rng.random() < 0.8, k) for k, (s, t) in enumerate((rng.choice("ab"), rng.randrange(120)) for _ in range(500))]
    rows.append(("a", None, 5, 1.0, True, 999))
    origins = [(s, t * H, (t + d) * H) for s in "abz" for t in range(0, 125, 3) for d in (0, 50)]
    ask = lambda o, r: {(x["sensor"], x["t"], x["asked"]): x.asDict() for x in bitemporal.as_known(spark.createDataFrame(o, "sensor string, t bigint, asked bigint"), known(spark, r), (180, 600), (60,), 60, wet=3.0, tie="id").collect()}
    got = ask(origins, rows)
    assert len(got) == len(origins)

    def stands(s, t, asked):
        own = [r for r in rows if r[0] == s and r[1] == t and r[2] <= asked]
        best = max(own, key=lambda r: (r[2], r[5]), default=None)
        return (best[3] if best and best[4] else None), len(own) > 1

    for (s, t, asked), r in got.items():
        assert r["known_value"] == stands(s, t, asked)[0] and r["known_lag_60m"] == stands(s, t - H, asked)[0]
        seen = [stands(s, t - k * H, asked) for k in range(10)]
        assert r["revised"] == sum(x for _, x in seen)
        for m in (3, 10):
            v = [x for x, _ in seen[:m] if x is not None]
            good = len(v) >= 0.8 * m
            assert r[f"known_{m * 60}m_coverage"] == pytest.approx(len(v) / m, abs=1e-6)
            assert r[f"known_{m * 60}m_sum"] == (pytest.approx(sum(v)) if good else None) and r[f"known_{m * 60}m_max"] == (max(v) if good else None)
            assert r[f"known_{m * 60}m_wet_count"] == (sum(x > 3 for x in v) if good else None)
    # what is known or corrected later changes no feature of an earlier question
    later = rows + [(s, t * H, 90 * H, 1000.0, True, 2000 + t) for s in "ab" for t in range(90)]
    now = ask([o for o in origins if o[2] < 90 * H], later)
    assert now == {k: v for k, v in got.items() if k[2] < 90 * H}
    assert ask([], rows) == {} and all(v["known_value"] is None for v in ask(origins, []).values())


@pytest.mark.parametrize("block", [None, 300])
def test_the_latest_known_instant(spark, block):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(60) * H, rng.randrange(80) * H, float(k), True, k) for k in range(200)]
    origins = [(s, a * H) for s in "abz" for a in range(-2, 85)]
    got = bitemporal.latest_known(spark.createDataFrame(origins, "sensor string, asked bigint"), known(spark, rows), ["sensor"], ["value"], block_minutes=block)
    for r in got.collect():
        own = [(x[1], x[2], x[3]) for x in rows if x[0] == r["sensor"] and x[2] <= r["asked"]]
        assert r["value"] == (max(own)[2] if own else None)

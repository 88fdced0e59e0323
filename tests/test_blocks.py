"""One-pass windows and runs against loops over rows, with blocks so short that runs, gaps and silence cross them, and their plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolith.operators import blocks, islands, missingness
from hydrolith.plans import catalog, coverage  # noqa: F401

M = 60_000_000


def series(seed, sensors="ab", span=400, share=0.5):
    rng = np.random.default_rng(seed)
    rows = []
    for s in sensors:
        for t in range(span):
            if rng.random() < share and not 100 < t < 180:
                rows.append((s, t * 5 * M, float(np.round(rng.normal(), 3)), bool(rng.random() < 0.6)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "sensor string, t bigint, value double, usable boolean")


def by_sensor(rows):
    for s in sorted({r[0] for r in rows}):
        yield s, sorted(r for r in rows if r[0] == s)


@pytest.mark.parametrize("minutes", [5, 30, 100_000])
def test_runs_with_gaps(spark, minutes):
    rows = series(minutes) + [("one", 7 * M, 1.0, False)]
    got = blocks.runs(
        frame(spark, rows), ["sensor"], blocks.by_time(minutes=minutes), ["t", "usable"], lambda a, b: (a["usable"] == b["usable"]) & (b["t"] - a["upto"] <= 20 * M),
        {"slots": ("sum", lambda s: s["slots"]), "top": ("max", lambda s: s["t"])}, {"n": lambda a, b: F.lit(True), "far": lambda a, b: b["t"] - a["upto"] > 20 * M},
        fill=(lambda a, b: b["t"] - a["upto"] <= 30 * M, 5 * M, {"usable": F.lit(False)}), since=("n", lambda a, b: a.isNull() | (b["t"] - a["upto"] > 20 * M)),
    )
    want = []
    for s, own in by_sensor(rows):
        pieces = []  # (first, last, slots, usable)
        for _, t, _, usable in own:
            if pieces and 5 * M < t - pieces[-1][1] <= 30 * M:
                slots = (t - pieces[-1][1]) // (5 * M) - 1
                pieces.append((pieces[-1][1] + 5 * M, t - 5 * M, slots, False))
            pieces.append((t, t, 1, usable))
        found, far, mark = [], 0, 0
        for p in pieces:
            if found and found[-1]["usable"] == p[3] and p[0] - found[-1]["end"] <= 20 * M:
                found[-1]["end"], found[-1]["slots"] = p[1], found[-1]["slots"] + p[2]
                continue
            jump = bool(found) and p[0] - found[-1]["end"] > 20 * M
            far += jump
            found.append({"usable": p[3], "start": p[0], "end": p[1], "slots": p[2]})
            mark = len(found) if jump or len(found) == 1 else mark
            found[-1] |= {"far": far, "since": mark}
        want += [(s, r["usable"], r["start"], r["end"], r["slots"], k + 1, r["far"], r["since"], k == 0, k == len(found) - 1) for k, r in enumerate(found)]
    rows = got.select("sensor", "first.usable", "first.t", "last.upto", "slots", "n", "far", "since", F.col("before").isNull(), F.col("after").isNull()).collect()
    assert sorted(map(tuple, rows)) == sorted(want)


@pytest.mark.parametrize("minutes", [5, 45])
def test_neighbours_and_running_values(spark, minutes):
    rows = series(1) + [(None, k * M, float(k), True) for k in range(30)]
    got = blocks.chained(frame(spark, rows), ["sensor"], ["t"], blocks.by_time(minutes=minutes), {"p": "value"}, {"n": "value"}, {"total": F.when(F.col("usable"), F.col("value")), "turns": (F.col("p") > F.col("value")).cast("int")})
    for _, g in got.toPandas().groupby("sensor", dropna=False):
        g = g.sort_values("t").reset_index(drop=True)
        assert g["p"].fillna(-9).tolist() == g["value"].shift().fillna(-9).tolist() and g["n"].fillna(-9).tolist() == g["value"].shift(-1).fillna(-9).tolist()
        assert np.allclose(g["total"].fillna(-9), g["value"].where(g["usable"]).fillna(0).cumsum().where(g["usable"].cummax(), -9))
        assert g["turns"].fillna(0).astype(int).tolist() == (g["value"].shift() > g["value"]).cumsum().tolist()


def test_episodes_of_many_blocks(spark, monkeypatch):
    rows = series(9, span=900, share=0.8)
    cut = spark.createDataFrame([(s, n, v) for s in "ab" for n, v in (("LOW", -0.5), ("HIGH", 0.7))], "sensor string, threshold_type string, threshold double")
    key = lambda df: sorted(map(str, df.collect()))
    whole = {}
    for minutes in (100_000, 25):
        monkeypatch.setattr(blocks, "by_time", lambda t="t", m=minutes: F.floor(F.col(t) / (m * M)))
        table = frame(spark, rows)
        found = {
            "episodes": key(islands.episodes(table, cut, 10, 60)), "pairs": key(islands.change_pairs(table, 10)), "runs": key(islands.change_runs(table, 10)),
            "missing": key(islands.missing_runs(table, 5)), "merged": key(islands.merged_windows(table.selectExpr("sensor", "t as a", f"t + {4 * M}L * (1 + abs(hash(t)) % 9) as b"), 2)),
        }
        whole = whole or found
        assert found == whole
    want, sensors = [], dict(by_sensor(rows))
    for s in "ab":
        for name, v in (("LOW", -0.5), ("HIGH", 0.7)):
            last, number = None, 0
            for _, t, x, usable in sensors[s]:
                if usable and x >= v:
                    number += not (last is not None and t - last[0] <= 10 * M and last[1])
                    want.append((s, name, number, t))
                last = (t, usable and x >= v)
    got = islands.episodes(frame(spark, rows), cut, 10, 60).selectExpr("sensor", "threshold_type", "episode", "observations").collect()
    counts = {}
    for s, name, number, _ in want:
        counts[s, name, number] = counts.get((s, name, number), 0) + 1
    assert {(r[0], r[1], r[2]): r[3] for r in got} == counts


def captures(spark):
    rows, rng = [], np.random.default_rng(2)
    for s in "ab":
        for batch, (a, b) in enumerate([(0, 50), (20, 30), (48, 60), (61, 70), (90, 95), (80, 200), (203, 203), (210, 212)]):
            rows += [(s, t * 5 * M, str(batch), bool(rng.random() < 0.7)) for t in range(a, b + 1) if t in (a, b) or rng.random() < 0.6]
    seen = {}
    rows = [seen.setdefault((s, t), (s, t, b, u)) and (s, t, b, seen[s, t][3]) for s, t, b, u in rows]
    return rows, spark.createDataFrame(rows, "sensor string, t bigint, batch string, usable boolean")


@pytest.mark.parametrize("minutes", [25, 1440])
def test_capture_windows_and_runs(spark, monkeypatch, minutes):
    monkeypatch.setattr(blocks, "by_time", lambda t="t", m=minutes: F.floor(F.col(t) / (m * M)))
    rows, table = captures(spark)
    windows, runs = [], []
    for s in "ab":
        state = {t: u for x, t, _, u in rows if x == s}
        spans = sorted((min(t for x, t, c, _ in rows if (x, c) == (s, b)), max(t for x, t, c, _ in rows if (x, c) == (s, b))) for b in {r[2] for r in rows})
        fresh, reached = set(), None
        for a, b in spans:
            if reached is not None and a > reached + 5 * M:
                fresh.add(a)
            reached = max(b, reached or b)
        n, last, slots = 0, None, {}
        for t in sorted(state):
            why = None if last is None else "SEPARATE_CAPTURES" if t in fresh else "GAP_EXCEEDS_MAX_ABSENT" if t - last > 30 * M else None
            n += why is not None
            windows.append((s, t, n, why))
            slots.setdefault(n, []).extend(([(x, False) for x in range(last + 5 * M, t, 5 * M)] if last is not None and why is None else []) + [(t, state[t])])
            last = t
        for w, own in slots.items():
            run, k = -1, 0
            while k < len(own):
                j = k
                while j + 1 < len(own) and own[j + 1][1] == own[k][1]:
                    j += 1
                run += 1
                runs.append((s, w, run, "OBSERVED" if own[k][1] else "MISSING", own[k][0], own[j][0], j - k + 1, k == 0, j == len(own) - 1))
                k = j + 1
    assert sorted(map(tuple, missingness.capture_windows(table, 5, 30).collect()), key=str) == sorted(windows, key=str)
    got = missingness.slot_runs(table, 5, 30).select("sensor", "window", "run", "state", "start_us", "end_us", "slots", "at_start", "at_end")
    assert sorted(map(tuple, got.collect())) == sorted(runs)


@pytest.mark.parametrize("name", ["episodes", "missingness_runs", "change_runs", "missing_runs", "capture_windows", "cadence_windows"])
def test_plans_read_once(spark, name):
    query = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().sparkPlan().toString() + query._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Scan parquet", query._jdf.queryExecution().sparkPlan().toString())) <= 2
    assert len(re.findall(r"\bExchange (?:hash|range|single|round)", query._jdf.queryExecution().executedPlan().toString())) <= 6
    assert "SortMergeJoin" not in plan


def test_nothing_gives_nothing(spark):
    none = frame(spark, [])
    assert islands.missing_runs(none, 5).count() == islands.change_runs(none, 5).count() == islands.observation_windows(none).count() == 0

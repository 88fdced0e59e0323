"""Sensors as keyed state with timers: a sensor that falls silent is reported though nothing comes from it any more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of a transition; the counters are those of the sensor up to it.
TRANSITIONS = "sensor string, state string, at timestamp, last_seen timestamp, rows bigint, late bigint, failed bigint"
_SEEN = "last_us bigint, state string, rows bigint, late bigint, failed bigint"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sensor_watch(stale_minutes: float, ahead_minutes: float) -> StatefulProcessor:
    """ACTIVE when a sensor's row is newer than all before, STALE when none has come for `stale_minutes` after its last.

    State of a sensor: the instant of its newest row, its state, and counters of rows, of rows older than one seen
    (late), and of rows without an instant or a finite value, or more than `ahead_minutes` ahead of their retrieval
    (failed), which touch no other counter and no other sensor. One timer stands at the newest row's deadline. Silence
    between two rows of one batch is found from the rows, so transitions don't depend on how rows fall into batches.

    The class is made here so that it reaches Spark's processes by value, whether they can import this module or not.
    """
    limit, ahead = int(stale_minutes * 60_000_000), int(ahead_minutes * 60_000_000)

    class Watch(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.seen = handle, handle.getValueState("seen", _SEEN)

        def _transitions(self, sensor, found: list[tuple]) -> Iterator[pd.DataFrame]:
            if found:
                state, at, last, rows, late, failed = zip(*found, strict=True)
                when = lambda us: pd.to_datetime(pd.Series(us, dtype="int64"), unit="us")
                yield pd.DataFrame({"sensor": sensor, "state": state, "at": when(at), "last_seen": when(last), "rows": rows, "late": late, "failed": failed})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            last, state, n, late, failed = self.seen.get() if self.seen.exists() else (None, "", 0, 0, 0)
            before, found = last, []
            parts = [(part["time"], part["retrieved"], part["value"]) for part in rows]
            time, retrieved = (pd.concat([p[k] for p in parts]).astype("datetime64[us]") for k in (0, 1))
            value = pd.to_numeric(pd.concat([p[2] for p in parts]), errors="coerce").to_numpy(np.float64)
            t, r = time.to_numpy().astype(np.int64), retrieved.to_numpy().astype(np.int64)
            good = ~time.isna().to_numpy() & np.isfinite(value) & (retrieved.isna().to_numpy() | (t - r <= ahead))
            failed += int((~good).sum())
            for us in np.sort(t[good], kind="stable").tolist():
                n += 1
                if last is not None and us <= last:
                    late += us < last
                    continue
                if last is not None and state == "ACTIVE" and us - last > limit:
                    found.append(("STALE", last + limit, last, n - 1, late, failed))
                    state = "STALE"
                last = us
                if state != "ACTIVE":
                    found.append(("ACTIVE", us, us, n, late, failed))
                    state = "ACTIVE"
            if last != before:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer((last + limit) // 1000 + 1)
            self.seen.update((last, state, n, late, failed))
            yield from self._transitions(key[0], found)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last, state, n, late, failed = self.seen.get()
            if state == "ACTIVE" and expiredTimerInfo.getExpiryTimeInMs() * 1000 > last + limit:
                self.seen.update((last, "STALE", n, late, failed))
                yield from self._transitions(key[0], [("STALE", last + limit, last, n, late, failed)])

        def close(self) -> None:
            pass

    return Watch()


def sensor_transitions(readings: DataFrame, stale_minutes: float = 60, delay: str = "10 minutes", ahead_minutes: float = 10) -> DataFrame:
    """Stream of TRANSITIONS of a stream of readings (sensor string, time timestamp, retrieved timestamp, value).

    Time is that of the readings: a silent sensor is STALE once the watermark, `delay` behind the newest row of all sensors,
    has passed its deadline. Rows behind the watermark are dropped before they are counted. Readings without a sensor are one
    sensor, null. State is kept by sensor in the state store and survives a restart from the checkpoint.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    watch = sensor_watch(stale_minutes, ahead_minutes)
    rows = readings.select("sensor", "time", "retrieved", "value").withWatermark("time", delay)
    return rows.groupBy("sensor").transformWithStateInPandas(watch, TRANSITIONS, "Append", "EventTime")

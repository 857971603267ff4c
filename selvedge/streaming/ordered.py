"""Keyed streams in order of event time: rows wait in state until the watermark has passed them, then are walked in order; what a key keeps goes when it is too old to matter.

State is kept by the RocksDB provider, and only of keys that still have rows waiting or something to remember. Rows behind the watermark are late: they aren't walked.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import rates
from ..operators.service import DONE, SILENT_AFTER

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def provide_state(spark: SparkSession) -> None:
    """Timers and state of several kinds need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Rows (at in microseconds, and `columns`) walked in order of (at, columns) once the watermark has passed them.

    walk(kept, rows) gives output rows and changes what is kept of the key (as JSON); idle(kept, until) gives what closes by that time; due(kept) is when the key has to be looked at next, None where nothing is kept.
    """

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row string")
        self.memory = handle.getValueState("memory", "kept string")

    def walk(self, kept: dict, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def idle(self, kept: dict, until: int) -> list[tuple]:
        return []

    def due(self, kept: dict) -> int | None:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            own = frame[frame["at"] > passed]
            if len(own):
                self.waiting.appendList([(int(at), json.dumps(values)) for at, values in zip(own["at"].tolist(), own[list(self.columns)].values.tolist(), strict=True)])
                self.handle.registerTimer(-(-int(own["at"].min()) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [(int(at), *json.loads(row)) for at, row in (self.waiting.get() if self.waiting.exists() else ())]
        ready = sorted(w for w in waiting if w[0] <= passed)
        rest = [w for w in waiting if w[0] > passed]
        kept = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        out = self.walk(kept, ready) + self.idle(kept, passed)
        if rest:
            self.waiting.put([(at, json.dumps(row)) for at, *row in rest])
        else:
            self.waiting.clear()
        due = [t for t in (min((w[0] for w in rest), default=None), self.due(kept)) if t is not None]
        if self.due(kept) is not None:
            self.memory.update((json.dumps(kept),))
        else:
            self.memory.clear()
        if due:
            self.handle.registerTimer(max(-(-min(due) // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self.names)

    def close(self) -> None:
        pass


class Admission(InOrder):
    """Requests admitted by limits; what is kept are the admitted times of the last day."""

    columns, names = ("event_id",), ["key", "ts", "event_id", "admitted"]

    def __init__(self, per_minute: int, per_day: int):
        self.limits = per_minute, per_day

    def walk(self, kept: dict, rows: list[tuple]) -> list[tuple]:
        times = deque(kept.get("times", ()))
        admitted = rates.admit([at for at, _ in rows], times, *self.limits)
        kept["times"] = list(times)
        return [(at, event_id, ok) for (at, event_id), ok in zip(rows, admitted, strict=True)]

    def idle(self, kept: dict, until: int) -> list[tuple]:
        kept["times"] = [t for t in kept["times"] if t >= until - rates.DAY]
        return []

    def due(self, kept: dict) -> int | None:
        return kept["times"][-1] + rates.DAY + 1000 if kept.get("times") else None


class Sessions(InOrder):
    """Messages of jobs cut into sessions by silence and by DONE (see service.log_sessions)."""

    columns, names = ("ord", "msg"), ["job_id", "started", "ended", "messages", "end"]

    def __init__(self, silence: int):
        self.silence = silence

    def walk(self, kept: dict, rows: list[tuple]) -> list[tuple]:
        out = []
        for at, _, msg in rows:
            out += self.idle(kept, at)
            kept.setdefault("started", at)
            kept["last"], kept["n"] = at, kept.get("n", 0) + 1
            if msg == DONE:
                out.append((kept["started"], at, kept["n"], "done"))
                kept.clear()
        return out

    def idle(self, kept: dict, until: int) -> list[tuple]:
        if not kept or until < kept["last"] + self.silence:
            return []
        out = [(kept["started"], kept["last"], kept["n"], "silent")]
        kept.clear()
        return out

    def due(self, kept: dict) -> int | None:
        return kept["last"] + self.silence if kept else None


def _walked(rows: DataFrame, key: str, processor: InOrder, schema: str, late: str) -> DataFrame:
    provide_state(rows.sparkSession)
    timed = rows.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", late)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName="")


def admission(requests: DataFrame, per_minute: int = rates.PER_MINUTE, per_day: int = rates.PER_DAY, late: str = "1 minute") -> DataFrame:
    """rates.admission() over a stream of requests (key, ts in microseconds, event_id) in any order: a request is decided when the watermark (`late` behind the newest) has passed it, so decisions are those of the batch for all that come in time. A key's state goes a day after its last admitted request."""
    rows = requests.select("key", F.col("ts").alias("at"), "event_id")
    return _walked(rows, "key", Admission(per_minute, per_day), rates.ADMITTED, late)


def log_sessions(messages: DataFrame, silence: int = SILENT_AFTER, late: str = "10 seconds") -> DataFrame:
    """service.log_sessions() over a stream of messages (job_id, at in microseconds, ord, msg): a session comes out when it is DONE or has been silent for so many seconds of event time."""
    rows = messages.select("job_id", "at", "ord", "msg")
    schema = f"{messages.select('job_id').schema.simpleString()[7:-1].replace(':', ' ')}, started long, ended long, messages long, end string"
    return _walked(rows, "job_id", Sessions(silence * MICROS), schema, late)

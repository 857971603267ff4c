"""Limits on requests over sliding time: counts, and admission, where a denied request doesn't count against later ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_MINUTE, PER_DAY = 60, 10_000
MINUTE, DAY = 60_000_000, 86_400_000_000
ADMITTED = "key long, ts long, event_id long, admitted boolean"


def in_window(requests: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """Requests (key, ts in microseconds) with the number of the same key's in the last minute and the last day, bounds and the request itself included."""
    order = Window.partitionBy(key).orderBy(ts)
    return requests.withColumns({"last_minute": F.count("*").over(order.rangeBetween(-MINUTE, 0)), "last_day": F.count("*").over(order.rangeBetween(-DAY, 0))})


def admit(times: list[int], kept: deque, per_minute: int, per_day: int) -> list[bool]:
    """Decisions on requests in order; kept holds the admitted times of the last day and is changed."""
    out = []
    for ts in times:
        while kept and kept[0] < ts - DAY:
            kept.popleft()
        recent = 0
        for t in reversed(kept):
            if t < ts - MINUTE or recent >= per_minute:
                break
            recent += 1
        ok = len(kept) < per_day and recent < per_minute
        if ok:
            kept.append(ts)
        out.append(ok)
    return out


def admission(requests: DataFrame, per_minute: int = PER_MINUTE, per_day: int = PER_DAY) -> DataFrame:
    """Requests (key, ts, event_id) with the decision on each, key by key in order of time. A key's requests are one sequence by definition; they are walked in batches, and only the admitted times of a day are held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, deque()
        for frame in frames:
            admitted: list[bool] = []
            for k, group in frame.groupby("key", sort=False):
                if k != key:
                    key, kept = k, deque()
                admitted += admit(group["ts"].tolist(), kept, per_minute, per_day)
            yield frame.assign(admitted=admitted)[["key", "ts", "event_id", "admitted"]]

    return requests.select("key", "ts", "event_id").repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, ADMITTED)

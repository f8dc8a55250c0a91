"""New products as they arrive, and the detector on growing series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import names as N


def new_products(spark: SparkSession, folder: str, schema: str, name: str = "name", fmt: str = "json") -> DataFrame:
    """A stream of catalogue records with their granule fields; what was read before is known by the query's checkpoint."""
    raw = spark.readStream.schema(schema).format(fmt).load(folder)
    return raw.withColumn("granule", N.granule(F.col(name))).where("granule IS NOT NULL")


def poll(stream: DataFrame, checkpoint: str, alert: Callable[[DataFrame, int], None], since: Column | None = None) -> StreamingQuery:
    """Process what is available and stop; ``alert`` gets each batch of products whose secondary date is after ``since``."""
    wanted = stream.where(F.col("granule.secondary") > since) if since is not None else stream
    return wanted.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(alert).start()


def poll_exit_code(spark: SparkSession, folder: str, schema: str, checkpoint: str, alert: Callable[[DataFrame, int], None], since: Column | None = None) -> int:
    """One poll for a scheduler: 10 where a product came whose secondary date is after ``since``, else 0."""
    seen = []

    def note(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            seen.append(number)
            alert(batch, number)

    poll(new_products(spark, folder, schema), checkpoint, note, since).awaitTermination()
    return 10 if seen else 0


def event_times(events: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events with a watermark: times without zone are taken as the session's zone, which is UTC."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def daily_totals(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", delay: str = "1 day") -> DataFrame:
    """Daily sums by key over a stream; a day is final once the watermark has passed it."""
    return event_times(events, time, delay).groupBy(F.window(time, "1 day"), key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


ALARM_SCHEMA = "series string, alarm boolean, fail_date date, lead_days int, last_observation date, r2 double"
_STATE = "days array<int>, sums array<double>, done boolean"


def detect(series: DataFrame, *, gate: float, window: int = 3, r2_min: float = 0.7, horizon_days: int = 60) -> DataFrame:
    """First alarm of each growing series (``series``, ``epoch`` date, ``cumulative``).

    The state of a series is its epochs; every new one is appended in order of time, and the verdict is that of the batch
    detector on what is known: the run of above-gate rates of one sign that is longest (the latest of equal ones), the first
    window of it that qualifies.  A series that has alarmed is closed.
    """
    zero = np.datetime64("1970-01-01")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, sums, done = state.get if state.exists else ([], [], False)
        known = dict(zip(days, sums, strict=True))
        for pdf in frames:
            for day, value in zip(pdf["epoch"], pdf["cumulative"], strict=True):
                known[int((np.datetime64(day) - zero).astype(int))] = float(value)
        days = sorted(known)
        found = None if done else first_alarm(np.array(days), np.array([known[d] for d in days]), gate, window, r2_min, horizon_days)
        state.update((days, [known[d] for d in days], done or found is not None))
        if found:
            fail, lead, last, r2 = found
            yield pd.DataFrame({"series": [key[0]], "alarm": [True], "fail_date": [pd.Timestamp(zero + fail).date()], "lead_days": [lead], "last_observation": [pd.Timestamp(zero + last).date()], "r2": [r2]})

    return series.groupBy("series").applyInPandasWithState(step, ALARM_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def first_alarm(days: np.ndarray, sums: np.ndarray, gate: float, window: int, r2_min: float, horizon_days: int) -> tuple[int, int, int, float] | None:
    """(failure day, lead, last acquisition, r2) of the first qualifying window, days counted from 1970."""
    if len(days) < window + 1:
        return None
    dt = np.diff(days)
    rate, middle = np.diff(sums) / dt, days[:-1] + dt // 2
    usable = np.flatnonzero(np.abs(rate) > gate)
    if not len(usable):
        return None
    turns = np.flatnonzero(np.diff(rate[usable] > 0)) + 1
    runs = np.split(usable, turns)
    best = max(reversed(runs), key=len)
    for k in range(window, len(best) + 1):
        own = best[k - window : k]
        x, y = (middle[own] - middle[own[0]]).astype(float), 1 / np.abs(rate[own])
        slope, level = np.polyfit(x, y, 1)
        left, total = ((y - slope * x - level) ** 2).sum(), ((y - y.mean()) ** 2).sum()
        r2 = 1 - left / total if total > 0 else 0.0
        if slope >= 0 or r2 < r2_min:
            continue
        fail = int(middle[own[0]] + np.floor(-level / slope))
        last = int(days[own[-1] + 1])
        if 0 < fail - last <= horizon_days:
            return fail, fail - last, last, float(r2)
    return None

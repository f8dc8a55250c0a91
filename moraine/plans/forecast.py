"""From a series to a verdict: cutoff, gates, the longest consistent run, trailing fits, the first alarm or the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import series as V


def forecast(series: DataFrame, keys: list[str], floors: DataFrame, on: list[str], *, window: int = 3, r2_min: float = 0.7, horizon_days: int = 60, multiple: float = 1.0, fallback: float | None = None, day: Column | None = None) -> DataFrame:
    """One row for each series: ``alarm``, ``reason`` and, of an alarm, the fit with its interval.

    ``keys`` name one geometry and component; a series is never mixed with another.
    """
    groups = series.select(*keys).distinct()
    all_rows = V.velocities(series, keys)
    kept, dropped = V.cutoff(all_rows, day) if day is not None else (all_rows, all_rows.limit(0))
    gated = V.gated(kept, floors, on, multiple, fallback)
    run = V.longest_run(gated.where("above"), keys)
    fits = V.fieller(V.window_fits(run, keys, window))
    alarm = V.first_alarm(fits, keys, r2_min, horizon_days).select(*keys, "slope", "r2", "origin", "fail_date", "lead_days", F.col("t1").alias("last_observation"), "ci_bounded", "ci_low", "ci_high")
    counts = all_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("intervals"))
    left = gated.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept_intervals"), F.count_if("above").alias("above_gate"), F.max_by("v", F.abs("v")).alias("fastest"))
    length = run.groupBy(*keys).agg(F.count(F.lit(1)).alias("run_length"))
    lost = dropped.groupBy(*keys).agg(F.count(F.lit(1)).alias("dropped"))
    out = groups
    for part in (counts, left, length, lost, alarm):
        out = out.join(part, keys, "left")
    reason = (
        F.when(F.col("intervals").isNull(), "no intervals").when(F.col("kept_intervals").isNull(), "all intervals post-cutoff")
        .when(F.coalesce("run_length", F.lit(0)) < window, "insufficient velocities above noise floor").when(F.col("slope").isNull(), "no qualifying accelerating trend")
    )
    return out.withColumn("alarm", F.col("slope").isNotNull()).withColumn("reason", reason).na.fill(0, ["intervals", "kept_intervals", "above_gate", "run_length", "dropped"])

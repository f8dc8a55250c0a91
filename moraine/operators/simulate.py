"""Monte-Carlo detectability of accelerating creep by trailing inverse-velocity fits."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISITS = (1, 2, 3, 4, 6, 8, 12, 16, 24)


@dataclass(frozen=True)
class Detector:
    window: int = 3
    r2_min: float = 0.70
    horizon_days: float = 30.0
    fixed_mm_day: float | None = None  # a flat gate; None scales with the noise
    multiple: float = 1.0
    noise_mm: float = 5.0

    def threshold(self, dt: np.ndarray | float) -> np.ndarray | float:
        if self.fixed_mm_day is not None:
            return np.full_like(np.asarray(dt, float), self.fixed_mm_day)
        return self.multiple * 3.0 * self.noise_mm * math.sqrt(2.0) / np.maximum(dt, 1e-9)


def first_alarms(times: np.ndarray, values: np.ndarray, d: Detector) -> tuple[float, float, int]:
    """(day of the first alarm or NaN, predicted failure, windows looked at) of one observed series.

    All trailing windows are fitted at once.  A sample below its own gate (signed velocity) bars its windows; the day is the
    last midpoint, and the predicted day must lie within the horizon after it.
    """
    if len(times) < d.window + 1:
        return math.nan, math.nan, 0
    dt = np.diff(times)
    rate, middle = np.diff(values) / dt, times[:-1] + dt / 2
    slides = np.lib.stride_tricks.sliding_window_view
    t, v = slides(middle, d.window), slides(rate, d.window)
    clear = ~(slides(rate < d.threshold(dt), d.window)).any(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = 1 / v
        tm, ym = t.mean(1, keepdims=True), y.mean(1, keepdims=True)
        slope = ((t - tm) * (y - ym)).sum(1) / ((t - tm) ** 2).sum(1)
        level = ym[:, 0] - slope * tm[:, 0]
        meets = -level / slope
        total = ((y - ym) ** 2).sum(1)
        left = ((y - slope[:, None] * t - level[:, None]) ** 2).sum(1)
        r2 = np.where(total > 0, 1 - left / total, 0.0)
        now = t[:, -1]
        good = clear & (slope < 0) & (meets > now) & (meets <= now + d.horizon_days) & (r2 >= d.r2_min)
    hits = np.flatnonzero(good)
    return (math.nan, math.nan, len(t)) if not len(hits) else (float(now[hits[0]]), float(meets[hits[0]]), int(hits[0]) + 1)


def run_cell(duration: float, revisit: float, creep_mm: float, d: Detector, trials: int, nulls: int, seed: int, lead_in: float = 30.0, wavelength_m: float | None = None, gradient: float = 1.0) -> dict:
    """One cell of the sweep from its own random stream, whatever other cells run.

    Detections divide by the trials that ran, saturations by those with enough samples, false alarms by the null trials that
    ran; what has no denominator is NULL.  An alarm before onset is premature, never a detection.
    """
    rng = np.random.default_rng((seed, int(duration * 1000), int(revisit * 1000)))
    scale = math.log(duration) / creep_mm
    eligible = ran = saturated = premature = 0
    warnings, errors = [], []

    def sampled() -> np.ndarray:
        t = np.arange(-lead_in + rng.uniform(0, revisit), duration, revisit)
        return t[t < duration]

    for _ in range(trials):
        t = sampled()
        if len(t) < d.window + 1:
            continue
        eligible += 1
        truth = np.where(t < 0, 0.0, np.log(duration / (duration - np.clip(t, 0.0, duration - 1e-6))) / scale)
        if wavelength_m:
            lost = np.flatnonzero(np.abs(np.diff(truth)) * gradient > wavelength_m / 4 * 1000)
            if len(lost):
                saturated += 1
                t, truth = t[: lost[0] + 1], truth[: lost[0] + 1]
                if len(t) < d.window + 1:
                    continue
        ran += 1
        day, meets, _ = first_alarms(t, truth + rng.normal(0.0, d.noise_mm, len(t)), d)
        if day < 0:
            premature += 1
        elif day >= 0:
            warnings.append(duration - day)
            errors.append(abs(meets - duration))
    false = null_ran = null_windows = 0
    null_days = 0.0
    for _ in range(nulls):
        t = sampled()
        if len(t) < d.window + 1:
            continue
        null_ran += 1
        null_days += float(t[-1] - t[0])
        day, _, looked = first_alarms(t, rng.normal(0.0, d.noise_mm, len(t)), d)
        null_windows += looked
        false += not math.isnan(day)
    share = lambda a, b: a / b if b else None
    quantile = lambda x, q: float(np.percentile(x, q)) if len(x) else None
    return {
        "precursor_days": duration, "revisit_days": revisit, "n_trials": trials, "n_eligible": eligible, "n_ran": ran, "detection_rate": len(warnings) / ran if ran else 0.0,
        "saturation_rate": share(saturated, eligible), "premature_rate": share(premature, ran), "n_null_ran": null_ran, "false_alarm_rate": share(false, null_ran),
        "far_per_window": share(false, null_windows), "far_per_100d": share(100.0 * false, null_days), "windows_per_trial": share(null_windows, null_ran),
        "warning_median": quantile(warnings, 50), "warning_p25": quantile(warnings, 25), "warning_p75": quantile(warnings, 75), "abs_error_median": quantile(errors, 50),
        "gate_mm_day": round(float(d.threshold(revisit)), 3),
    }


SCHEMA = (
    "precursor_days double, revisit_days double, n_trials int, n_eligible int, n_ran int, detection_rate double, saturation_rate double, premature_rate double, n_null_ran int,"
    " false_alarm_rate double, far_per_window double, far_per_100d double, windows_per_trial double, warning_median double, warning_p25 double, warning_p75 double, abs_error_median double, gate_mm_day double"
)


def sweep(spark: SparkSession, durations: list[float], revisits: list[float] = REVISITS, *, creep_mm: float = 300.0, detector: Detector = Detector(), trials: int = 400, nulls: int = 1000, seed: int = 0, lead_in: float = 30.0, wavelength_m: float | None = None, gradient: float = 1.0) -> DataFrame:
    """Every (duration, revisit) cell as a group of its own."""
    cells = spark.createDataFrame([(float(a), float(b)) for a in durations for b in revisits], "precursor_days double, revisit_days double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([run_cell(a, b, creep_mm, detector, trials, nulls, seed, lead_in, wavelength_m, gradient) for a, b in pdf.itertuples(index=False)])

    return cells.repartition(len(durations) * len(revisits), "precursor_days", "revisit_days").groupBy("precursor_days", "revisit_days").applyInPandas(run, SCHEMA)


def summary(cells: DataFrame) -> DataFrame:
    """Per duration: cells that detect no more than they alarm falsely, the largest revisit that still works at one half, and
    the first one beyond it that doesn't."""
    works = F.col("detection_rate") >= 0.5
    best = cells.groupBy("precursor_days").agg(F.max(F.when(works, F.col("revisit_days"))).alias("largest_working"), F.count_if(F.col("detection_rate") <= F.col("false_alarm_rate")).alias("useless_cells"))
    beyond = cells.join(best, "precursor_days").where(~works & (F.col("revisit_days") > F.col("largest_working"))).groupBy("precursor_days").agg(F.min("revisit_days").alias("collapse_revisit"))
    return best.join(beyond, "precursor_days", "left")


def walk_through(duration: float, revisit: float, detector: Detector = Detector(), creep_mm: float = 300.0, seed: int = 0) -> pd.DataFrame:
    """One trial from twenty days before onset: samples, rates, inverse rates and whether the alarm has gone off."""
    rng = np.random.default_rng(seed)
    t = np.arange(-20.0, duration, revisit)
    truth = np.where(t < 0, 0.0, np.log(duration / (duration - np.clip(t, 0.0, duration - 1e-6))) / (math.log(duration) / creep_mm))
    seen = truth + rng.normal(0.0, detector.noise_mm, len(t))
    day, _, _ = first_alarms(t, seen, detector)
    rate = np.concatenate(([np.nan], np.diff(seen) / np.diff(t)))
    return pd.DataFrame({"day": t, "displacement_mm": seen, "rate_mm_day": rate, "inverse_rate": 1 / rate, "alarmed": t >= (math.inf if math.isnan(day) else day)})

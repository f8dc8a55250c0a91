"""Scalar rules: units, calendars, decision ladders, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SPEED_OF_LIGHT = 299_792_458.0
L_BAND_HZ = 1_257_500_000.0
WAVELENGTH_M = SPEED_OF_LIGHT / L_BAND_HZ
WINTER, MONSOON = (11, 12, 1, 2, 3), (6, 7, 8, 9)
UNUSABLE_SCENE_CLASSES = (0, 1, 3, 8, 9, 10)
PRECURSOR_MM_DAY = 10 / 30


def wavelength(frequencies: Column) -> Column:
    """Wavelength from the first plausible centre frequency of an array; the band's own otherwise."""
    found = F.get(F.filter(frequencies, lambda f: (f > 1e8) & (f < 1e11)), 0)
    return F.coalesce(SPEED_OF_LIGHT / found, F.lit(WAVELENGTH_M))


def displacement_mm(phase: Column, wavelength_m: Column | float = WAVELENGTH_M, flip: bool = False) -> Column:
    """Line-of-sight millimetres of a phase, positive towards the sensor unless flipped."""
    return (1000.0 if flip else -1000.0) * F.lit(wavelength_m) / (4 * math.pi) * phase


def without_ionosphere(phase: Column, screen: Column) -> Column:
    """Phase less its screen; where the screen is unknown it counts as zero.  No-data is decided on the raw phase before."""
    return phase - F.coalesce(F.nanvl(screen, F.lit(None).cast("double")), F.lit(0.0))


def metres_to_mm(x: Column) -> Column:
    return 1000.0 * x


def magnitude(across: Column, along: Column) -> Column:
    return F.hypot(across, along)


def velocity(displacement: Column, span_days: Column) -> Column:
    return F.try_divide(displacement, span_days)


def trend_removed(displacement: Column, elevation_m: Column, slope_mm_km: Column, usable: Column) -> Column:
    """Displacement less its elevation slope; the intercept stays, an unusable fit changes nothing."""
    return F.when(usable, displacement - slope_mm_km * (elevation_m / 1000.0)).otherwise(displacement)


def season(day: Column) -> Column:
    """Half of the year that a pair is filed under."""
    return F.when(F.month(day).isin(*WINTER), "winter").otherwise("summer")


def wet_season(day: Column) -> Column:
    """Monsoon or dry: the season that creep rates are compared over."""
    return F.when(F.month(day).isin(*MONSOON), "monsoon").otherwise("dry")


def bucket(ref: Column, sec: Column, event: Column) -> Column:
    """Folder of a pair: a pair that ends after the event (not on it) is co-event, others go by month and season."""
    return F.when(sec > event, "co_event").otherwise(F.concat_ws("_", F.date_format(ref, "yyyy-MM"), season(ref)))


def covers_pre_event(ref: Column, sec: Column, event: Column, within_days: int = 60) -> Column:
    """The pair ends before the event and begins at most ``within_days`` before it."""
    return (sec < event) & (F.datediff(event, ref) <= within_days)


def mask_digits(mask: Column) -> Column:
    """Water, reference and secondary digit of a mask code."""
    hundred, ten = F.floor(mask / 100), F.floor(mask / 10)
    return F.struct(hundred.cast("int").alias("water"), (ten % 10).cast("int").alias("ref"), (mask % 10).cast("int").alias("sec"))


def on_land(mask: Column) -> Column:
    d = mask_digits(mask)
    return (d["water"] == 0) & (d["ref"] > 0) & (d["sec"] > 0) & (mask != 255)


def snow_index(green: Column, swir: Column) -> Column:
    total = green + swir
    return F.when(total > 0, (green - swir) / F.greatest(total, F.lit(1.0)))


def usable_scene(scene_class: Column) -> Column:
    """Neither no data, defective, shadow nor cloud; snow stays."""
    return ~scene_class.isin(*UNUSABLE_SCENE_CLASSES)


def snow_lost(before: Column, after: Column, was_snow: float = 0.35, drop: float = 0.25) -> Column:
    """Both observed, snow before, and the index fell by more than ``drop``."""
    return before.isNotNull() & after.isNotNull() & (before > was_snow) & (after - before < -drop)


def terrain_reading(slope: Column, aspect: Column, elevation: Column) -> Column:
    """What lost its snow, by where it lies; the order of the rules decides."""
    off_north = F.least(F.abs(aspect), F.abs(aspect - 360))
    return (
        F.when((slope >= 28) & (elevation >= 5000) & (off_north <= 60), "DETACHMENT-like")
        .when(slope < 20, "deposit / flat")
        .when((aspect > 135) & (aspect < 225), "south-facing -> melt")
        .otherwise("ambiguous")
    )


def geometry_verdict(sens_asc: Column, sens_desc: Column, v_asc: Column, v_desc: Column, slope: Column) -> Column:
    """Downslope motion or path delay: which predicted ratio of the two tracks' rates is nearer; a struct with the reason.

    ``undetermined`` is a verdict: ground too gentle, a blind track, hypotheses that predict the same, no ascending rate.
    """
    none = F.lit(None).cast("double")
    motion, ratio = sens_desc / sens_asc, F.try_divide(v_desc, v_asc)
    to_motion, to_delay = F.abs(ratio - motion), F.abs(ratio - 1)
    reason = (
        F.when(slope < 10, "gentle slope")
        .when((F.abs(sens_asc) < 0.25) | (F.abs(sens_desc) < 0.25), "blind track")
        .when(F.abs(motion - 1) < 0.15, "same ratio")
        .when(v_asc == 0, "no ascending rate")
        .when(to_motion < to_delay, "nearer to motion")
        .otherwise("nearer to delay")
    )
    open_ = reason.isin("gentle slope", "blind track", "same ratio", "no ascending rate")
    verdict = F.when(open_, "undetermined").when(reason == "nearer to motion", "motion").otherwise("delay")
    return F.struct(
        verdict.alias("verdict"), reason.alias("reason"), (~open_).alias("conclusive"),
        F.when(~reason.isin("gentle slope", "blind track"), motion).otherwise(none).alias("ratio_motion"),
        F.when(~open_, ratio).otherwise(none).alias("ratio_measured"),
        F.when(verdict == "motion", v_asc / sens_asc).otherwise(none).alias("downslope_rate"),
    )


def precursor_scale(duration: Column, creep_mm: Column) -> Column:
    """A of the accelerating creep whose displacement reaches ``creep_mm`` one day before failure."""
    return F.log(duration) / creep_mm


def precursor_displacement(t: Column, duration: Column, creep_mm: Column) -> Column:
    left = duration - F.least(F.greatest(t, F.lit(0.0)), duration - 1e-6)
    return F.log(duration / left) / precursor_scale(duration, creep_mm)


def precursor_velocity(t: Column, duration: Column, creep_mm: Column) -> Column:
    left = duration - F.least(F.greatest(t, F.lit(0.0)), duration - 1e-6)
    return 1 / (precursor_scale(duration, creep_mm) * left)


def gate_threshold(dt: Column, noise_mm: Column, multiple: float = 1.0, fixed: float | None = None) -> Column:
    """Velocity that a sample must clear: three sigma of a difference over its days, or a fixed rate."""
    return F.lit(fixed) if fixed is not None else multiple * 3.0 * noise_mm * math.sqrt(2.0) / F.greatest(dt, F.lit(1e-9))


def above_gate(rate: Column, gate: Column) -> Column:
    """Strictly above, by absolute value."""
    return F.abs(rate) > gate


def quantised(x: Column) -> Column:
    """[-1, 1] as a byte; what is not finite becomes the midpoint."""
    level = F.bround((x + 1) * 127.5, 0)
    ok = F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))
    return F.when(ok, F.least(F.greatest(level, F.lit(0.0)), F.lit(255.0))).otherwise(F.lit(128.0)).cast("int")


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting: edges count on a half-open range of y, so a vertex is met once."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring[-1:] + ring[:-1], ring, strict=True):
        if y1 != y2:
            meets = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x1 - x2) * (y - y2) / (y1 - y2) + x2)
            crossings = crossings + F.when(meets, 1).otherwise(0)
    return crossings % 2 == 1


def flat_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Distance on a flat earth about the first point."""
    return F.hypot((lat_a - lat_b) * 111.32, (lon_a - lon_b) * 111.32 * F.cos(F.radians(lat_a)))

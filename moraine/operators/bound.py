"""The headline bound: the worst floor over the intervals that could have seen a precursor, against the precursor's rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as R
from ..functions import stats as S


def assess(candidates: DataFrame, offsets: DataFrame, phases: DataFrame, common: DataFrame, sensitivity: DataFrame, event: Column, rate: float = R.PRECURSOR_MM_DAY) -> DataFrame:
    """One row for each candidate, observed or not.

    Offset floors count if usable and from before the event; phase floors if usable; common-datum rates from windows of six
    pixels up.  Each table is reduced to one row a candidate before it is joined, so the joins never fan out.  A candidate
    with no interval keeps its row with NULL numbers: unobserved is not zero.
    """
    ref, sec = N.pair_of_name(F.col("file"))
    early = offsets.where(F.col("usable") & R.covers_pre_event(N.compact_date(ref), N.compact_date(sec), event))
    g = early.groupBy("target_id").agg(F.count(F.lit(1)).alias("intervals"), S.worst(F.col("local_floor_mm_day")).alias("pixel"), S.worst(F.col("block_median_floor_mm_day")).alias("block"))
    p = phases.where("usable").groupBy("target_id").agg(F.count(F.lit(1)).alias("phase_pairs"), S.worst(F.col("local_floor_mm_day")).alias("phase_pixel"), S.worst(F.col("block_median_floor_mm_day")).alias("phase_block"))
    c = common.where("window_px >= 6").groupBy("target_id").agg(F.max(F.abs(S.measured(F.col("target_mm_day_common_ref")))).alias("common_speed"))
    out = candidates.join(sensitivity, "target_id", "left").join(g, "target_id", "left").join(p, "target_id", "left").join(c, "target_id", "left")
    return out.select(
        *candidates.columns, F.round("sensitivity", 3).alias("sensitivity"), F.coalesce("intervals", F.lit(0)).alias("intervals"), F.round("pixel", 2).alias("los_floor_pixel"), F.round("block", 2).alias("los_floor_block"),
        F.round(F.col("pixel") / F.abs("sensitivity"), 1).alias("downslope_bound"), F.round(F.col("pixel") / rate, 1).alias("ratio_pixel"), F.round(F.col("block") / rate, 1).alias("ratio_block"),
        F.round("common_speed", 2).alias("max_speed_common"), F.coalesce("phase_pairs", F.lit(0)).alias("phase_pairs"), F.round("phase_pixel", 2).alias("phase_floor_pixel"), F.round("phase_block", 2).alias("phase_floor_block"),
    )

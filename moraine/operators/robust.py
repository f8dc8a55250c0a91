"""Robust scatter, floors, culls, blocks, windows and datums over long pixel tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from .graph import checkpointed
from .ranks import _beside, exact_percentiles, largest_group


def with_group_median(df: DataFrame, keys: list[str], value: str, name: str = "group_median") -> DataFrame:
    """Each row beside its group's median.  Two passes: the medians are an aggregate joined back, never a window, so a
    large group is aggregated in parts; the join is Spark's choice by the size of the aggregate."""
    medians = df.groupBy(*keys).agg(S.median(S.measured(F.col(value))).alias(name))
    return df.join(medians, keys) if keys else df.crossJoin(medians)


def robust_sigma(df: DataFrame, keys: list[str], value: str, large: bool = False) -> DataFrame:
    """``n``, ``median`` and ``sigma`` (1.4826 median absolute deviations) of the measured values of each group.

    With ``large``, for few groups of any size, medians are found by rank, as ``exact_percentiles`` does.
    """
    if large:
        most = largest_group(df, keys)
        middle = checkpointed(exact_percentiles(df, keys, F.col(value), (0.5,), "_m", largest=most).select(*keys, "n", F.get("_m", 0).alias("median")))
        off = F.abs(S.measured(F.col(value)) - F.col("median"))
        spread = exact_percentiles(_beside(df.select(*keys, value), middle, keys), keys, off, (0.5,), "_s", largest=most).select(*keys, (S.MAD_SCALE * F.get("_s", 0)).alias("sigma"))
        return _beside(middle, spread, keys)
    deviation = F.abs(S.measured(F.col(value)) - F.col("group_median"))
    return with_group_median(df, keys, value).groupBy(*keys).agg(F.count(S.measured(F.col(value))).alias("n"), F.first("group_median").alias("median"), S.sigma_of_deviation(deviation).alias("sigma"))


def detection_floor(df: DataFrame, keys: list[str], value: str, span: Column | str, least: int = S.LEAST_PIXELS) -> DataFrame:
    """``floor``: three sigma per day of span; NULL below ``least`` values or without a positive span."""
    days = F.first(F.col(span) if isinstance(span, str) else span)
    spans = df.groupBy(*keys).agg(days.alias("span_days"))
    out = robust_sigma(df, keys, value).join(spans, keys)
    return out.withColumn("floor", S.at_least(F.col("n"), least, S.floor_rate(F.col("sigma"), F.col("span_days"))))


def percentile_profile(df: DataFrame, keys: list[str], value: str, points: Iterable[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles, extremes, largest magnitude and population deviation of each group."""
    x, points = S.measured(F.col(value)), tuple(points)
    made = df.groupBy(*keys).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.max(F.abs(x)).alias("max_abs"), F.stddev_pop(x).alias("std"), F.avg(x).alias("mean"))
    made = _beside(made, exact_percentiles(df, keys, F.col(value), points, "_p", largest=largest_group(df, keys)), keys)
    return made.select(*keys, "n", *[F.get("_p", i).alias(S.percentile_name(p)) for i, p in enumerate(points)], "low", "high", "max_abs", "std", "mean")


def culled(df: DataFrame, keys: list[str], value: str, sigmas: float = 4.0, least: int = 10, large: bool = False) -> DataFrame:
    """Rows within ``sigmas`` robust sigmas of their group's median; a group of ``least`` or fewer, or without scatter, stays."""
    scale = robust_sigma(df, keys, value, large).select(*keys, F.col("n").alias("_n"), F.col("median").alias("_median"), F.col("sigma").alias("_sigma"))
    joined = df.join(scale, keys)
    keep = (F.col("_n") <= least) | ~F.coalesce(F.col("_sigma") > 0, F.lit(False)) | (F.abs(F.col(value) - F.col("_median")) <= sigmas * F.col("_sigma"))
    return joined.where(keep).drop("_n", "_median", "_sigma")


def gate_chain(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Each row with one Boolean per gate that says whether it is still in after that gate."""
    out, so_far = df, F.lit(True)
    for name, gate in gates.items():
        so_far = so_far & F.coalesce(gate, F.lit(False))
        out = out.withColumn(name, so_far)
    return out


def gate_counts(df: DataFrame, keys: list[str], gates: dict[str, Column]) -> DataFrame:
    """Survivors after each gate, in one pass."""
    total = F.count(F.lit(1)).alias("total")
    return gate_chain(df, gates).groupBy(*keys).agg(total, *[F.count_if(F.col(n)).alias(n) for n in gates])


def coverage(df: DataFrame, keys: list[str], valid: Column, area: Column) -> DataFrame:
    """Valid pixels as percent of the area's and of the frame's pixels: two denominators, both reported."""
    inside = F.count_if(valid & area)
    return df.groupBy(*keys).agg(
        F.count_if(valid).alias("valid_px"), F.count_if(area).alias("aoi_px"), F.count(F.lit(1)).alias("frame_px"),
        S.coverage(inside, F.count_if(area)).alias("aoi_pct"), S.coverage(F.count_if(valid), F.count(F.lit(1))).alias("frame_pct"),
    )


def window(pixels: DataFrame, row: Column | int, col: Column | int, radius: int) -> DataFrame:
    """Pixels of a square window, clipped at the edge, not padded."""
    return pixels.where(F.col("row").between(row - radius, row + radius) & F.col("col").between(col - radius, col + radius))


def window_median(pixels: DataFrame, keys: list[str], value: str, row: int, col: int, radius: int) -> DataFrame:
    x = S.measured(F.col(value))
    return window(pixels, row, col, radius).groupBy(*keys).agg(S.median(x).alias("window_median"), F.count(x).alias("window_px"))


def block_medians(pixels: DataFrame, keys: list[str], value: str, size: int, least: int = 30) -> DataFrame:
    """Median of every whole block of ``size`` x ``size`` pixels that holds min(least, size^2) measured ones.

    Blocks that the grid's edge cuts are left out.
    """
    shape = pixels.groupBy(*keys).agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
    whole = (F.col("block_row") < F.floor(F.col("_rows") / size)) & (F.col("block_col") < F.floor(F.col("_cols") / size))
    blocks = pixels.withColumn("block_row", F.floor(F.col("row") / size)).withColumn("block_col", F.floor(F.col("col") / size))
    blocks = (blocks.join(shape, keys) if keys else blocks.crossJoin(shape)).where(whole)
    x = S.measured(F.col(value))
    return blocks.groupBy(*keys, "block_row", "block_col").agg(S.median(x).alias("block_median"), F.count(x).alias("n")).where(F.col("n") >= min(least, size * size))


def block_median_floor(pixels: DataFrame, keys: list[str], value: str, size: int, span_days: float, least: int = 30) -> DataFrame:
    """Floor of a window median, measured over all blocks of the window's size; NULL from fewer than six blocks."""
    out = robust_sigma(block_medians(pixels, keys, value, size, least), keys, "block_median")
    return out.select(*keys, F.col("n").alias("n_blocks"), S.at_least(F.col("n"), S.LEAST_PIXELS, S.floor_rate(F.col("sigma"), F.lit(span_days))).alias("block_median_floor"))


def window_against_area(pixels: DataFrame, keys: list[str], value: str, row: int, col: int, radius: int, span_days: float) -> DataFrame:
    """Floors of a window and of the whole area, the block floor at the window's size, and their ratio.

    Not usable (numbers NULL) where either has fewer than six measured pixels.
    """
    days = F.lit(span_days)
    area = robust_sigma(pixels, keys, value).select(*keys, F.col("n").alias("aoi_px"), F.col("sigma").alias("_area"))
    inside = window(pixels, row, col, radius)
    own = robust_sigma(inside, keys, value).select(*keys, F.col("n").alias("window_px"), F.col("sigma").alias("_own"))
    sides = inside.agg((F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w")).first()
    size = max(sides["h"] or 0, sides["w"] or 0)
    blocks = block_median_floor(pixels, keys, value, max(size, 1), span_days)
    on = (lambda a, b: a.join(b, keys, "left")) if keys else (lambda a, b: a.crossJoin(b))
    out = on(on(area, own), blocks)
    usable = F.coalesce((F.col("aoi_px") >= S.LEAST_PIXELS) & (F.col("window_px") >= S.LEAST_PIXELS), F.lit(False))
    aoi, local = S.floor_rate(F.col("_area"), days), S.floor_rate(F.col("_own"), days)
    return out.select(
        *keys, "aoi_px", "window_px", usable.alias("usable"), F.when(usable, aoi).alias("aoi_floor"), F.when(usable, local).alias("local_floor"),
        F.when(usable & (aoi > 0), local / aoi).alias("ratio"), F.when(usable, F.col("block_median_floor")).alias("block_median_floor"), F.when(usable, F.col("n_blocks")).alias("n_blocks"),
    )


def bootstrap_floor(pixels: DataFrame, keys: list[str], value: str, span_days: float, resamples: int = 2000, seed: int = 20260909) -> DataFrame:
    """95 % interval of the floor of each group by resampling pixels; NULL below six.

    A group is one window's pixels, so its size is the window's.  Values go in the order of the grid before drawing.
    """

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["row", "col"])[value].to_numpy(float)
        v = v[np.isfinite(v)]
        low = high = None
        if len(v) >= S.LEAST_PIXELS and span_days > 0:
            rng, floors = np.random.default_rng(seed), []
            for _ in range(0, resamples, 100):
                draw = v[rng.integers(0, len(v), (min(100, resamples - len(floors)), len(v)))]
                spread = np.median(np.abs(draw - np.median(draw, axis=1, keepdims=True)), axis=1)
                floors.extend(3 * S.MAD_SCALE * spread / span_days)
            low, high = np.percentile(floors, [2.5, 97.5])
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), len(v), low, high]], columns=[*keys, "n", "floor_low", "floor_high"])

    types = dict(pixels.dtypes)
    return pixels.groupBy(*keys).applyInPandas(interval, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n long", "floor_low double", "floor_high double"]))


def common_pixels(pixels: DataFrame, pair: str, value: str) -> DataFrame:
    """(row, col) measured in every pair: relational division by counts."""
    everything = pixels.agg(F.count_distinct(pair).alias("_pairs"))
    seen = pixels.where(S.finite(F.col(value))).groupBy("row", "col").agg(F.count_distinct(pair).alias("_seen"))
    return seen.join(F.broadcast(everything), F.col("_seen") == F.col("_pairs")).select("row", "col")


def outside_buffers(pixels: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """Pixels farther than ``radius`` cells from every centre.

    Centres are dealt to the coarse cells that their circle touches, so the anti-join is an equi-join on cells.
    """
    size = max(1, 2 * radius)
    touched = centres.select(F.col("row").alias("_r"), F.col("col").alias("_c"))
    for axis, name in (("_r", "_cell_row"), ("_c", "_cell_col")):
        touched = touched.withColumn(name, F.explode(F.sequence(F.floor((F.col(axis) - radius) / size), F.floor((F.col(axis) + radius) / size))))
    near = (F.col("row") - F.col("_r")) ** 2 + (F.col("col") - F.col("_c")) ** 2 <= radius * radius
    own = pixels.withColumn("_own_row", F.floor(F.col("row") / size)).withColumn("_own_col", F.floor(F.col("col") / size))
    return own.join(touched, (F.col("_own_row") == F.col("_cell_row")) & (F.col("_own_col") == F.col("_cell_col")) & near, "left_anti").drop("_own_row", "_own_col")


def datum(pixels: DataFrame, stable: DataFrame, pair: str, value: str, least: int = 200) -> DataFrame:
    """Each pair's median over the stable pixels; NULL from fewer than ``least``."""
    x = S.measured(F.col(value))
    return pixels.join(stable, ["row", "col"], "left_semi").groupBy(pair).agg(F.count(x).alias("stable_px"), S.median(x).alias("_m")).select(pair, "stable_px", S.at_least(F.col("stable_px"), least, F.col("_m")).alias("datum"))


def rereferenced(pixels: DataFrame, stable: DataFrame, pair: str, value: str, least: int = 200) -> DataFrame:
    """Values less their pair's datum."""
    return pixels.join(datum(pixels, stable, pair, value, least), pair).withColumn(value, F.col(value) - F.col("datum"))


def without_scene_median(pixels: DataFrame, epoch: str, value: str) -> DataFrame:
    """Values less their scene's median: the common mode."""
    return with_group_median(pixels, [epoch], value, "_scene").withColumn(value, F.col(value) - F.col("_scene")).drop("_scene")


def layer_summary(rows: DataFrame, layer: str, sigma: str, floor: str) -> DataFrame:
    """Median, least and largest sigma and finite floor of each layer's products."""
    cols = []
    for name in (sigma, floor):
        x = S.measured(F.col(name))
        cols += [S.median(x).alias(f"{name}_median"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]
    return rows.groupBy(layer).agg(F.count(F.lit(1)).alias("n"), *cols)


def dominant_component(pixels: DataFrame, keys: list[str], component: str) -> DataFrame:
    """Most frequent component of each group (the lowest id on a tie) and its share."""
    counts = pixels.where(F.col(component).isNotNull()).groupBy(*keys, component).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(F.col(component).alias("component"), F.col("_n").alias("n")), F.struct(-F.col("_n"), F.col(component))).alias("_b"), F.sum("_n").alias("_all"))
    return best.select(*keys, F.col("_b.component").alias("component"), (F.col("_b.n") / F.col("_all")).alias("fraction"))


def reference_block(pixels: DataFrame, keys: list[str], size: int, valid: Column, area: Column, component_ok: Column, quality: str, levels: tuple[float, ...] = (1.0, 0.8, 0.6, 0.4)) -> DataFrame:
    """Where to reference a scene: of the blocks outside the area whose valid pixels lie in the right component, those of the
    highest level of validity that has any, and of these the one of best mean quality, first in row order on a tie.

    ``reference_kind`` says ``outside`` or, for a group with no such block, ``none``.
    """
    shape = pixels.groupBy(*keys).agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
    on = (lambda a, b, how="inner": a.join(b, keys, how)) if keys else (lambda a, b, how="inner": a.crossJoin(b))
    rows = on(pixels, shape).withColumn("block_row", F.floor(F.col("row") / size)).withColumn("block_col", F.floor(F.col("col") / size))
    rows = rows.where((F.col("block_row") < F.floor(F.col("_rows") / size)) & (F.col("block_col") < F.floor(F.col("_cols") / size)))
    scored = rows.groupBy(*keys, "block_row", "block_col").agg(
        F.avg(valid.cast("int")).alias("share"), F.bool_or(area).alias("inside"), F.bool_and(~valid | component_ok).alias("one"), F.coalesce(F.avg(F.when(valid, F.col(quality))), F.lit(0.0)).alias("score")
    )
    rank = F.lit(None).cast("int")
    for i, level in reversed(list(enumerate(levels))):
        rank = F.when(F.col("share") >= level, i).otherwise(rank)
    good = scored.where(~F.col("inside") & F.col("one") & (F.col("score") > 0)).withColumn("level", rank).where("level IS NOT NULL")
    best = good.groupBy(*keys).agg(F.min_by(F.struct("block_row", "block_col", "level", "score"), F.struct("level", -F.col("score"), "block_row", "block_col")).alias("b"))
    groups = pixels.select(*keys).distinct() if keys else pixels.agg(F.count(F.lit(1)).alias("_n"))
    out = groups.join(best, keys, "left") if keys else groups.crossJoin(best)
    return out.select(*keys, "b.*", F.when(F.col("b").isNull(), "none").otherwise("outside").alias("reference_kind"))


def stack_reference(pixels: DataFrame, product: str, size: int, valid: Column, area: Column, quality: str) -> DataFrame:
    """The block that is wholly valid in every product and outside the area, of the largest summed quality."""
    products = pixels.agg(F.count_distinct(product).alias("_all"))
    blocks = pixels.groupBy(product, F.floor(F.col("row") / size).alias("block_row"), F.floor(F.col("col") / size).alias("block_col")).agg(F.bool_and(valid).alias("full"), F.count(F.lit(1)).alias("px"), F.bool_or(area).alias("inside"), F.avg(quality).alias("q"))
    full = blocks.where(F.col("full") & ~F.col("inside") & (F.col("px") == size * size)).groupBy("block_row", "block_col").agg(F.count(F.lit(1)).alias("_n"), F.sum("q").alias("score"))
    return full.join(F.broadcast(products), F.col("_n") == F.col("_all")).select("block_row", "block_col", "score").orderBy(F.desc("score"), "block_row", "block_col").limit(1)

"""Scene catalogues, look-vector cubes, nearest resampling, noise clusters and the candidate stress test."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as R
from ..functions import stats as S
from .products import one_of_each


def search(features: DataFrame, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Features of a period in order of time (``id``, ``datetime``), the first ``limit`` if one is asked for."""
    found = features.where((F.col("datetime") >= start) & (F.col("datetime") <= end)).orderBy("datetime", "id")
    return found.limit(limit) if limit else found


def by_id(features: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(found, missing): asked ids that the catalogue lacks are reported."""
    asked = features.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return features.join(F.broadcast(asked), "id", "left_semi"), asked.join(features.select("id"), "id", "left_anti")


def newer_than(pairs: DataFrame, day: Column, span_days: int | None = None) -> DataFrame:
    """Pairs whose secondary date is after ``day``, of one temporal baseline if asked."""
    found = pairs.where(F.col("sec") > day)
    return found.where(F.col("span_days") == span_days) if span_days is not None else found


def look_vector_of_cube(cube: DataFrame, x: float, y: float, tolerance: float = 0.02) -> DataFrame:
    """Look vector at the nearest column of a cube (x, y, height, los_x, los_y, incidence): means over height.

    No row where a mean is missing, or where the vertical part that the horizontal ones imply is off the incidence's.
    """
    near = cube.agg(F.min_by("x", F.struct(F.abs(F.col("x") - x), F.col("x"))).alias("nx"), F.min_by("y", F.struct(F.abs(F.col("y") - y), F.col("y"))).alias("ny"))
    own = cube.join(F.broadcast(near), (F.col("x") == F.col("nx")) & (F.col("y") == F.col("ny")))
    mean = own.agg(*[F.avg(S.measured(F.col(c))).alias(c) for c in ("los_x", "los_y", "incidence")])
    up = F.sqrt(F.greatest(1 - F.col("los_x") * F.col("los_x") - F.col("los_y") * F.col("los_y"), F.lit(0.0)))
    return mean.withColumn("los_z", up).where(F.abs(F.col("los_z") - F.cos(F.radians("incidence"))) <= tolerance)


def nearest_resampled(pixels: DataFrame, value: str, rows: int, cols: int, to_rows: int, to_cols: int) -> DataFrame:
    """A grid of ``rows`` x ``cols`` on one of another shape over the same ground: each new cell takes the one it lies in."""
    spark = pixels.sparkSession
    grid = spark.range(to_rows * to_cols).select((F.col("id") / to_cols).cast("int").alias("row"), (F.col("id") % to_cols).cast("int").alias("col"))
    asked = grid.withColumn("_r", F.floor((F.col("row") + 0.5) * rows / to_rows).cast("int")).withColumn("_c", F.floor((F.col("col") + 0.5) * cols / to_cols).cast("int"))
    source = pixels.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value))
    return asked.join(source, ["_r", "_c"], "left").drop("_r", "_c")


def area_statistics(stats: DataFrame, file: str = "file", order: str | None = None) -> DataFrame:
    """Area median by pair and direction from routine products; of a pair's rows the last."""
    g = r"_GUNW_\d+_(\d+)_([AD])_"
    rows = stats.where(~F.contains(file, F.lit("_UR_")) & F.col(file).rlike(g)).withColumn("direction", F.regexp_extract(file, g, 2))
    return one_of_each(rows, ["reference", "secondary"], [F.desc(order or file)]).select("reference", "secondary", F.col("median").cast("double").alias("area_mm"), "direction")


def stress_test(target: DataFrame, area: DataFrame, wavelength_m: float = R.WAVELENGTH_M, repeat_days: float = 12.0) -> DataFrame:
    """Local rates (target minus area) by direction and season with the rate at which phase wraps between passes."""
    joined = target.join(area, (target["ref"] == area["reference"]) & (target["sec"] == area["secondary"]))
    days = F.datediff("sec", "ref")
    g = joined.groupBy("direction", R.wet_season(F.col("ref")).alias("season")).agg(F.count(F.lit(1)).alias("pairs"), F.try_divide(F.sum(F.col("mm") - F.col("area_mm")), F.sum(days)).alias("rate"))
    ceiling = wavelength_m / 4 * 1000 / repeat_days
    return g.withColumn("ceiling", F.lit(ceiling)).withColumn("above_ceiling", F.abs("rate") > ceiling)


def seasonal(rates: DataFrame) -> DataFrame:
    """Per direction, dry season and monsoon rates and whether the monsoon's is below four tenths of the dry season's."""
    of = lambda s: F.max(F.when(F.col("season") == s, F.col("rate")))
    out = rates.groupBy("direction").agg(of("dry").alias("dry"), of("monsoon").alias("monsoon"))
    return out.withColumn("monsoon_weaker", F.abs("monsoon") < 0.4 * F.abs("dry"))


def largest_cluster(mask: np.ndarray) -> int:
    """Size of the largest group of cells that touch by sides, on a small dense mask."""
    left, best = mask.copy(), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if not left[start]:
            continue
        left[start], queue, size = False, deque([start]), 0
        while queue:
            i, j = queue.popleft()
            size += 1
            for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and left[a, b]:
                    left[a, b] = False
                    queue.append((a, b))
        best = max(best, size)
    return best


def noise_clusters(spark: SparkSession, rows: int, cols: int, length: int, trials: int = 20, seed: int = 0) -> DataFrame:
    """Largest three-sigma cluster of noise smoothed over ``length`` cells, trial by trial: each its own group and stream."""
    k = max(3, min(length, min(rows, cols) // 2 or 3))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for trial in pdf["trial"]:
            field = np.random.default_rng((seed, int(trial))).normal(size=(rows, cols))
            kernel = np.zeros((rows, cols))
            kernel[:k, :k] = 1 / (k * k)
            smooth = np.fft.irfft2(np.fft.rfft2(field) * np.fft.rfft2(kernel), (rows, cols))
            spread = smooth.std()
            out.append((trial, largest_cluster(np.abs(smooth) > 3 * spread) if spread > 0 else 0))
        return pd.DataFrame(out, columns=["trial", "n_px"])

    return spark.range(trials).select(F.col("id").alias("trial")).repartition(trials, "trial").groupBy("trial").applyInPandas(run, "trial long, n_px long")


def footprints(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Box of each cluster of cells with lon and lat."""
    return cells.groupBy(*keys).agg(F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.count(F.lit(1)).alias("n_px"))


def running_common(pixels: DataFrame, product: str) -> DataFrame:
    """How many pixels are still valid in all products as products are added in order."""
    w = Window.partitionBy("row", "col").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    order = pixels.select(product).distinct().withColumn("_k", F.row_number().over(Window.orderBy(product)))
    held = pixels.join(F.broadcast(order), product).withColumn("_seen", F.count(F.lit(1)).over(w))
    return held.where(F.col("_seen") == F.col("_k")).groupBy(product).agg(F.count(F.lit(1)).alias("common_px"))


def names_filtered(df: DataFrame, column: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose name holds any of ``include`` (all, if none is given) and none of ``exclude``."""
    out = df.where(N.contains_any(F.col(column), include)) if include else df
    return out.where(~N.contains_any(F.col(column), exclude)) if exclude else out

"""Terrain: slopes, resampling, trends against elevation, impoundments and their ranking, look sensitivities."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import stats as S
from .ranks import exact_percentiles, largest_group
from .robust import robust_sigma
from .graph import checkpointed, flow_accumulation, depressions_filled, receivers, upstream_pairs


def shifted(grid: DataFrame, value: str) -> DataFrame:
    """Each cell beside its eight neighbours' values (``n00`` .. ``n22``); beyond the edge the edge's own value repeats."""
    edge = grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    steps = grid.sparkSession.createDataFrame([(i, j) for i in range(3) for j in range(3)], "i int, j int")
    asked = grid.select("row", "col").crossJoin(F.broadcast(edge)).crossJoin(F.broadcast(steps))
    at = lambda axis, k, low, high: F.least(F.greatest(F.col(axis) + F.col(k) - 1, F.col(low)), F.col(high))
    asked = asked.select("row", "col", "i", "j", at("row", "i", "r0", "r1").alias("_r"), at("col", "j", "c0", "c1").alias("_c"))
    source = grid.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"))
    joined = asked.join(source, ["_r", "_c"])
    return joined.groupBy("row", "col").agg(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("_v"))).alias(f"n{i}{j}") for i in range(3) for j in range(3)])


def slope_aspect(grid: DataFrame, value: str, dx: float, dy: float) -> DataFrame:
    """Slope in degrees and downslope direction (clockwise from north) by Horn's weights; row 0 is the north."""
    n = {(i, j): F.col(f"n{i}{j}") for i in range(3) for j in range(3)}
    east = (n[0, 2] + 2 * n[1, 2] + n[2, 2] - n[0, 0] - 2 * n[1, 0] - n[2, 0]) / (8 * dx)
    north = (n[0, 0] + 2 * n[0, 1] + n[0, 2] - n[2, 0] - 2 * n[2, 1] - n[2, 2]) / (8 * dy)
    return shifted(grid, value).select("row", "col", F.degrees(F.atan(F.hypot(east, north))).alias("slope"), F.pmod(F.degrees(F.atan2(-east, -north)) + 360, F.lit(360.0)).alias("aspect"))


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Values at fractional (x = column, y = row) positions from the four cells around; NULL where one is missing."""
    base = points.withColumn("_c", F.floor(x)).withColumn("_r", F.floor(y)).withColumn("_fx", F.col(x) - F.col("_c")).withColumn("_fy", F.col(y) - F.col("_r"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((F.col("_fy") if i else 1 - F.col("_fy")) * (F.col("_fx") if j else 1 - F.col("_fx"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    asked = base.withColumn("_k", F.explode(corners)).where("_k.w > 0").withColumn("row", F.col("_r") + F.col("_k.i")).withColumn("col", F.col("_c") + F.col("_k.j"))
    got = asked.join(grid.select("row", "col", F.col(value).alias("_v")), ["row", "col"], "left")
    return got.groupBy(*points.columns).agg(F.when(F.count("_v") == F.count(F.lit(1)), F.sum(F.col("_k.w") * F.col("_v"))).alias(value))


def elevation_fit(samples: DataFrame, keys: list[str], elevation_m: str, value: str, clip: float | None = 3.0, passes: int = 2, least: int = 30) -> DataFrame:
    """Displacement against elevation: slope per km, intercept, r, reach of the fit, p; ``usable`` false below ``least``.

    With ``clip``, each pass fits what the pass before left within that many robust sigmas of the residuals' median, which
    are taken over all samples.  A pass is three aggregations over the samples; each leaves one row for a key, which is
    checkpointed, so a plan has one scan, and whether a row is kept is worked out from those rows alone.
    """
    rows = samples.where(S.finite(F.col(elevation_m)) & S.finite(F.col(value))).select(*keys, (F.col(elevation_m) / 1000).alias("e"), F.col(value).alias("d"))

    def beside(df: DataFrame, small: DataFrame) -> DataFrame:
        small = checkpointed(small)
        named = [small[k].alias(f"_k_{k}") for k in keys]
        other = small.select(*named, *[c for c in small.columns if c not in keys])
        if not keys:
            return df.crossJoin(other)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        return df.join(other, same).drop(*[f"_k_{k}" for k in keys])

    keep, most = F.lit(True), largest_group(rows, keys) if clip else 0
    for k in range(passes if clip else 0):
        e, d = F.when(keep, F.col("e")), F.when(keep, F.col("d"))
        line = rows.groupBy(*keys).agg(F.count(e).alias("_n"), F.regr_slope(d, e).alias("s_kept"), F.regr_intercept(d, e).alias("i_kept"), F.regr_slope("d", "e").alias("s_all"), F.regr_intercept("d", "e").alias("i_all"))
        enough = F.col("_n") >= least
        line = line.select(*keys, F.when(enough, F.col("s_kept")).otherwise(F.col("s_all")).alias(f"_s{k}"), F.when(enough, F.col("i_kept")).otherwise(F.col("i_all")).alias(f"_i{k}"), enough.alias(f"_enough{k}"))
        rows = beside(rows, line)
        residual = F.col("d") - F.col(f"_s{k}") * F.col("e") - F.col(f"_i{k}")
        rows = beside(rows, exact_percentiles(rows, keys, residual, (0.5,), "_p", largest=most).select(*keys, F.get("_p", 0).alias(f"_m{k}")))
        deviation = F.abs(residual - F.col(f"_m{k}"))
        rows = beside(rows, exact_percentiles(rows, keys, deviation, (0.5,), "_p", largest=most).select(*keys, (S.MAD_SCALE * F.get("_p", 0)).alias(f"_scale{k}")))
        keep = F.when(F.col(f"_enough{k}") & (F.col(f"_scale{k}") > 0), deviation <= clip * F.col(f"_scale{k}")).otherwise(F.lit(True))
    if clip:
        rows = beside(rows, rows.groupBy(*keys).agg(F.count_if(keep).alias("_kept")))
        keep = keep | (F.col("_kept") < least)
    e, d = F.when(keep, F.col("e")), F.when(keep, F.col("d"))
    fit = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(e).alias("n_used"), F.regr_slope(d, e).alias("slope_mm_per_km"), F.regr_intercept(d, e).alias("intercept_mm"), F.corr(d, e).alias("r"),
        (1000 * (F.max(e) - F.min(e))).alias("elev_range_m"), F.percentile(e, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
    ).withColumn("elev_iqr_m", 1000 * (F.get("_q", 1) - F.get("_q", 0))).drop("_q")
    usable = (F.col("n") >= least) & (F.col("elev_range_m") > 0)
    t = F.abs("r") * F.sqrt((F.col("n_used") - 2) / (1 - F.col("r") * F.col("r")))
    p = F.when((F.abs("r") < 1) & (F.col("n_used") > 2), S.erfc(t / math.sqrt(2.0)))
    own = {"slope_mm_per_km": F.col("slope_mm_per_km"), "intercept_mm": F.col("intercept_mm"), "r": F.col("r"), "variance_explained": F.col("r") * F.col("r"), "p_value": p, "leverage": F.try_divide(F.col("elev_range_m"), F.col("elev_iqr_m"))}
    return fit.withColumns({k: F.when(usable, v) for k, v in own.items()}).withColumn("usable", usable)


def scatter_before_after(samples: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Population deviation and robust sigma of the measured values of two columns: what a correction did to either."""
    out = None
    for name in (before, after):
        x = S.measured(F.col(name))
        std = samples.groupBy(*keys).agg(F.stddev_pop(x).alias(f"{name}_std"))
        mad = robust_sigma(samples, keys, name).select(*keys, F.col("sigma").alias(f"{name}_mad"))
        both = std.join(mad, keys) if keys else std.crossJoin(mad)
        out = both if out is None else out.join(both, keys) if keys else out.crossJoin(both)
    return out


def plane_fit(pixels: DataFrame, keys: list[str], value: str, least: int = 5000, stable: Column | None = None, clip: float | None = 4.0) -> DataFrame:
    """a + b col + c row by the normal equations about the means; NULL where no more than ``least`` pixels are stable.

    Only measured pixels where ``stable`` holds are fitted (ground outside the area, so that no plane is fitted to the
    signal), of them those within ``clip`` robust sigmas of their group's median.
    """
    x, y, z = F.col("col").cast("double"), F.col("row").cast("double"), S.measured(F.col(value))
    ok = pixels.where(S.finite(F.col(value)) & (F.lit(True) if stable is None else F.coalesce(stable, F.lit(False))))
    on = (lambda a, b, how="inner": a.join(b, keys, how)) if keys else (lambda a, b, how="inner": a.crossJoin(b))
    sizes = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("_stable"))
    core = ok
    if clip:
        scale = robust_sigma(ok, keys, value).select(*keys, F.col("median").alias("_median"), F.col("sigma").alias("_sigma"))
        core = on(ok, scale).where(F.abs(F.col(value) - F.col("_median")) <= clip * F.col("_sigma"))
    s = core.groupBy(*keys).agg(
        F.count(z).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"),
        F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    enough = (F.col("_stable") > least) & (det > 0)
    b, c = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    return on(s, sizes).select(*keys, "n", F.when(enough, F.col("mz") - b * F.col("mx") - c * F.col("my")).alias("a"), F.when(enough, b).alias("b"), F.when(enough, c).alias("c"))


def deramped(pixels: DataFrame, fits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values less their group's plane; unchanged where there is none."""
    plane = F.col("a") + F.col("b") * F.col("col") + F.col("c") * F.col("row")
    joined = pixels.join(fits.select(*keys, "a", "b", "c"), keys, "left") if keys else pixels.crossJoin(fits.select("a", "b", "c"))
    return joined.withColumn("ramp", plane).withColumn(value, F.col(value) - F.coalesce("ramp", F.lit(0.0))).drop("a", "b", "c")


def ramp_rms(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.sqrt(F.avg(F.col("ramp") * F.col("ramp"))).alias("ramp_rms"))


def sensitivities(points: DataFrame, least: float = 0.3) -> DataFrame:
    """Points x tracks: how much of a downslope motion each track sees; ``usable`` from ``least`` up."""
    look = G.look_vector(G.heading(F.col("inclination"), F.col("lat"), F.col("ascending")), F.col("incidence"), F.col("left_looking"))
    down = G.downslope_vector(F.col("slope"), F.col("aspect"))
    out = points.crossJoin(F.broadcast(G.tracks(points.sparkSession))).withColumn("sensitivity", G.dot(look, down))
    return out.withColumn("amplification", G.amplification(F.col("sensitivity"))).withColumn("usable", F.abs("sensitivity") >= least)


def sensitivity_coverage(cells: DataFrame, least: float = 0.3, steep: float = 20.0) -> DataFrame:
    """Share of cells that both directions, either, or none of the tracks can see, over all cells and over steep ones."""
    seen = sensitivities(cells, least).groupBy("row", "col", "slope").agg(F.bool_or(F.col("usable") & F.col("ascending")).alias("asc"), F.bool_or(F.col("usable") & ~F.col("ascending")).alias("desc"))
    share = lambda c: F.avg(c.cast("int"))
    either, both = F.col("asc") | F.col("desc"), F.col("asc") & F.col("desc")
    on_steep = F.col("slope") >= steep
    return seen.agg(F.count(F.lit(1)).alias("cells"), share(either).alias("either"), share(both).alias("both"), share(~either).alias("neither"), F.avg(F.when(on_steep, both.cast("int"))).alias("both_steep"), F.avg(F.when(on_steep, (~either).cast("int"))).alias("neither_steep"))


def stencil_sweep(estimates: DataFrame, least: float = 0.3) -> DataFrame:
    """Per point and track, over several slope stencils: least and largest sensitivity and whether the sign holds."""
    return sensitivities(estimates, least).groupBy("point", "track").agg(F.min("sensitivity").alias("low"), F.max("sensitivity").alias("high"), (F.min("sensitivity") * F.max("sensitivity") > 0).alias("sign_holds"))


def impoundments(dem: DataFrame, heights: list[float], dx: float, dy: float, least_cells: int = 40) -> DataFrame:
    """Channel cells with what a dam of each height would hold: a map by height of volume, area, backwater, truncation.

    A site needs three upstream cells and two flooded ones; a lake that meets the grid's edge is truncated.
    """
    filled = depressions_filled(dem)
    flow = receivers(filled, dx, dy)
    cells = filled.where("z IS NOT NULL")
    channel = flow_accumulation(flow, cells).where(F.col("acc") >= least_cells).select("row", "col")
    up = upstream_pairs(flow, cells).join(channel, ["row", "col"], "left_semi")
    z = cells.select(F.col("row").alias("up_row"), F.col("col").alias("up_col"), F.col("z").alias("up_z"))
    sill = cells.select("row", "col", F.col("z").alias("sill"))
    edge = dem.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    rows = up.join(z, ["up_row", "up_col"]).join(sill, ["row", "col"])
    enough = rows.groupBy("row", "col").agg(F.count(F.lit(1)).alias("upstream_cells")).where("upstream_cells >= 3")
    asked = rows.join(enough, ["row", "col"]).withColumn("height", F.explode(F.array(*[F.lit(float(h)) for h in heights])))
    wet = asked.where(F.col("up_z") < F.col("sill") + F.col("height")).crossJoin(F.broadcast(edge))
    area = dx * dy
    lakes = wet.groupBy("row", "col", "sill", "upstream_cells", "height").agg(
        F.count(F.lit(1)).alias("_n"), (F.sum(F.col("sill") + F.col("height") - F.col("up_z")) * area / 1e6).alias("volume_Mm3"), (F.count(F.lit(1)) * area / 1e6).alias("area_km2"),
        (F.hypot((F.max("up_row") - F.min("up_row")) * dy, (F.max("up_col") - F.min("up_col")) * dx) / 1000).alias("backwater_km"),
        F.bool_or(F.col("up_row").isin(0) | (F.col("up_row") == F.col("r0")) | (F.col("up_row") == F.col("r1")) | (F.col("up_col") == F.col("c0")) | (F.col("up_col") == F.col("c1"))).alias("truncated"),
    ).where("_n >= 2")
    response = F.struct("volume_Mm3", "area_km2", "backwater_km", "truncated")
    sites = lakes.groupBy("row", "col", "sill", "upstream_cells").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("height", response.alias("response"))))).alias("by_height"), F.max("volume_Mm3").alias("max_volume_Mm3"),
        F.min("height").alias("threshold_height_m"), F.min_by("volume_Mm3", "height").alias("volume_at_min_height_Mm3"), F.bool_or("truncated").alias("truncated"),
    )
    return sites.withColumn("efficiency_Mm3_per_m", F.col("volume_at_min_height_Mm3") / F.col("threshold_height_m"))


def ranked_sites(sites: DataFrame, by: str = "efficiency") -> DataFrame:
    """Sites in order: least threshold height first, then volume per metre; or by largest volume."""
    order = [F.asc("threshold_height_m"), F.desc("efficiency_Mm3_per_m")] if by == "efficiency" else [F.desc("max_volume_Mm3")]
    return sites.orderBy(*order)


def suppressed(sites: DataFrame, by: str = "efficiency", top: int = 12, least_km: float = 1.5, pool: int = 5000) -> DataFrame:
    """The first ``top`` sites of the order that keep ``least_km`` from every one taken before.

    Taking sites one by one is sequential, so it runs over the first ``pool`` of the order, then over the first ``pool`` of
    those that are far enough from all taken so far, until ``top`` are taken or no site is left.
    """
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    order = [known("threshold_height_m").asc_nulls_last(), known("efficiency_Mm3_per_m").desc_nulls_last()] if by == "efficiency" else [known("max_volume_Mm3").desc_nulls_last()]
    order.append(F.col("_site").asc())
    pool = max(pool, top)
    numbered = checkpointed(sites.withColumn("_site", F.monotonically_increasing_id()))
    kept: list[tuple[int, float, float]] = []

    def near(lat: float, lon: float, taken: list[tuple[int, float, float]]) -> bool:
        return any(math.hypot((lat - y) * 110.57, (lon - x) * 111.32 * math.cos(math.radians(lat))) < least_km for _, y, x in taken)

    left = numbered
    while len(kept) < top:
        block = left.orderBy(*order).limit(pool).select("_site", F.coalesce(F.col("lat").cast("double"), F.lit(math.nan)), F.coalesce(F.col("lon").cast("double"), F.lit(math.nan))).collect()
        for site, lat, lon in block:
            if len(kept) < top and not near(lat, lon, kept):
                kept.append((site, lat, lon))
        if len(block) < pool:
            break
        left = _away(numbered, near, list(kept))
    return numbered.where(F.col("_site").isin([site for site, _, _ in kept])).orderBy(*order).drop("_site")


def _away(sites: DataFrame, near: Callable[..., bool], taken: list[tuple[int, float, float]]) -> DataFrame:
    """Sites that are none of ``taken`` nor near one of them, by the very test that takes them."""
    names = {site for site, _, _ in taken}

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lat, lon = pdf["lat"].astype(float), pdf["lon"].astype(float)
            yield pdf[[s not in names and not near(y, x, taken) for s, y, x in zip(pdf["_site"], lat, lon, strict=True)]]

    return sites.mapInPandas(keep, sites.schema)


def site_rank(sites: DataFrame, by: str = "efficiency", ties: tuple[str, ...] = ()) -> DataFrame:
    """``rank`` of each site in the order of :func:`ranked_sites`, equal ones by the columns ``ties``.

    Sites are dealt by ranges of the order; a site's rank is its place in its range after the ranges before, so no task
    sees all of them.
    """
    order = [F.asc("threshold_height_m"), F.desc("efficiency_Mm3_per_m")] if by == "efficiency" else [F.desc("max_volume_Mm3")]
    order += [F.asc(c) for c in ties]
    dealt = checkpointed(sites.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("rank", (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_own", "_before")


def lag_autocorrelation(pixels: DataFrame, value: str, axis: str, most: int = 60) -> DataFrame:
    """Mean product of values ``lag`` cells apart over the mean square, for each lag up to ``most``."""
    mean = pixels.agg(F.avg(S.measured(F.col(value))).alias("_m"))
    centred = pixels.where(S.finite(F.col(value))).crossJoin(F.broadcast(mean)).select("row", "col", (F.col(value) - F.col("_m")).alias("a"))
    square = centred.agg(F.avg(F.col("a") * F.col("a")).alias("_sq"))
    moved = centred.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(most)))).select("row", "col", "lag", F.col("a").alias("b")).withColumn(axis, F.col(axis) + F.col("lag"))
    pairs = centred.join(moved, ["row", "col"])
    return pairs.groupBy("lag").agg(F.avg(F.col("a") * F.col("b")).alias("_p")).crossJoin(F.broadcast(square)).select("lag", (F.col("_p") / F.col("_sq")).alias("correlation"))


def correlation_length(pixels: DataFrame, value: str, most: int = 60) -> Column | DataFrame:
    """First lag below 1/e, the longer of both axes; ``most`` where it never falls."""
    both = lag_autocorrelation(pixels, value, "row", most).withColumn("axis", F.lit("row")).unionByName(lag_autocorrelation(pixels, value, "col", most).withColumn("axis", F.lit("col")))
    first = both.groupBy("axis").agg(F.coalesce(F.min(F.when(F.col("correlation") < math.exp(-1), F.col("lag"))), F.lit(most)).alias("lag"))
    return first.agg(F.max("lag").alias("lag"))

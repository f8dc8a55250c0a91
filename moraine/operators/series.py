"""Velocities, runs, inverse-velocity fits and verdicts over epoch series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S


def velocities(series: DataFrame, keys: list[str], epoch: str = "epoch", value: str = "cumulative") -> DataFrame:
    """One row for each consecutive pair of epochs: ``t0``, ``t1``, ``days``, ``mid`` (half days dropped) and ``v``.

    Intervals without a positive length are left out.
    """
    w = Window.partitionBy(*keys).orderBy(epoch)
    out = series.select(*keys, F.lag(epoch).over(w).alias("t0"), F.col(epoch).alias("t1"), F.lag(value).over(w).alias("_a"), F.col(value).alias("_b"))
    out = out.withColumn("days", F.datediff("t1", "t0")).where("days > 0")
    return out.select(*keys, "t0", "t1", "days", F.date_add("t0", F.floor(F.col("days") / 2).cast("int")).alias("mid"), ((F.col("_b") - F.col("_a")) / F.col("days")).alias("v"))


def largest_floors(floors: DataFrame, *keys: str) -> DataFrame:
    """Usable floors, the largest of duplicates: what is not a positive number is no floor."""
    x = S.measured(F.col("floor").try_cast("double"))
    return floors.withColumn("floor", x).where("floor > 0").groupBy(*keys).agg(F.max("floor").alias("floor"))


def gated(intervals: DataFrame, floors: DataFrame, on: list[str], multiple: float = 1.0, fallback: float | None = None) -> DataFrame:
    """Intervals with their own pair's gate, the fallback's where it has none (by default the largest known floor).

    ``above`` is strict and by absolute velocity.
    """
    if fallback is None:
        spare = floors.agg(F.max("floor").alias("_spare"))
    else:
        spare = floors.sparkSession.range(1).select(F.lit(float(fallback)).alias("_spare"))
    out = intervals.join(floors, on, "left").crossJoin(F.broadcast(spare))
    out = out.withColumn("gate_is_own", F.col("floor").isNotNull()).withColumn("gate", multiple * F.coalesce("floor", "_spare")).drop("_spare")
    return out.withColumn("above", F.coalesce(F.abs("v") > F.col("gate"), F.lit(False)))


def cutoff(intervals: DataFrame, day: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): an interval that ends on or after the cutoff is dropped, and reported."""
    return intervals.where(F.col("t1") < day), intervals.where(F.col("t1") >= day)


def sign_runs(usable: DataFrame, keys: list[str], order: str = "t0", value: str = "v") -> DataFrame:
    """Rows with ``run``: consecutive rows of one sign share a number."""
    w = Window.partitionBy(*keys).orderBy(order)
    turn = F.when((F.col(value) > 0) == (F.lag(value).over(w) > 0), 0).otherwise(1)
    return usable.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w)).drop("_turn")


def longest_run(usable: DataFrame, keys: list[str], order: str = "t0", value: str = "v") -> DataFrame:
    """Rows of each group's longest run of one sign; of equally long ones the latest."""
    runs = sign_runs(usable, keys, order, value)
    best = runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("run_length")).groupBy(*keys).agg(F.max_by("run", F.struct("run_length", "run")).alias("run"), F.max("run_length").alias("run_length"))
    return runs.join(best, [*keys, "run"])


def window_fits(rows: DataFrame, keys: list[str], size: int = 3) -> DataFrame:
    """Least squares of 1/|v| on days over every full trailing window of ``size`` rows, from its running sums.

    ``origin`` is the window's first midpoint; days count from it, so no large number cancels.  Adds slope, intercept, r2,
    the sums (sxx, x_mean, ss_res) that the interval needs, and the fitted failure in days from the origin.
    """
    w = Window.partitionBy(*keys).orderBy("t0").rowsBetween(-(size - 1), 0)
    points = F.collect_list(F.struct("mid", (1 / F.abs("v")).alias("y"))).over(w)
    out = rows.withColumn("_p", points).where(F.size("_p") == size)
    out = out.withColumn("origin", F.col("_p")[0]["mid"]).withColumn("_xy", F.expr("transform(_p, p -> struct(cast(datediff(p.mid, origin) as double) as x, p.y as y))"))
    total = lambda e: F.aggregate("_xy", F.lit(0.0), e)
    out = out.withColumn("x_mean", total(lambda a, p: a + p["x"]) / size).withColumn("_y_mean", total(lambda a, p: a + p["y"]) / size)
    out = out.withColumn("sxx", total(lambda a, p: a + (p["x"] - F.col("x_mean")) * (p["x"] - F.col("x_mean"))))
    out = out.withColumn("_sxy", total(lambda a, p: a + (p["x"] - F.col("x_mean")) * (p["y"] - F.col("_y_mean"))))
    out = out.withColumn("ss_tot", total(lambda a, p: a + (p["y"] - F.col("_y_mean")) * (p["y"] - F.col("_y_mean"))))
    out = out.withColumn("slope", F.try_divide("_sxy", "sxx")).withColumn("intercept", F.col("_y_mean") - F.col("slope") * F.col("x_mean"))
    residual = lambda p: p["y"] - F.col("slope") * p["x"] - F.col("intercept")
    out = out.withColumn("ss_res", total(lambda a, p: a + residual(p) * residual(p)))
    out = out.withColumn("r2", F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(0.0))
    out = out.withColumn("fail_days", F.when(F.col("slope") != 0, -F.col("intercept") / F.col("slope")))
    return out.withColumn("n", F.lit(size)).drop("_p", "_xy", "_y_mean", "_sxy")


def fieller(fits: DataFrame) -> DataFrame:
    """Exact 95 % interval of the fitted failure, in days from the origin, or ``ci_bounded`` false.

    Values t with |a t + b| within the critical multiple of its error solve a quadratic; if its leading term is not positive
    the slope isn't resolved from zero and no interval is bounded.
    """
    dof = F.col("n") - 2
    tc2 = F.pow(S.t_critical(dof), 2)
    s2 = F.try_divide("ss_res", dof)
    vaa = s2 / F.col("sxx")
    vab = -F.col("x_mean") * vaa
    vbb = s2 / F.col("n") + F.col("x_mean") * F.col("x_mean") * vaa
    a, b = F.col("slope"), F.col("intercept")
    qa, qb, qc = a * a - tc2 * vaa, 2 * (a * b - tc2 * vab), b * b - tc2 * vbb
    out = fits.withColumns({"_qa": qa, "_qb": qb}).withColumn("_disc", F.col("_qb") * F.col("_qb") - 4 * F.col("_qa") * qc)
    bounded = F.coalesce((dof >= 1) & (a != 0) & (F.col("_qa") > 0) & (F.col("_disc") >= 0), F.lit(False))
    root = F.sqrt(F.greatest("_disc", F.lit(0.0)))
    out = out.withColumn("ci_bounded", bounded).withColumn("ci_low", F.when(bounded, (-F.col("_qb") - root) / (2 * F.col("_qa")))).withColumn("ci_high", F.when(bounded, (-F.col("_qb") + root) / (2 * F.col("_qa"))))
    return out.drop("_qa", "_qb", "_disc")


def first_alarm(fits: DataFrame, keys: list[str], r2_min: float = 0.7, horizon_days: int = 60) -> DataFrame:
    """The earliest window whose 1/v falls, fits well and meets zero within the horizon after its last acquisition."""
    out = fits.withColumn("fail_date", F.when(F.abs("fail_days") < 1e6, F.date_add("origin", F.floor("fail_days").cast("int")))).withColumn("lead_days", F.datediff("fail_date", "t1"))
    good = out.where((F.col("slope") < 0) & (F.col("r2") >= r2_min) & (F.col("lead_days") > 0) & (F.col("lead_days") <= horizon_days))
    w = Window.partitionBy(*keys).orderBy("t0")
    return good.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def sign_reversals(rows: DataFrame, track: str, order: str, slope: str, tie: str) -> DataFrame:
    """Reversals and transitions of the slope's sign within each track, one row for each reference date (the first)."""
    first = Window.partitionBy(track, order).orderBy(tie)
    w = Window.partitionBy(track).orderBy(order)
    one = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    sign = F.when(F.col(slope) > 0, "+").otherwise("-")
    moved = one.withColumn("_s", sign).withColumn("_flip", F.coalesce((F.col("_s") != F.lag("_s").over(w)).cast("int"), F.lit(0)))
    return moved.groupBy(track).agg(F.sum("_flip").alias("reversals"), (F.count(F.lit(1)) - 1).alias("transitions"))


def chains(pairs: DataFrame, keys: list[str], ref: str = "ref", sec: str = "sec") -> DataFrame:
    """Rows with ``chain``: a new one starts where a pair does not begin at the end of the one before."""
    w = Window.partitionBy(*keys).orderBy(ref, sec)
    start = F.when(F.lag(sec).over(w) == F.col(ref), 0).otherwise(1)
    return pairs.withColumn("_s", start).withColumn("chain", F.sum("_s").over(w)).drop("_s")


def accumulated(pairs: DataFrame, keys: list[str], value: str, order: tuple[str, ...] = ("ref",)) -> DataFrame:
    """Running displacement of a chain; once a difference is missing, every later epoch is NULL.

    Rows without a place in ``order`` come last; of rows at the same place the largest difference comes first and a
    missing one last, so that the sums do not depend on how the table is stored."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order), F.col(value).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.bool_and(F.col(value).isNotNull()).over(w)
    return pairs.withColumn("cumulative", F.when(whole, F.sum(value).over(w)))


def pixel_velocity(series: DataFrame, keys: list[str], days: str, value: str, epochs: int) -> DataFrame:
    """Rate and its standard error from all epochs of a complete pixel; others are left out."""
    sums = series.groupBy(*keys).agg(F.regr_slope(value, days).alias("velocity"), F.regr_sxx(value, days).alias("_sxx"), F.regr_syy(value, days).alias("_syy"), F.regr_sxy(value, days).alias("_sxy"), F.count(value).alias("n"))
    rest = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    error = F.sqrt(rest / F.greatest(F.col("n") - 2, F.lit(1)) / F.col("_sxx"))
    return sums.where(F.col("n") == epochs).select(*keys, "velocity", error.alias("sigma"), "n")


def significant(fits: DataFrame, keys: list[str], multiple: float = 3.0) -> DataFrame:
    """Counts beyond ``multiple`` own errors, beyond as many robust sigmas of the population, beyond both, and by chance."""
    from .robust import robust_sigma

    scale = robust_sigma(fits, keys, "velocity").select(*keys, F.col("median").alias("_m"), F.col("sigma").alias("_s"))
    joined = fits.join(scale, keys) if keys else fits.crossJoin(scale)
    own, population = F.abs("velocity") > multiple * F.col("sigma"), F.abs(F.col("velocity") - F.col("_m")) > multiple * F.col("_s")
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("own"), F.count_if(population).alias("population"), F.count_if(own & population).alias("both"), (0.0027 * F.count(F.lit(1))).alias("by_chance"))


def downslope(series: DataFrame, sensitivity: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """Series projected downslope: value over sensitivity, weight its square, error over its size; blind tracks are left out."""
    joined = series.join(sensitivity, keys).where(F.abs("sensitivity") >= least)
    out = joined.withColumn("downslope", F.col("cumulative") / F.col("sensitivity")).withColumn("weight", F.col("sensitivity") * F.col("sensitivity"))
    return out.withColumn("error", F.col("error") / F.abs("sensitivity")) if "error" in series.columns else out


def merge_gaps(series: DataFrame, keys: list[str], epoch: str = "epoch") -> DataFrame:
    """Positive gaps in days between consecutive epochs of a merged series."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    return series.withColumn("gap_days", F.datediff(epoch, F.lag(epoch).over(w))).where("gap_days > 0")


def days_from_start(series: DataFrame, keys: list[str], epoch: str = "epoch") -> DataFrame:
    return series.withColumn("days_from_start", F.datediff(epoch, F.min(epoch).over(Window.partitionBy(*keys))))


def last_before(series: DataFrame, keys: list[str], event: Column, epoch: str = "epoch") -> DataFrame:
    """Rows flagged where they are their group's last epoch not after the event."""
    last = F.max(F.when(F.col(epoch) <= event, F.col(epoch))).over(Window.partitionBy(*keys))
    return series.withColumn("last_before_event", F.coalesce(F.col(epoch) == last, F.lit(False)))


def group_rates(joined: DataFrame, keys: list[str], local: str, area: str, days: str, px: str, least_px: int = 20) -> DataFrame:
    """Rate of local minus area displacement over the summed days of each group, from intervals with enough pixels."""
    ok = joined.where(F.col(px) >= least_px)
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col(local) - F.col(area)), F.sum(days)).alias("rate"))

"""Exact percentiles of groups of any size: values are found by their rank, no group's values are held in one place."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from .graph import checkpointed


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, points: tuple[float, ...], name: str = "p", bins: int = 1024, enough: int = 1_000_000, largest: int | None = None) -> DataFrame:
    """``keys``, ``n`` and the array ``name`` of exact percentiles, linear between ranks, of the measured values.

    Groups of up to ``enough`` values are aggregated as they are.  In a larger group every rank asked for has a bracket of
    values, at first the group's range; each pass counts the bracket's values in ``bins`` bins and keeps the bin that holds
    the rank, until it has ``enough`` values or one.  What is shuffled is counts, what is kept is a row for each group and
    rank.  Groups without a measured value have no percentiles (NULL).  A caller that knows the ``largest`` group's size
    spares the pass that counts.
    """
    x = S.measured(value)
    rows = df.select(*keys, x.cast("double").alias("_x"))
    plain = F.percentile("_x", F.array(*map(F.lit, points))).alias(name)
    if largest is not None and largest <= enough:
        return rows.groupBy(*keys).agg(F.count("_x").alias("n"), plain)
    sizes = checkpointed(rows.groupBy(*keys).agg(F.count("_x").alias("n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")))
    if not sizes.where(F.col("n") > enough).limit(1).count():
        return rows.groupBy(*keys).agg(F.count("_x").alias("n"), plain)
    spots = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(points)])
    asked = sizes.where("n > 0").withColumn("_s", F.explode(spots)).select(*keys, "n", "_low", "_high", F.explode(F.array(F.floor("_s.at"), F.ceil("_s.at"))).alias("_rank")).distinct()
    now = checkpointed(asked.select(*keys, "_rank", "_low", "_high", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_held")))
    open_ = (F.col("_held") > enough) & (F.col("_low") < F.col("_high"))
    order = Window.partitionBy(*keys, "_rank")
    while now.where(open_).limit(1).count():
        part = lambda scale: (F.col("_x") * scale - F.col("_low") * scale) / (F.col("_high") * scale - F.col("_low") * scale)
        share = F.when(F.col("_high") - F.col("_low") < F.lit(math.inf), part(1.0)).otherwise(part(0.25))
        place = F.least(F.floor(share * bins), F.lit(bins - 1))
        counts = _within(rows, now.where(open_), keys).groupBy(*keys, "_rank", "_below", place.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_l"), F.max("_x").alias("_h"))
        upto = counts.withColumn("_upto", F.col("_below") + F.sum("_c").over(order.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)))
        hit = upto.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        closer = hit.select(*keys, "_rank", F.col("_l").alias("_low"), F.col("_h").alias("_high"), (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_held"))
        now = checkpointed(closer.unionByName(now.where(~open_)))
    distinct = _within(rows, now.where("_low < _high"), keys).groupBy(*keys, "_rank", "_below", "_x").agg(F.count(F.lit(1)).alias("_c"))
    upto = distinct.withColumn("_upto", F.col("_below") + F.sum("_c").over(order.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    values = upto.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank"))).select(*keys, "_rank", "_x")
    values = values.unionByName(now.where("_low = _high").select(*keys, "_rank", F.col("_low").alias("_x")))
    known = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    out = _beside(sizes, known, keys, "left")
    each = []
    for p in points:
        at = F.lit(p) * (F.col("n") - 1)
        low, high = (F.try_element_at("_at", f(at).cast("long")) for f in (F.floor, F.ceil))
        each.append(low + (high - low) * (at - F.floor(at)))
    return out.select(*keys, "n", F.when(F.col("n") > 0, F.array(*each)).alias(name))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def _beside(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys that takes NULL for a key like any other."""
    if not keys:
        return a.crossJoin(b)
    named = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(named, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), how).drop(*[f"_k_{k}" for k in keys])


def _within(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside every bracket of their group that they lie in."""
    return _beside(rows, brackets, keys).where(F.col("_x").between(F.col("_low"), F.col("_high")))

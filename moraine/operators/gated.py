"""Whole products from their layers: phase and offset datasets joined by cell, gated in order, turned into millimetres."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import stats as S
from . import robust as B
from . import terrain as T

CELL = ["file", "row", "col"]


def layers_joined(first: DataFrame, others: dict[str, DataFrame | None], name: str) -> DataFrame:
    """One row a cell of ``first`` with its value as ``name`` and the other layers' values beside it; a layer that a product
    lacks is a column of NULL."""
    out = first.select(*CELL, S.measured(F.col("value")).alias(name))
    for key, layer in others.items():
        out = out.withColumn(key, F.lit(None).cast("double")) if layer is None else out.join(layer.select(*CELL, S.measured(F.col("value")).alias(key)), CELL, "left")
    return out


def _gated(pixels: DataFrame, gates: dict[str, Column], area: Column | None) -> DataFrame:
    """The gates' Booleans in order, ``quality_valid`` (before the area's cut) and ``valid``."""
    out = B.gate_chain(pixels, gates)
    out = out.withColumn("quality_valid", F.col(list(gates)[-1]))
    inside = F.lit(True) if area is None else F.coalesce(area, F.lit(False))
    return out.withColumn("inside", inside).withColumn("valid", F.col("quality_valid") & F.col("inside"))


def phase_product(
    phase: DataFrame, ionosphere: DataFrame | None = None, coherence: DataFrame | None = None, component: DataFrame | None = None, mask: DataFrame | None = None,
    *, wavelength_m: float = R.WAVELENGTH_M, least_coherence: float = 0.3, area: Column | None = None, flip: bool = False,
) -> DataFrame:
    """Gated line-of-sight displacement of unwrapped phase products, from their layers (``file``, ``row``, ``col``, ``value``).

    Gates, in this order and each only if the product has its layer: finite phase, coherence, a connected component above
    zero, dry land inside a subswath of both acquisitions; then the area.  No data is decided on the raw phase, before the
    ionosphere is taken off; where its screen is unknown it counts as zero.  ``displacement_mm`` is NULL where not ``valid``.
    """
    rows = layers_joined(phase, {"ionosphere": ionosphere, "coherence": coherence, "component": component, "mask": mask}, "phase")
    gates = {"finite": F.col("phase").isNotNull() & (F.col("phase") != 0)}
    if coherence is not None:
        gates["coherent"] = F.col("coherence") >= least_coherence
    if component is not None:
        gates["in_component"] = F.col("component") > 0
    if mask is not None:
        gates["on_land"] = R.on_land(F.col("mask"))
    out = _gated(rows, gates, area)
    value = R.displacement_mm(R.without_ionosphere(F.col("phase"), F.col("ionosphere")), wavelength_m, flip)
    return out.withColumn("raw_mm", value).withColumn("displacement_mm", F.when(F.col("valid"), value))


def offset_product(
    across: DataFrame, along: DataFrame | None = None, correlation: DataFrame | None = None, snr: DataFrame | None = None,
    *, least_correlation: float = 0.3, least_snr: float = 3.0, area: Column | None = None, deramp: bool = True, cull: float | None = 4.0, least_stable: int = 5000,
) -> DataFrame:
    """Gated offsets of one layer of offset products, in millimetres: ``range_mm``, ``azimuth_mm``, ``magnitude_mm``.

    Gates: finite offsets, correlation, signal to noise; then the area.  With ``deramp``, the plane of the stable ground
    outside the area goes from both; with ``cull``, valid offsets that many robust sigmas off the median are NULL.
    """
    rows = layers_joined(across, {"azimuth": along, "correlation": correlation, "snr": snr}, "range")
    finite = F.col("range").isNotNull() if along is None else F.col("range").isNotNull() & F.col("azimuth").isNotNull()
    gates = {"finite": finite}
    if correlation is not None:
        gates["correlated"] = F.col("correlation") >= least_correlation
    if snr is not None:
        gates["above_noise"] = F.col("snr") >= least_snr
    out = _gated(rows, gates, area)
    names = ["range"] + ["azimuth"] * (along is not None)
    for name in names:
        mm = f"{name}_mm"
        out = out.withColumn(mm, R.metres_to_mm(F.col(name)))
        if deramp:
            stable = F.col("quality_valid") & (~F.col("inside") if area is not None else F.lit(True))
            out = T.deramped(out, T.plane_fit(out, ["file"], mm, least_stable, stable), ["file"], mm).withColumnRenamed("ramp", f"{name}_ramp_mm")
    if cull:
        for name in names:
            mm = f"{name}_mm"
            scale = B.robust_sigma(out.where("valid"), ["file"], mm).select("file", F.col("n").alias("_n"), F.col("median").alias("_m"), F.col("sigma").alias("_s"))
            far = (F.col("_n") > 10) & (F.col("_s") > 0) & (F.abs(F.col(mm) - F.col("_m")) > cull * F.col("_s"))
            out = out.join(scale, "file", "left").withColumn("valid", F.col("valid") & ~F.coalesce(far, F.lit(False))).drop("_n", "_m", "_s")
    out = out.withColumns({f"{n}_mm": F.when(F.col("valid"), F.col(f"{n}_mm")) for n in names})
    return out.withColumn("magnitude_mm", R.magnitude(F.col("range_mm"), F.col("azimuth_mm"))) if along is not None else out


def gate_report(product: DataFrame, gates: list[str]) -> DataFrame:
    """Pixels left after each gate and in the area, per file."""
    return product.groupBy("file").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(g)).alias(g) for g in (*gates, "valid")])


def stats_with_exports(stats: DataFrame, exports: DataFrame, keys: tuple[str, ...] = ("file", "layer")) -> DataFrame:
    """Each statistics row beside what was exported of its layer; the export's columns win where both have one, and rows
    without an export keep NULL."""
    shared = [k for k in keys if k in stats.columns and k in exports.columns]
    again = [c for c in exports.columns if c in stats.columns and c not in shared]
    other = exports.select(*shared, F.lit(True).alias("_exported"), *[F.col(c).alias(f"_x_{c}") if c in again else F.col(c) for c in exports.columns if c not in shared])
    out = stats.join(other, shared, "left")
    out = reduce(lambda d, c: d.withColumn(c, F.when(F.col("_exported"), F.col(f"_x_{c}")).otherwise(F.col(c))).drop(f"_x_{c}"), again, out)
    return out.drop("_exported")

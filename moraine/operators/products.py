"""Product rows: duplicates, consistency, pair tables, acquisition reports, optical composites and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as R
from ..functions import stats as S


def one_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order: the one policy behind every ``first wins`` and ``last wins``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def resolve_duplicates(stats: DataFrame, geometry: list[str], pair: list[str], value: str, processing: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of products of one acquisition pair.

    Kept is the value whose size is nearest the median size of the other pairs of its geometry; routine wins a tie.  The
    median leaves out the pair in question: it stands in the geometry's order of sizes, that pair's places passed over.
    """
    keys = [*geometry, *pair]
    many = stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    known = stats.where(F.col(value).isNotNull()).select(*keys, F.abs(value).alias("_size"))
    known = known.withColumn("_rank", F.row_number().over(Window.partitionBy(*geometry).orderBy("_size")))
    totals = known.groupBy(*geometry).agg(F.count(F.lit(1)).alias("_all"))
    own = known.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_rank")))
    counts = many.join(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_own")), keys, "left").join(totals, geometry).na.fill(0, ["_own"])
    others = F.col("_all") - F.col("_own")
    wanted = counts.where(others > 0).withColumn("_t", F.explode(F.array_distinct(F.array(F.floor((others + 1) / 2), F.floor(others / 2) + 1))))
    # the t-th of the others has the pair's own members before it whose rank among the others is below t
    passed = F.count_if(F.col("_rank") - F.col("_place") < F.col("_t"))
    places = wanted.join(own.select(*keys, "_rank", "_place"), keys, "left").groupBy(*keys, "_t").agg((F.first("_t") + passed).alias("_rank"))
    expected = places.join(known.select(*geometry, "_rank", "_size"), [*geometry, "_rank"]).groupBy(*keys).agg(F.avg("_size").alias("_expect"))
    joined = stats.join(many.select(*keys, "_n"), keys, "left").join(expected, keys, "left")
    distance = F.abs(F.abs(value) - F.coalesce("_expect", F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy(distance.asc_nulls_last(), (F.col(processing) != "PR").cast("int"), F.col(value))
    ranked = joined.withColumn("_k", F.row_number().over(w)).withColumn("_best", F.first(value).over(w))
    kept = ranked.where("_k = 1").select(*stats.columns)
    dropped = ranked.where("_k > 1").select(*stats.columns, F.abs(F.col(value) - F.col("_best")).alias("gap"))
    return kept, dropped


def consistency(stats: DataFrame, pair: list[str], value: str, fringe: Column) -> DataFrame:
    """Verdict on each pair processed more than once: fewer than two measured products can't be compared."""
    g = stats.groupBy(*pair).agg(F.count(F.lit(1)).alias("products"), F.count(value).alias("measured"), (F.max(value) - F.min(value)).alias("spread"), F.first(fringe).alias("_fringe")).where("products > 1")
    fringes = F.col("spread") / F.col("_fringe")
    whole = F.bround(fringes, 0)
    verdict = F.when(F.col("measured") < 2, "not comparable").when((F.abs(fringes - whole) < 0.25) & (whole >= 1), "unwrapping ambiguity").when(F.col("spread") > 0.5 * F.col("_fringe"), "large, no whole fringe").otherwise("consistent")
    return g.select(*pair, "products", "measured", F.when(F.col("measured") >= 2, F.col("spread")).alias("spread"), F.when(F.col("measured") >= 2, fringes).alias("fringes"), verdict.alias("verdict"))


def normalised_stats(stats: DataFrame) -> DataFrame:
    """Both readers' columns under one name each."""
    have = set(stats.columns)
    names = {"value": ("median", "range_median_mm"), "quality": ("mean_coherence", "mean_correlation"), "coverage_pct": ("aoi_pct", "valid_pct")}
    return stats.withColumns({k: F.coalesce(*[F.col(c).cast("double") for c in cs if c in have], F.lit(None).cast("double")) for k, cs in names.items()})


def pairs_of_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Pair rows from granule names; other names give none."""
    g = names.select(F.col(column).alias("source"), N.granule(F.col(column)).alias("g")).where("g IS NOT NULL")
    return g.select("source", F.when(F.col("g.direction") == "A", "ASC").otherwise("DESC").alias("direction"), F.col("g.path").cast("int").alias("path"), F.col("g.processing").alias("processing"), F.col("g.product").alias("product"), F.col("g.reference").alias("ref"), F.col("g.secondary").alias("sec"), F.col("g.span_days").alias("span_days"))


def acquisitions(pairs: DataFrame, event: Column) -> DataFrame:
    """One row: pairs, spans, latest acquisition, days before the event, and whether any pair spans it."""
    spans = (F.col("ref") <= event) & (F.col("sec") > event)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.min("ref").alias("first"), F.max("sec").alias("latest"), F.min("span_days").alias("shortest"), F.min(F.when(F.col("sec") <= event, F.datediff(event, "sec"))).alias("days_before_event"), (~F.coalesce(F.bool_or(spans), F.lit(False))).alias("co_event_missing"))


def sampling_gap(dates: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Typical gap between distinct dates: the upper median, never interpolated."""
    w = Window.partitionBy(*keys).orderBy(day)
    gaps = dates.select(*keys, day).distinct().withColumn("gap", F.datediff(day, F.lag(day).over(w))).where("gap IS NOT NULL")
    return gaps.groupBy(*keys).agg(S.upper_median(F.col("gap")).alias("gap_days"))


def bucket_counts(records: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return records.groupBy(row).pivot(column, values).count().na.fill(0)


def chunks_united(chunks: list[DataFrame], key: str, chunk_no: str = "chunk") -> DataFrame:
    """Chunks of a catalogue as one, the last row of each key; schemas may differ."""
    marked = [c.withColumn(chunk_no, F.lit(i)) for i, c in enumerate(chunks)]
    return one_of_each(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked), [key], [F.desc(chunk_no)])


def log_targets(lines: DataFrame, column: str = "value", order: str = "line_no") -> DataFrame:
    """Measurement lines of a text log; of each pair the first."""
    part = lambda i: F.regexp_extract(column, N.TARGET_LINE, i)
    rows = lines.where(F.col(column).rlike(N.TARGET_LINE)).select(order, F.to_date(part(1)).alias("ref"), F.to_date(part(2)).alias("sec"), part(3).cast("double").alias("mm"), part(4).cast("int").alias("px"), part(5).cast("double").alias("coherence"))
    return one_of_each(rows, ["ref", "sec"], [F.asc(order)])


def as_floors(local: DataFrame, layer: str) -> DataFrame:
    """Local floors under the pair keys of the gate; more than one target is an error, not a mixture."""
    if local.select("target_id").distinct().limit(2).count() > 1:
        raise ValueError("floors of more than one target cannot serve as one gate")
    ref, sec = N.pair_of_name(F.col("file"))
    return local.where("usable").select(ref.alias("reference"), sec.alias("secondary"), F.lit(layer).alias("layer"), F.col("local_floor_mm_day").alias("detect_floor_mm_day"))


def newest_clear(scenes: DataFrame, cell: list[str], day: str, value: str, ok: Column) -> DataFrame:
    """Per cell, the value of the latest scene in which it was clear; NULL where none was."""
    return scenes.groupBy(*cell).agg(F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col(day))).alias(value), F.max(F.when(ok, F.col(day))).alias(day))


def cloud_percent(pixels: DataFrame, scene: str, scene_class: str) -> DataFrame:
    return pixels.groupBy(scene).agg((100 * F.avg((~R.usable_scene(F.col(scene_class))).cast("int"))).alias("cloud_pct"))


def cluster_measures(cells: DataFrame, keys: list[str], change: str, before: str, cell_km2: float = 4e-4) -> DataFrame:
    """Size, centres (plain and weighted by change), extent and change of each cluster of (row, col) cells."""
    weight = F.abs(change)
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_px"), (F.count(F.lit(1)) * cell_km2).alias("area_km2"), F.avg("row").alias("row_centre"), F.avg("col").alias("col_centre"),
        F.try_divide(F.sum(weight * F.col("row")), F.sum(weight)).alias("row_weighted"), F.try_divide(F.sum(weight * F.col("col")), F.sum(weight)).alias("col_weighted"),
        (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"), S.median(F.col(change)).alias("change_median"), F.min(change).alias("change_min"),
        (100 * F.avg((F.col(before) > 0.4).cast("int"))).alias("was_snow_pct"),
    )


def probed(cells: DataFrame, row: int, col: int, radius: int, change: str, before: str) -> DataFrame:
    """What was seen around a point; nothing seen is ``observed`` false, not zero change."""
    near = cells.where(F.col("row").between(row - radius, row + radius) & F.col("col").between(col - radius, col + radius))
    x = S.measured(F.col(change))
    out = near.agg(F.count(x).alias("n"), S.median(x).alias("median"), F.min(x).alias("low"), (100 * F.avg(F.when(x.isNotNull(), (F.col(before) > 0.4).cast("int")))).alias("was_snow_pct"), (100 * F.avg((x < -0.35).cast("int"))).alias("dropped_pct"))
    return out.withColumn("observed", F.col("n") > 0)


def footprint_overlap(boxes: DataFrame, name: str, geometry: str) -> DataFrame:
    """Pairs of boxes of different geometries that overlap in both axes (lon0, lon1, lat0, lat1); boxes are few and ranked."""
    other = boxes.select(*[F.col(c).alias(f"_{c}") for c in boxes.columns])
    meet = (F.col(geometry) < F.col(f"_{geometry}")) & (F.col("lon0") <= F.col("_lon1")) & (F.col("_lon0") <= F.col("lon1")) & (F.col("lat0") <= F.col("_lat1")) & (F.col("_lat0") <= F.col("lat1"))
    return boxes.join(other, meet).select(F.col(name).alias("a"), F.col(f"_{name}").alias("b"))


def on_lattice(points: DataFrame, x0: float, y1: float, step: float, width: int, height: int) -> DataFrame:
    """Points with the row and column of a north-up lattice; outside ones are left out."""
    out = points.withColumn("col", F.floor((F.col("x") - x0) / step).cast("int")).withColumn("row", F.floor((y1 - F.col("y")) / step).cast("int"))
    return out.where(F.col("col").between(0, width - 1) & F.col("row").between(0, height - 1))


def aligned(xs: DataFrame, x0: float, step: float, most: float = 0.01) -> bool:
    """Whether every coordinate lies within ``most`` of a cell of the lattice: what doesn't is refused, not resampled."""
    off = F.abs((F.col("x") - x0) / step - F.bround((F.col("x") - x0) / step, 0))
    worst = xs.agg(F.max(off).alias("w")).first()["w"]
    return worst is None or worst <= most


def nearest(coordinates: DataFrame, index: str, x: str, target: Column | float) -> DataFrame:
    """Index of the coordinate nearest a target, the first on a tie."""
    return coordinates.agg(F.min_by(index, F.struct(F.abs(F.col(x) - target), F.col(index))).alias(index))


def dataset_matches(catalogue: DataFrame, patterns: list[str], dims: int | None = None) -> DataFrame:
    """The best dataset path that holds all patterns: frequency A, then co-polarised, then the shortest path."""
    lower = F.lower("path")
    keep = reduce(lambda a, b: a & b, [F.contains(lower, F.lit(p.lower())) for p in patterns])
    if dims is not None:
        keep = keep & (F.size("shape") == dims)
    order = [F.when(F.contains(lower, F.lit("frequencya")), 0).otherwise(1), F.when(lower.rlike("/(hh|vv)/"), 0).otherwise(1), F.length("path"), F.col("path")]
    return catalogue.where(keep).orderBy(*order).limit(1)


def sibling(catalogue: DataFrame, path: str, name: str) -> DataFrame:
    """A dataset of a name beside ``path``, else in the group above, of the same shape."""
    own = catalogue.where(F.col("path") == path).select(F.col("shape").alias("_shape"))
    parent = path.rsplit("/", 1)[0]
    places = [f"{parent}/{name}", f"{parent.rsplit('/', 1)[0]}/{name}"]
    found = catalogue.where(F.col("path").isin(places)).join(own, F.col("shape") == F.col("_shape")).drop("_shape")
    return found.orderBy(F.when(F.col("path") == places[0], 0).otherwise(1)).limit(1)


def layers(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(F.regexp_extract("path", r"^(.*/pixelOffsets/[^/]+/layer\d+)/", 1).alias("layer")).where("layer <> ''").distinct().orderBy("layer")


def selected_layer(found: DataFrame, wanted: str | int) -> DataFrame:
    """``best``: all layers; a number or suffix: that one, or the first of all where none matches."""
    if wanted == "best":
        return found
    suffix = f"layer{wanted}" if isinstance(wanted, int) else wanted
    match = found.where(F.endswith("layer", F.lit(suffix)))
    return found.orderBy(F.when(F.endswith("layer", F.lit(suffix)), 0).otherwise(1), "layer").limit(1) if not isinstance(match, str) else match


def split_verified(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable): bad files are reported, never silently dropped."""
    return files.where("ok"), files.where("NOT ok")

"""Tables, logs and product folders as DataFrames, and the sinks that write results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N

SERIES_SCHEMA = "geometry string, component int, epoch date, days_from_start int, cumulative_mm double, error_mm double"
LOCAL_FLOOR_COLUMNS = ("target_id", "file", "usable", "window_px", "local_floor_mm_day", "block_median_floor_mm_day", "span_days")
EXCLUDED_FOLDERS = (".git", ".venv", "venv", "__pycache__", "node_modules", "site-packages", ".cache")


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A headed CSV; with a schema columns are matched by name, so files of older layouts can be united by name."""
    plain = spark.read.option("header", True).option("nanValue", "nan").csv(path)
    if schema is None:
        return plain
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    have = set(plain.columns)
    return plain.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])


def series_table(spark: SparkSession, path: str) -> DataFrame:
    """A series file, typed; an empty error is NULL."""
    return csv_table(spark, path, SERIES_SCHEMA)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text log with line numbers in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return lines


def products(spark: SparkSession, root: str, pattern: str = "NISAR_*", strict: bool = True) -> DataFrame:
    """Product files below a folder, once each: path, name, size; caches and environments are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).drop("content")
    inside = ~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in EXCLUDED_FOLDERS) + ")/")
    out = files.where(inside).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).dropDuplicates(["path"])
    return out.where(F.col("name").rlike("^" + N.GRANULE)) if strict else out


def still_to_fetch(wanted: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """Records whose file is not there yet; empty files count as absent."""
    return wanted.join(present.where("bytes > 0"), name, "left_anti")


# ---- sinks ----


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, digits: int | None = None) -> None:
    """One headed CSV folder; by default all columns in sorted order, or the named ones and no others."""
    names = columns or sorted(df.columns)
    kinds = dict(df.dtypes)
    cells = [F.round(n, digits).alias(n) if digits is not None and kinds[n] == "double" else F.col(n) for n in names]
    df.select(*cells).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_pixels(pixels: DataFrame, path: str, by: tuple[str, ...] = ("pair",), clip: Column | None = None) -> None:
    """A pixel table as Parquet in folders by pair, sorted by row and column so that readers can skip; values as floats."""
    rows = pixels.where(clip) if clip is not None else pixels
    rows = rows.select(*[F.col(c).cast("float").alias(c) if t == "double" and c not in ("x", "y") else F.col(c) for c, t in rows.dtypes])
    rows.repartition(*by).sortWithinPartitions(*by, "row", "col").write.mode("overwrite").partitionBy(*by).parquet(path)


def geojson(sites: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row with a FeatureCollection; maps keep their keys as text.  For ranked results, which are few."""
    properties = F.struct(*[F.col(c) for c in sites.columns if c not in (lon, lat)])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return sites.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("document"))


def json_document(blocks: dict[str, DataFrame]) -> str:
    """Named small tables as one JSON document."""
    import json

    return json.dumps({name: [json.loads(x) for x in df.toJSON().collect()] for name, df in blocks.items()}, ensure_ascii=False)


def file_plan(records: DataFrame, event: Column, filed: DataFrame | None = None) -> DataFrame:
    """Where each product belongs (product and bucket) and what is not filed yet: a plan, which moves nothing."""
    from ..functions import rules as R

    g = records.select("path", "name", "bytes", N.granule(F.col("name")).alias("g")).where("g IS NOT NULL")
    plan = g.select("path", "name", "bytes", F.col("g.product").alias("product"), R.bucket(F.col("g.reference"), F.col("g.secondary"), event).alias("bucket"))
    return plan.join(filed, ["name", "product", "bucket"], "left_anti") if filed is not None else plan


def write_manifest(plan: DataFrame, path: str) -> None:
    plan.write.mode("overwrite").partitionBy("product", "bucket").parquet(path)

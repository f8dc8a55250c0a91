"""Tables of a data folder, and the views of them that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unmeasured(df: DataFrame, *columns: str) -> DataFrame:
    """NaN as NULL: one mark for what was not measured."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in columns})


def raster(embeddings: DataFrame) -> DataFrame:
    """Vectors as a long pixel table: one row of the grid for each vector, one layer for each label."""
    return embeddings.select(F.col("vec_id").cast("int").alias("row"), F.col("label").alias("layer"), F.posexplode("embedding").alias("col", "value")).withColumn("value", F.col("value").cast("double"))


def daily_series(events: DataFrame) -> DataFrame:
    """Events as a series: the day's total by type counts as cumulative displacement at that epoch."""
    return events.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("epoch")).agg(F.round(F.sum("value"), 6).alias("cumulative"))

"""Heights of points from a service that answers batches, and tables kept under the name of what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import shared_folder


def heights_at(points: DataFrame, ask: Callable[[list[tuple[float, float]]], list[float | None]], batch: int = 100) -> DataFrame:
    """``points`` (``lat``, ``lon``) with ``z``; ``ask`` answers at most ``batch`` of them a call, in their order.

    Each task asks for its own rows, each distinct place once a batch; an answer of another length is an error.
    """

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            places = list(dict.fromkeys(zip(pdf["lat"], pdf["lon"], strict=True)))
            known: dict = {}
            for a in range(0, len(places), batch):
                part = places[a : a + batch]
                answer = ask(part)
                if len(answer) != len(part):
                    raise RuntimeError(f"{len(answer)} heights for {len(part)} points")
                known.update(zip(part, answer, strict=True))
            yield pdf.assign(z=[known[p] for p in zip(pdf["lat"], pdf["lon"], strict=True)])

    return points.mapInPandas(fill, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields), "z double"]))


def kept(spark: SparkSession, key: dict, make: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """The table made for ``key``: read where it was written before, else made, written and read.

    The folder is the shared one unless given.  A table counts as written once its commit marker stands.
    """
    name = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/kept/{name}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

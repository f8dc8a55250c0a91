"""Runs of equal keys in sorted Arrow batches, and bounded tiles of the rows that share a key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables made of whole runs of an integer ``key`` and the runs' boundaries (first row of each, then the row count).

    Batches must be sorted by ``key``.  Only the run that is still open is carried from batch to batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        same = bool(held) and held[-1].column(key)[held[-1].num_rows - 1].as_py() == keys[0]
        if same and not len(change):
            held.append(batch)
            continue
        last = int(change[-1]) if len(change) else 0
        ready = [*held, batch.slice(0, last)] if last else held
        if ready:
            yield _with_bounds(pa.Table.from_batches(ready), key)
        held = [batch.slice(last)]
    if held:
        yield _with_bounds(pa.Table.from_batches(held), key)


def _with_bounds(table: pa.Table, key: str) -> tuple[pa.Table, np.ndarray]:
    table = table.combine_chunks()
    keys = table.column(key).to_numpy()
    return table, np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def tiled(df: DataFrame, key: str, row: str, tile: int, weight: str | None = None, weight_tile: int = 1 << 62) -> DataFrame:
    """Deal the rows of each ``key`` into tiles so that every two rows of a key meet in exactly one pair of tiles.

    A key with more than ``tile`` rows (or more than ``weight_tile`` in the sum of ``weight``) is cut into t tiles by a
    hash of ``row``; each of its rows goes to t of the t(t+1)/2 tile pairs.  No task gets more than two tiles of a key.
    Adds ``cell`` (long: one value for each key and tile pair), ``tile_a``, ``tile_b`` and ``tile_own``.
    """
    total = F.sum(weight).cast("double") if weight else F.lit(0.0)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"), total.alias("key_weight"))
    hot = sizes.where((F.col("key_rows") > tile) | (F.col("key_weight") > weight_tile)).select(
        F.col(key).alias("hot_key"), F.ceil(F.greatest(F.col("key_rows") / tile, F.col("key_weight") / float(weight_tile))).cast("int").alias("hot_tiles")
    )
    dealt = df.join(hot, df[key] == hot["hot_key"], "left").drop("hot_key")
    dealt = dealt.withColumn("hot_tiles", F.coalesce("hot_tiles", F.lit(1)))
    dealt = dealt.withColumn("tile_own", F.pmod(F.xxhash64(row, F.lit(7)), F.col("hot_tiles")).cast("int"))
    dealt = dealt.withColumn("tile_other", F.explode(F.sequence(F.lit(0), F.col("hot_tiles") - 1)))
    dealt = dealt.withColumn("tile_a", F.least("tile_own", "tile_other")).withColumn("tile_b", F.greatest("tile_own", "tile_other"))
    return dealt.withColumn("cell", F.xxhash64(key, "tile_a", "tile_b")).drop("hot_tiles", "tile_other")


def together(df: DataFrame, key: str = "cell", *order: str) -> DataFrame:
    """Rows of a key side by side in one partition, for :func:`whole_groups`."""
    return df.repartition(key).sortWithinPartitions(key, *order)

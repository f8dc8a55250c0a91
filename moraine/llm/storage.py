"""Where operators keep tables and files that every executor must be able to read."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

#: Tables of the shared folder, where it is local: Hadoop starts a process to set the mode of each file, of its checksum file and
#: of each folder, and until that runs its own program the JVM's pages seem to be there twice.  So no checksum files; Parquet's
#: own checksums of pages are verified instead.  Other file systems ignore the first two options.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one is set only where that is unset."""
    place = spark.conf.get(CHECKPOINT_SETTING, None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="moraine-")
        spark.conf.set(CHECKPOINT_SETTING, place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/moraine/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, within: int | None = None, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors.

    ``within`` is a bound on its bytes, as :func:`size_of` a table it came from gives: see :func:`in_few_files`.
    """
    path = new_path(df.sparkSession, name)
    in_few_files(df, within).write.options(**PLAIN_FILES).parquet(path, compression=codec)
    return df.sparkSession.read.options(**VERIFIED).schema(df.schema).parquet(path)


def size_of(table: DataFrame) -> int:
    """Bytes of the files of a written table."""
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        total += where.getFileSystem(conf).getContentSummary(where).getLength()
    return total


def in_few_files(df: DataFrame, within: int | None, file_mb: int = 64) -> DataFrame:
    """``df`` in as many partitions as ``within`` bytes ask for, two for each core at least; as it is without a bound.

    Rounds over slim tables else write a tiny file for every shuffle partition, and open them all again.
    """
    if within is None:
        return df
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, within // (file_mb << 20) + 1))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path written by :func:`written` or :func:`new_path`."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of an iteration: each new one lets the one before the last go."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def put(self, df: DataFrame, within: int | None = None) -> DataFrame:
        path = new_path(self.spark, self.name)
        in_few_files(df, within).write.options(**PLAIN_FILES).parquet(path)
        self.paths.append(path)
        return self.spark.read.options(**VERIFIED).schema(df.schema).parquet(path)

    def keep_last(self) -> None:
        while len(self.paths) > 1:
            drop_path(self.spark, self.paths.pop(0))


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` while tables are written: whole documents in larger ones fill an executor's memory."""
    before = spark.conf.get(BATCH_SETTING)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def light_bounds(texts: pa.Array, rows: int, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of slices of at most ``rows`` values and ``size`` bytes; a longer value has a slice of its own.

    Working memory follows the bytes at hand, so a batch of very long texts needs no more than one of short ones.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        upto = min(max(upto, at + 1), at + rows, len(ends))
        yield at, upto
        at = upto


def light_slices(batch: pa.RecordBatch, column: str, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` as :func:`light_bounds` cuts its ``column``."""
    for a, b in light_bounds(batch.column(column), rows, size):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers are kept for later tasks, their heaps with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)

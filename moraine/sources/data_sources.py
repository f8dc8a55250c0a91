"""Python data sources: HDF5 catalogues and pixels, GeoTIFF bands, JSON catalogues over HTTP.

``register(spark)`` makes them known as ``h5catalog``, ``h5pixels``, ``rasterband`` and ``restcatalog``.  A partition is a
file, a dataset's block of rows or a year of a catalogue, so reads spread over executors.  h5py and rasterio are imported in
the readers; without them a read fails with their ImportError and nothing else is affected.
"""

from __future__ import annotations

import glob
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _files(options: dict) -> list[str]:
    path = options.get("path") or ""
    return sorted({f for p in path.split(",") for f in glob.glob(p, recursive=True)})


class _FileReader(DataSourceReader):
    """One partition for each file."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.options)]


class H5Catalog(DataSource):
    """Every dataset of HDF5 files: file, path, shape, type."""

    @classmethod
    def name(cls) -> str:
        return "h5catalog"

    def schema(self) -> str:
        return "file string, path string, shape array<int>, dtype string"

    def reader(self, schema) -> DataSourceReader:
        return _H5CatalogReader(self.options)


class _H5CatalogReader(_FileReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import h5py

        found: list[tuple] = []
        with h5py.File(partition.value, "r") as f:
            f.visititems(lambda path, item: found.append((partition.value, "/" + path, list(map(int, item.shape)), str(item.dtype))) if isinstance(item, h5py.Dataset) else None)
        yield from found


class H5Pixels(DataSource):
    """A two-dimensional dataset as rows (file, row, col, value), in blocks of ``rows`` rows."""

    @classmethod
    def name(cls) -> str:
        return "h5pixels"

    def schema(self) -> str:
        return "file string, row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _H5PixelReader(self.options)


class _H5PixelReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import h5py

        out, step = [], int(self.options.get("rows", 512))
        for name in _files(self.options):
            with h5py.File(name, "r") as f:
                out += [InputPartition((name, a, a + step)) for a in range(0, f[self.options["dataset"]].shape[0], step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import h5py

        name, a, b = partition.value
        with h5py.File(name, "r") as f:
            yield block_batch(name, f[self.options["dataset"]][a:b], a)


def block_batch(name: str, block: np.ndarray, row: int = 0, col: int = 0) -> pa.RecordBatch:
    """A block of a grid that begins at ``row`` and ``col`` as one Arrow batch, a row a cell; masked cells are NULL."""
    rows, cols = np.indices(block.shape, np.int32).reshape(2, -1)
    gone = np.ma.getmaskarray(block).reshape(-1)
    values = pa.array(np.ma.getdata(block).reshape(-1).astype(np.float64), mask=gone if gone.any() else None)
    names = pa.DictionaryArray.from_arrays(np.zeros(len(rows), np.int32), pa.array([name])).cast(pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array(rows + np.int32(row)), pa.array(cols + np.int32(col)), values], ["file", "row", "col", "value"])


def centres(batch: pa.RecordBatch, affine: tuple[float, float, float, float, float, float], tags: str) -> pa.RecordBatch:
    """A batch of cells with their centres by the file's affine (a, b, c, d, e, f) and the file's tags."""
    a, b, c, d, e, f = affine
    row, col = (batch.column(k).to_numpy() + 0.5 for k in ("row", "col"))
    notes = pa.DictionaryArray.from_arrays(np.zeros(batch.num_rows, np.int32), pa.array([tags])).cast(pa.string())
    columns = [*batch.columns[:3], pa.array(a * col + b * row + c), pa.array(d * col + e * row + f), batch.column("value"), notes]
    return pa.RecordBatch.from_arrays(columns, ["file", "row", "col", "x", "y", "value", "tags"])


class RasterBand(DataSource):
    """A GeoTIFF band as rows with cell centres; the no-data value is NULL, file tags come along as JSON."""

    @classmethod
    def name(cls) -> str:
        return "rasterband"

    def schema(self) -> str:
        return "file string, row int, col int, x double, y double, value double, tags string"

    def reader(self, schema) -> DataSourceReader:
        return _RasterReader(self.options)


class _RasterReader(_FileReader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import rasterio

        with rasterio.open(partition.value) as f:
            tags = json.dumps(f.tags())
            for _, window in f.block_windows(int(self.options.get("band", 1))):
                block = f.read(int(self.options.get("band", 1)), window=window, masked=True)
                yield centres(block_batch(partition.value, block, window.row_off, window.col_off), tuple(f.transform)[:6], tags)


def fetched(url: str, tries: int = 4, wait: float = 2.0, opener: Callable = urllib.request.urlopen) -> str:
    """Text at a URL; network, time-out and JSON errors are tried again after doubling waits."""
    for k in range(tries):
        try:
            with opener(url, timeout=60) as answer:
                text = answer.read().decode("utf-8")
                json.loads(text)
                return text
        except (urllib.error.URLError, TimeoutError, ValueError):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


class RestCatalog(DataSource):
    """Features of a JSON search service, one partition for each calendar year.

    ``url`` holds ``{start}`` and ``{end}``.  A year that returns ``cap`` rows or more was cut by the service, which is an
    error here and never a silent loss.
    """

    @classmethod
    def name(cls) -> str:
        return "restcatalog"

    def schema(self) -> str:
        return "year int, granule string, start string, feature string"

    def reader(self, schema) -> DataSourceReader:
        return _RestReader(self.options)


class _RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(y) for y in range(int(self.options["firstyear"]), int(self.options["lastyear"]) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url = self.options["url"].format(start=f"{partition.value}-01-01T00:00:00Z", end=f"{partition.value}-12-31T23:59:59Z")
        features = json.loads(fetched(url)).get("features", [])
        if len(features) >= int(self.options.get("cap", 2000)):
            raise RuntimeError(f"the catalogue returned its limit of rows for {partition.value}: narrow the search")
        for f in features:
            p = f.get("properties", {})
            yield partition.value, p.get("sceneName") or f.get("id"), p.get("startTime") or p.get("datetime"), json.dumps(f)


def register(spark: SparkSession) -> None:
    for source in (H5Catalog, H5Pixels, RasterBand, RestCatalog):
        spark.dataSource.register(source)

"""Readers, sinks and their refusals."""

import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from moraine.sources import data_sources, files

NAME = "NISAR_L2_PR_GUNW_006_098_A_074_007_2000_SH_20260620T125813_20260620T125848_20260702T125814_20260702T125849_X05010_N_F_J_001.h5"


def test_csv_round_trip_and_older_layout(spark, tmp_path):
    df = spark.createDataFrame([("g", 1, 2.123456)], "geometry string, component int, cumulative_mm double")
    files.write_csv(df, str(tmp_path / "a"), digits=3)
    back = files.series_table(spark, str(tmp_path / "a"))
    row = back.first()
    assert row.cumulative_mm == 2.123 and row.error_mm is None and row.epoch is None


def test_products_are_found_once(spark, tmp_path):
    (tmp_path / "venv").mkdir()
    for p in (NAME, "NISAR_other.h5", f"venv/{NAME}"):
        (tmp_path / p).write_bytes(b"x")
    assert [r.name for r in files.products(spark, str(tmp_path)).collect()] == [NAME]
    assert files.products(spark, str(tmp_path), strict=False).count() == 2
    plan = files.file_plan(files.products(spark, str(tmp_path)), F.lit("2026-07-01").cast("date")).first()
    assert (plan.product, plan.bucket) == ("GUNW", "co_event")


def test_log_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "x.log").write_text("a\nb\nc")
    assert [(r.line_no, r.value) for r in files.log_lines(spark, str(tmp_path / "x.log")).orderBy("line_no").collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_geojson(spark):
    doc = json.loads(files.geojson(spark.createDataFrame([(85.1, 28.2, {10.0: 1.5})], "lon double, lat double, by_height map<double, double>")).first().document)
    assert doc["features"][0]["geometry"]["coordinates"] == [85.1, 28.2] and doc["features"][0]["properties"]["by_height"] == {"10.0": 1.5}


def test_pixels_are_clipped_and_partitioned(spark, tmp_path):
    px = spark.createDataFrame([("p", 0, 0, 1.5), ("p", 9, 9, 2.5)], "pair string, row int, col int, value double")
    files.write_pixels(px, str(tmp_path / "px"), clip=F.col("row") < 5)
    back = spark.read.parquet(str(tmp_path / "px"))
    assert back.count() == 1 and dict(back.dtypes)["value"] == "float"


class _Answer:
    def __init__(self, text):
        self.text = text

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.text.encode()


def test_fetch_tries_again_and_gives_up():
    calls = []

    def flaky(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.URLError("down")
        return _Answer('{"features": []}')

    assert json.loads(data_sources.fetched("u", wait=0, opener=flaky)) == {"features": []} and len(calls) == 3
    with pytest.raises(ValueError):
        data_sources.fetched("u", tries=2, wait=0, opener=lambda *_, **__: _Answer("not json"))


def test_sources_register_without_their_libraries(spark):
    data_sources.register(spark)
    pytest.importorskip("pyspark")
    with pytest.raises(Exception, match="h5py|rasterio|No module"):
        spark.read.format("h5pixels").option("dataset", "/x").load(__file__).collect()

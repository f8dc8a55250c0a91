"""Projection, areas, catalogues and noise clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import lattice as L
from moraine.operators import scenes as Q


def test_projection_round_trip_and_scale(spark):
    df = spark.createDataFrame([(85.5, 28.3), (87.0, 28.0), (85.46, 28.47), (84.2, 0.0)], "lon double, lat double")
    x, y = L.to_utm(F.col("lon"), F.col("lat"), 45)
    rows = df.select("lon", "lat", x.alias("x"), y.alias("y")).withColumns(dict(zip(("lon2", "lat2"), L.from_utm(F.col("x"), F.col("y"), 45), strict=True))).collect()
    for r in rows:
        assert r.lon2 == pytest.approx(r.lon, abs=1e-8) and r.lat2 == pytest.approx(r.lat, abs=1e-8)
    assert rows[1].x == pytest.approx(500000, abs=1e-6) and rows[1].y == pytest.approx(0.9996 * 3098428.6, rel=2e-4) and rows[3].y == pytest.approx(0, abs=1e-6)


def test_areas(spark):
    df = spark.createDataFrame([(85.51, 28.29), (85.40, 28.29), (85.56, 28.35)], "lon double, lat double")
    got = [r[0] for r in df.select(L.in_area(F.col("lon"), F.col("lat"), L.area("langtang"))).collect()]
    assert got == [True, False, False]
    with pytest.raises(ValueError, match="unknown area"):
        L.area("nowhere")


def test_cube_column(spark):
    rows = [(0.0, 0.0, h, 0.6161, 0.1531, 39.4) for h in (0, 1)] + [(1.0, 0.0, 0, 0.1, 0.1, 39.4)]
    cube = spark.createDataFrame(rows, "x double, y double, height int, los_x double, los_y double, incidence double")
    assert Q.look_vector_of_cube(cube, 0.2, 3.0).first().los_z == pytest.approx(0.7727, abs=1e-3)
    assert Q.look_vector_of_cube(cube, 0.9, 0.0).count() == 0


def test_catalogue(spark):
    f = spark.createDataFrame([("b", "2026-07-02"), ("a", "2026-07-01"), ("c", "2026-09-01")], "id string, datetime string")
    assert [r.id for r in Q.search(f, F.lit("2026-07-01"), F.lit("2026-08-01")).collect()] == ["a", "b"]
    found, missing = Q.by_id(f, ["a", "z"])
    assert [r.id for r in found.collect()] == ["a"] and [r.id for r in missing.collect()] == ["z"]


def test_nearest_resampling(spark):
    px = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(2) for j in range(2)], "row int, col int, value double")
    got = {(r.row, r.col): r.value for r in Q.nearest_resampled(px, "value", 2, 2, 4, 4).collect()}
    assert got[0, 0] == got[1, 1] == 0.0 and got[3, 0] == 10.0 and got[0, 3] == 1.0


def test_noise_clusters(spark):
    mask = np.zeros((6, 6), bool)
    mask[0, :3] = mask[3:5, 3:5] = True
    assert Q.largest_cluster(mask) == 4
    rows = Q.noise_clusters(spark, 40, 40, 5, trials=4)
    assert rows.count() == 4 and sorted(r.n_px for r in rows.collect()) == sorted(r.n_px for r in rows.collect())


def test_stress_test_and_area_rows(spark):
    stats = spark.createDataFrame([("NISAR_L2_PR_GUNW_006_098_A_x", "20260101", "20260113", "1.0"), ("NISAR_L2_PR_GUNW_007_098_A_x", "20260101", "20260113", "2.0"), ("NISAR_L2_UR_GUNW_006_098_A_x", "20260101", "20260113", "9.0")], "file string, reference string, secondary string, median string")
    area = Q.area_statistics(stats)
    assert [(r.area_mm, r.direction) for r in area.collect()] == [(2.0, "A")]
    target = spark.createDataFrame([("2026-01-01", "2026-01-13", -10.0)], "ref string, sec string, mm double").select(F.to_date("ref").alias("ref"), F.to_date("sec").alias("sec"), "mm")
    dated = area.withColumn("reference", F.to_date("reference", "yyyyMMdd")).withColumn("secondary", F.to_date("secondary", "yyyyMMdd"))
    row = Q.stress_test(target, dated).first()
    assert row.season == "dry" and row.rate == pytest.approx(-1.0) and not row.above_ceiling

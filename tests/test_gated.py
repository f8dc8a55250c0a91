"""Products composed of their layers; heights in batches, kept tables, Arrow blocks, the poll's exit code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.functions import rules as R
from moraine.operators import gated, terrain
from moraine.sources import data_sources, heights
from moraine.streaming import incremental


def layer(spark, values, file="a"):
    values = np.asarray(values, float)
    rows = [(file, i, j, float(values[i, j])) for i in range(values.shape[0]) for j in range(values.shape[1])]
    return spark.createDataFrame(rows, "file string, row int, col int, value double")


def test_phase_product(spark):
    phase = layer(spark, [[1.0, 2.0, 0.0], [float("nan"), 3.0, 4.0]])
    out = gated.phase_product(
        phase, layer(spark, [[0.5, float("nan"), 0], [0, 0, 0]]), layer(spark, [[0.9, 0.9, 0.9], [0.9, 0.2, 0.9]]), layer(spark, [[1, 1, 1], [1, 1, 0]]), layer(spark, [[11, 11, 11], [11, 11, 11]]), area=F.col("col") < 1
    )
    got = {(r.row, r.col): r for r in out.collect()}
    per_radian = -1000 * R.WAVELENGTH_M / (4 * np.pi)
    assert got[0, 0].displacement_mm == pytest.approx(0.5 * per_radian) and got[0, 1].raw_mm == pytest.approx(2 * per_radian)
    assert got[0, 1].quality_valid and not got[0, 1].valid and got[0, 1].displacement_mm is None
    row = gated.gate_report(out, ["finite", "coherent", "in_component", "on_land"]).first()
    assert (row.total, row.finite, row.coherent, row.in_component, row.on_land, row.valid) == (6, 4, 3, 2, 2, 1)


def test_offset_product_leaves_no_ramp(spark):
    rng = np.random.default_rng(2)
    i, j = np.indices((60, 60))
    ramp = 0.5 + 0.002 * j - 0.001 * i
    across, along = ramp + rng.normal(0, 0.001, ramp.shape), -ramp + rng.normal(0, 0.001, ramp.shape)
    across[25:35, 25:35] += 0.05
    across[5, 5] = 30.0
    area = F.col("row").between(20, 40) & F.col("col").between(20, 40)
    out = gated.offset_product(layer(spark, across), layer(spark, along), layer(spark, np.full(ramp.shape, 0.8)), area=area, cull=None, least_stable=1000)
    got = {(r.row, r.col): r for r in out.where("valid").collect()}
    assert len(got) == 21 * 21 and got[30, 30].range_mm == pytest.approx(50, abs=6) and abs(got[22, 22].azimuth_mm) < 6
    assert terrain.scatter_before_after(out.where("NOT inside AND row <> 5"), [], "range", "azimuth").first().range_std > 0


def test_stats_beside_exports(spark):
    stats = spark.createDataFrame([("f", "l1", 1.0), ("f", "l2", 2.0)], "file string, layer string, n double")
    exports = spark.createDataFrame([("f", "l2", 9.0, "p")], "file string, layer string, n double, path string")
    got = {r.layer: (r.n, r.path) for r in gated.stats_with_exports(stats, exports).collect()}
    assert got == {"l1": (1.0, None), "l2": (9.0, "p")}


def test_heights_and_kept_tables(spark, tmp_path):
    points = spark.createDataFrame([(float(i % 30), 85.0, i) for i in range(90)], "lat double, lon double, id int")
    made = []

    def make():
        made.append(1)
        return heights.heights_at(points, lambda part: [10 * lat for lat, _ in part], batch=7)

    for _ in range(2):
        rows = heights.kept(spark, {"grid": [30, 1]}, make, str(tmp_path)).collect()
        assert len(rows) == 90 and all(r.z == 10 * r.lat for r in rows)
    assert len(made) == 1


def test_blocks_are_arrow_batches():
    block = np.ma.masked_equal(np.arange(6.0).reshape(2, 3), 4.0)
    batch = data_sources.centres(data_sources.block_batch("f", block, 10, 20), (2.0, 0.0, 100.0, 0.0, -2.0, 500.0), "{}")
    assert batch.to_pylist()[4] == {"file": "f", "row": 11, "col": 21, "x": 143.0, "y": 477.0, "value": None, "tags": "{}"}


def test_poll_exit_code(spark, tmp_path):
    name = "NISAR_L2_PR_GUNW_006_098_A_074_007_2000_SH_20260620T125813_20260620T125848_20260702T125814_20260702T125849_X05010_N_F_J_001.h5"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"name": "%s"}' % name)
    ask = lambda: incremental.poll_exit_code(spark, str(tmp_path / "in"), "name string", str(tmp_path / "state"), lambda batch, number: None)
    assert ask() == 10 and ask() == 0

"""The raster queries see every row and column: a raster of more rows than any of them once took."""

import heapq

import numpy as np

from moraine.plans import raster_queries as R


def test_every_cell(spark, tmp_path):
    rng = np.random.default_rng(3)
    z = np.round(rng.normal(0, 0.2, (510, 5)), 4)
    spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(z)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d, h = str(tmp_path), np.round(z * 1000, 1)
    assert R.horn_slope_aspect(spark, d).count() == z.size
    lower = {(i, j) for i in range(510) for j in range(5) if min(h[max(i - 1, 0) : i + 2, max(j - 1, 0) : j + 2].ravel()) < h[i, j]}
    assert {(r.row, r.col) for r in R.d8_receivers(spark, d).collect()} == lower
    flat = {(r.k, r.x): r.z for r in R.bilinear_resample(spark, d).collect()}
    assert len(flat) == z.size and all((flat[i, j + 0.5] is None) == (i == 509 or j == 4) for i in range(510) for j in range(5))
    assert abs(flat[508, 3.5] - (0.375 * (h[508, 3] + h[508, 4]) + 0.125 * (h[509, 3] + h[509, 4]))) < 1e-5
    level = np.full(h.shape, np.inf)
    queue = [(h[i, j], i, j) for i in range(510) for j in range(5) if i in (0, 509) or j in (0, 4)]
    heapq.heapify(queue)
    while queue:
        v, i, j = heapq.heappop(queue)
        if level[i, j] <= v:
            continue
        level[i, j] = v
        for a in range(max(i - 1, 0), min(i + 2, 510)):
            for b in range(max(j - 1, 0), min(j + 2, 5)):
                if level[a, b] == np.inf:
                    heapq.heappush(queue, (max(v, h[a, b]), a, b))
    assert {(r.row, r.col): r.filled for r in R.fill_depressions(spark, d).collect()} == {(i, j): level[i, j] for i in range(510) for j in range(5)}

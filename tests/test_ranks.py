"""Percentiles by rank against numpy, whatever the shape of the values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.operators import robust
from moraine.operators.ranks import exact_percentiles

POINTS = (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)


@pytest.mark.parametrize("enough", [20, 1_000_000])
def test_percentiles_of_any_shape(spark, enough):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=900), "heavy": np.exp(rng.normal(0, 30, 700)), "ties": rng.integers(0, 3, 800).astype(float), "one": np.full(300, 2.5),
        "few": np.array([3.0, 1.0]), "spike": np.concatenate((np.zeros(500), rng.normal(size=50))), None: rng.uniform(-1e300, 1e300, 100),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("normal", None), ("normal", float("nan")), ("none", None), ("few", float("inf"))]
    got = {r.g: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), POINTS, bins=16, enough=enough).collect()}
    assert set(got) == {*groups, "none"} and got["none"].n == 0 and got["none"].p is None
    for k, values in groups.items():
        assert got[k].n == len(values) and np.allclose(got[k].p, np.quantile(values, POINTS), rtol=1e-9, atol=0), k


def test_sigma_by_rank_is_the_sigma(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.sin("id").alias("v"))
    assert sorted(robust.robust_sigma(df, ["g"], "v", large=True).collect()) == sorted(robust.robust_sigma(df, ["g"], "v").collect())
    assert exact_percentiles(df.limit(0), [], F.col("v"), (0.5,)).first().p is None

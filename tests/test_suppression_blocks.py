"""Suppression goes on past the first block of the ranked sites."""

import math
import random

from moraine.operators import terrain

COLUMNS = "lat double, lon double, threshold_height_m double, efficiency_Mm3_per_m double"


def walk(rows, top, least):
    kept = []
    for r in sorted(rows, key=lambda r: (r[2], -r[3])):
        if len(kept) < top and all(math.hypot((r[0] - k[0]) * 110.57, (r[1] - k[1]) * 111.32 * math.cos(math.radians(r[0]))) >= least for k in kept):
            kept.append(r)
    return kept


def test_crowded_best_sites(spark):
    rows = [(28.0, 85.0, 10.0, 9000.0 - i) for i in range(5200)] + [(28.1 + i / 10, 85.0, 50.0, float(i)) for i in range(3)]
    got = terrain.suppressed(spark.createDataFrame(rows, COLUMNS))
    assert [tuple(r) for r in got.collect()] == walk(rows, 12, 1.5) and got.count() == 4


def test_small_blocks_against_a_walk(spark):
    rng = random.Random(1)
    rows = [(28 + rng.random() / 20, 85 + rng.random() / 20, 10.0 * rng.randint(1, 3), rng.random()) for _ in range(300)]
    got = terrain.suppressed(spark.createDataFrame(rows, COLUMNS), top=9, pool=9)
    assert [tuple(r) for r in got.collect()] == walk(rows, 9, 1.5)

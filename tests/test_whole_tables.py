"""The whole queries over lineitem and events see rows that no slice holds."""

import random
from datetime import datetime, timedelta
from statistics import median

from moraine.plans import product_queries as Q
from moraine.plans import series_queries as S


def test_lineitem(spark, tmp_path):
    rng = random.Random(4)
    rows = [(o, n, rng.randint(1, 60), rng.randint(1, 12) * 100 + o % 3, float(rng.randint(1, 49)), float(rng.randint(40000, 60000)), rng.choice([0.03, 0.07]), rng.choice([0.0, 0.08]), rng.choice("OF"), datetime(1995, 1, rng.randint(1, 28))) for o in range(60) for n in range(1, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    d = str(tmp_path)
    label: dict[str, str] = {}
    for r in rows:
        ends = {label.get(x, x) for x in (f"p{r[2]}", f"s{r[3]}")}
        label.update({f"p{r[2]}": min(ends), f"s{r[3]}": min(ends)})
        label = {k: min(ends) if v in ends else v for k, v in label.items()}
    assert {r.node: r.component for r in S.network_components(spark, d).collect()} == label
    edges = {(r[2], r[3]) for r in rows}
    got = S.network_redundancy(spark, d).collect()
    assert sum(r.pairs for r in got) == len(edges) and sum(r.epochs for r in got) == len(label)
    sums: dict[int, list] = {}
    for r in sorted(rows):
        sums.setdefault(r[3] % 20, []).append((r[0], r[1], r[4] if r[7] != 0.08 else None))
    want = set()
    for track, steps in sums.items():
        total = 0.0
        for o, n, v in steps:
            total = None if total is None or v is None else total + v
            want.add((track, o, n, total))
    assert {tuple(r) for r in S.cumulative_with_gaps(spark, d).collect()} == want
    pairs = {(r[3], r[9].date(), r[9].date() + timedelta(days=7 + r[3] % 3)) for r in rows}
    assert sum(r.pairs for r in S.chain_runs(spark, d).collect()) == len(pairs)
    groups: dict[tuple, list] = {}
    for r in rows:
        groups.setdefault((r[8], r[3]), []).append((r[5] - 50000, r[1] % 2 != 1))
    checked = {(r.geometry, r.pair): r.products for r in Q.duplicate_consistency(spark, d).collect()}
    assert checked == {k: len(v) for k, v in groups.items() if len(v) > 1}
    best = {}
    for k, v in groups.items():
        away = [abs(x) for g, w in groups.items() if g[0] == k[0] and g != k for x, _ in w]
        expect = median(away) if len(v) > 1 and away else 0
        best[k] = min(v, key=lambda x: (abs(abs(x[0]) - expect), x[1], x[0]))[0]
    assert {(r.geometry, r.pair): r.value for r in Q.duplicate_resolution(spark, d).collect()} == best


def test_every_epoch(spark, tmp_path):
    days = [datetime(2024, 1, 10) + timedelta(days=2 * i) for i in range(8)]
    spark.createDataFrame([("click", t, float(i * i)) for i, t in enumerate(days)], "event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.epoch for r in S.network_inversion(spark, str(tmp_path)).collect()} == {t.date() for t in days}
    assert S.jackknife_velocity(spark, str(tmp_path)).first().n_pairs == 7 + 6


def _cumulative(spark, folder, rows, parts):
    # one file for each part: how a table is stored differs, its rows do not
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_tax double").coalesce(1).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    got = S.cumulative_with_gaps(spark, str(folder)).collect()
    return sorted(((r.l_orderkey, r.l_linenumber, r.cumulative) for r in got), key=str)


def test_unknown_tax_and_keys(spark, tmp_path):
    rows = [(None, 1, 1, 8.0, 0.0), (1, 1, 1, 1.0, None), (1, None, 1, 2.0, 0.0), (2, 1, 1, 4.0, 0.0), (3, 1, 1, None, 0.0)]
    want = [(1, 1, 1.0), (1, None, 3.0), (2, 1, 7.0), (3, 1, None), (None, 1, None)]
    assert _cumulative(spark, tmp_path, rows, 1) == sorted(want, key=str)


def test_lines_with_the_same_key(spark, tmp_path):
    rows = [(1, 1, 1, 5.0, 0.0), (2, 1, 1, 17.0, 0.0), (2, 1, 1, 26.0, 0.0), (3, 1, 1, 1.0, 0.0), (4, 1, 1, 46.0, 0.08), (4, 1, 1, 20.0, 0.0)]
    want = sorted([(1, 1, 5.0), (2, 1, 31.0), (2, 1, 48.0), (3, 1, 49.0), (4, 1, 69.0), (4, 1, None)], key=str)
    stored = [rows, rows[::-1], sorted(rows, key=lambda r: r[3])]
    assert [_cumulative(spark, tmp_path / str(i), r, i + 1) for i, r in enumerate(stored)] == [want] * 3

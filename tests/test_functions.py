"""Column functions against hand-worked values, with the boundaries that are easy to get wrong."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from moraine.functions import geometry as G
from moraine.functions import names as N
from moraine.functions import rules as R
from moraine.functions import stats as S

NAME = "NISAR_L2_UR_GUNW_006_098_A_074_007_2000_SH_20260620T125813_20260620T125848_20260702T125814_20260702T125849_X05010_N_F_J_001.h5"


def one(spark, column, rows=((1,),), schema="k int"):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def day(text):
    return F.lit(text).cast("date")


def test_granule_fields(spark):
    g = one(spark, N.granule(F.lit(NAME)))[0]
    assert (g.processing, g.product, g.path, g.direction, g.reference, g.secondary, g.span_days) == ("UR", "GUNW", "098", "A", date(2026, 6, 20), date(2026, 7, 2), 12)
    assert one(spark, N.granule(F.lit("other.h5"))) == [None]
    assert one(spark, N.track(F.lit(NAME))) == ["ASC 098"] and one(spark, N.track(F.lit("x"))) == [""]
    assert one(spark, N.release(F.lit(NAME))) == ["X05010"]


@pytest.mark.parametrize(("ref", "sec", "want"), [("20251017", "20260120", "BETA"), ("20251016", "20251101", "UNKNOWN"), ("20260617", "20260617", "PROVISIONAL"), ("20260120", "20260617", "UNKNOWN")])
def test_maturity_needs_both_dates(spark, ref, sec, want):
    assert one(spark, N.maturity_of_dates(F.lit(ref), F.lit(sec))) == [want]


def test_three_boundaries_differ(spark):
    event = day("2026-08-26")
    assert one(spark, R.bucket(day("2026-08-14"), event, event)) == ["2026-08_summer"]
    assert one(spark, R.bucket(day("2026-08-14"), day("2026-08-27"), event)) == ["co_event"]
    assert one(spark, R.covers_pre_event(day("2026-08-14"), event, event)) == [False]
    assert one(spark, R.covers_pre_event(day("2026-06-27"), day("2026-08-25"), event)) == [True]
    assert one(spark, R.covers_pre_event(day("2026-06-26"), day("2026-08-25"), event)) == [False]


def test_mask_digits_and_land(spark):
    d = one(spark, R.mask_digits(F.lit(123)))[0]
    assert (d.water, d.ref, d.sec) == (1, 2, 3)
    assert one(spark, R.on_land(F.col("m")), [(11,), (111,), (10,), (255,), (0,)], "m int") == [True, False, False, False, False]


def test_t_critical_uses_next_lower_key(spark):
    assert one(spark, S.t_critical(F.col("d")), [(0,), (1,), (22,), (27,), (30,), (31,)], "d int") == [None, 12.706, 2.086, 2.060, 2.042, 1.960]


def test_erfc(spark):
    for x in (0.0, 0.3, 1.0, 2.5, 5.0):
        assert one(spark, S.erfc(F.lit(x)))[0] == pytest.approx(math.erfc(x), rel=2e-7)


def test_worst_skips_nan(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,), (3.0,)], "x double")
    assert df.agg(S.worst(F.col("x"))).first()[0] == 3.0
    assert df.where("x IS NULL").agg(S.worst(F.col("x"))).first()[0] is None


def test_look_side_turns_the_horizontal(spark):
    left = [one(spark, c)[0] for c in G.look_vector(F.lit(350.0), F.lit(37.0), F.lit(True))]
    right = [one(spark, c)[0] for c in G.look_vector(F.lit(350.0), F.lit(37.0), F.lit(False))]
    assert left[0] == pytest.approx(-right[0]) and left[1] == pytest.approx(-right[1]) and left[2] == pytest.approx(right[2])


def test_published_sensitivities(spark):
    from moraine.operators.terrain import sensitivities

    rows = {r.track: r.sensitivity for r in sensitivities(spark.createDataFrame([(28.275, 27.4, 273.0)], "lat double, slope double, aspect double")).collect()}
    assert rows["NISAR ASC 98"] == pytest.approx(-0.889, abs=0.005) and rows["NISAR DESC 48"] == pytest.approx(0.163, abs=0.005)
    assert rows["S1 ASC 85"] == pytest.approx(0.188, abs=0.005) and rows["S1 DESC 19"] == pytest.approx(-0.913, abs=0.005)


@pytest.mark.parametrize(
    ("args", "verdict", "reason"),
    [((-0.732, 0.472, -3.49, -1.47, 25.0), "delay", "nearer to delay"), ((-0.732, 0.472, -3.49, 2.2, 25.0), "motion", "nearer to motion"), ((-0.732, 0.472, -3.49, 2.2, 9.9), "undetermined", "gentle slope"),
     ((-0.2, 0.472, -3.0, 2.0, 25.0), "undetermined", "blind track"), ((0.5, 0.55, 1.0, 1.0, 25.0), "undetermined", "same ratio"), ((-0.7, 0.5, 0.0, 1.0, 25.0), "undetermined", "no ascending rate")],
)
def test_geometry_verdict(spark, args, verdict, reason):
    got = one(spark, R.geometry_verdict(*[F.lit(x) for x in args]))[0]
    assert (got.verdict, got.reason) == (verdict, reason)


def test_ring_is_half_open(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    points = [(2.0, 2.0), (5.0, 2.0), (2.0, 4.0), (2.0, 0.0)]
    assert one(spark, R.in_ring(F.col("x"), F.col("y"), ring), points, "x double, y double") == [True, False, False, True]


def test_redaction(spark):
    got = one(spark, N.redacted(F.lit('GET https://x.y/z?token=1  {"api_key": "s3 cret", "n": 1} password=abc;')))[0]
    assert got == 'GET [URL] {"api_key": [REDACTED], "n": 1} password=[REDACTED];'
    nested = '{"token": ["aaa", "SECRETB"], "a": [{"Client-Secret": {"x": 1}, "b": "c d"}], "url": "https://x.y/?q"}'
    texts = [(nested,), ("my_token : 'a b', x=1",), ('{"password": "unclosed',), ("Set-Cookie=abc; key=1 api key=2",), ("",), (None,), ("cookie=",)]
    assert one(spark, N.redacted(F.col("t")), texts, "t string") == [
        '{"token":"[REDACTED]","a":[{"Client-Secret":"[REDACTED]","b":"c d"}],"url":"[URL]"}', "my_token : [REDACTED], x=1", '{"password": [REDACTED]', "Set-Cookie=[REDACTED]; key=1 api key=2", "", None, "cookie="
    ]


def test_quantised(spark):
    assert one(spark, R.quantised(F.col("x")), [(-1.0,), (1.0,), (math.nan,), (None,), (7.0,)], "x double") == [0, 255, 128, 128, 255]


def test_track_number_is_not_a_substring(spark):
    assert one(spark, N.geometry_number(F.col("t")), [("ASC 098",), ("ASC 9",), ("x",)], "t string") == [98, 9, None]

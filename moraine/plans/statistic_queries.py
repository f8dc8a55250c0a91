"""Robust statistics, gates and scalar rules over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..functions import rules as R
from ..functions import stats as S
from ..operators import robust as B
from ..tables import load
from .registry import query

EVENT = "2024-01-25"


@query("""
WITH e AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, value FROM events),
m AS (SELECT event_type, week, median(value) AS m FROM e GROUP BY 1, 2),
s AS (SELECT event_type, week, 1.4826 * median(abs(value - m)) AS sigma, count(*) AS n FROM e JOIN m USING (event_type, week) GROUP BY 1, 2),
f AS (SELECT event_type, 3 * sigma / 7 AS floor FROM s WHERE n >= 6 AND week + 7 < DATE '2024-01-25' AND date_diff('day', week, DATE '2024-01-25') <= 60)
SELECT event_type, count(*) AS intervals, round(max(floor), 6) AS worst_floor, round(max(floor) / (10.0 / 30), 6) AS ratio FROM f GROUP BY 1
""")
def bound_worst_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_type", F.to_date(F.date_trunc("week", "ts")).alias("week"), "value")
    floors = B.robust_sigma(rows, ["event_type", "week"], "value").withColumn("floor", S.at_least(F.col("n"), S.LEAST_PIXELS, S.floor_rate(F.col("sigma"), F.lit(7))))
    early = floors.where(R.covers_pre_event(F.col("week"), F.date_add("week", 7), F.lit(EVENT).cast("date")) & F.col("floor").isNotNull())
    worst = early.groupBy("event_type").agg(F.count(F.lit(1)).alias("intervals"), S.worst(F.col("floor")).alias("w"))
    return worst.select("event_type", "intervals", F.round("w", 6).alias("worst_floor"), F.round(F.col("w") / R.PRECURSOR_MM_DAY, 6).alias("ratio"))


@query("""
WITH m AS (SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(any_value(m), 4) AS median, round(1.4826 * median(abs(l_extendedprice - m)), 4) AS sigma
FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY 1, 2
""")
def robust_sigma_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.robust_sigma(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", large=True)
    return out.select("l_returnflag", "l_linestatus", "n", F.round("median", 4).alias("median"), F.round("sigma", 4).alias("sigma"))


@query("""
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.01), 4) AS p1, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5,
 round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
 round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
 max(abs(l_extendedprice)) AS max_abs, round(stddev_pop(l_extendedprice), 4) AS std, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1
""")
def percentile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.percentile_profile(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("p1", "p5", "p25", "p50", "p75", "p95", "p99", "std", "mean")})


@query("""
SELECT l_returnflag, count(*) AS total, count(*) FILTER (l_discount >= 0.03) AS coherent, count(*) FILTER (l_discount >= 0.03 AND l_quantity >= 10) AS on_land,
 count(*) FILTER (l_discount >= 0.03 AND l_quantity >= 10 AND l_tax <= 0.06) AS in_component FROM lineitem GROUP BY 1
""")
def gate_chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = {"coherent": F.col("l_discount") >= 0.03, "on_land": F.col("l_quantity") >= 10, "in_component": F.col("l_tax") <= 0.06}
    return B.gate_counts(load(spark, sf_dir, "lineitem"), ["l_returnflag"], gates)


@query("""
WITH m AS (SELECT l_linestatus, median(l_extendedprice) AS m FROM lineitem GROUP BY 1),
s AS (SELECT l_linestatus, any_value(m) AS m, 1.4826 * median(abs(l_extendedprice - m)) AS s FROM lineitem JOIN m USING (l_linestatus) GROUP BY 1)
SELECT l_linestatus, count(*) AS kept, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN s USING (l_linestatus) WHERE abs(l_extendedprice - m) <= 1.5 * s GROUP BY 1
""")
def mad_cull(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = B.culled(load(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", sigmas=1.5, large=True)
    return kept.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
SELECT l_returnflag, count(*) FILTER (l_discount >= 0.05) AS valid_px, count(*) FILTER (l_quantity <= 25) AS aoi_px, count(*) AS frame_px,
 round(100.0 * count(*) FILTER (l_discount >= 0.05 AND l_quantity <= 25) / count(*) FILTER (l_quantity <= 25), 6) AS aoi_pct,
 round(100.0 * count(*) FILTER (l_discount >= 0.05) / count(*), 6) AS frame_pct FROM lineitem GROUP BY 1
""")
def coverage_two_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.coverage(load(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_discount") >= 0.05, F.col("l_quantity") <= 25)
    return out.withColumns({c: F.round(c, 6) for c in ("aoi_pct", "frame_pct")})


@query("""
WITH n AS (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem)
SELECT l_linenumber AS row, CAST(l_quantity AS INTEGER) AS col FROM lineitem, n WHERE l_discount = 0.1 AND l_tax = 0.08
GROUP BY l_linenumber, CAST(l_quantity AS INTEGER), n.n HAVING count(DISTINCT l_returnflag) = n.n
""")
def common_mask_relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = F.when((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08), F.col("l_extendedprice"))
    return B.common_pixels(load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("row"), F.col("l_quantity").cast("int").alias("col"), "l_returnflag", measured.alias("v")), "l_returnflag", "v")


RING = [(2.0, -1.0), (20.0, 0.5), (24.0, 8.0), (12.0, 14.0), (6.0, 9.0), (1.0, 20.0)]


@query(f"""
WITH r AS (SELECT * FROM (VALUES {", ".join(f"({i}, {x1}, {y1}, {x2}, {y2})" for i, ((x1, y1), (x2, y2)) in enumerate(zip(RING[-1:] + RING[:-1], RING, strict=True)))}) AS t(i, x1, y1, x2, y2)),
p AS (SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal / 500 AS y FROM customer),
c AS (SELECT c_custkey, c_mktsegment, count(*) FILTER (y1 <> y2 AND ((y1 > y) <> (y2 > y)) AND x < (x1 - x2) * (y - y2) / CASE WHEN y1 = y2 THEN 1 ELSE y1 - y2 END + x2) AS n FROM p, r GROUP BY 1, 2)
SELECT c_mktsegment, count(*) FILTER (n % 2 = 1) AS inside, count(*) AS total FROM c GROUP BY 1
""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 500).alias("y"))
    return p.groupBy("c_mktsegment").agg(F.count_if(R.in_ring(F.col("x"), F.col("y"), RING)).alias("inside"), F.count(F.lit(1)).alias("total"))


@query("""
WITH m AS (SELECT o_orderkey % 256 AS mask FROM orders)
SELECT CAST(mask // 100 AS INTEGER) AS water, CAST((mask // 10) % 10 AS INTEGER) AS ref, CAST(mask % 10 AS INTEGER) AS sec, count(*) AS n,
 count(*) FILTER (mask // 100 = 0 AND (mask // 10) % 10 > 0 AND mask % 10 > 0 AND mask <> 255) AS land FROM m GROUP BY 1, 2, 3
""")
def nodata_mask_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 256).alias("mask"))
    return m.select("mask", R.mask_digits(F.col("mask")).alias("d")).groupBy("d.water", "d.ref", "d.sec").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.on_land(F.col("mask"))).alias("land"))


_SHIFT = 11_000


@query(f"""
WITH d AS (SELECT strftime(CAST(o_orderdate AS DATE) + {_SHIFT}, '%Y%m%d') AS ref, strftime(CAST(o_orderdate AS DATE) + {_SHIFT} + 12, '%Y%m%d') AS sec FROM orders)
SELECT CASE WHEN ref BETWEEN '20251017' AND '20260120' AND sec BETWEEN '20251017' AND '20260120' THEN 'BETA' WHEN ref >= '20260617' AND sec >= '20260617' THEN 'PROVISIONAL' ELSE 'UNKNOWN' END AS maturity, count(*) AS n FROM d GROUP BY 1
""")
def maturity_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.to_date("o_orderdate"), _SHIFT)
    d = load(spark, sf_dir, "orders").select(F.date_format(day, "yyyyMMdd").alias("ref"), F.date_format(F.date_add(day, 12), "yyyyMMdd").alias("sec"))
    return d.groupBy(N.maturity_of_dates(F.col("ref"), F.col("sec")).alias("maturity")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CASE WHEN month(o_orderdate) IN (11, 12, 1, 2, 3) THEN 'winter' ELSE 'summer' END AS season, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2
""")
def season_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(R.season(F.col("o_orderdate")).alias("season"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS ref, CAST(o_orderdate AS DATE) + 12 AS sec FROM orders)
SELECT CASE WHEN sec > DATE '1997-06-15' THEN 'co_event' ELSE strftime(ref, '%Y-%m') || '_' || CASE WHEN month(ref) IN (11, 12, 1, 2, 3) THEN 'winter' ELSE 'summer' END END AS bucket, count(*) AS n FROM d GROUP BY 1
""")
def bucket_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.to_date("o_orderdate")
    return load(spark, sf_dir, "orders").groupBy(R.bucket(ref, F.date_add(ref, 12), F.lit("1997-06-15").cast("date")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_NAME_SQL = """'NISAR_L2_' || CASE WHEN o_orderkey % 2 = 0 THEN 'PR' ELSE 'UR' END || '_GUNW_006_' || lpad(CAST(o_orderkey % 200 AS VARCHAR), 3, '0') || '_' || CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'D' END
 || '_074_007_2000_SH_' || strftime(o_orderdate, '%Y%m%d') || 'T125813_' || strftime(o_orderdate, '%Y%m%d') || 'T125848_' || strftime(CAST(o_orderdate AS DATE) + 12, '%Y%m%d') || 'T125814_' || strftime(CAST(o_orderdate AS DATE) + 12, '%Y%m%d') || 'T125849_X05010_N_F_J_001.h5'"""


def granule_names(orders: DataFrame) -> DataFrame:
    key, ref = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    sec = F.date_format(F.date_add(F.to_date("o_orderdate"), 12), "yyyyMMdd")
    name = F.concat(F.lit("NISAR_L2_"), F.when(key % 2 == 0, "PR").otherwise("UR"), F.lit("_GUNW_006_"), F.lpad((key % 200).cast("string"), 3, "0"), F.lit("_"), F.when(key % 3 == 0, "A").otherwise("D"), F.lit("_074_007_2000_SH_"), ref, F.lit("T125813_"), ref, F.lit("T125848_"), sec, F.lit("T125814_"), sec, F.lit("T125849_X05010_N_F_J_001.h5"))
    return orders.select("o_orderkey", name.alias("name"))


@query(f"""
WITH n AS (SELECT o_orderkey, {_NAME_SQL} AS name FROM orders)
SELECT o_orderkey, regexp_extract(name, 'NISAR_L2_([A-Z]{{2}})_', 1) AS processing, CAST(regexp_extract(name, '_GUNW_006_(\\d+)_', 1) AS INTEGER) AS path,
 CASE WHEN regexp_extract(name, '_(\\d{{3}})_([AD])_', 2) = 'A' THEN 'ASC ' ELSE 'DESC ' END || regexp_extract(name, '_(\\d{{3}})_([AD])_', 1) AS track,
 regexp_extract(name, '_([A-Z]\\d{{5}})_', 1) AS release, CAST(strptime(regexp_extract(name, '_(\\d{{8}})T\\d{{6}}', 1), '%Y%m%d') AS DATE) AS reference, 12 AS span_days FROM n
""")
def granule_regex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = granule_names(load(spark, sf_dir, "orders")).withColumn("g", N.granule(F.col("name")))
    return rows.select("o_orderkey", "g.processing", F.col("g.path").cast("int").alias("path"), N.track(F.col("name")).alias("track"), N.release(F.col("name")).alias("release"), "g.reference", "g.span_days")


@query("""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS plain, list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) AS file FROM pages""")
def file_of_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("plain"), N.file_of_url(F.col("url")).alias("file"))


@query(r"""
SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s"''<>]+', '[URL]', 'g'),
 '(?i)((?:passwo?r?d|passphrase|token|authorization|secret|api[-_]*key|cookie)["'']?\s*[:=]\s*)("[^"]*"|''[^'']*''|[^,;<>\s]+)', '\1[REDACTED]', 'g'), '\s+', ' ', 'g')), 1, 350) AS redacted FROM documents
""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", N.redacted(F.col("text")).alias("redacted"))


_TRACKS_SQL = ", ".join(f"('{n}', {str(a).lower()}, {i}, {t}, {str(left).lower()})" for n, _, a, i, t, _, left in G.TRACKS)
_SENS = """
p AS (SELECT s_suppkey, 28.0 + s_nationkey / 100.0 AS lat, 10 + (s_suppkey % 35) AS slope, (s_suppkey * 37) % 360 AS aspect FROM supplier),
h AS (SELECT *, degrees(asin(greatest(-1, least(1, cos(radians(inc)) / cos(radians(lat)))))) AS a FROM p, t),
k AS (SELECT *, radians(((CASE WHEN asc_ THEN a ELSE 180 - a END) + 360) % 360) AS head, radians(th) AS tt, CASE WHEN lft THEN -1.0 ELSE 1.0 END AS side FROM h),
s AS (SELECT s_suppkey, track, asc_, side * -sin(tt) * cos(head) * cos(radians(slope)) * sin(radians(aspect)) + side * sin(tt) * sin(head) * cos(radians(slope)) * cos(radians(aspect)) + cos(tt) * -sin(radians(slope)) AS sensitivity, slope FROM k)
"""


def look_points(suppliers: DataFrame) -> DataFrame:
    return suppliers.select("s_suppkey", (28.0 + F.col("s_nationkey") / 100.0).alias("lat"), (10 + F.col("s_suppkey") % 35).alias("slope"), ((F.col("s_suppkey") * 37) % 360).alias("aspect"))


@query(f"""
WITH t AS (SELECT * FROM (VALUES {_TRACKS_SQL}) AS v(track, asc_, inc, th, lft)), {_SENS}
SELECT s_suppkey, track, round(sensitivity, 6) AS sensitivity, abs(sensitivity) >= 0.3 AS usable FROM s
""")
def track_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.terrain import sensitivities

    return sensitivities(look_points(load(spark, sf_dir, "supplier"))).select("s_suppkey", "track", F.round("sensitivity", 6).alias("sensitivity"), "usable")


@query(f"""
WITH t AS (SELECT * FROM (VALUES {_TRACKS_SQL}) AS v(track, asc_, inc, th, lft)), {_SENS},
w AS (SELECT s_suppkey, any_value(slope) AS slope, max(CASE WHEN track = 'NISAR ASC 98' THEN sensitivity END) AS sa, max(CASE WHEN track = 'NISAR DESC 48' THEN sensitivity END) AS sd FROM s GROUP BY 1),
v AS (SELECT w.*, s_acctbal / 1000 AS va, (s_acctbal - 3000) / 1500 AS vd FROM w JOIN supplier USING (s_suppkey))
SELECT s_suppkey, CASE WHEN slope < 10 THEN 'undetermined' WHEN abs(sa) < 0.25 OR abs(sd) < 0.25 THEN 'undetermined' WHEN abs(sd / sa - 1) < 0.15 THEN 'undetermined' WHEN va = 0 THEN 'undetermined'
 WHEN abs(vd / va - sd / sa) < abs(vd / va - 1) THEN 'motion' ELSE 'delay' END AS verdict FROM v
""")
def geometry_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.terrain import sensitivities

    suppliers = load(spark, sf_dir, "supplier")
    s = sensitivities(look_points(suppliers))
    of = lambda t: F.max(F.when(F.col("track") == t, F.col("sensitivity")))
    wide = s.groupBy("s_suppkey").agg(F.first("slope").alias("slope"), of("NISAR ASC 98").alias("sa"), of("NISAR DESC 48").alias("sd"))
    rates = wide.join(suppliers.select("s_suppkey", (F.col("s_acctbal") / 1000).alias("va"), ((F.col("s_acctbal") - 3000) / 1500).alias("vd")), "s_suppkey")
    return rates.select("s_suppkey", R.geometry_verdict(F.col("sa"), F.col("sd"), F.col("va"), F.col("vd"), F.col("slope"))["verdict"].alias("verdict"))


@query(f"""
WITH t AS (SELECT * FROM (VALUES {_TRACKS_SQL}) AS v(track, asc_, inc, th, lft)), {_SENS},
c AS (SELECT s_suppkey, any_value(slope) AS slope, bool_or(abs(sensitivity) >= 0.3 AND asc_) AS a, bool_or(abs(sensitivity) >= 0.3 AND NOT asc_) AS d FROM s GROUP BY 1)
SELECT count(*) AS cells, round(avg(CAST(a OR d AS INTEGER)), 6) AS either, round(avg(CAST(a AND d AS INTEGER)), 6) AS both, round(avg(CAST(NOT (a OR d) AS INTEGER)), 6) AS neither,
 round(avg(CASE WHEN slope >= 20 THEN CAST(a AND d AS INTEGER) END), 6) AS both_steep, round(avg(CASE WHEN slope >= 20 THEN CAST(NOT (a OR d) AS INTEGER) END), 6) AS neither_steep FROM c
""".replace(" AS both,", ' AS "both",'))
def coverage_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.terrain import sensitivity_coverage

    cells = look_points(load(spark, sf_dir, "supplier")).withColumnRenamed("s_suppkey", "row").withColumn("col", F.lit(0))
    out = sensitivity_coverage(cells)
    return out.select("cells", *[F.round(c, 6).alias(c) for c in ("either", "both", "neither", "both_steep", "neither_steep")])


@query("""
WITH a AS (SELECT c_mktsegment, ((c_custkey * 53) % 360) / 2.0 + CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE 200 END AS d FROM customer)
SELECT c_mktsegment, round((degrees(atan2(avg(sin(radians(d))), avg(cos(radians(d))))) + 360) % 360, 4) AS mean_direction FROM a GROUP BY 1
""")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ((F.col("c_custkey") * 53) % 360) / 2.0 + F.when(F.col("c_nationkey") % 2 == 0, 0).otherwise(200)
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(S.circular_mean(d), 4).alias("mean_direction"))


_NAMES_SQL = "['" + "','".join(G.COMPASS) + "']"


@query(f"""
SELECT list_extract({_NAMES_SQL}, CAST(floor((s_suppkey * 37 % 360) / 22.5 + 0.5) AS INTEGER) % 16 + 1) AS direction, count(*) AS n, round(1 / sum(1.0 / (1 + s_suppkey % 12)), 6) AS revisit FROM supplier GROUP BY 1
""")
def compass_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").groupBy(G.compass(key * 37 % 360).alias("direction")).agg(F.count(F.lit(1)).alias("n"), F.round(S.harmonic_revisit((1 + key % 12).cast("double")), 6).alias("revisit"))


@query("""
WITH p AS (SELECT p_partkey, 5.0 + p_size AS dur, (p_partkey % 40) * 1.0 AS t FROM part)
SELECT p_partkey, round(ln(dur / (dur - least(greatest(t, 0), dur - 1e-6))) / (ln(dur) / 300), 4) AS displacement, round(CASE WHEN t < dur - 1 THEN 1 / (ln(dur) / 300 * (dur - t)) END, 6) AS rate FROM p
""")
def precursor_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    T, t, creep = 5.0 + F.col("p_size"), (F.col("p_partkey") % 40) * 1.0, F.lit(300.0)
    return load(spark, sf_dir, "part").select("p_partkey", F.round(R.precursor_displacement(t, T, creep), 4).alias("displacement"), F.round(F.when(t < T - 1, R.precursor_velocity(t, T, creep)), 6).alias("rate"))


@query("""
WITH p AS (SELECT p_partkey, (p_size - 25) / 20.0 AS x FROM part)
SELECT p_partkey, CAST(least(greatest(round_even((x + 1) * 127.5, 0), 0), 255) AS INTEGER) AS level, CASE WHEN p_partkey % 3 = 0 THEN 128 ELSE NULL END AS missing_level FROM p
""")
def quantised_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("p_size") - 25) / 20.0
    return load(spark, sf_dir, "part").select("p_partkey", R.quantised(x).alias("level"), F.when(F.col("p_partkey") % 3 == 0, R.quantised(F.lit(None).cast("double"))).alias("missing_level"))


@query("""
WITH p AS (SELECT s_suppkey, s_acctbal / 1000 AS da, (s_suppkey % 17) - 8.0 AS dd FROM supplier),
l AS (SELECT *, -0.62 AS ae, 0.77 AS au, 0.58 AS de, 0.79 AS du FROM p)
SELECT s_suppkey, round((da * du - au * dd) / (ae * du - au * de), 6) AS east, round((ae * dd - da * de) / (ae * du - au * de), 6) AS up FROM l
""")
def two_track_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    asc, desc = (F.lit(-0.62), F.lit(-0.1), F.lit(0.77)), (F.lit(0.58), F.lit(-0.1), F.lit(0.79))
    m = G.two_track_motion(F.col("s_acctbal") / 1000, (F.col("s_suppkey") % 17) - 8.0, asc, desc)
    return load(spark, sf_dir, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", F.round("m.east", 6).alias("east"), F.round("m.up", 6).alias("up"))


@query("""
SELECT p_partkey, CASE WHEN p_size >= 28 AND p_retailprice >= 1200 AND least(abs(p_partkey % 360), abs(p_partkey % 360 - 360)) <= 60 THEN 'DETACHMENT-like' WHEN p_size < 20 THEN 'deposit / flat'
 WHEN p_partkey % 360 > 135 AND p_partkey % 360 < 225 THEN 'south-facing -> melt' ELSE 'ambiguous' END AS reading FROM part
""")
def terrain_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    elevation = F.when(F.col("p_retailprice") >= 1200, 5000.0).otherwise(4000.0)
    return load(spark, sf_dir, "part").select("p_partkey", R.terrain_reading(F.col("p_size"), F.col("p_partkey") % 360, elevation).alias("reading"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_partkey % 97 AS DOUBLE) / 7 AS phase, p_retailprice AS g, CAST(p_size * 20 AS DOUBLE) AS s FROM part)
SELECT p_partkey, round(-1000.0 * (299792458.0 / 1257500000.0) / (4 * pi()) * (phase - CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 0.25 END), 6) AS mm, round(CASE WHEN g + s > 0 THEN (g - s) / greatest(g + s, 1) END, 6) AS snow_index, round(sqrt(g * g + s * s), 4) AS magnitude FROM p
""")
def pixel_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase, g, s = F.col("p_partkey").cast("double") % 97 / 7, F.col("p_retailprice"), (F.col("p_size") * 20).cast("double")
    screen = F.when(F.col("p_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(0.25))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(R.displacement_mm(R.without_ionosphere(phase, screen)), 6).alias("mm"), F.round(R.snow_index(g, s), 6).alias("snow_index"), F.round(R.magnitude(g, s), 4).alias("magnitude"))


@query("""
SELECT l_returnflag, count(*) AS n, round(median(l_quantity), 6) AS l_quantity_median, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, round(median(l_tax), 6) AS l_tax_median, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max FROM lineitem GROUP BY 1
""")
def layer_noise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.layer_summary(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_tax")
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity_median", "l_tax_median")})


@query("""
WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS k, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM c)
SELECT l_returnflag, l_linenumber AS component, round(n / total, 6) AS fraction FROM r WHERE k = 1
""")
def dominant_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.dominant_component(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber").withColumn("fraction", F.round("fraction", 6))


@query("""
WITH o AS (SELECT row_number() OVER (ORDER BY p_partkey) AS k, p_partkey, p_size AS dof FROM part)
SELECT p_partkey, CASE WHEN dof > 30 THEN 1.960 ELSE (SELECT max_by(v, d) FROM (VALUES (1,12.706),(2,4.303),(3,3.182),(4,2.776),(5,2.571),(6,2.447),(7,2.365),(8,2.306),(9,2.262),(10,2.228),(11,2.201),(12,2.179),(13,2.160),(14,2.145),(15,2.131),(16,2.120),(17,2.110),(18,2.101),(19,2.093),(20,2.086),(25,2.060),(30,2.042)) AS t(d, v) WHERE d <= dof) END AS t_95 FROM o
""")
def student_t_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", S.t_critical(F.col("p_size")).cast("decimal(5,3)").alias("t_95"))

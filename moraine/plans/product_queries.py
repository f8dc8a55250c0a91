"""Duplicates, catalogues, optical scenes and the bound over product tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import products as P
from ..tables import load
from .registry import query

_D = "d AS (SELECT l_linestatus AS geometry, l_suppkey AS pair, l_extendedprice - 50000 AS value, CASE WHEN l_linenumber % 2 = 1 THEN 'PR' ELSE 'UR' END AS processing FROM lineitem)"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_linestatus").alias("geometry"), F.col("l_suppkey").alias("pair"), (F.col("l_extendedprice") - 50000).alias("value"), F.when(F.col("l_linenumber") % 2 == 1, "PR").otherwise("UR").alias("processing"))


@query(f"""WITH {_D}, n AS (SELECT geometry, pair FROM d GROUP BY 1, 2 HAVING count(*) > 1), x AS (SELECT n.geometry, n.pair, median(abs(d.value)) AS expect FROM n JOIN d ON d.geometry = n.geometry AND d.pair <> n.pair GROUP BY 1, 2),
r AS (SELECT d.*, row_number() OVER (PARTITION BY d.geometry, d.pair ORDER BY abs(abs(value) - coalesce(expect, 0)), CASE WHEN processing = 'PR' THEN 0 ELSE 1 END, value) AS k FROM d LEFT JOIN x USING (geometry, pair)) SELECT geometry, pair, processing, round(value, 2) AS value FROM r WHERE k = 1""")
def duplicate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = P.resolve_duplicates(_stats(spark, sf_dir), ["geometry"], ["pair"], "value", "processing")
    return kept.select("geometry", "pair", "processing", F.round("value", 2).alias("value"))


@query(f"""WITH {_D}, g AS (SELECT geometry, pair, count(*) AS products, count(value) AS measured, max(value) - min(value) AS spread, (max(value) - min(value)) / 5000.0 AS f FROM d GROUP BY 1, 2 HAVING count(*) > 1)
SELECT geometry, pair, products, measured, round(spread, 2) AS spread, round(f, 6) AS fringes, CASE WHEN abs(f - round_even(f, 0)) < 0.25 AND round_even(f, 0) >= 1 THEN 'unwrapping ambiguity' WHEN spread > 2500 THEN 'large, no whole fringe' ELSE 'consistent' END AS verdict FROM g""")
def duplicate_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.consistency(_stats(spark, sf_dir), ["geometry", "pair"], "value", F.lit(5000.0)).withColumns({"spread": F.round("spread", 2), "fringes": F.round("fringes", 6)})


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS z FROM lineitem)
SELECT l_suppkey, max(CASE WHEN a = 1 THEN l_orderkey END) AS first_order, max(CASE WHEN z = 1 THEN l_orderkey END) AS last_order FROM r GROUP BY 1""")
def dedupe_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    first = P.one_of_each(rows, ["l_suppkey"], [F.asc("l_orderkey"), F.asc("l_linenumber")])
    last = P.one_of_each(rows, ["l_suppkey"], [F.desc("l_orderkey"), F.desc("l_linenumber")])
    return first.select("l_suppkey", F.col("l_orderkey").alias("first_order")).join(last.select("l_suppkey", F.col("l_orderkey").alias("last_order")), "l_suppkey")


@query("""WITH u AS (SELECT o_custkey, o_orderkey, o_totalprice, year(o_orderdate) AS y FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC, o_orderkey DESC) AS k FROM u) SELECT o_custkey, y, o_orderkey, o_totalprice FROM r WHERE k = 1""")
def chunked_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    years = sorted(r["y"] for r in orders.select("y").distinct().collect())
    chunks = [P.one_of_each(orders.where(F.col("y") == y), ["o_custkey"], [F.desc("o_orderkey")]) for y in years]
    return P.chunks_united(chunks, "o_custkey").select("o_custkey", "y", "o_orderkey", "o_totalprice")


@query("""WITH d AS (SELECT DISTINCT o_custkey % 50 AS track, CAST(o_orderdate AS DATE) AS day FROM orders), g AS (SELECT track, day - lag(day) OVER (PARTITION BY track ORDER BY day) AS gap FROM d), l AS (SELECT track, list_sort(list(gap)) AS x FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT track, list_extract(x, len(x) // 2 + 1) AS gap_days FROM l""")
def sampling_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("track"), F.to_date("o_orderdate").alias("day"))
    return P.sampling_gap(dates, ["track"], "day")


@query("""SELECT CASE WHEN month(o_orderdate) IN (11, 12, 1, 2, 3) THEN 'winter' ELSE 'summer' END AS season, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bucket_counts(load(spark, sf_dir, "orders").withColumn("season", R.season(F.col("o_orderdate"))), "season", "o_orderstatus", ["F", "O", "P"])


@query("""WITH c AS (SELECT user_id, hour(ts) AS hour, CASE WHEN event_id % 12 NOT IN (0, 1, 3, 8, 9, 10) THEN value END AS v, CASE WHEN event_id % 12 NOT IN (0, 1, 3, 8, 9, 10) THEN event_id END AS e FROM events) SELECT user_id, hour, arg_max(v, e) AS value, max(e) AS event_id FROM c GROUP BY 1, 2""")
def mosaic_latest_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = load(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    return P.newest_clear(scenes, ["user_id", "hour"], "event_id", "value", R.usable_scene(F.col("event_id") % 12))


@query("""SELECT event_type, round(100.0 * avg(CAST(event_id % 12 IN (0, 1, 3, 8, 9, 10) AS INTEGER)), 6) AS cloud_pct FROM events GROUP BY 1""")
def scene_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cloud_percent(load(spark, sf_dir, "events").withColumn("c", F.col("event_id") % 12), "event_type", "c").withColumn("cloud_pct", F.round("cloud_pct", 6))


@query("""WITH p AS (SELECT c_custkey, CAST(floor((c_acctbal + 1000) / 250) AS INTEGER) AS col, CAST(floor((25.0 - c_nationkey) / 2.5) AS INTEGER) AS row FROM customer) SELECT c_custkey, row, col FROM p WHERE col BETWEEN 0 AND 31 AND row BETWEEN 0 AND 9""")
def place_on_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    wide = points.withColumn("y", F.col("y") * 100)
    return P.on_lattice(wide, -1000.0, 2500.0, 250.0, 32, 10).select("c_custkey", "row", "col")


@query("""WITH b AS (SELECT n_nationkey AS name, n_regionkey % 2 AS g, n_nationkey * 1.0 AS lon0, n_nationkey + 3.0 AS lon1, (n_nationkey * 7 % 13) * 1.0 AS lat0, (n_nationkey * 7 % 13) + 2.5 AS lat1 FROM nation)
SELECT x.name AS a, y.name AS b FROM b x JOIN b y ON x.g < y.g AND x.lon0 <= y.lon1 AND y.lon0 <= x.lon1 AND x.lat0 <= y.lat1 AND y.lat0 <= x.lat1""")
def footprint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    boxes = load(spark, sf_dir, "nation").select(k.alias("name"), (F.col("n_regionkey") % 2).alias("g"), (k * 1.0).alias("lon0"), (k + 3.0).alias("lon1"), (k * 7 % 13 * 1.0).alias("lat0"), (k * 7 % 13 + 2.5).alias("lat1"))
    return P.footprint_overlap(boxes, "name", "g")


@query("""WITH p AS (SELECT CAST(o_orderdate AS DATE) AS ref, CAST(o_orderdate AS DATE) + 12 AS sec FROM orders)
SELECT count(*) AS pairs, min(ref) AS first, max(sec) AS latest, 12 AS shortest, min(CASE WHEN sec <= DATE '1997-06-15' THEN DATE '1997-06-15' - sec END) AS days_before_event, NOT coalesce(bool_or(ref <= DATE '1997-06-15' AND sec > DATE '1997-06-15'), false) AS co_event_missing FROM p""")
def acquisition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .statistic_queries import granule_names

    pairs = P.pairs_of_names(granule_names(load(spark, sf_dir, "orders")))
    return P.acquisitions(pairs, F.lit("1997-06-15").cast("date"))


_T = "t AS (SELECT s_suppkey AS target_id, s_acctbal FROM supplier)"


@query("""WITH o AS (SELECT l_suppkey AS target_id, CAST(l_shipdate AS DATE) AS ref, CAST(l_shipdate AS DATE) + 12 AS sec, l_extendedprice / 1000 AS pixel, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS block, l_discount >= 0.02 AS usable FROM lineitem WHERE l_linenumber <= 3),
g AS (SELECT target_id, count(*) AS intervals, max(pixel) AS pixel, max(block) AS block FROM o WHERE usable AND sec < DATE '1997-06-15' AND DATE '1997-06-15' - ref <= 60 GROUP BY 1),
p AS (SELECT l_suppkey AS target_id, count(*) AS phase_pairs, max(l_quantity) AS phase FROM lineitem WHERE l_linenumber = 4 AND l_discount >= 0.05 GROUP BY 1),
c AS (SELECT l_suppkey AS target_id, max(abs(l_extendedprice / 1000 - 40)) AS speed FROM lineitem WHERE l_linenumber = 5 AND l_quantity >= 6 GROUP BY 1),
x AS (SELECT s_suppkey AS target_id, 0.3 + (s_suppkey % 6) / 10.0 AS sens FROM supplier)
SELECT target_id, round(sens, 3) AS sensitivity, coalesce(intervals, 0) AS intervals, round(pixel, 2) AS los_floor_pixel, round(block, 2) AS los_floor_block, round(pixel / abs(sens), 1) AS downslope_bound, round(pixel / (10.0 / 30), 1) AS ratio_pixel,
 round(block / (10.0 / 30), 1) AS ratio_block, round(speed, 2) AS max_speed_common, coalesce(phase_pairs, 0) AS phase_pairs, round(phase, 2) AS phase_floor_pixel FROM x LEFT JOIN g USING (target_id) LEFT JOIN p USING (target_id) LEFT JOIN c USING (target_id)""")
def candidate_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.bound import assess

    rows = load(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "target_id")
    day = F.to_date("l_shipdate")
    file = F.concat_ws("_", F.lit("goff"), F.date_format(day, "yyyyMMdd"), F.date_format(F.date_add(day, 12), "yyyyMMdd"), F.lit("layer2.tif"))
    offsets = rows.where("l_linenumber <= 3").select("target_id", file.alias("file"), (F.col("l_discount") >= 0.02).alias("usable"), (F.col("l_extendedprice") / 1000).alias("local_floor_mm_day"), F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_quantity")).alias("block_median_floor_mm_day"))
    phases = rows.where("l_linenumber = 4").select("target_id", (F.col("l_discount") >= 0.05).alias("usable"), F.col("l_quantity").alias("local_floor_mm_day"), F.lit(None).cast("double").alias("block_median_floor_mm_day"))
    common = rows.where("l_linenumber = 5").select("target_id", F.col("l_quantity").alias("window_px"), (F.col("l_extendedprice") / 1000 - 40).alias("target_mm_day_common_ref"))
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"))
    sens = suppliers.select("target_id", (0.3 + (F.col("target_id") % 6) / 10.0).alias("sensitivity"))
    return assess(suppliers, offsets, phases, common, sens, F.lit("1997-06-15").cast("date")).drop("phase_floor_block")

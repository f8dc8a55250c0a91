"""Grid operators over the vectors read as a raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators import products as P
from ..operators import robust as B
from ..operators import series as V
from ..operators import terrain as T
from ..tables import load, raster
from .registry import query

_P = "p AS (SELECT CAST(vec_id AS INTEGER) AS row, label AS layer, CAST(i - 1 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(load(spark, sf_dir, "embeddings"))


def _dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster as heights."""
    return _pixels(spark, sf_dir).select("row", "col", F.round(F.col("value") * 1000, 1).alias("z"))


_DEM = "z AS (SELECT row, col, round(value * 1000, 1) AS z FROM p)"


@query(f"""WITH {_P}, s AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM p), b AS (SELECT row // 8 AS r, col // 8 AS c, median(value) AS m, count(*) AS n FROM p, s WHERE row // 8 < h // 8 AND col // 8 < w // 8 GROUP BY 1, 2 HAVING count(*) >= 30),
m AS (SELECT median(m) AS mm FROM b) SELECT count(*) AS n_blocks, round(3 * 1.4826 * median(abs(m - mm)) / 7, 6) AS block_median_floor FROM b, m""")
def block_median_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.block_median_floor(_pixels(spark, sf_dir), [], "value", 8, 7.0).withColumn("block_median_floor", F.round("block_median_floor", 6))


@query(f"""WITH {_P}, a AS (SELECT median(value) AS m FROM p), af AS (SELECT count(*) AS n, 3 * 1.4826 * median(abs(value - m)) / 12 AS f FROM p, a), w AS (SELECT value FROM p WHERE row BETWEEN 94 AND 106 AND col BETWEEN 14 AND 26),
wm AS (SELECT median(value) AS m FROM w), wf AS (SELECT count(*) AS n, 3 * 1.4826 * median(abs(value - m)) / 12 AS f FROM w, wm)
SELECT af.n AS aoi_px, wf.n AS window_px, round(af.f, 6) AS aoi_floor, round(wf.f, 6) AS local_floor, round(wf.f / af.f, 6) AS ratio FROM af, wf""")
def window_floor_vs_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.window_against_area(_pixels(spark, sf_dir), [], "value", 100, 20, 6, 12.0)
    return out.select("aoi_px", "window_px", *[F.round(c, 6).alias(c) for c in ("aoi_floor", "local_floor", "ratio")])


@query()
def bootstrap_floor_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bootstrap_floor(B.window(_pixels(spark, sf_dir), 100, 20, 6).withColumn("target", F.lit("w1")), ["target"], "value", 12.0).withColumns({c: F.round(c, 9) for c in ("floor_low", "floor_high")})


@query(f"""WITH {_P}, d AS (SELECT layer, count(*) AS stable_px, median(value) AS m FROM p WHERE col < 32 GROUP BY 1)
SELECT layer, stable_px, round(m, 9) AS datum, (SELECT round(avg(value - m), 9) FROM p WHERE p.layer = d.layer) AS mean_after FROM d""")
def common_datum_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    stable = pixels.where("col < 32").select("row", "col")
    own = B.rereferenced(pixels, stable, "layer", "value")
    return own.groupBy("layer").agg(F.first("stable_px").alias("stable_px"), F.round(F.first("datum"), 9).alias("datum"), F.round(F.avg("value"), 9).alias("mean_after"))


@query(f"""WITH {_P}, c AS (SELECT * FROM (VALUES (50, 10), (200, 40), (400, 60), (52, 12)) AS t(r, k)) SELECT count(*) AS n, CAST(sum(row) AS BIGINT) AS rows_total, CAST(sum(col) AS BIGINT) AS cols_total FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE (row - r) ** 2 + (col - k) ** 2 <= 49)""")
def buffer_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = spark.createDataFrame([(50, 10), (200, 40), (400, 60), (52, 12)], "row int, col int")
    return B.outside_buffers(_pixels(spark, sf_dir), centres, 7).agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows_total"), F.sum("col").alias("cols_total"))


@query(f"WITH {_P}, m AS (SELECT row, median(value) AS m FROM p GROUP BY 1) SELECT p.row, round(max(value - m), 9) AS high, round(min(value - m), 9) AS low FROM p JOIN m USING (row) GROUP BY 1")
def scene_median_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.without_scene_median(_pixels(spark, sf_dir), "row", "value").groupBy("row").agg(F.round(F.max("value"), 9).alias("high"), F.round(F.min("value"), 9).alias("low"))


@query(f"""WITH {_P}, s AS (SELECT row // 8 AS block_row, col // 8 AS block_col, avg(CAST(value > -0.1 AS INTEGER)) AS share, bool_or(row < 64) AS inside, coalesce(avg(CASE WHEN value > -0.1 THEN abs(value) END), 0) AS score FROM p WHERE row // 8 < (SELECT (max(row) + 1) // 8 FROM p) GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN share >= 1 THEN 0 WHEN share >= 0.8 THEN 1 WHEN share >= 0.6 THEN 2 WHEN share >= 0.4 THEN 3 END AS level FROM s WHERE NOT inside AND score > 0)
SELECT block_row, block_col, level, round(score, 9) AS score, 'outside' AS reference_kind FROM k WHERE level IS NOT NULL ORDER BY level, score DESC, block_row, block_col LIMIT 1""")
def reference_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir).withColumn("quality", F.abs("value"))
    out = B.reference_block(pixels, [], 8, F.col("value") > -0.1, F.col("row") < 64, F.lit(True), "quality")
    return out.withColumn("score", F.round("score", 9))


_SHIFT = "x AS (SELECT max(row) AS r1, max(col) AS c1 FROM z), n AS (SELECT a.row, a.col, i, j, b.z AS v FROM z a, x, (VALUES (-1), (0), (1)) AS t(i), (VALUES (-1), (0), (1)) AS u(j), z b WHERE b.row = least(greatest(a.row + i, 0), r1) AND b.col = least(greatest(a.col + j, 0), c1))"


@query(f"""WITH {_P}, {_DEM}, {_SHIFT}, g AS (SELECT row, col, sum(v * j * CASE WHEN i = 0 THEN 2 ELSE 1 END) / 640 AS e, sum(-v * i * CASE WHEN j = 0 THEN 2 ELSE 1 END) / 640 AS n FROM n GROUP BY 1, 2)
SELECT row, col, round(degrees(atan(sqrt(e * e + n * n))), 4) AS slope FROM g""")
def horn_slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.slope_aspect(_dem(spark, sf_dir), "z", 80.0, 80.0).select("row", "col", F.round("slope", 4).alias("slope"))


_STEPS = "t AS (SELECT * FROM (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) AS v(step, di, dj))"
_RECV = _STEPS + ", s AS (SELECT a.row, a.col, b.row AS to_row, b.col AS to_col, step, (a.z - b.z) / CASE WHEN di = 0 OR dj = 0 THEN 80 ELSE sqrt(2) * 80 END AS slope FROM z a, t JOIN z b ON b.row = a.row + di AND b.col = a.col + dj), f AS (SELECT row, col, to_row, to_col, slope FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY slope DESC, step) AS k FROM s WHERE slope > 0) WHERE k = 1)"


@query(f"WITH {_P}, {_DEM}, {_RECV} SELECT row, col, to_row, to_col, round(slope, 6) AS slope FROM f".replace("z a, t JOIN z b ON", "z a JOIN t ON true JOIN z b ON"))
def d8_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.receivers(_dem(spark, sf_dir), 80.0, 80.0, "z").withColumn("slope", F.round("slope", 6))


@query(f"WITH RECURSIVE {_P}, {_DEM}, {_RECV}, up AS (SELECT row, col, row AS ur, col AS uc FROM z UNION ALL SELECT f.to_row, f.to_col, up.ur, up.uc FROM up JOIN f ON f.row = up.row AND f.col = up.col) SELECT row, col, count(*) AS acc FROM up GROUP BY 1, 2".replace("z a, t JOIN z b ON", "z a JOIN t ON true JOIN z b ON"))
def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    dem = _dem(spark, sf_dir)
    return T.flow_accumulation(T.receivers(dem, 80.0, 80.0, "z"), dem)


# each round lowers a cell to the greater of its height and its lowest neighbour
@query(f"""WITH RECURSIVE {_P}, {_DEM}, x AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM z),
w(row, col, filled) USING KEY (row, col) AS (SELECT row, col, CASE WHEN row IN (r0, r1) OR col IN (c0, c1) THEN z ELSE CAST('inf' AS DOUBLE) END FROM z, x
UNION SELECT a.row, a.col, min(greatest(a.z, n.filled)) FROM w AS n, (VALUES (-1), (0), (1)) AS t(i), (VALUES (-1), (0), (1)) AS u(j), z AS a, recurring.w AS o WHERE n.filled < CAST('inf' AS DOUBLE) AND a.row = n.row + i AND a.col = n.col + j AND o.row = a.row AND o.col = a.col AND greatest(a.z, n.filled) < o.filled GROUP BY a.row, a.col)
SELECT w.row, w.col, CASE WHEN z = 0 THEN 0.0 ELSE z END AS z, CASE WHEN filled = 0 THEN 0.0 ELSE filled END AS filled FROM w JOIN z ON z.row = w.row AND z.col = w.col""")
def fill_depressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    unsigned = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c)
    return T.depressions_filled(_dem(spark, sf_dir)).select("row", "col", unsigned("z"), unsigned("filled"))


@query()
def impoundment_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = T.impoundments(_dem(spark, sf_dir), [10.0, 50.0, 100.0], 80.0, 80.0, least_cells=8)
    return T.site_rank(sites.drop("by_height"), ties=("row", "col"))


@query("""WITH RECURSIVE s AS (SELECT p_partkey, 28 + (p_partkey * 7 % 1000) / 5000.0 AS lat, 85 + (p_partkey * 13 % 1000) / 5000.0 AS lon, 10.0 * (1 + p_size % 5) AS threshold_height_m, p_retailprice / 1000 AS efficiency_Mm3_per_m FROM part),
o AS (SELECT *, row_number() OVER (ORDER BY threshold_height_m, efficiency_Mm3_per_m DESC, p_partkey) AS rn FROM s),
k AS (SELECT 1 AS n, rn, [struct_pack(lat := lat, lon := lon)] AS kept FROM o WHERE rn = 1
UNION ALL SELECT x.n + 1, x.rn, list_append(x.kept, struct_pack(lat := o.lat, lon := o.lon)) FROM (SELECT k.n, k.kept, min(o.rn) AS rn FROM k JOIN o ON o.rn > k.rn
 WHERE k.n < 12 AND len(list_filter(k.kept, lambda t: sqrt(((o.lat - t.lat) * 110.57) ** 2 + ((o.lon - t.lon) * 111.32 * cos(radians(o.lat))) ** 2) < 1.5)) = 0 GROUP BY k.n, k.kept) AS x JOIN o ON o.rn = x.rn)
SELECT o.* EXCLUDE (rn) FROM o JOIN k ON k.rn = o.rn""")
def nms_top_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    sites = p.select("p_partkey", (28 + (F.col("p_partkey") * 7 % 1000) / 5000).alias("lat"), (85 + (F.col("p_partkey") * 13 % 1000) / 5000).alias("lon"), (10.0 * (1 + F.col("p_size") % 5)).alias("threshold_height_m"), (F.col("p_retailprice") / 1000).alias("efficiency_Mm3_per_m"))
    return T.suppressed(sites, top=12)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size % 5, p_retailprice DESC, p_partkey) AS rank FROM part")
def dam_site_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("threshold_height_m"), F.col("p_retailprice").alias("efficiency_Mm3_per_m"))
    return T.site_rank(sites, ties=("p_partkey",)).select("p_partkey", "rank")


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity / 1000), 2) AS slope_mm_per_km, round(regr_intercept(l_extendedprice, l_quantity / 1000), 2) AS intercept_mm, round(corr(l_extendedprice, l_quantity / 1000), 6) AS r FROM lineitem GROUP BY 1")
def elevation_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = T.elevation_fit(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", clip=None)
    return fit.select("l_returnflag", "n", F.round("slope_mm_per_km", 2).alias("slope_mm_per_km"), F.round("intercept_mm", 2).alias("intercept_mm"), F.round("r", 6).alias("r"))


def _clip(n: int, source: str) -> str:
    return f"""f{n} AS (SELECT g, regr_slope(d, e) AS s, regr_intercept(d, e) AS i FROM {source} GROUP BY 1), r{n} AS (SELECT p.g, e, d, d - s * e - i AS res FROM p JOIN f{n} USING (g)), m{n} AS (SELECT g, median(res) AS m FROM r{n} GROUP BY 1),
s{n} AS (SELECT g, any_value(m) AS m, 1.4826 * median(abs(res - m)) AS s FROM r{n} JOIN m{n} USING (g) GROUP BY 1), k{n} AS (SELECT r{n}.g, e, d FROM r{n} JOIN s{n} USING (g) WHERE abs(res - m) <= 1.2 * s)"""


@query(f"WITH p AS (SELECT l_returnflag AS g, l_quantity / 1000 AS e, l_extendedprice AS d FROM lineitem), {_clip(1, 'p')}, {_clip(2, 'k1')} SELECT g AS l_returnflag, count(*) AS n_used, round(regr_slope(d, e), 2) AS slope_mm_per_km, round(corr(d, e), 6) AS r FROM k2 GROUP BY 1")
def elevation_trend_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = T.elevation_fit(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", clip=1.2)
    return fit.select("l_returnflag", "n_used", F.round("slope_mm_per_km", 2).alias("slope_mm_per_km"), F.round("r", 6).alias("r"))


@query(f"""WITH {_P}, o AS (SELECT * FROM p WHERE NOT (row BETWEEN 40 AND 80 AND col BETWEEN 10 AND 30)), m AS (SELECT median(value) AS m FROM o), d AS (SELECT any_value(m) AS m, 1.4826 * median(abs(value - m)) AS s FROM o, m), k AS (SELECT o.* FROM o, d WHERE abs(value - m) <= 2 * s),
s AS (SELECT count(*) AS n, avg(col) AS mx, avg(row) AS my, avg(value) AS mz, var_pop(col) AS xx, var_pop(row) AS yy, covar_pop(col, row) AS xy, covar_pop(col, value) AS xz, covar_pop(row, value) AS yz FROM k)
SELECT n, round((xz * yy - yz * xy) / (xx * yy - xy * xy) * 1e6, 4) AS b_scaled, round((yz * xx - xz * xy) / (xx * yy - xy * xy) * 1e6, 4) AS c_scaled FROM s""")
def plane_fit_deramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.col("row").between(40, 80) & F.col("col").between(10, 30)
    fit = T.plane_fit(_pixels(spark, sf_dir), [], "value", stable=~area, clip=2.0)
    return fit.select("n", F.round(F.col("b") * 1e6, 4).alias("b_scaled"), F.round(F.col("c") * 1e6, 4).alias("c_scaled"))


@query(f"""WITH {_P}, m AS (SELECT avg(value) AS m FROM p), a AS (SELECT row, col, value - m AS a FROM p, m), q AS (SELECT avg(a * a) AS sq FROM a)
SELECT CAST(b.col - a.col AS INTEGER) AS lag, round(avg(a.a * b.a) / any_value(sq), 6) AS correlation FROM a JOIN a b ON a.row = b.row AND b.col > a.col AND b.col <= a.col + 8, q GROUP BY 1""")
def lag_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lag_autocorrelation(_pixels(spark, sf_dir), "value", "col", 8).select(F.col("lag").cast("int").alias("lag"), F.round("correlation", 6).alias("correlation"))


@query(f"""WITH {_P}, {_DEM} SELECT q.row AS k, q.col + 0.5 AS x, round(0.75 * (0.5 * q.z + 0.5 * b.z) + 0.25 * (0.5 * c.z + 0.5 * d.z), 6) AS z FROM z q LEFT JOIN z b ON b.row = q.row AND b.col = q.col + 1 LEFT JOIN z c ON c.row = q.row + 1 AND c.col = q.col LEFT JOIN z d ON d.row = q.row + 1 AND d.col = q.col + 1""")
def bilinear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in every cell; NULL where the raster ends beside it."""
    dem = _dem(spark, sf_dir)
    points = dem.select(F.col("row").alias("k"), (F.col("row") + 0.25).alias("y"), (F.col("col") + 0.5).alias("x"))
    return T.bilinear(points, dem, "x", "y", "z").select("k", "x", F.round("z", 6).alias("z"))


_MASK = "c AS (SELECT row, col, value FROM p WHERE value > 0.17)"


@query(f"""WITH RECURSIVE {_P}, {_MASK}, k AS (SELECT a.row * 64 + a.col AS a, b.row * 64 + b.col AS b FROM c a JOIN c b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1), reach AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM reach r JOIN k ON r.b = k.a),
l AS (SELECT a, min(b) AS component FROM reach GROUP BY 1), n AS (SELECT component, count(*) AS n_px FROM l GROUP BY 1 HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (ORDER BY n_px DESC, component) AS cluster FROM n)
SELECT r.cluster, any_value(r.n_px) AS n_px, round(avg(c.row), 6) AS row_centre, round(sum(abs(value) * c.col) / sum(abs(value)), 6) AS col_weighted, max(c.row) - min(c.row) + 1 AS height, max(c.col) - min(c.col) + 1 AS width, round(median(value), 6) AS change_median FROM c JOIN l ON l.a = c.row * 64 + c.col JOIN r USING (component) GROUP BY 1""")
def connected_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cluster_rows(_pixels(spark, sf_dir))


def _cluster_rows(pixels: DataFrame) -> DataFrame:
    cells = pixels.where("value > 0.17").select("row", "col", "value", F.lit(1.0).alias("before"))
    found = graph.clusters(cells, least=3)
    out = P.cluster_measures(found, ["cluster"], "value", "before")
    return out.select("cluster", "n_px", F.round("row_centre", 6).alias("row_centre"), F.round("col_weighted", 6).alias("col_weighted"), "height", "width", F.round("change_median", 6).alias("change_median"))


@query(f"""WITH {_P}, v AS (SELECT col, regr_slope(value, row) * 1000 AS velocity, 1000 * sqrt(greatest(regr_syy(value, row) - regr_sxy(value, row) ** 2 / regr_sxx(value, row), 0) / (count(*) - 2) / regr_sxx(value, row)) AS sigma FROM p GROUP BY 1), m AS (SELECT median(velocity) AS m FROM v), s AS (SELECT any_value(m) AS m, 1.4826 * median(abs(velocity - m)) AS s FROM v, m)
SELECT count(*) AS n, count(*) FILTER (abs(velocity) > 2 * sigma) AS own, count(*) FILTER (abs(velocity - m) > 2 * s) AS population, count(*) FILTER (abs(velocity) > 2 * sigma AND abs(velocity - m) > 2 * s) AS both_ FROM v, s""")
def significant_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    fits = V.pixel_velocity(pixels, ["col"], "row", "value", load(spark, sf_dir, "embeddings").count())
    return V.significant(fits, [], 2.0).select("n", "own", "population", F.col("both").alias("both_"))


@query(f"""WITH {_P} SELECT count(*) AS n, round(median(value), 9) AS median, round(min(value), 9) AS low, round(100.0 * avg(CAST(abs(value) > 0.4 AS INTEGER)), 6) AS was_snow_pct, count(*) > 0 AS observed FROM p WHERE row BETWEEN 30 AND 40 AND col BETWEEN 5 AND 15""")
def probe_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _pixels(spark, sf_dir).withColumn("before", F.abs("value"))
    out = P.probed(cells, 35, 10, 5, "value", "before")
    return out.select("n", F.round("median", 9).alias("median"), F.round("low", 9).alias("low"), F.round("was_snow_pct", 6).alias("was_snow_pct"), "observed")

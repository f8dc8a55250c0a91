"""Series, gates and fits over daily event totals; networks over part-supplier edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, simulate
from ..operators import series as V
from ..tables import daily_series, load
from .forecast import forecast
from .registry import query

_S = "s AS (SELECT event_type AS series, CAST(ts AS DATE) AS epoch, round(sum(value), 6) AS cumulative FROM events GROUP BY 1, 2)"
_V = (
    _S + ", l AS (SELECT series, lag(epoch) OVER w AS t0, epoch AS t1, lag(cumulative) OVER w AS a, cumulative AS b FROM s WINDOW w AS (PARTITION BY series ORDER BY epoch)),"
    " v AS (SELECT series, t0, t1, t1 - t0 AS days, t0 + CAST(floor((t1 - t0) / 2.0) AS INTEGER) AS mid, (b - a) / (t1 - t0) AS v FROM l WHERE t0 IS NOT NULL AND t1 > t0)"
)
_F = "f AS (SELECT event_type AS series, CAST(ts AS DATE) AS t0, 3 * stddev_pop(value) / 20 AS floor FROM events WHERE user_id % 3 = 0 AND day(ts) % 4 <> 0 GROUP BY 1, 2 HAVING stddev_pop(value) > 0)"
_G = _V + ", " + _F + ", g AS (SELECT v.*, coalesce(f.floor, (SELECT max(floor) FROM f)) AS gate, f.floor IS NOT NULL AS own FROM v LEFT JOIN f USING (series, t0))"
_U = _G + ", u AS (SELECT * FROM g WHERE abs(v) > gate), c AS (SELECT *, CASE WHEN (v > 0) = (lag(v) OVER (PARTITION BY series ORDER BY t0) > 0) THEN 0 ELSE 1 END AS turn FROM u), r AS (SELECT *, sum(turn) OVER (PARTITION BY series ORDER BY t0) AS run FROM c)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_series(load(spark, sf_dir, "events"))


def _velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.velocities(_series(spark, sf_dir), ["series"])


def _floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where((F.col("user_id") % 3 == 0) & (F.dayofmonth("ts") % 4 != 0))
    floors = rows.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("t0")).agg((3 * F.stddev_pop("value") / 20).alias("floor"))
    return V.largest_floors(floors, "series", "t0")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gated(_velocities(spark, sf_dir), _floors(spark, sf_dir), ["series", "t0"])


@query(f"WITH {_V} SELECT series, t0, t1, days, mid, round(v, 6) AS v FROM v")
def velocity_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _velocities(spark, sf_dir).withColumn("v", F.round("v", 6))


@query(f"WITH {_G} SELECT series, t0, round(gate, 6) AS gate, own AS gate_is_own, abs(v) > gate AS above FROM g")
def floor_max_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("series", "t0", F.round("gate", 6).alias("gate"), "gate_is_own", "above")


@query(f"""WITH {_U}, n AS (SELECT series, run, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT series, max_by(run, n * 100000 + run) AS run, max(n) AS run_length FROM n GROUP BY 1)
SELECT r.series, t0, t1, round(v, 6) AS v, run_length FROM r JOIN b USING (series, run)""")
def sign_runs_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = V.longest_run(_gated(spark, sf_dir).where("above"), ["series"])
    return run.select("series", "t0", "t1", F.round("v", 6).alias("v"), "run_length")


@query(f"""WITH {_V}, k AS (SELECT series, CASE WHEN v > 0 THEN '+' ELSE '-' END AS s, t0 FROM v), j AS (SELECT series, CAST(s <> lag(s) OVER (PARTITION BY series ORDER BY t0) AS INTEGER) AS flip FROM k)
SELECT series, CAST(coalesce(sum(flip), 0) AS BIGINT) AS reversals, count(*) - 1 AS transitions FROM j GROUP BY 1""")
def sign_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sign_reversals(_velocities(spark, sf_dir), "series", "t0", "v", "t1")


_W = _V + """, w AS (SELECT *, first_value(mid) OVER k AS origin, count(*) OVER k AS n FROM v WHERE v <> 0 WINDOW k AS (PARTITION BY series ORDER BY t0 ROWS 2 PRECEDING)),
x AS (SELECT w.series, w.t0, w.t1, w.origin, p.mid - w.origin AS x, 1 / abs(p.v) AS y FROM w JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t0) AS i FROM v WHERE v <> 0) AS c ON c.series = w.series AND c.t0 = w.t0
 JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t0) AS i FROM v WHERE v <> 0) AS p ON p.series = c.series AND p.i BETWEEN c.i - 2 AND c.i WHERE w.n = 3),
m AS (SELECT series, t0, t1, origin, avg(x) AS mx, avg(y) AS my FROM x GROUP BY 1, 2, 3, 4),
q AS (SELECT series, t0, t1, origin, mx, my, sum((x - mx) ** 2) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) ** 2) AS syy FROM x JOIN m USING (series, t0, t1, origin) GROUP BY 1, 2, 3, 4, 5, 6),
fit AS (SELECT *, sxy / sxx AS a, my - sxy / sxx * mx AS b, greatest(syy - sxy * sxy / sxx, 0) AS res FROM q)"""


@query(f"WITH {_W} SELECT series, t0, origin, round(a, 6) AS slope, round(b, 4) AS intercept, round(CASE WHEN syy > 0 THEN 1 - res / syy ELSE 0 END, 4) AS r2 FROM fit")
def inverse_velocity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = V.window_fits(_velocities(spark, sf_dir).where("v <> 0"), ["series"])
    return fits.select("series", "t0", "origin", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 4).alias("r2"))


@query(f"""WITH {_W}, z AS (SELECT *, 12.706 ** 2 AS tc, res / sxx AS vaa, -mx * res / sxx AS vab, res / 3 + mx * mx * res / sxx AS vbb FROM fit),
k AS (SELECT *, a * a - tc * vaa AS qa, 2 * (a * b - tc * vab) AS qb, b * b - tc * vbb AS qc FROM z), d AS (SELECT *, a <> 0 AND qa > 0 AND qb * qb - 4 * qa * qc >= 0 AS bounded FROM k)
SELECT series, t0, bounded AS ci_bounded, round(CASE WHEN bounded THEN (-qb - sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa) END, 3) AS ci_low, round(CASE WHEN bounded THEN (-qb + sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa) END, 3) AS ci_high FROM d""")
def fieller_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = V.fieller(V.window_fits(_velocities(spark, sf_dir).where("v <> 0"), ["series"]))
    return fits.select("series", "t0", "ci_bounded", F.round("ci_low", 3).alias("ci_low"), F.round("ci_high", 3).alias("ci_high"))


@query(f"WITH {_V} SELECT series, count(*) FILTER (t1 < DATE '2024-01-20') AS kept, count(*) FILTER (t1 >= DATE '2024-01-20') AS dropped FROM v GROUP BY 1")
def forecast_cutoff_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = V.cutoff(_velocities(spark, sf_dir), F.lit("2024-01-20").cast("date"))
    a, b = (x.groupBy("series").agg(F.count(F.lit(1)).alias(n)) for x, n in ((kept, "kept"), (dropped, "dropped")))
    return a.join(b, "series", "full").na.fill(0)


@query()
def forecast_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast(_series(spark, sf_dir), ["series"], _floors(spark, sf_dir), ["series", "t0"], r2_min=0.3, day=F.lit("2024-01-28").cast("date"))


@query(f"""WITH {_S}, d AS (SELECT series, epoch - min(epoch) OVER (PARTITION BY series) AS x, cumulative AS y FROM s)
SELECT series, count(*) AS n, round(regr_slope(y, x), 6) AS velocity, round(sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x), 0) / greatest(count(*) - 2, 1) / regr_sxx(y, x)), 6) AS sigma FROM d GROUP BY 1""")
def chain_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = V.days_from_start(_series(spark, sf_dir), ["series"])
    epochs = days.select("epoch").distinct().count()
    out = V.pixel_velocity(days, ["series"], "days_from_start", "cumulative", epochs)
    return out.select("series", "n", F.round("velocity", 6).alias("velocity"), F.round("sigma", 6).alias("sigma"))


@query("""WITH p AS (SELECT l_suppkey % 20 AS track, l_orderkey, l_linenumber, CASE WHEN l_tax = 0.08 THEN NULL ELSE l_quantity END AS d FROM lineitem),
w AS (SELECT *, sum(d) OVER k AS c, bool_and(d IS NOT NULL) OVER k AS ok FROM p WINDOW k AS (PARTITION BY track ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING))
SELECT track, l_orderkey, l_linenumber, CASE WHEN ok THEN c END AS cumulative FROM w""")
def cumulative_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.coalesce(F.col("l_tax") == 0.08, F.lit(False))  # an unknown tax is no gap
    p = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("track"), "l_orderkey", "l_linenumber", F.when(~gap, F.col("l_quantity")).alias("d"))
    return V.accumulated(p, ["track"], "d", ("l_orderkey", "l_linenumber")).select("track", "l_orderkey", "l_linenumber", "cumulative")


_SENS = {"click": -0.889, "view": 0.163, "purchase": 0.5}


@query(f"""WITH {_S}, k AS (SELECT series, epoch, cumulative, CASE WHEN length(series) % 3 = 0 THEN -0.889 WHEN length(series) % 3 = 1 THEN 0.163 ELSE 0.5 END AS sens FROM s),
m AS (SELECT epoch, sum(sens * sens * cumulative / sens) / sum(sens * sens) AS merged, count(*) AS n FROM k WHERE abs(sens) >= 0.3 GROUP BY 1) SELECT epoch, round(merged, 4) AS merged, n FROM m""")
def downslope_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    third = F.length("series") % 3
    sens = s.select("series").distinct().withColumn("sensitivity", F.when(third == 0, -0.889).when(third == 1, 0.163).otherwise(0.5))
    d = V.downslope(s, sens, ["series"])
    return d.groupBy("epoch").agg(F.round(F.sum(F.col("weight") * F.col("downslope")) / F.sum("weight"), 4).alias("merged"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_V}, a AS (SELECT t0, avg(v) AS area FROM v GROUP BY 1)
SELECT v.series, count(*) AS n, round(sum(v.v - a.area) / sum(v.days), 6) AS rate FROM v JOIN a USING (t0) WHERE (length(v.series) + day(t0)) % 30 >= 8 GROUP BY 1""")
def local_minus_area_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _velocities(spark, sf_dir)
    area = v.groupBy("t0").agg(F.avg("v").alias("area"))
    joined = v.join(area, "t0").withColumn("px", 12 + (F.length("series") + F.dayofmonth("t0")) % 30)
    return V.group_rates(joined, ["series"], "v", "area", "days", "px").withColumn("rate", F.round("rate", 6))


@query(f"WITH {_S}, g AS (SELECT series, epoch, epoch - lag(epoch) OVER (PARTITION BY series ORDER BY epoch) AS gap_days, epoch - min(epoch) OVER (PARTITION BY series) AS days_from_start, max(CASE WHEN epoch <= DATE '2024-01-15' THEN epoch END) OVER (PARTITION BY series) = epoch AS last FROM s) SELECT series, epoch, gap_days, days_from_start, coalesce(last, false) AS last_before_event FROM g WHERE gap_days > 0")
def epoch_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.last_before(V.days_from_start(_series(spark, sf_dir), ["series"]), ["series"], F.lit("2024-01-15").cast("date"))
    return V.merge_gaps(s, ["series"]).select("series", "epoch", "gap_days", "days_from_start", "last_before_event")


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS track, CAST(l_shipdate AS DATE) AS ref, CAST(l_shipdate AS DATE) + CAST(7 + l_suppkey % 3 AS INTEGER) AS sec FROM lineitem),
c AS (SELECT *, CASE WHEN lag(sec) OVER (PARTITION BY track ORDER BY ref, sec) = ref THEN 0 ELSE 1 END AS start FROM p) SELECT track, count(*) AS pairs, CAST(sum(start) AS BIGINT) AS chains FROM c GROUP BY 1""")
def chain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.to_date("l_shipdate")
    p = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("track"), ref.alias("ref"), F.date_add(ref, (7 + F.col("l_suppkey") % 3).cast("int")).alias("sec")).distinct()
    return V.chains(p, ["track"]).groupBy("track").agg(F.count(F.lit(1)).alias("pairs"), F.max("chain").alias("chains"))


_E = "e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), k AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"
# labels by node: each round lowers a node's label to its neighbours' least
_C = _E + ", c(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM k UNION SELECT k.a, min(x.component) FROM c AS x JOIN k ON k.b = x.node JOIN recurring.c AS o ON o.node = k.a WHERE x.component < o.component GROUP BY k.a)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("ref"), F.concat(F.lit("s"), "l_suppkey").alias("sec")).distinct()


@query(f"WITH RECURSIVE {_C} SELECT node, component FROM c")
def network_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_edges(spark, sf_dir), "ref", "sec")


@query(f"WITH RECURSIVE {_C} SELECT component, count(DISTINCT e.a) + count(DISTINCT e.b) AS epochs, count(*) AS pairs, count(*) - (count(DISTINCT e.a) + count(DISTINCT e.b) - 1) AS redundancy FROM e JOIN c ON c.node = e.a GROUP BY 1")
def network_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.redundancy(edges, [], "ref", "sec", graph.connected_components(edges, "ref", "sec")).select("component", "epochs", "pairs", "redundancy")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring and next-but-one epochs as measured pairs, with a loop misfit."""
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("epoch")
    s = _series(spark, sf_dir)
    one = s.select("series", F.lag("epoch").over(w).alias("ref"), F.col("epoch").alias("sec"), (F.col("cumulative") - F.lag("cumulative").over(w)).alias("value"))
    two = s.select("series", F.lag("epoch", 2).over(w).alias("ref"), F.col("epoch").alias("sec"), (F.col("cumulative") - F.lag("cumulative", 2).over(w) + F.dayofmonth("epoch") % 3).alias("value"))
    return one.unionByName(two).where("ref IS NOT NULL")


@query()
def network_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.invert_network(_pairs(spark, sf_dir), ["series"]).withColumns({c: F.round(c, 6) for c in ("cumulative", "error", "rate", "rate_error", "sigma")})


@query()
def jackknife_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.jackknife(_pairs(spark, sf_dir), ["series"]).withColumns({c: F.round(c, 6) for c in ("rate", "low", "high")})


@query()
def detectability_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.sweep(spark, [5.0, 10.0, 20.0, 40.0])


@query()
def detectability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.summary(simulate.sweep(spark, [10.0, 40.0], trials=100, nulls=100))

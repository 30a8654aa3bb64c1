"""R: reports over result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import elongation
from ..operators import report
from .proxies import RESULTS_SQL, results
from .registry import query, table

_W = f"WITH {RESULTS_SQL} "
KEYS = ["thickness", "name", "num_ang", "max_ang"]


#: Averages differ in their last bits by the order of summing; percentiles do not, but often end in a 5.
_DIGITS = {"estimate": 6}


def _rounded(df, *columns, digits=None, median=False):
    return df.withColumns({c: F.round(c, digits or (9 if median else _DIGITS.get(c, 9))) for c in columns})


def _ok(spark, sf):
    return report.clean(results(spark, sf)).filter("status = 'ok'")


@query("r01_load_with_catalog", _W + """
SELECT clean.thickness, s_name AS tomogram, n_name AS site, count(*) AS n, count(clean.res) AS n_ok, round(avg(clean.res), 6) AS res
FROM clean JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def r01(spark, sf):
    catalog = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("tomogram"), F.col("n_name").alias("site"))
    joined = report.load_results(results(spark, sf), catalog, on=["l_suppkey"])
    return joined.groupBy("thickness", "tomogram", "site").agg(F.count(F.lit(1)).alias("n"), F.count("res").alias("n_ok"), F.round(F.avg("res"), 6).alias("res"))


@query("r02_constant_increment_load", _W + """, grid AS (SELECT unnest([11, 21, 31, 41]) AS num_ang, unnest([10.0, 20.0, 30.0, 40.0])::DOUBLE AS max_ang)
SELECT num_ang, max_ang, count(*) AS n, round(avg(res), 6) AS res FROM clean SEMI JOIN grid USING (num_ang, max_ang) GROUP BY ALL""")
def r02(spark, sf):
    from ..plans.grids import const_increment_grid

    grid = const_increment_grid(spark, [11, 21, 31, 41], [10.0, 20.0, 30.0, 40.0])
    return report.clean(results(spark, sf)).join(F.broadcast(grid), ["num_ang", "max_ang"], "left_semi").groupBy("num_ang", "max_ang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("res"), 6).alias("res"))


_AVG = """, a AS (SELECT thickness, name, num_ang, max_ang, avg({col}) AS res, avg(corr) AS corr FROM {src} WHERE ref = 'a' GROUP BY ALL),
b AS (SELECT thickness, name, num_ang, max_ang, avg({col}) AS res, avg(corr) AS corr FROM {src} WHERE ref = 'b' GROUP BY ALL)
SELECT thickness, name, num_ang, max_ang, round((a.res + b.res) / 2, 8) AS res, round((a.corr + b.corr) / 2, 8) AS corr FROM a JOIN b USING (thickness, name, num_ang, max_ang)"""


def _refs(df):
    """Averages of either reference, of the runs that both have."""
    per_run = df.groupBy("ref", *KEYS).agg(F.avg("res").alias("res"), F.avg("corr").alias("corr"))
    a, b = per_run.filter("ref = 'a'"), per_run.filter("ref = 'b'")
    gone = report.unmatched_refs(a, b, KEYS).select(*KEYS)
    return a.join(gone, KEYS, "left_anti"), b.join(gone, KEYS, "left_anti")


@query("r03_average_refs", _W + _AVG.format(col="res", src="clean"))
def r03(spark, sf):
    a, b = _refs(report.clean(results(spark, sf)))
    return _rounded(report.average_refs(a, b, KEYS, ("res", "corr")), "res", "corr", digits=8)


@query("r03_average_refs_compat", _W + _AVG.format(col="CASE WHEN isnan(res) THEN NULL ELSE res END", src="results"))
def r03_compat(spark, sf):
    a, b = _refs(results(spark, sf).withColumn("res", F.when(~F.isnan("res"), F.col("res"))))
    return _rounded(report.average_refs(a, b, KEYS, ("res", "corr"), compat=True), "res", "corr", digits=8)


_SIDES = """, a AS (SELECT DISTINCT thickness, name, num_ang, max_ang, l_partkey FROM results WHERE ref = 'a'), b AS (SELECT DISTINCT thickness, name, num_ang, max_ang, l_partkey FROM results WHERE ref = 'b')
SELECT *, 'a' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE (a.thickness, a.name, a.num_ang, a.max_ang, a.l_partkey) = (b.thickness, b.name, b.num_ang, b.max_ang, b.l_partkey))
UNION ALL SELECT *, 'b' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE (a.thickness, a.name, a.num_ang, a.max_ang, a.l_partkey) = (b.thickness, b.name, b.num_ang, b.max_ang, b.l_partkey))"""


@query("r03_unmatched_refs", _W + _SIDES)
def r03_unmatched(spark, sf):
    df = results(spark, sf)
    return report.unmatched_refs(df.filter("ref = 'a'"), df.filter("ref = 'b'"), [*KEYS, "l_partkey"])


@query("r04_filters", _W + """SELECT l_orderkey, thickness, num_ang, max_ang, x, y, res FROM clean
WHERE thickness IN ('250nm', '500nm') AND x BETWEEN 100 AND 1900 AND y BETWEEN 100 AND 1900 AND res > 0 AND num_ang = 21""")
def r04(spark, sf):
    kept = report.in_range(results(spark, sf), ["250nm", "500nm"], (100, 1900), complete=["corr"]).filter("num_ang = 21")
    return kept.select("l_orderkey", "thickness", "num_ang", "max_ang", "x", "y", "res")


_STATS = """SELECT {by}, round({centre}, {d}) AS estimate, round(quantile_cont({v}, 0.25), 9) AS low, round(quantile_cont({v}, 0.75), 9) AS high, count({v}) AS n FROM clean WHERE res > 0 GROUP BY ALL"""


@query("r05_mean_interval", _W + _STATS.format(by="num_ang, thickness", centre="avg(res)", v="res", d=6))
def r05_mean(spark, sf):
    return _rounded(report.point_stats(_ok(spark, sf), ["num_ang", "thickness"], "res", exact="refined"), "estimate", "low", "high")


@query("r05_median_interval", _W + _STATS.format(by="max_ang, thickness", centre="quantile_cont(res, 0.5)", v="res", d=9))
def r05_median(spark, sf):
    return _rounded(report.point_stats(_ok(spark, sf), ["max_ang", "thickness"], "res", "median", exact="refined"), "estimate", "low", "high", median=True)


@query("r06_mean_only", _W + "SELECT num_ang, max_ang, round(avg(res), 6) AS estimate FROM clean WHERE res > 0 GROUP BY ALL")
def r06(spark, sf):
    return _ok(spark, sf).groupBy("num_ang", "max_ang").agg(F.round(F.avg("res"), 6).alias("estimate"))


@query("r07_group_summary", _W + """SELECT thickness, num_ang, round(avg(res), 6) AS estimate,
round((quantile_cont(res, 0.75) - quantile_cont(res, 0.25)) / 2, 9) AS iqr_half, count(res) AS n FROM clean WHERE res > 0 GROUP BY ALL""")
def r07(spark, sf):
    return _rounded(report.iqr_half(_ok(spark, sf), ["thickness", "num_ang"], "res", exact="refined"), "estimate", "iqr_half")


@query("r07_median_summary", _W + """SELECT thickness, round(quantile_cont(res, 0.5), 9) AS estimate,
round((quantile_cont(res, 0.75) - quantile_cont(res, 0.25)) / 2, 9) AS iqr_half, count(res) AS n FROM clean WHERE res > 0 AND num_ang = 21 GROUP BY ALL""")
def r07_median(spark, sf):
    return _rounded(report.iqr_half(_ok(spark, sf).filter("num_ang = 21"), ["thickness"], "res", "median", exact="refined"), "estimate", "iqr_half", median=True)


_CELLS = [float(45 * i) for i in range(4)]


@query("r08_heatmap", _W + ", cells AS (SELECT num_ang, z, round(avg(res), 6) AS res FROM clean WHERE res > 0 GROUP BY ALL) SELECT num_ang, "
       + ", ".join(f'max(res) FILTER (z = {c}) AS "z{int(c)}"' for c in _CELLS) + " FROM cells GROUP BY num_ang")
def r08(spark, sf):
    cells = _ok(spark, sf).groupBy("num_ang", "z").agg(F.round(F.avg("res"), 6).alias("res"))
    wide = report.heatmap(cells, "num_ang", "z", "res", _CELLS)
    return wide.select("num_ang", *[F.col(f"`{c}`").alias(f"z{int(c)}") for c in _CELLS])


@query("r09_profile_by_position", _W + _STATS.format(by="x, thickness", centre="avg(res)", v="res", d=6))
def r09(spark, sf):
    return _rounded(report.point_stats(_ok(spark, sf), ["x", "thickness"], "res", exact="refined"), "estimate", "low", "high")


@query("r10_in_pixels", _W + "SELECT thickness, num_ang, round(avg(res / pixel_size), 6) AS estimate FROM clean WHERE res > 0 GROUP BY ALL")
def r10(spark, sf):
    return report.in_pixels(_ok(spark, sf)).groupBy("thickness", "num_ang").agg(F.round(F.avg("res_px"), 6).alias("estimate"))


_E = "sqrt((radians({a}) + sin(radians({a})) * cos(radians({a}))) / nullif(radians({a}) - sin(radians({a})) * cos(radians({a})), 0))"


@query("r11_elongation", _W + f"SELECT DISTINCT max_ang, round({_E.format(a='max_ang')}, 6) AS elongation FROM results")
def r11(spark, sf):
    return results(spark, sf).select("max_ang").distinct().select("max_ang", F.round(elongation(F.col("max_ang")), 6).alias("elongation"))


@query("r12_z_resolution", _W + f"SELECT thickness, max_ang, round(avg(res * {_E.format(a='max_ang')}), 5) AS res_z FROM clean WHERE res > 0 GROUP BY ALL")
def r12(spark, sf):
    return report.z_resolution(_ok(spark, sf)).groupBy("thickness", "max_ang").agg(F.round(F.avg("res_z"), 5).alias("res_z"))


@query("r13_full_array", _W + "SELECT pixel_size, thickness, max_ang, num_ang, round(quantile_cont(res, 0.5), 9) AS estimate FROM clean WHERE res > 0 GROUP BY ALL")
def r13(spark, sf):
    cells = report.point_stats(_ok(spark, sf), ["pixel_size", "thickness", "max_ang", "num_ang"], "res", "median", exact="refined")
    return cells.select("pixel_size", "thickness", "max_ang", "num_ang", F.round("estimate", 9).alias("estimate"))


@query("r13_rollup", _W + "SELECT thickness, num_ang, count(*) AS n, round(avg(res), 6) AS estimate FROM clean WHERE res > 0 GROUP BY ROLLUP (thickness, num_ang)")
def r13_rollup(spark, sf):
    return _ok(spark, sf).rollup("thickness", "num_ang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("res"), 6).alias("estimate"))


@query("r14_correlation", _W + "SELECT max_ang, num_ang, round(quantile_cont(corr, 0.5), 9) AS estimate, round(quantile_cont(corr, 0.25), 9) AS low, round(quantile_cont(corr, 0.75), 9) AS high, count(corr) AS n FROM clean GROUP BY ALL")
def r14(spark, sf):
    return _rounded(report.point_stats(report.clean(results(spark, sf)), ["max_ang", "num_ang"], "corr", "median", exact="refined"), "estimate", "low", "high", median=True)


@query("r15_distinct_values", _W + "SELECT DISTINCT name, max_ang FROM results")
def r15(spark, sf):
    return results(spark, sf).select("name", "max_ang").distinct()


@query("r16_theory_curve", _W + f"""g AS (SELECT thickness, name, min(max_ang) AS lo, max(max_ang) AS hi FROM results GROUP BY ALL), p AS (SELECT thickness, name, i, lo + i * ((hi - lo) / 49) AS alpha FROM (SELECT *, unnest(range(50)) AS i FROM g))
SELECT thickness, name, i::INT AS i, round(alpha, 9) AS alpha, round({_E.format(a='alpha')}, 9) AS elongation FROM p""".replace("g AS (", "SELECT * FROM (WITH g AS (", 1) + ")")
def r16(spark, sf):
    ranges = results(spark, sf).groupBy("thickness", "name").agg(F.min("max_ang").alias("low"), F.max("max_ang").alias("high"))
    return _rounded(report.theory_curve(ranges, 50), "alpha", "elongation").select("thickness", "name", "i", "alpha", "elongation")


@query("r17_constant_of_group", _W + "SELECT thickness, min(pixel_size) AS pixel_size, min(pixel_size) = max(pixel_size) AS single FROM results GROUP BY ALL")
def r17(spark, sf):
    return report.constant(results(spark, sf), ["thickness"], "pixel_size")

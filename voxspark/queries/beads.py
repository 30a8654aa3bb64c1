"""D: point-source resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import beads as bd
from ..plans.grids import roi_plan
from .fourier import bricks, clean0
from .proxies import VOXELS_SQL, voxels
from .registry import query, table

_V = f"WITH {VOXELS_SQL}"
# measurements of beads: a bead for each order, its number and reconstruction from the line
_FITS = """fits AS (SELECT l_orderkey AS bead, 'tomo' || (l_suppkey % 7)::VARCHAR AS tomogram, 'r' || l_linenumber::VARCHAR AS recon,
  CASE WHEN l_tax > 0.07 THEN NULL ELSE l_quantity / 10 END AS fwhm_x, l_discount * 50 + 1 AS fwhm_y, l_extendedprice / 20000 AS fwhm_z, 1 - l_discount * 4 AS r2_x, 1 - l_tax * 4 AS r2_y, 1 - l_tax * 5 AS r2_z FROM lineitem)"""


def fits(spark, sf):
    tax, off = F.col("l_tax"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("bead"), F.concat(F.lit("tomo"), (F.col("l_suppkey") % 7).cast("string")).alias("tomogram"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("recon"),
        F.when(tax <= 0.07, F.col("l_quantity") / 10).alias("fwhm_x"), (off * 50 + 1).alias("fwhm_y"), (F.col("l_extendedprice") / 20000).alias("fwhm_z"),
        (1 - off * 4).alias("r2_x"), (1 - tax * 4).alias("r2_y"), (1 - tax * 5).alias("r2_z"),
    )


_LONG = _FITS + ", long AS (SELECT tomogram, recon, bead, axis, value FROM (SELECT *, unnest(['x', 'y', 'z']) AS axis, unnest([fwhm_x, fwhm_y, fwhm_z]) AS value FROM fits))"


def long(spark, sf):
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"fwhm_{a}").alias("value")) for a in "xyz"]))
    return fits(spark, sf).withColumn("e", axes).select("tomogram", "recon", "bead", "e.axis", "e.value")


# profiles with known parameters: a dark bead on a bright ground
_PLANT = "plant AS (SELECT o_orderkey AS bead, -(1.0 + o_custkey % 5)::DOUBLE AS a, 10.0 + (o_orderkey % 7) * 0.5::DOUBLE AS x0, 2.0 + (o_custkey % 10) * 0.2::DOUBLE AS s, 10.0::DOUBLE AS c FROM orders)"
_SAMPLES = _PLANT + ", samples AS (SELECT *, i, a * exp(-((i - x0) ** 2) / (2 * s ** 2)) + c AS v FROM (SELECT *, unnest(range(24)) AS i FROM plant))"


#: Samples of a profile, as in the SQL.
SAMPLES = 24


def planted(spark, sf):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(k.alias("bead"), (-(u % 5 + 1.0)).alias("a"), (k % 7 * 0.5 + 10.0).alias("x0"), (u % 10 * 0.2 + 2.0).alias("s"), F.lit(10.0).alias("c"))


def profiles(spark, sf):
    # an expression for each of the samples, which Spark compiles; it interprets the functions of transform()
    return planted(spark, sf).withColumn("samples", F.array(*[C.gaussian(F.lit(float(i)), F.col("a"), F.col("x0"), F.col("s"), F.col("c")) for i in range(SAMPLES)]))


# beads are numbered anew in each volume: two of each number, in boxes of their own
_BOXES = "boxes AS (SELECT k.b + vec_id % 3 AS bead, vec_id AS vol_id, (vec_id % 4 - 2)::INT AS z0, (vec_id // 4 % 4 - 2)::INT AS x0, ((vec_id // 16 + k.b) % 4 - 2)::INT AS y0 FROM embeddings, (SELECT unnest([0, 1]) AS b) k), grid AS (SELECT a.i::INT AS dz, b.i::INT AS dx, c.i::INT AS dy FROM range(4) a(i), range(4) b(i), range(4) c(i))"


@query("d01_roi_padded", f"{_V}, {_BOXES} SELECT boxes.vol_id, bead, count(*) AS n, count(v) AS n_inside, round(sum(v * (1 + dz * 16 + dx * 4 + dy)), 6) + 0.0 AS total FROM boxes CROSS JOIN grid LEFT JOIN voxels ON voxels.vol_id = boxes.vol_id AND z = z0 + dz AND x = x0 + dx AND y = y0 + dy GROUP BY boxes.vol_id, bead")
def d01(spark, sf):
    k, b = F.col("vec_id"), F.col("b")
    numbered = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("b"))
    points = numbered.select((b + k % 3).alias("bead"), k.alias("vol_id"), (k % 4).cast("int").alias("z"), (F.floor(k / 4) % 4).cast("int").alias("x"), ((F.floor(k / 16) + b) % 4).cast("int").alias("y"))
    boxes = roi_plan(points, 4, "plain")
    roi = bd.roi_voxels(bd.roi_arrays(bricks(spark, sf), boxes, (4, 4, 4), 4), 4)
    weight = 1 + F.col("dz") * 16 + F.col("dx") * 4 + F.col("dy")
    return roi.groupBy("vol_id", "bead").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_inside"), clean0(F.sum(F.col("v") * weight), 6).alias("total"))


@query("d02_roi_inside", f"{_V}, b AS (SELECT vec_id AS vol_id, greatest(least(vec_id % 4 + 1, 3) - 2, 0) AS z0, greatest(least(vec_id // 4 % 4 + 1, 3) - 2, 0) AS x0, greatest(least(vec_id // 16 % 4 + 1, 3) - 2, 0) AS y0 FROM embeddings) SELECT b.vol_id AS bead, count(v) AS n, round(sum(v), 6) + 0.0 AS total FROM b JOIN voxels USING (vol_id) WHERE z BETWEEN z0 AND z0 + 1 AND x BETWEEN x0 AND x0 + 1 AND y BETWEEN y0 AND y0 + 1 GROUP BY b.vol_id")
def d02(spark, sf):
    k = F.col("vec_id")
    points = table(spark, sf, "embeddings").select(k.alias("bead"), k.alias("vol_id"), *[(F.floor(k / d) % 4).cast("int").alias(a) for a, d in (("z", 1), ("x", 4), ("y", 16))], *[F.lit(4).alias(f"n{a}") for a in "xyz"])
    roi = bd.roi_voxels(bd.roi_arrays(bricks(spark, sf), roi_plan(points, 2, "shift").filter("fits"), (4, 4, 4), 2), 2)
    return roi.groupBy("bead").agg(F.count("v").alias("n"), clean0(F.sum("v"), 6).alias("total"))


@query("d03_plan_all_recons", """WITH points AS (SELECT o_custkey % 16 AS tomogram, o_orderkey AS bead_id, (o_orderkey * 7 % 100)::INT AS x, (o_orderkey % 60)::INT AS z FROM orders), labels_ AS (SELECT tomogram, unnest(range(1 + tomogram % 3)) AS k FROM (SELECT DISTINCT tomogram FROM points))
SELECT tomogram, (k * 10 + 11)::VARCHAR || '_lim15' AS recon_label, bead_id, greatest(x - 18, 0) AS x0, greatest(least(x + 18, 100) - greatest(x - 18, 0), 0) AS x_size, greatest(z - 18, 0) AS z0 FROM points JOIN labels_ USING (tomogram)""")
def d03(spark, sf):
    from .planning import points

    p = points(spark, sf)
    labels = F.transform(F.sequence(F.lit(0), (F.col("tomogram") % 3).cast("int")), lambda k: F.concat((k * 10 + 11).cast("string"), F.lit("_lim15")))
    config = p.select("tomogram").distinct().select("tomogram", labels.alias("recon_labels"))
    return bd.plan_all_recons(config, p, 36).select("tomogram", "recon_label", "bead_id", "x0", "x_size", "z0")


@query("d03_boxes_of_all_recons", f"""{_V}, points AS (SELECT vec_id // 3 AS tomogram, unnest([0, 1]) AS bead, vec_id % 3 AS k, vec_id FROM embeddings)
SELECT vec_id AS vol_id, tomogram, k::INT AS "order", bead, count(v) AS n, round(sum(v * (1 + z * 16 + x * 4 + y)), 6) + 0.0 AS total FROM points JOIN voxels ON vol_id = vec_id WHERE z BETWEEN bead AND bead + 1 AND x BETWEEN 1 AND 2 AND y BETWEEN 1 + bead AND 2 + bead GROUP BY ALL""")
def d03_boxes(spark, sf):
    """Three reconstructions for each tomogram, and the same bead numbers in all of them."""
    k = F.col("vec_id")
    recons = table(spark, sf, "embeddings").select(F.floor(k / 3).alias("tomogram"), (k % 3).cast("int").alias("order"), k.alias("vol_id"))
    config = recons.groupBy("tomogram").agg(F.transform(F.sequence(F.lit(0), F.max("order")), lambda i: i.cast("string")).alias("recon_labels"))
    sizes = [F.lit(4).alias(f"n{a}") for a in "xyz"]
    points = config.select("tomogram", F.explode(F.array(F.lit(0), F.lit(1))).alias("bead_id")).select("tomogram", "bead_id", F.lit(2).alias("x"), (F.col("bead_id") + 2).alias("y"), (F.col("bead_id") + 1).alias("z"), *sizes)
    plan = bd.plan_all_recons(config, points, 2, "plain").join(recons, ["tomogram", "order"])
    boxes = plan.withColumnRenamed("bead_id", "bead")
    roi = bd.roi_voxels(bd.roi_arrays(bricks(spark, sf), boxes, (4, 4, 4), 2), 2).join(boxes.select("vol_id", "bead", "tomogram", "order", "z0", "x0", "y0"), ["vol_id", "bead"])
    place = 1 + (F.col("dz") + F.col("z0")) * 16 + (F.col("dx") + F.col("x0")) * 4 + F.col("dy") + F.col("y0")
    return roi.groupBy("vol_id", "tomogram", "order", "bead").agg(F.count("v").alias("n"), clean0(F.sum(F.col("v") * place), 6).alias("total"))


def roi(spark, sf):
    return voxels(spark, sf).select(F.col("vol_id").alias("bead"), F.col("z").alias("dz"), F.col("x").alias("dx"), F.col("y").alias("dy"), "v")


def joined_samples(df, digits=6):
    return df.withColumn("samples", F.transform("samples", lambda v: F.round(v, digits) + 0.0)).select("bead", "axis", *[F.get("samples", F.lit(i)).alias(f"s{i}") for i in range(4)])


def _profile_sql(low, high):
    parts = [f"SELECT vol_id AS bead, '{a}' AS axis, {a} AS i, avg(v) AS v FROM voxels WHERE {b} BETWEEN {low} AND {high} AND {c} BETWEEN {low} AND {high} GROUP BY ALL" for a, b, c in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))]
    return f"{_V}, p AS ({' UNION ALL '.join(parts)}) SELECT bead, axis, " + ", ".join(f"round(max(v) FILTER (i = {i}), 6) + 0.0 AS s{i}" for i in range(4)) + " FROM p GROUP BY bead, axis"


@query("d04_centre_profiles", _profile_sql(2, 2))
def d04(spark, sf):
    return joined_samples(bd.centre_profiles(roi(spark, sf), ["bead"], 4))


@query("d05_thick_profiles", _profile_sql(1, 3))
def d05(spark, sf):
    return joined_samples(bd.centre_profiles(roi(spark, sf), ["bead"], 4, 2))


@query("d06_exact_width_profiles", _profile_sql(1, 2))
def d06(spark, sf):
    return joined_samples(bd.centre_profiles(roi(spark, sf), ["bead"], 4, 2, exact=True))


@query("d07_moving_average", "SELECT vec_id, i::INT AS i, round((v0 + v1 + v2 + v3) / 4, 7) + 0.0 AS v FROM (SELECT vec_id, i, e[greatest(i - 2, 0) + 1]::DOUBLE AS v0, e[greatest(i - 1, 0) + 1]::DOUBLE AS v1, e[i + 1]::DOUBLE AS v2, e[least(i + 1, 63) + 1]::DOUBLE AS v3 FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings))")
def d07(spark, sf):
    smooth = C.moving_average(F.col("embedding").cast("array<double>"), 4)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(smooth).alias("i", "v")).withColumn("v", clean0(F.col("v"), 7))


_TRIM = "t AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.2 THEN NULL ELSE x END) AS e FROM embeddings), f AS (SELECT vec_id, e, list_position(list_transform(e, lambda x: x IS NOT NULL), true) AS a, 65 - list_position(list_transform(list_reverse(e), lambda x: x IS NOT NULL), true) AS b FROM t)"


@query("d08_trim_nan", f"WITH {_TRIM} SELECT vec_id, CASE WHEN a IS NULL OR b - a + 1 < 7 THEN 0 ELSE b - a + 1 END::INT AS n FROM f")
def d08(spark, sf):
    holes = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(F.abs(v.cast("float")) < F.lit(0.2), None).otherwise(v))
    return table(spark, sf, "embeddings").select("vec_id", F.size(C.trim_nan(holes)).alias("n"))


@query("d09_gaussian_model", f"WITH {_SAMPLES} SELECT bead, i::INT AS i, round(v, 7) AS v FROM samples")
def d09(spark, sf):
    return profiles(spark, sf).select("bead", F.posexplode("samples").alias("i", "v")).withColumn("v", F.round("v", 7))


@query("d10_initial_guess", f"WITH {_SAMPLES} SELECT bead, round(max(v) - min(v), 7) AS amplitude, arg_min(i, (v, i))::DOUBLE AS centre, 3.0::DOUBLE AS sigma, round(max(v), 7) AS offset_ FROM samples GROUP BY bead")
def d10(spark, sf):
    g = profiles(spark, sf).select("bead", bd.guess(F.col("samples")).alias("g"))
    return g.select("bead", F.round("g.amplitude", 7).alias("amplitude"), F.col("g.centre").alias("centre"), F.col("g.sigma").alias("sigma"), F.round("g.offset", 7).alias("offset_"))


def fitted(spark, sf):
    return bd.fit_gaussians(profiles(spark, sf), ["bead"])


@query("d11_gaussian_fit", f"WITH {_PLANT} SELECT bead, round(a, 4) AS amplitude, round(x0, 4) AS centre, round(s, 4) AS sigma, round(c, 4) AS offset_ FROM plant")
def d11(spark, sf):
    return fitted(spark, sf).select("bead", *[F.round(c, 4).alias("offset_" if c == "offset" else c) for c in ("amplitude", "centre", "sigma", "offset")])


@query("d12_fwhm", f"WITH {_PLANT} SELECT bead, round(2.355::DOUBLE * s, 4) AS fwhm FROM plant")
def d12(spark, sf):
    return fitted(spark, sf).select("bead", F.round(bd.fwhm(F.col("sigma")), 4).alias("fwhm"))


@query("d13_r_squared", f"WITH {_SAMPLES}, n AS (SELECT bead, v AS m, v + ((bead * 31 + i * 17) % 7 - 3) * 0.05 AS v FROM samples), g AS (SELECT bead, avg(v) AS mean FROM n GROUP BY bead) SELECT bead, round(1 - sum((v - m) ** 2) / sum((v - mean) ** 2), 6) AS r2 FROM n JOIN g USING (bead) GROUP BY bead")
def d13(spark, sf):
    noisy = F.array(*[F.get("samples", F.lit(i)) + ((F.col("bead") * 31 + i * 17) % 7 - 3) * 0.05 for i in range(SAMPLES)])
    return profiles(spark, sf).select("bead", F.round(C.r_squared(noisy, F.col("samples")), 6).alias("r2"))


@query("d14_deconvolve", f"WITH {_FITS} SELECT bead, recon, CASE WHEN (fwhm_y / 2.355 * 4.9) ** 2 - 15.0 ** 2 / 12 > 0 THEN round(2.355::DOUBLE * sqrt((fwhm_y / 2.355 * 4.9) ** 2 - 15.0 ** 2 / 12), 5) END AS nm FROM fits")
def d14(spark, sf):
    return fits(spark, sf).select("bead", "recon", F.round(C.deconvolve(F.col("fwhm_y"), F.lit(15.0), F.lit(4.9)), 5).alias("nm"))


@query("d15_keep_good", f"WITH {_FITS} SELECT tomogram, recon, bead FROM fits WHERE r2_x >= 0.8 AND r2_z >= 0.8")
def d15(spark, sf):
    return bd.keep_good(fits(spark, sf), 0.8).select("tomogram", "recon", "bead")


# beads of orders in up to four reconstructions; some lack the last one, some fits fail
_RECONS = """config AS (SELECT 'tomo' || k::VARCHAR AS tomogram, 250.0 * (k + 1) AS thickness, 1.4 + k AS pxl_size FROM (SELECT unnest(range(7)) AS k)),
wide AS (SELECT 'tomo' || (o_custkey % 7)::VARCHAR AS tomogram, (r * 10 + 11)::VARCHAR || '_lim' || (r * 15 + 15)::VARCHAR || '_16bit' AS recon, r, o_orderkey AS bead, (1 + o_orderkey % 5 + r / 4)::DOUBLE AS fwhm_x, (1 + o_orderkey % 4 + r / 8)::DOUBLE AS fwhm_y, (2 + o_orderkey % 9 + r / 2)::DOUBLE AS fwhm_z,
  CASE WHEN (o_orderkey * 7 + r) % 13 = 0 THEN NULL ELSE 1 - ((o_orderkey * 3 + r) % 8) / 20 END::DOUBLE AS r2_x, (1 - ((o_orderkey + r) % 10) / 10)::DOUBLE AS r2_y, (1 - ((o_orderkey * 5 + r) % 9) / 20)::DOUBLE AS r2_z
  FROM (SELECT *, unnest(range(CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 4 END)) AS r FROM orders))"""
_SKIP = _RECONS + ", skip AS (SELECT tomogram, bead FROM wide GROUP BY ALL HAVING bool_or(r2_x IS NULL OR r2_x < 0.7 OR r2_z < 0.7) OR count(DISTINCT recon) < 4)"


def recons(spark, sf):
    k, r = F.col("o_orderkey"), F.col("r")
    each = table(spark, sf, "orders").withColumn("r", F.explode(F.sequence(F.lit(0), F.when(k % 11 == 0, 2).otherwise(3))))
    label = F.concat((r * 10 + 11).cast("string"), F.lit("_lim"), (r * 15 + 15).cast("string"), F.lit("_16bit"))
    return each.select(
        F.concat(F.lit("tomo"), (F.col("o_custkey") % 7).cast("string")).alias("tomogram"), label.alias("recon"), k.alias("bead"),
        (1 + k % 5 + r / 4).alias("fwhm_x"), (1 + k % 4 + r / 8).alias("fwhm_y"), (2 + k % 9 + r / 2).alias("fwhm_z"),
        F.when((k * 7 + r) % 13 != 0, 1 - (k * 3 + r) % 8 / 20).alias("r2_x"), (1 - (k + r) % 10 / 10).alias("r2_y"), (1 - (k * 5 + r) % 9 / 20).alias("r2_z"),
    )


def skip(spark, sf):
    return bd.skip_beads(recons(spark, sf), 0.7)


@query("d16_skip_set", f"WITH {_SKIP} SELECT * FROM skip")
def d16(spark, sf):
    return skip(spark, sf)


@query("d17_kept", f"WITH {_SKIP} SELECT tomogram, recon, bead, round(fwhm_y, 6) AS fwhm_y FROM wide ANTI JOIN skip USING (tomogram, bead)")
def d17(spark, sf):
    return bd.exclude(recons(spark, sf), skip(spark, sf)).select("tomogram", "recon", "bead", F.round("fwhm_y", 6).alias("fwhm_y"))


@query("d18_tidy_table", f"""WITH {_SKIP}, kept AS (SELECT * FROM wide ANTI JOIN skip USING (tomogram, bead)), n AS (SELECT tomogram, count(*) AS n_beads_total FROM wide WHERE r = 0 GROUP BY 1), p AS (SELECT tomogram, count(*) AS n_beads_pass FROM kept WHERE r = 0 GROUP BY 1)
SELECT tomogram, thickness::DOUBLE AS thickness, pxl_size::DOUBLE AS pxl_size, recon AS recon_label, (r * 10 + 11)::DOUBLE AS num_proj, (r * 15 + 15)::DOUBLE AS max_angle, bead AS bead_id, n_beads_total, coalesce(n_beads_pass, 0) AS n_beads_pass, fwhm_x, fwhm_y, fwhm_z, round(fwhm_x * pxl_size::DOUBLE, 8) AS res_nm_x, round(fwhm_y * pxl_size::DOUBLE, 8) AS res_nm_y, round(fwhm_z * pxl_size::DOUBLE, 8) AS res_nm_z
FROM kept JOIN config USING (tomogram) JOIN n USING (tomogram) LEFT JOIN p USING (tomogram)""")
def d18(spark, sf):
    k = F.col("k")
    labels = F.array(*[F.lit(f"{r * 10 + 11}_lim{r * 15 + 15}_16bit") for r in range(4)])
    tomograms = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("k")).distinct()
    config = tomograms.select(F.concat(F.lit("tomo"), k.cast("string")).alias("tomogram"), (250.0 * (k + 1)).alias("thickness"), (1.4 + k).alias("pxl_size"), labels.alias("recon_labels"))
    tidy = bd.bead_table(config, recons(spark, sf), 0.7)
    return tidy.withColumns({f"res_nm_{a}": F.round(f"res_nm_{a}", 8) for a in "xyz"})


@query("d19_count_mismatch", f"WITH {_FITS}, n AS (SELECT tomogram, recon, count(DISTINCT bead) AS n FROM fits GROUP BY ALL) SELECT tomogram, min(n) AS least, max(n) AS most FROM n GROUP BY 1 HAVING min(n) < max(n)")
def d19(spark, sf):
    return bd.count_mismatch(fits(spark, sf))


_PLANES = " UNION ALL ".join(f"SELECT vol_id AS bead, '{p}' AS plane, {r} AS row, {c} AS col, v FROM voxels WHERE {f} = 2" for p, f, r, c in (("xy", "z", "x", "y"), ("yz", "x", "y", "z"), ("zx", "y", "z", "x")))


@query("d20_mid_planes", f"{_V} SELECT bead, plane, row, col, round(v, 7) + 0.0 AS v FROM ({_PLANES})")
def d20(spark, sf):
    return bd.mid_planes(roi(spark, sf), 4).withColumn("v", clean0(F.col("v"), 7))


@query("d21_rotated_views", f"{_V} SELECT bead, plane, 3 - col AS row, row AS col, round(v, 7) + 0.0 AS v FROM ({_PLANES})")
def d21(spark, sf):
    return bd.rot90(bd.mid_planes(roi(spark, sf), 4), 4).select("bead", "plane", "row", "col", clean0(F.col("v"), 7).alias("v"))


def _turned_sql(panel, row, col, fixed):
    return f"SELECT vol_id // 3 AS bead, vol_id % 3 AS recon, '{panel}' AS panel, 3 - {col} AS row, {row} AS col, v FROM voxels WHERE {fixed} = 2"


@query("d21_views_across_recons", f"{_V} SELECT bead, recon, panel, row, col, round(v, 7) + 0.0 AS v FROM ({_turned_sql('XY', 'y', 'x', 'z')} UNION ALL {_turned_sql('SIDE', 'y', 'z', 'x')})")
def d21_views(spark, sf):
    """Three reconstructions of each bead side by side, the side view through the middle x, all turned."""
    boxes = roi(spark, sf).withColumns({"recon": F.col("bead") % 3, "bead": F.floor(F.col("bead") / 3)})
    return bd.views_across_recons(boxes, ["bead", "recon"], 4, "XZ").withColumn("v", clean0(F.col("v"), 7))


@query("d22_contrast", f"{_V} SELECT bead, plane, round(quantile_cont(v, 0.01), 7) + 0.0 AS low, round(quantile_cont(v, 0.99), 7) + 0.0 AS high FROM ({_PLANES}) GROUP BY ALL")
def d22(spark, sf):
    limits = bd.contrast(bd.mid_planes(roi(spark, sf), 4), ["bead", "plane"], 1, 99)
    return limits.select("bead", "plane", clean0(F.col("low"), 7).alias("low"), clean0(F.col("high"), 7).alias("high"))


@query("d23_profile_traces", "WITH t AS (SELECT vec_id, label, (dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 0.2 AS lift, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, embedding FROM embeddings) SELECT vec_id, round(sum((v - lo) / (hi - lo) + lift), 4) AS total FROM (SELECT vec_id, lift, lo, hi, unnest(embedding)::DOUBLE AS v FROM t) GROUP BY vec_id")
def d23(spark, sf):
    p = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))
    traces = bd.profile_traces(p, ["label"], "vec_id")
    return traces.select("vec_id", F.round(F.aggregate("traces", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("d24_dense_fit", f"WITH {_PLANT}, k AS (SELECT *, unnest(range(47)) AS k FROM plant) SELECT bead, k::INT AS k, round(a * exp(-((k * 0.5::DOUBLE - x0) ** 2) / (2 * s ** 2)) + c, 4) AS value FROM k")
def d24(spark, sf):
    return bd.dense_fit(fitted(spark, sf), 47, 23.0).select("bead", "k", F.round("value", 4).alias("value"))


@query("d25_spot_check", f"WITH {_PLANT} SELECT bead, round(2.355::DOUBLE * s, 4) AS fwhm, 1.0::DOUBLE AS r2 FROM plant WHERE bead = 77")
def d25(spark, sf):
    one = profiles(spark, sf).filter("bead = 77")  # the bead that is looked at
    return bd.fit_gaussians(one, ["bead"]).select("bead", F.round(bd.fwhm(F.col("sigma")), 4).alias("fwhm"), F.round("r2", 6).alias("r2"))


@query("d26_sigma_outliers", f"WITH {_LONG}, st AS (SELECT axis, avg(value) AS m, stddev_pop(value) AS sd FROM long GROUP BY axis) SELECT tomogram, bead, axis, round(value, 9) AS value FROM long JOIN st USING (axis) WHERE abs(value - m) > 1.5 * sd")
def d26(spark, sf):
    return bd.sigma_outliers(long(spark, sf), ["axis"], "value", 1.5).select("tomogram", "bead", "axis", F.round("value", 9).alias("value"))


@query("d27_joint_outliers", f"WITH {_FITS} SELECT tomogram, recon, bead FROM fits WHERE fwhm_x > 0 AND fwhm_x <= 4 AND fwhm_y > 0 AND fwhm_y <= 4 AND fwhm_z > 0 AND fwhm_z <= 4")
def d27(spark, sf):
    return bd.joint_outliers(fits(spark, sf), ["fwhm_x", "fwhm_y", "fwhm_z"], 4.0).select("tomogram", "recon", "bead")


@query("d28_value_range", f"WITH {_LONG} SELECT tomogram, recon, bead, axis FROM long WHERE value BETWEEN 1 AND 3")
def d28(spark, sf):
    return bd.value_range(long(spark, sf), 1, 3).select("tomogram", "recon", "bead", "axis")


@query("d29_drop_empty", f"WITH {_LONG}, full_ AS (SELECT bead FROM long WHERE value IS NOT NULL GROUP BY bead HAVING count(DISTINCT axis) = 3) SELECT bead, count(*) AS n FROM long SEMI JOIN full_ USING (bead) GROUP BY bead")
def d29(spark, sf):
    return bd.drop_empty(long(spark, sf), "bead").groupBy("bead").agg(F.count(F.lit(1)).alias("n"))


@query("d30_named_groups", f"WITH {_LONG}, g(grp, part) AS (VALUES ('thin', 'tomo1'), ('thin', 'tomo2'), ('thick', 'omo5'), ('all', 'tomo'), ('all', 'o')), m AS (SELECT DISTINCT grp, long.* FROM long JOIN g ON contains(tomogram, part)) SELECT grp, axis, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM m GROUP BY ALL")
def d30(spark, sf):
    names = spark.createDataFrame([("thin", "tomo1"), ("thin", "tomo2"), ("thick", "omo5"), ("all", "tomo"), ("all", "o")], "grp string, part string")
    met = bd.group_by_name(long(spark, sf).distinct(), names, "tomogram")
    return bd.summary(met, ["grp", "axis"], "value").select("grp", "axis", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("d31_summary", f"WITH {_LONG} SELECT tomogram, axis, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n, round(avg(value) * 4.9, 5) AS mean_nm FROM long GROUP BY ALL")
def d31(spark, sf):
    return bd.summary(long(spark, sf), ["tomogram", "axis"], "value").select("tomogram", "axis", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n", F.round(F.col("mean") * 4.9, 5).alias("mean_nm"))


@query("d32_anisotropy", f"WITH {_FITS} SELECT tomogram, round(avg(fwhm_z / fwhm_y), 6) AS mean, round(stddev_pop(fwhm_z / fwhm_y), 6) AS std, count(*) AS n FROM fits WHERE fwhm_y > 0.1 AND fwhm_z < 5 AND fwhm_y < 5 GROUP BY 1")
def d32(spark, sf):
    return bd.ratio_stats(fits(spark, sf), ["tomogram"], "fwhm_z", "fwhm_y", 5.0).select("tomogram", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("d33_zx_ratio", f"WITH {_FITS} SELECT bead, recon, CASE WHEN fwhm_x > 0 THEN fwhm_z / fwhm_x END AS zx FROM fits")
def d33(spark, sf):
    return bd.zx_ratio(fits(spark, sf)).select("bead", "recon", "zx")


@query("d34_filtered_summary", f"WITH {_FITS} SELECT tomogram, round(avg(fwhm_z * 4.9), 6) AS estimate, round((quantile_cont(fwhm_z * 4.9, 0.75) - quantile_cont(fwhm_z * 4.9, 0.25)) / 2, 7) AS iqr_half, count(*) AS n FROM fits WHERE fwhm_z * 4.9 < 20 GROUP BY 1")
def d34(spark, sf):
    from ..operators.report import iqr_half

    nm = fits(spark, sf).withColumn("nm", F.col("fwhm_z") * 4.9).filter("nm < 20")
    return iqr_half(nm, ["tomogram"], "nm", exact="refined").select("tomogram", F.round("estimate", 6).alias("estimate"), F.round("iqr_half", 7).alias("iqr_half"), "n")


@query("d35_r2_trend", f"WITH {_FITS} SELECT tomogram, round(regr_slope(fwhm_z, r2_z), 5) + 0.0 AS slope, round(regr_intercept(fwhm_z, r2_z), 5) AS intercept, count(*) AS n FROM fits GROUP BY 1")
def d35(spark, sf):
    return bd.trend(fits(spark, sf), ["tomogram"], "r2_z", "fwhm_z").select("tomogram", clean0(F.col("slope"), 5).alias("slope"), F.round("intercept", 5).alias("intercept"), "n")


@query("d36_histogram", f"WITH {_FITS}, e AS (SELECT tomogram, min(fwhm_z) AS lo, max(fwhm_z) AS hi FROM fits GROUP BY 1) SELECT tomogram, least(floor((fwhm_z - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM fits JOIN e USING (tomogram) GROUP BY ALL")
def d36(spark, sf):
    return bd.histogram(fits(spark, sf), ["tomogram"], "fwhm_z", 20)


# a bead of separable Gaussians for each supplier: thick profiles keep the width, whatever the linewidth
_WIDTHS = " UNION ALL ".join(f"SELECT s_suppkey AS bead, {w} AS linewidth, round(2.355::DOUBLE * (1.2 + s_suppkey % 5 * 0.1), 2) AS fwhm_x, round(2.355::DOUBLE * (1.3 + s_suppkey % 3 * 0.1), 2) AS fwhm_y, round(2.355::DOUBLE * (1.5 + s_suppkey % 4 * 0.2), 2) AS fwhm_z FROM supplier" for w in (1, 2, 3))


def planted_boxes(spark, sf, size=11):
    k, c = F.col("s_suppkey"), size // 2
    sigma = {"x": 1.2 + k % 5 * 0.1, "y": 1.3 + k % 3 * 0.1, "z": 1.5 + k % 4 * 0.2}
    out = table(spark, sf, "supplier").select(k, k.alias("bead"))
    for a in "zxy":
        out = out.withColumn(f"d{a}", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    depth = F.lit(0.0)
    for a in "zxy":
        depth = depth - (F.col(f"d{a}") - c) * (F.col(f"d{a}") - c) / (2 * sigma[a] * sigma[a])
    return out.select("bead", "dz", "dx", "dy", (10 - 5 * F.exp(depth)).alias("v"))


@query("d37_linewidth_scan", _WIDTHS)
def d37(spark, sf):
    scan = bd.linewidth_scan(planted_boxes(spark, sf), ["bead"], 11, (1, 2, 3))
    return scan.select("bead", "linewidth", *[F.round(f"fwhm_{a}", 2).alias(f"fwhm_{a}") for a in "xyz"])


@query("d38_fit_grid", f"WITH {_SAMPLES}, gone AS (SELECT DISTINCT bead FROM plant WHERE x0 > 12.5 OR s > 3.5) SELECT bead, i::INT AS i, round(v, 5) AS value, round(v, 4) AS fit FROM samples ANTI JOIN gone USING (bead)")
def d38(spark, sf):
    gone = planted(spark, sf).filter("x0 > 12.5 or s > 3.5").select("bead")
    return bd.fit_grid(profiles(spark, sf), gone).select("bead", "i", F.round("value", 5).alias("value"), F.round("fit", 4).alias("fit"))


@query("d39_montage", f"{_V} SELECT bead, plane, round(sum(v * (1 + row * 4 + col)), 6) + 0.0 AS total FROM ({_PLANES}) GROUP BY ALL")
def d39(spark, sf):
    return bd.mid_planes(roi(spark, sf), 4).groupBy("bead", "plane").agg(clean0(F.sum(F.col("v") * (1 + F.col("row") * 4 + F.col("col"))), 6).alias("total"))

"""N: cross-validation curves, regions, projections and peaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import crossval as cv
from ..operators import fourier as fo
from ..operators import imageops as io
from ..operators import volumes as vo
from ..plans.grids import tilt_series
from .fourier import _PLAIN, arrays, clean0, pairs_ft
from .fourier import bricks as fo_bricks
from .images import _T, pairs, total
from .proxies import IMAGES_SQL, VOXELS_SQL, images, voxels
from .registry import query, table

_I = f"WITH {IMAGES_SQL}"
_P2 = _I + ", pairs AS (SELECT a.img // 2 AS run, a.px, a.py, a.v AS v1, b.v AS v2 FROM images a JOIN images b ON b.img = a.img + 1 AND a.px = b.px AND a.py = b.py WHERE a.img % 2 = 0)"
_R = "sqrt(kz * kz + kx * kx + ky * ky)"


def radius(*axes):
    """Length of a frequency."""
    return F.sqrt(sum((F.col(a) * F.col(a) for a in axes), F.lit(0)))



def _shelled(radius, count):
    """Rows by shell: int(r - 0.5 + 1) to int(r + 0.5), the origin in shell 0; from the last of ``count`` shells on none."""
    return f", r AS (SELECT * FROM (SELECT *, {radius} AS r FROM {{src}}) WHERE trunc(r) + 1 < {count}), e AS (SELECT *, unnest(CASE WHEN r = 0 THEN [0] ELSE range(trunc(r + 0.5)::BIGINT, trunc(r + 0.5)::BIGINT + 1) END) AS idx FROM r)"


#: Shells of 4 x 4 x 4 volumes and of 8 x 8 images at a resolution of two pixels, see ``axis_dim``.
SHELLS_3D, SHELLS_2D = 4, 6
_FSC = _PLAIN + _shelled(_R, SHELLS_3D).replace("{src}", "fts") + ", p AS (SELECT run, idx::INT AS idx, sum(re1 * re2 + im1 * im2) AS c, sum(re1 ** 2 + im1 ** 2) AS c1, sum(re2 ** 2 + im2 ** 2) AS c2 FROM e GROUP BY ALL), q AS (SELECT run, idx, CASE WHEN idx = 0 THEN 1 ELSE greatest(least(coalesce(c / nullif(sqrt(c1 * c2), 0), 0), 1), 0) END AS value FROM p)"


@query("n01_fsc_physical", _FSC + " SELECT run, idx, round(value, 4) + 0.0 AS value FROM q")
def n01(spark, sf):
    return cv.fsc_physical(pairs_ft(spark, sf), ["run"], radius("kz", "kx", "ky"), count=SHELLS_3D).select("run", "idx", clean0(F.col("value"), 4).alias("value"))


@query("n02_even_odd", _FSC + " SELECT run, idx, round(CASE WHEN idx = 0 THEN 1 ELSE 2 * value / (value + 1) END, 4) + 0.0 AS value FROM q")
def n02(spark, sf):
    return cv.fsc_physical(pairs_ft(spark, sf), ["run"], radius("kz", "kx", "ky"), even_odd=True, count=SHELLS_3D).select("run", "idx", clean0(F.col("value"), 4).alias("value"))


@query("n03_shell_axis", "SELECT p_partkey, round(res, 6) AS res, trunc(2 + extent / res)::INT AS shells FROM (SELECT *, least(greatest(p_retailprice / 200, 2 * u), extent / 2) AS res FROM (SELECT *, (p_size + 20) * u AS extent FROM (SELECT *, 1.0::DOUBLE + p_partkey % 5 AS u FROM part)))")
def n03(spark, sf):
    res, shells = cv.axis_dim(F.col("p_size") + 20, F.lit(1.0) + F.col("p_partkey") % 5, F.col("p_retailprice") / 200)
    return table(spark, sf, "part").select("p_partkey", F.round(res, 6).alias("res"), shells.alias("shells"))


_CURVES = """curves AS (SELECT label AS run, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS proj, embedding FROM embeddings),
flat AS (SELECT run, proj, -60 + proj * 0.5::DOUBLE AS tilt, i AS idx, (i + 1) / 100 AS s, (0.5 + v * 2)::DOUBLE AS value FROM (SELECT run, proj, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM curves))"""


def curves(spark, sf):
    """``run, proj, tilt, idx, s, value``: a curve of 64 points for each vector, in series by label."""
    numbered = table(spark, sf, "embeddings").select(F.col("label").alias("run"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("proj"), "embedding")
    flat = numbered.select("run", "proj", F.posexplode("embedding").alias("idx", "v"))
    return flat.select("run", "proj", (F.col("proj") * 0.5 - 60).alias("tilt"), "idx", ((F.col("idx") + 1) / 100).alias("s"), (F.col("v").cast("double") * 2 + 0.5).alias("value"))


_LAST = """, st AS (SELECT *, lag(value) OVER (PARTITION BY run, proj ORDER BY idx) AS v0, lag(s) OVER (PARTITION BY run, proj ORDER BY idx) AS s0 FROM {src}),
c AS (SELECT *, unnest([0.3, 0.5])::DOUBLE AS threshold FROM st)
SELECT run, proj::INT AS proj, threshold, round(coalesce(1 / arg_max(s0 + (s - s0) * (v0 - threshold) / (v0 - value), idx) FILTER (v0 >= threshold AND value < threshold), 0), 6) AS res FROM c GROUP BY run, proj, threshold"""


@query("n04_last_crossings", f"WITH {_CURVES}" + _LAST.format(src="flat"))
def n04(spark, sf):
    return cv.last_crossings(curves(spark, sf), ["run", "proj"], [0.3, 0.5, 0.0]).withColumn("res", F.round("res", 6))


@query("n05_frequency_correlation", _PLAIN + " SELECT run, kz, kx, ky, round(greatest(least((re1 * re2 + im1 * im2) / sqrt((re1 ** 2 + im1 ** 2) * (re2 ** 2 + im2 ** 2)), 1), 0), 3) + 0.0 AS c FROM fts WHERE (re1 ** 2 + im1 ** 2) * (re2 ** 2 + im2 ** 2) > 1e-9")
def n05(spark, sf):
    return cv.frequency_correlation(pairs_ft(spark, sf)).select("run", "kz", "kx", "ky", clean0(F.col("c"), 3).alias("c"))


# 57 degrees either way and an x tilt of 5 degrees; where kx is 0 the angle is a right one, or none where kz is 0 too
_WEDGE = "CASE WHEN kx = 0 AND ky = 0 AND kz = 0 THEN false WHEN kx = 0 THEN kz <> 0 ELSE abs(atan((kz * cos(radians(5)) + ky * sin(radians(5))) / kx)) > 1.0 END"
_WEDGE_RANGE = (1.0, -1.0, 0.08726646259971647)


def wedge():
    return cv.wedge_mask(F.col("kx"), F.col("ky"), F.col("kz"), *_WEDGE_RANGE)


@query("n06_missing_wedge", _PLAIN + f" SELECT run, count(*) FILTER ({_WEDGE}) AS n_missing, count(*) AS n, round(sum(re1) FILTER ({_WEDGE}), 4) + 0.0 AS re FROM fts GROUP BY run")
def n06(spark, sf):
    return pairs_ft(spark, sf).groupBy("run").agg(F.count_if(wedge()).alias("n_missing"), F.count(F.lit(1)).alias("n"), clean0(F.sum(F.when(wedge(), F.col("re1"))), 4).alias("re"))


@query("n07_reciprocal_mask", _PLAIN + f" SELECT run, round(sum(re1 * re2 + im1 * im2), 4) + 0.0 AS c FROM fts WHERE NOT ({_WEDGE}) GROUP BY run")
def n07(spark, sf):
    ft = pairs_ft(spark, sf)
    mask = ft.select("kz", "kx", "ky").distinct().filter(~wedge())
    kept = ft.join(mask, ["kz", "kx", "ky"], "left_semi")
    return kept.groupBy("run").agg(clean0(F.sum(F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2")), 4).alias("c"))


# three images of a projection: vectors 3k, 3k + 1 and 3k + 2
_K8 = "ks AS (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3]) AS k), ft AS (SELECT img, any_value(label) AS label, a.k AS kx, b.k AS ky, sum(v * cos(2 * pi() * (a.k * px + b.k * py) / 8)) AS re, sum(-v * sin(2 * pi() * (a.k * px + b.k * py) / 8)) AS im FROM images, ks a, ks b GROUP BY img, kx, ky)"
_TRI = f"{_I}, {_K8}, t AS (SELECT a.img // 3 AS proj, a.kx, a.ky, a.re AS re0, a.im AS im0, b.re AS re1, b.im AS im1, c.re AS re2, c.im AS im2 FROM ft a JOIN ft b ON b.img = a.img + 1 AND a.kx = b.kx AND a.ky = b.ky JOIN ft c ON c.img = a.img + 2 AND a.kx = c.kx AND a.ky = c.ky WHERE a.img % 3 = 0)" + _shelled("sqrt(kx * kx + ky * ky)", SHELLS_2D).replace("{src}", "t") + ", sums AS (SELECT proj, idx::INT AS idx, sum(re0 * re1 + im0 * im1) AS cm, sum(re1 ** 2 + im1 ** 2) AS mm, sum(re0 * re2 + im0 * im2) AS cf, sum(re2 ** 2 + im2 ** 2) AS ff FROM e GROUP BY ALL)"
_RATIO = "CASE WHEN abs(cf) < 1e-30 OR mm < 1e-30 OR ff < 1e-30 THEN 0 ELSE greatest(least(cm * sqrt(ff) / (cf * sqrt(mm)), 1), {low}) END"


def triples(spark, sf):
    three = arrays(spark, sf, 3).withColumnRenamed("run", "proj")
    flat = fo.frequencies(fo.fft_arrays(three, "proj", ["v1", "v2", "v3"], (8, 8)), ["proj"], [("x", 8), ("y", 8)])
    return flat.withColumnsRenamed({f"{c}{k}": f"{c}{k - 1}" for k in (1, 2, 3) for c in ("re", "im")})


def nloo_sums(spark, sf):
    return cv.nloo2d_sums(triples(spark, sf), ["proj"], radius("kx", "ky"), count=SHELLS_2D)


@query("n08_nloo2d", _TRI + f" SELECT proj, idx, round({_RATIO.format(low=0)}, 3) + 0.0 AS value FROM sums")
def n08(spark, sf):
    return cv.nloo_ratio(nloo_sums(spark, sf)).select("proj", "idx", clean0(F.col("value"), 3).alias("value"))


@query("n09_nloo3d", _TRI + f", g AS (SELECT proj % 10 AS run, idx, sum(cm) AS cm, sum(mm) AS mm, sum(cf) AS cf, sum(ff) AS ff FROM sums GROUP BY ALL) SELECT run, idx, round({_RATIO.format(low=0)}, 3) + 0.0 AS value FROM g")
def n09(spark, sf):
    sums = nloo_sums(spark, sf).withColumn("run", F.col("proj") % 10)
    return cv.nloo3d(sums, ["run"]).select("run", "idx", clean0(F.col("value"), 3).alias("value"))


@query("n10_nloo_band", _TRI + f", g AS (SELECT proj, sum(re0 * re1 + im0 * im1) AS cm, sum(re1 ** 2 + im1 ** 2) AS mm, sum(re0 * re2 + im0 * im2) AS cf, sum(re2 ** 2 + im2 ** 2) AS ff FROM t WHERE kx * kx + ky * ky BETWEEN 1 AND 9 GROUP BY proj) SELECT proj, round({_RATIO.format(low=-1)}, 3) + 0.0 AS value FROM g")
def n10(spark, sf):
    return cv.nloo_coefficient(triples(spark, sf), ["proj"], radius("kx", "ky"), 3.0, 1.0).select("proj", clean0(F.col("value"), 3).alias("value"))


_BACK = ["kx * cos(t)", "-kx * sin(t) * sin(0.05) + ky * cos(0.05)", "(-kx * sin(t) * cos(0.05) - ky * sin(0.05)) / 2"]
_ROUND = "CASE WHEN {v} < 0 THEN ceil({v} - 0.5) ELSE floor({v} + 0.5) END::INT"


@query("n11_nloo_volume", _TRI + f""", m AS (SELECT proj % 10 AS run, {', '.join(f"{_ROUND.format(v='(' + v + ')')} AS h{a}" for a, v in zip("xyz", _BACK))}, * FROM (SELECT *, radians((proj // 10) * 3.0) AS t FROM t)),
g AS (SELECT run, hx, hy, hz, sum(re0 * re1 + im0 * im1) AS cm, sum(re1 ** 2 + im1 ** 2) AS mm, sum(re0 * re2 + im0 * im2) AS cf, sum(re2 ** 2 + im2 ** 2) AS ff FROM m WHERE hx BETWEEN -4 AND 3 AND hy BETWEEN -4 AND 3 AND hz BETWEEN -3 AND 2 GROUP BY ALL)
SELECT run, hx, hy, hz, round({_RATIO.format(low=-1)}, 2) + 0.0 AS value FROM g WHERE abs(cf) > 1e-6""")
def n11(spark, sf):
    """Tilts of 3 degrees apart and an x tilt of 0.05 radians, into volumes of 8 x 8 x 6 whose z is binned by 2."""
    tilted = triples(spark, sf).withColumns({"run": F.col("proj") % 10, "tilt": F.floor(F.col("proj") / 10) * 3.0, "xtilt": F.degrees(F.lit(0.05))})
    found = cv.nloo_volume(cv.tilt_views(tilted), ["run"], (8, 8, 6), 2.0).filter("abs(cf) > 1e-6")
    return found.select("run", "hx", "hy", "hz", clean0(F.col("value"), 2).alias("value"))


_WEIGHTS = """, tl AS (SELECT DISTINCT run, proj, tilt FROM flat), ln AS (SELECT run, max(proj) + 1 AS np FROM tl GROUP BY run),
m AS (SELECT a.run, a.proj AS centre, a.tilt, b.proj AS near, b.tilt AS tilt_near, np FROM tl a JOIN tl b ON a.run = b.run AND b.proj BETWEEN a.proj - 2 AND a.proj + 2 JOIN ln ON ln.run = a.run),
sp AS (SELECT run, centre, abs(max(tilt_near) - min(tilt_near)) AS span, count(*) AS n FROM m GROUP BY run, centre),
rw AS (SELECT m.*, CASE WHEN n > 1 THEN span * CASE WHEN centre + 2 > np - 1 THEN 4.0::DOUBLE / (centre + 2 - np + 1) WHEN centre < 2 THEN 4.0::DOUBLE / (2 - centre) ELSE 1 END ELSE 1 END - abs(tilt_near - tilt) AS raw FROM m JOIN sp USING (run, centre)),
w AS (SELECT run, centre, near, raw / sum(raw) OVER (PARTITION BY run, centre) AS w FROM rw),
smooth AS (SELECT w.run, w.centre AS proj, idx, sum(w * value) AS value FROM w JOIN flat ON flat.run = w.run AND flat.proj = w.near GROUP BY ALL)"""


@query("n12_smooth_over_tilt", f"WITH {_CURVES}{_WEIGHTS} SELECT run, proj::INT AS proj, idx::INT AS idx, round(value, 6) + 0.0 AS value FROM smooth")
def n12(spark, sf):
    return cv.smooth_over_tilt(curves(spark, sf), ["run"], 5).select("run", "proj", "idx", clean0(F.col("value"), 6).alias("value"))


@query("n13_tilt_resolution", f"WITH {_CURVES}{_WEIGHTS}, lim AS (SELECT *, (idx + 1) / 100 AS s FROM smooth WHERE 100 / (idx + 1) >= 2.5)" + _LAST.format(src="lim"))
def n13(spark, sf):
    smooth = cv.smooth_over_tilt(curves(spark, sf), ["run"], 5).withColumn("s", (F.col("idx") + 1) / 100)
    # points beyond the resolution limit do not count
    held = smooth.filter(1 / F.col("s") >= 2.5)
    return cv.last_crossings(held, ["run", "proj"], [0.3, 0.5]).withColumn("res", F.round("res", 6))


@query("n14_smooth_estimates", f"WITH {_CURVES}{_WEIGHTS}, est AS (SELECT run, proj, max(value) AS value FROM flat GROUP BY ALL) SELECT w.run, w.centre::INT AS proj, round(sum(w * value), 6) + 0.0 AS value FROM w JOIN est ON est.run = w.run AND est.proj = w.near GROUP BY w.run, w.centre")
def n14(spark, sf):
    estimates = curves(spark, sf).groupBy("run", "proj", "tilt").agg(F.max("value").alias("value"))
    return cv.smooth_estimates(estimates, ["run"], 5).select("run", "proj", clean0(F.col("value"), 6).alias("value"))




def faces():
    """Axis, start and size of a box."""
    return [(F.col("px"), F.lit(1), F.lit(6)), (F.col("py"), F.lit(2), F.lit(5))]


_BOX = "(px BETWEEN 1 AND 6 AND py BETWEEN 2 AND 6)"
_SPH = "((px - 4) ** 2 + (py - 4) ** 2 <= 9)"
_INNER2 = "((px - 4) ** 2 + (py - 4) ** 2 <= 4)"
_INNER = "((px - 4) ** 2 + (py - 4) ** 2 <= 1)"


def box():
    return cv.inside_box(faces())


def sphere(radius):
    return cv.inside_sphere([(F.col("px"), F.lit(4)), (F.col("py"), F.lit(4))], F.lit(radius))


@query("n15_region_test", f"{_I} SELECT img, count(*) FILTER ({_BOX}) AS n_box, count(*) FILTER ({_SPH} AND NOT {_INNER}) AS n_ring, round(sum(v) FILTER ({_SPH} AND NOT {_INNER}), 6) + 0.0 AS total FROM images GROUP BY img")
def n15(spark, sf):
    ring = sphere(3) & ~sphere(1)
    return images(spark, sf).groupBy("img").agg(F.count_if(box()).alias("n_box"), F.count_if(ring).alias("n_ring"), clean0(F.sum(F.when(ring, F.col("v"))), 6).alias("total"))


_SHAPES = {"all": ("true", vo.Region.whole((8, 8))), "largest": ("(px - 3.5) ** 2 + (py - 3.5) ** 2 <= 9", vo.Region.largest_sphere((8, 8))), "ring": (f"{_BOX} AND NOT {_INNER2}", vo.Region(start=(1.0, 2.0), size=(6.0, 5.0), inner=vo.Region(centre=(4.0, 4.0), radius=2.0)))}
_EDGE = {"all": "least(px, 7 - px, py, 7 - py)", "largest": "3 - sqrt((px - 3.5) ** 2 + (py - 3.5) ** 2)", "ring": "least(px - 1, 6 - px, py - 2, 6 - py, sqrt((px - 4) ** 2 + (py - 4) ** 2) - 2)"}


@query("n15_regions", f"{_I} SELECT img, " + ", ".join(f"count(*) FILTER ({w}) AS n_{n}, round(sum(v * ({_EDGE[n]})) FILTER ({w}), 5) + 0.0 AS d_{n}, count(*) FILTER (({w}) AND {_EDGE[n]} <= 1) AS f_{n}" for n, (w, _) in _SHAPES.items()) + " FROM images GROUP BY img")
def n15_regions(spark, sf):
    """The whole image, its largest circle, and a box without an inner circle: pixels, distances to the border, frame."""
    at, out = (F.col("px"), F.col("py")), []
    for name, (_, region) in _SHAPES.items():
        region.check((8, 8))
        inside, d = region.inside(*at), region.column_distance(*at)
        out += [F.count_if(inside).alias(f"n_{name}"), clean0(F.sum(F.when(inside, F.col("v") * d)), 5).alias(f"d_{name}"), F.count_if(region.frame(*at, width=1.0)).alias(f"f_{name}")]
    return images(spark, sf).groupBy("img").agg(*out)


_DIST = "least(abs(px - 1), abs(px - 6), abs(py - 2), abs(py - 6))"


@query("n16_border_distance", f"{_I} SELECT img, round(sum({_DIST} * v), 6) + 0.0 AS total, round(sum(v) FILTER ({_DIST} = 0 AND {_BOX}), 6) + 0.0 AS frame FROM images GROUP BY img")
def n16(spark, sf):
    d = cv.border_distance(faces())
    return images(spark, sf).groupBy("img").agg(clean0(F.sum(d * F.col("v")), 6).alias("total"), clean0(F.sum(F.when((d == 0) & box(), F.col("v"))), 6).alias("frame"))


@query("n17_taper", f"{_I} SELECT img, {_T.format(v=f'CASE WHEN {_BOX} THEN 0.1 + (v - 0.1) * CASE WHEN {_DIST} >= 0.375 THEN 1.0 ELSE 0.5 - 0.5 * cos(pi() * {_DIST} / 0.375) END ELSE 0.1 END')} FROM images GROUP BY img")
def n17(spark, sf):
    return total(images(spark, sf).withColumn("v", cv.taper(F.col("v"), F.lit(0.1), cv.border_distance(faces()), box(), cv.taper_size((6, 5)))), ["img"])


_RS = f", rs AS (SELECT img, avg(v) FILTER ({_SPH}) AS m, stddev_pop(v) FILTER ({_SPH}) AS sd, avg(v) FILTER (NOT {_SPH}) AS bg FROM images GROUP BY img)"


@query("n18_region_stats", _I + _RS + f", fr AS (SELECT img, avg(v) FILTER ({_SPH} AND NOT {_INNER2}) AS frame FROM images GROUP BY img) SELECT img, round(m, 7) + 0.0 AS avg, round(sd, 7) AS std, round(bg, 7) + 0.0 AS background, round(frame, 7) + 0.0 AS frame FROM rs JOIN fr USING (img)")
def n18(spark, sf):
    df = images(spark, sf)
    outside = cv.region_stats(df, ["img"], sphere(3))
    frame = cv.region_stats(df, ["img"], sphere(3), "frame", sphere(3) & ~sphere(2)).select("img", F.col("background").alias("frame"))
    return outside.join(frame, "img").select("img", *[clean0(F.col(c), 7).alias(c) for c in ("avg", "std", "background", "frame")])


@query("n19_mask", _I + _RS + f" SELECT img, {_T.format(v=f'CASE WHEN {_SPH} THEN v ELSE bg END')} FROM images JOIN rs USING (img) GROUP BY img")
def n19(spark, sf):
    return total(cv.mask_region(images(spark, sf), ["img"], sphere(3)), ["img"])


# values are brought to mean 128 and deviation 60 of the region, cut to bytes; the background is as it is given
@query("n20_rescale", _I + _RS + f" SELECT img, {_T.format(v=f'CASE WHEN {_SPH} THEN trunc(greatest(least(v * (60 / sd) + (128 - m * 60 / sd), 255), 0)) ELSE 7.5 END')} FROM images JOIN rs USING (img) GROUP BY img")
def n20(spark, sf):
    df = images(spark, sf)
    joined = df.join(cv.region_stats(df, ["img"], sphere(3)), "img")
    scale = 60 / F.col("std")
    return total(joined.withColumn("v", cv.rescale(F.col("v"), scale, 128 - F.col("avg") * 60 / F.col("std"), "uint8", sphere(3), 7.5)), ["img"])


# a type with a sign: what is below zero is cut towards zero too
@query("n20_rescale_signed", _I + f" SELECT img, {_T.format(v='trunc(greatest(least(v * 1000 - 3.5, 127), -128))')} FROM images GROUP BY img")
def n20_signed(spark, sf):
    return total(images(spark, sf).withColumn("v", cv.rescale(F.col("v"), 1000.0, -3.5, "int8")), ["img"])


@query("n21_rescale_least_squares", _P2 + f", b AS (SELECT run, px // 4 AS bx, py // 4 AS by_, avg(v1) AS v1, avg(v2) AS v2 FROM pairs WHERE {_SPH} GROUP BY ALL), f AS (SELECT run, regr_slope(v1, v2) AS slope, regr_intercept(v1, v2) AS off FROM b GROUP BY run) SELECT run, round(sum((off + slope * v2) * (1 + px * 8 + py)), 4) + 0.0 AS total FROM pairs JOIN f USING (run) GROUP BY run")
def n21(spark, sf):
    return total(cv.rescale_ls(pairs(spark, sf), ["run"], ["px", "py"], 4, sphere(3)), ["run"], digits=4)


@query("n22_bin_diluted", _I + " SELECT img, px // 3 AS px, py // 3 AS py, round(sum(v) / 9, 7) + 0.0 AS v FROM images GROUP BY ALL")
def n22(spark, sf):
    return io.bin_volume(images(spark, sf), ["img"], ["px", "py"], 3).withColumn("v", clean0(F.col("v"), 7))


# a tilt series for each supplier, its x tilt and its steps from the key
_VIEWS = """tilts AS (SELECT s_suppkey AS series, proj::INT AS proj, (CASE WHEN raw >= 0 THEN floor(raw + 0.5) ELSE ceil(raw - 0.5) END / 10) AS tilt, (s_suppkey % 5 - 2)::DOUBLE AS xtilt
  FROM (SELECT s_suppkey, proj, (amin + proj * step) * 10 AS raw FROM (SELECT s_suppkey, amin, step, unnest(range(0, floor((60.0 - amin) / step + 0.5)::INT + 1)) AS proj FROM (SELECT s_suppkey, (-60 + s_suppkey % 20)::DOUBLE AS amin, (20 + s_suppkey % 4 * 5)::DOUBLE AS step FROM supplier)))),
views AS (SELECT series, proj, cos(radians(tilt)) AS m00, -sin(radians(tilt)) * sin(radians(xtilt)) AS m01, -sin(radians(tilt)) * cos(radians(xtilt)) AS m02, 0.0::DOUBLE AS m10, cos(radians(xtilt)) AS m11, -sin(radians(xtilt)) AS m12, sin(radians(tilt)) AS m20, cos(radians(tilt)) * sin(radians(xtilt)) AS m21, cos(radians(tilt)) * cos(radians(xtilt)) AS m22 FROM tilts)"""


def views(spark, sf):
    k = F.col("s_suppkey")
    runs = table(spark, sf, "supplier").select(k.alias("series"), (k % 20 - 60).cast("double").alias("amin"), F.lit(60.0).alias("amax"), (k % 4 * 5 + 20).cast("double").alias("step"), (k % 5 - 2).cast("double").alias("xtilt"))
    return cv.tilt_views(tilt_series(runs)).drop("tilt", "xtilt", "amin", "amax", "step")


def of_series(df, key, spark, sf):
    """``series`` of each row, dealt over all suppliers."""
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n_series"))  # one row
    return df.crossJoin(F.broadcast(n)).withColumn("series", F.col(key) % F.col("n_series")).drop("n_series")


@query("n23_reproject", f"""WITH {VOXELS_SQL}, {_VIEWS}, n AS (SELECT count(*) AS n FROM supplier), a AS (SELECT vol_id, proj, v - 0.5 AS v, (x - 1.5) * m00 + (y - 1.5) * m01 + (z - 1.5) * m02 + 1.5 AS ax, (x - 1.5) * m10 + (y - 1.5) * m11 + (z - 1.5) * m12 + 1.5 AS ay FROM voxels JOIN n ON true JOIN views ON series = vol_id % n WHERE z >= 1),
l AS (SELECT * FROM a WHERE floor(ax) BETWEEN 0 AND 3 AND floor(ay) BETWEEN 0 AND 3),
s AS (SELECT vol_id, proj, v, (floor(ax) + i)::INT AS px, (floor(ay) + j)::INT AS py, CASE i WHEN 0 THEN 1 - (ax - floor(ax)) ELSE ax - floor(ax) END * CASE j WHEN 0 THEN 1 - (ay - floor(ay)) ELSE ay - floor(ay) END AS w FROM l, (SELECT unnest([0, 1]) AS i) p, (SELECT unnest([0, 1]) AS j) q)
SELECT vol_id, proj, px, py, round(sum(v * w) / sum(w) + 0.5, 5) + 0.0 AS v FROM s WHERE w > 1e-12 AND px < 4 AND py < 4 GROUP BY ALL""")
def n23(spark, sf):
    """Bricks become partial projections; no voxel does."""
    volumes = of_series(fo_bricks(spark, sf), "vol_id", spark, sf)
    region = vo.Region(start=(1.0, 0.0, 0.0), size=(3.0, 4.0, 4.0))
    return vo.project_bricks(volumes, views(spark, sf), (1.5, 1.5, 1.5), (4, 4), region, 0.5).withColumn("v", clean0(F.col("v"), 5))


@query("n24_project_points", f"""WITH {_VIEWS}, p AS (SELECT l_suppkey AS series, l_orderkey % 100 AS x, l_partkey % 70 AS y, l_linenumber * 8 AS z FROM lineitem)
SELECT series, proj, count(*) AS n, round(sum((x - 50) * m00 + (y - 35) * m01 + (z - 30) * m02 + 50), 3) + 0.0 AS px, round(sum((x - 50) * m10 + (y - 35) * m11 + (z - 30) * m12 + 35), 3) + 0.0 AS py FROM p JOIN views USING (series) GROUP BY ALL""")
def n24(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("series"), (F.col("l_orderkey") % 100).alias("x"), (F.col("l_partkey") % 70).alias("y"), (F.col("l_linenumber") * 8).alias("z"))
    seen = cv.project_points(points, views(spark, sf), (50.0, 35.0, 30.0))
    return seen.groupBy("series", "proj").agg(F.count(F.lit(1)).alias("n"), clean0(F.sum("px"), 3).alias("px"), clean0(F.sum("py"), 3).alias("py"))


_M = [f"m{i}{j}" for i in range(3) for j in range(3)]


@query("n25_tilt_views", f"WITH {_VIEWS} SELECT series, proj, " + ", ".join(f"round({m}, 8) + 0.0 AS {m}" for m in _M) + " FROM views")
def n25(spark, sf):
    return views(spark, sf).select("series", "proj", *[clean0(F.col(m), 8).alias(m) for m in _M])


_GEN = [(f"m0{k} * {n - 1}", f"m1{k} * {n - 1}") for k, n in enumerate((5, 4, 3))]
_FOOT = " AND ".join(f"abs((py - my) * {gx} - (px - mx) * {gy}) <= (" + " + ".join(f"abs({ey} * {gx} - {ex} * {gy})" for ex, ey in _GEN) + ") / 2 + 1e-6" for gx, gy in _GEN)


@query("n26_footprint", f"""WITH {_VIEWS}, g AS (SELECT *, (4 - 5.5) * m00 + (4.5 - 5.5) * m01 + (6 - 5.5) * m02 + 5.5 AS mx, (4 - 5.5) * m10 + (4.5 - 5.5) * m11 + (6 - 5.5) * m12 + 5.5 AS my, px, py FROM views, (SELECT unnest(range(12)) AS px) a, (SELECT unnest(range(12)) AS py) b)
SELECT series, proj, px::INT AS px, py::INT AS py FROM g WHERE {_FOOT}""")
def n26(spark, sf):
    return cv.box_footprint(views(spark, sf), (2, 3, 5), (5, 4, 3), (5.5, 5.5, 5.5), (12, 12)).select("series", "proj", "px", "py")


@query("n26_sphere_footprint", f"""WITH {_VIEWS}, g AS (SELECT *, (4 - 5.5) * m00 + (4.5 - 5.5) * m01 + (6 - 5.5) * m02 + 5.5 AS mx, (4 - 5.5) * m10 + (4.5 - 5.5) * m11 + (6 - 5.5) * m12 + 5.5 AS my, px, py FROM views, (SELECT unnest(range(12)) AS px) a, (SELECT unnest(range(12)) AS py) b)
SELECT series, proj, px::INT AS px, py::INT AS py FROM g WHERE (px - mx) ** 2 + (py - my) ** 2 <= 6.25 + 1e-6""")
def n26_sphere(spark, sf):
    return cv.sphere_footprint(views(spark, sf), (4, 4.5, 6), 2.5, (5.5, 5.5, 5.5), (12, 12)).select("series", "proj", "px", "py")


@query("n27_log_intensity", f"{_I} SELECT img, {_T.format(v='ln(v + 1.5)')} FROM images GROUP BY img")
def n27(spark, sf):
    return total(images(spark, sf).withColumn("v", cv.log_intensity(F.col("v"), 1.5)), ["img"])


_BALL = "SELECT unnest([-1, 0, 0, 0, 0, 0, 1]) AS oz, unnest([0, -1, 0, 0, 0, 1, 0]) AS ox, unnest([0, 0, -1, 0, 1, 0, 0]) AS oy"


# volumes of 8 x 8 x 8 voxels, each made of eight vectors as its bricks
_CUBES = f"""{VOXELS_SQL}, cubes AS (SELECT vol_id // 8 AS vol_id, (z + 4 * (vol_id % 8 // 4))::INT AS z, (x + 4 * (vol_id % 4 // 2))::INT AS x, (y + 4 * (vol_id % 2))::INT AS y, v FROM voxels),
held AS (SELECT vol_id FROM cubes GROUP BY vol_id HAVING count(*) = 512), big AS (SELECT cubes.* FROM cubes SEMI JOIN held USING (vol_id))"""
EIGHT, FOUR = (8, 8, 8), (4, 4, 4)


def cubes(spark, sf):
    """Bricks of the volumes that have all eight of theirs."""
    k = F.col("vec_id")
    numbers = [(F.floor(k / 4) % 2).alias("bz"), (F.floor(k / 2) % 2).alias("bx"), (k % 2).alias("by")]
    rows = table(spark, sf, "embeddings").select(F.floor(k / 8).alias("vol_id"), *numbers, F.col("embedding").alias("data"))
    rows = rows.select("vol_id", "bz", "bx", "by", *[(F.col(f"b{a}") * 4).alias(f"{a}0") for a in "zxy"], *[F.lit(4).alias(f"n{a}") for a in "zxy"], "data")
    return rows.join(rows.groupBy("vol_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 8").select("vol_id"), "vol_id", "left_semi")


@query("n28_bead_score_bricks", f"""WITH {_CUBES}, ball AS ({_BALL}),
sc AS (SELECT b.vol_id, (b.z + oz + 8) % 8 AS z, (b.x + ox + 8) % 8 AS x, (b.y + oy + 8) % 8 AS y, -sum(v) AS v FROM big b, ball GROUP BY ALL),
st AS (SELECT vol_id, avg(v) + 2 * stddev_pop(v) AS cut FROM sc GROUP BY vol_id) SELECT sc.vol_id, z, x, y, round(v, 5) + 0.0 AS v FROM sc JOIN st USING (vol_id) WHERE v > cut""")
def n28_bricks(spark, sf):
    """Beads lie across the eight bricks of a volume, which exchange their faces."""
    score = vo.bead_score_bricks(cubes(spark, sf), EIGHT, FOUR, 2.0)
    return vo.strong_voxels(score, 2.0).withColumn("v", clean0(F.col("v"), 5))


@query("n28_bead_score_wedge", f"""WITH {_CUBES}, ks AS (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3]) AS k), ball AS ({_BALL}), freq AS (SELECT a.k AS kz, b.k AS kx, c.k AS ky FROM ks a, ks b, ks c),
kept AS (SELECT kz, kx, ky, CASE WHEN {_WEDGE} THEN 0 ELSE sum(-cos(2 * pi() * (kz * oz + kx * ox + ky * oy) / 8)) END AS t FROM freq, ball GROUP BY kz, kx, ky),
near AS (SELECT a.i AS dz, b.i AS dx, c.i AS dy, sum(t * cos(2 * pi() * (kz * a.i + kx * b.i + ky * c.i) / 8)) / 512 AS w FROM kept, range(8) a(i), range(8) b(i), range(8) c(i) GROUP BY ALL),
sc AS (SELECT vol_id, (z + dz) % 8 AS z, (x + dx) % 8 AS x, (y + dy) % 8 AS y, sum(v * w) AS v FROM big, near GROUP BY ALL),
st AS (SELECT vol_id, avg(v) + 2 * stddev_pop(v) AS cut FROM sc GROUP BY vol_id) SELECT sc.vol_id, z::INT AS z, x::INT AS x, y::INT AS y, round(v, 5) + 0.0 AS v FROM sc JOIN st USING (vol_id) WHERE v > cut""")
def n28_wedge(spark, sf):
    """The same without the frequencies of the missing wedge: transformed by transposition, there and back."""
    score = vo.bead_score_wedge(cubes(spark, sf), EIGHT, 2.0, _WEDGE_RANGE, block=4)
    return vo.strong_voxels(score, 2.0).withColumn("v", clean0(F.col("v"), 5))


# a ball of diameter 2 has the centre and its six neighbours; the transform of minus it, without the wedge, times that of the volume
@query("n28_bead_score", _PLAIN + f""", ball AS ({_BALL}), tmpl AS (SELECT kz, kx, ky, CASE WHEN {_WEDGE} THEN 0 ELSE sum(-cos(2 * pi() * (kz * oz + kx * ox + ky * oy) / 4)) END AS t FROM freq, ball GROUP BY kz, kx, ky),
prod AS (SELECT vol_id, kz, kx, ky, re * t AS re, im * t AS im FROM ft JOIN tmpl USING (kz, kx, ky)),
sc AS (SELECT p.vol_id, v.z, v.x, v.y, sum(re * cos(2 * pi() * (kz * z + kx * x + ky * y) / 4) - im * sin(2 * pi() * (kz * z + kx * x + ky * y) / 4)) / 64 AS v FROM prod p, (SELECT a.i::INT AS z, b.i::INT AS x, c.i::INT AS y FROM range(4) a(i), range(4) b(i), range(4) c(i)) v GROUP BY ALL),
st AS (SELECT vol_id, avg(v) + 2 * stddev_pop(v) AS cut FROM sc GROUP BY vol_id) SELECT sc.vol_id, z, x, y, round(v, 5) + 0.0 AS v FROM sc JOIN st USING (vol_id) WHERE v > cut""")
def n28(spark, sf):
    volumes = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "vol_id")
    made = cv.bead_score(volumes, "vol_id", "embedding", (4, 4, 4), 2.0, _WEDGE_RANGE)
    flat = made.select("vol_id", F.posexplode("score").alias("i", "v"))
    i = F.col("i")
    score = flat.select("vol_id", F.floor(i / 16).cast("int").alias("z"), (F.floor(i / 4) % 4).cast("int").alias("x"), (i % 4).cast("int").alias("y"), "v")
    return cv.above_deviation(score, ["vol_id"], 2.0).withColumn("v", clean0(F.col("v"), 5))


# tiles of 2 x 2 from place 2 to place 5 of each axis; the strongest first, and what it beats beats nothing
@query("n29_peaks", f"""{_I.replace('WITH', 'WITH RECURSIVE')}, tops AS (SELECT img, px // 2 AS tx, py // 2 AS ty, max(v) AS v FROM images WHERE v > 0.05 AND px BETWEEN 2 AND 5 AND py BETWEEN 2 AND 5 GROUP BY ALL), p AS (SELECT t.img, i.px, i.py, t.v FROM tops t JOIN images i ON i.img = t.img AND i.v = t.v AND i.px // 2 = tx AND i.py // 2 = ty),
r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, px, py) AS k FROM p),
g AS (SELECT img, k, [{{'x': px, 'y': py, 'v': v}}] AS kept FROM r WHERE k = 1 UNION ALL SELECT g.img, r.k, CASE WHEN len([c FOR c IN kept IF (c.x - px) ** 2 + (c.y - py) ** 2 < 4]) = 0 THEN list_append(kept, {{'x': px, 'y': py, 'v': v}}) ELSE kept END FROM g JOIN r ON r.img = g.img AND r.k = g.k + 1),
e AS (SELECT img, unnest(kept) AS c FROM (SELECT img, arg_max(kept, k) AS kept FROM g GROUP BY img))
SELECT img, c.x AS px, c.y AS py, round(c.v, 7) AS v FROM e""")
def n29(spark, sf):
    return cv.pick_peaks(images(spark, sf), ["img"], {"px": 8, "py": 8}, 2, F.lit(0.05)).select("img", "px", "py", F.round("v", 7).alias("v"))


@query("n30_unbin", "SELECT o_orderkey, (o_orderkey % 100) * f + (f - 1) / 2 AS x FROM (SELECT *, greatest(o_custkey % 12 // 3, 1) AS f FROM orders)")
def n30(spark, sf):
    f = F.greatest(F.floor(F.col("o_custkey") % 12 / 3), F.lit(1))
    return table(spark, sf, "orders").select("o_orderkey", cv.unbin_coordinate(F.col("o_orderkey") % 100, f).alias("x"))


_C = "centres AS (SELECT img, b AS bead, (img * 3 + b * 4) % 8 AS cx, (img * 5 + b * 3) % 8 AS cy FROM (SELECT DISTINCT img FROM images), (SELECT unnest([0, 1, 2]) AS b))"


def centres(spark, sf):
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), F.explode(F.array(*[F.lit(b) for b in range(3)])).alias("bead"))
    return ids.select("img", "bead", ((F.col("img") * 3 + F.col("bead") * 4) % 8).cast("int").alias("cx"), ((F.col("img") * 5 + F.col("bead") * 3) % 8).cast("int").alias("cy"))


_RING = f"{_I}, {_C}, d AS (SELECT i.img, bead, px, py, v, (px - cx) ** 2 + (py - cy) ** 2 AS d2 FROM images i JOIN centres c ON i.img = c.img), rings AS (SELECT img, bead, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n FROM d WHERE d2 >= 4 AND d2 < 16 GROUP BY ALL)"


@query("n31_ring_stats", _RING + " SELECT img, bead, round(mean, 7) + 0.0 AS mean, round(std, 7) AS std, n FROM rings")
def n31(spark, sf):
    return cv.ring_stats(images(spark, sf), centres(spark, sf), ["img"], 2).select("img", "bead", clean0(F.col("mean"), 7).alias("mean"), F.round("std", 7).alias("std"), "n")


@query("n32_erase_beads", _RING + f", fill AS (SELECT d.img, px, py, arg_max(mean, d.bead) AS fill FROM d JOIN rings USING (img, bead) WHERE d2 < 5.76 GROUP BY ALL) SELECT i.img, round(sum(coalesce(fill, v) * (1 + i.px * 8 + i.py)), 6) + 0.0 AS total FROM images i LEFT JOIN fill f ON f.img = i.img AND f.px = i.px AND f.py = i.py GROUP BY i.img")
def n32(spark, sf):
    return total(cv.erase_beads(images(spark, sf), centres(spark, sf), ["img"], 2), ["img"])


@query("n33_drop_and_swap", f"WITH {_CURVES} SELECT run, proj::INT AS proj, round(sum(value * CASE WHEN run % 2 = 1 THEN idx % 8 ELSE idx // 8 END), 6) AS total FROM flat WHERE proj NOT IN (3, 8) GROUP BY ALL")
def n33(spark, sf):
    gone = spark.createDataFrame([(3,), (8,)], "proj int")
    placed = curves(spark, sf).withColumn("px", F.floor(F.col("idx") / 8).cast("int")).withColumn("py", F.col("idx") % 8)
    out = cv.drop_excluded(placed, gone, swap=F.col("run") % 2 == 1)
    return out.groupBy("run", "proj").agg(F.round(F.sum(F.col("value") * F.col("px")), 6).alias("total"))


@query("n34_count_check", f"WITH {_CURVES} SELECT run, count(DISTINCT proj) AS n_proj, count(DISTINCT tilt) AS n_tilt, count(DISTINCT proj) = count(DISTINCT tilt) AS consistent FROM flat GROUP BY run")
def n34(spark, sf):
    flat = curves(spark, sf)
    return cv.assert_counts(flat.select("run", "proj"), flat.select("run", "tilt").distinct(), ["run"]).select("run", "n_proj", "n_tilt", (F.col("n_proj") == F.col("n_tilt")).alias("consistent"))


# images 3k, 3k + 1 and 3k + 2: input, miss and full; the first two rescaled to the third within a circle
_MASKED = f"""{_I}, st AS (SELECT img, avg(v) FILTER ({_SPH}) AS m, stddev_pop(v) FILTER ({_SPH}) AS sd, avg(v) FILTER (NOT {_SPH}) AS bg FROM images GROUP BY img),
ready AS (SELECT i.img, px, py, CASE WHEN NOT {_SPH} THEN f.bg WHEN i.img % 3 = 2 THEN v ELSE (v - s.m) / s.sd * f.sd + f.m END AS v FROM images i JOIN st s ON s.img = i.img JOIN st f ON f.img = i.img // 3 * 3 + 2)"""
_DRIVER = _MASKED + _TRI.replace(_I, "", 1).replace("any_value(label) AS label, ", "").replace("FROM images, ks", "FROM ready, ks")


def disc(n=8, c=4, r=3):
    x, y = np.mgrid[0:n, 0:n] - c
    return x * x + y * y <= r * r


@query("n35_cross_validation_driver", _DRIVER + f", g AS (SELECT proj % 10 AS run, idx, sum(cm) AS cm, sum(mm) AS mm, sum(cf) AS cf, sum(ff) AS ff FROM sums GROUP BY ALL) SELECT run, idx, round({_RATIO.format(low=0)}, 2) + 0.0 AS value FROM g")
def n35(spark, sf):
    return cv.nloo3d(validated(spark, sf).withColumn("run", F.col("proj") % 10), ["run"]).select("run", "idx", clean0(F.col("value"), 2).alias("value"))


def validated(spark, sf):
    three = arrays(spark, sf, 3).withColumnsRenamed({"run": "proj", "v1": "input", "v2": "miss", "v3": "full"})
    return cv.cross_validate(three, (8, 8), disc(), count=SHELLS_2D)


@query("n35_projection_table", _DRIVER + f", c AS (SELECT proj, idx, idx / 8 AS s, round({_RATIO.format(low=0)}, 6) AS value FROM sums), steps_ AS (SELECT *, lag(value) OVER (PARTITION BY proj ORDER BY idx) AS v0, lag(s) OVER (PARTITION BY proj ORDER BY idx) AS s0 FROM c) SELECT proj, round(coalesce(1 / arg_max(s0 + (s - s0) * (v0 - 0.3) / (v0 - value), idx) FILTER (v0 >= 0.3 AND value < 0.3), 0), 2) AS res FROM steps_ GROUP BY proj")
def n35_table(spark, sf):
    curve = cv.nloo_ratio(validated(spark, sf)).select("proj", "idx", (F.col("idx") / 8).alias("s"), F.round("value", 6).alias("value"))
    return cv.last_crossings(curve, ["proj"], [0.3]).select("proj", F.round("res", 2).alias("res"))


# the mask of each image is the footprint of a box of 5 x 4 x 7 voxels in its own view; every second projection, without two
_TILT5 = "radians((proj % 9) * 12.0 - 48)"
_GEN5 = [(f"cos({_TILT5}) * 4", "0.0"), (f"-sin({_TILT5}) * sin(0.05) * 3", "cos(0.05) * 3"), (f"-sin({_TILT5}) * cos(0.05) * 6", "-sin(0.05) * 6")]
_AT5 = [f"(3 - 3.5) * cos({_TILT5}) + (3.5 - 3.5) * (-sin({_TILT5}) * sin(0.05)) + (4 - 3.5) * (-sin({_TILT5}) * cos(0.05)) + 3.5", "(3.5 - 3.5) * cos(0.05) + (4 - 3.5) * (-sin(0.05)) + 3.5"]


def _slab5(k):
    gx, gy = _GEN5[k]
    reach = " + ".join(f"abs(({ey}) * ({gx}) - ({ex}) * ({gy}))" for ex, ey in _GEN5)
    return f"abs((py - my) * ({gx}) - (px - mx) * ({gy})) <= ({reach}) / 2 + 1e-6 * sqrt(({gx}) ** 2 + ({gy}) ** 2) OR ({gx}) ** 2 + ({gy}) ** 2 < 1e-18"


_VIEW5 = f"""{_I}, seen AS (SELECT *, img // 3 AS proj FROM images WHERE img // 3 % 2 = 0 AND img // 3 NOT IN (4, 10)), placed AS (SELECT *, {_AT5[0]} AS mx, {_AT5[1]} AS my FROM seen),
covered AS (SELECT *, ({_slab5(0)}) AND ({_slab5(1)}) AND ({_slab5(2)}) AS inside FROM placed),
full_ AS (SELECT proj, px, py, v AS f FROM seen WHERE img % 3 = 2), both_ AS (SELECT c.*, f FROM covered c JOIN full_ USING (proj, px, py)),
st AS (SELECT img, avg(v) FILTER (inside) AS m, avg(f) FILTER (inside) AS fm, avg(f) FILTER (NOT inside) AS bg, covar_pop(v, f) FILTER (inside) / var_pop(v) FILTER (inside) AS slope FROM both_ GROUP BY img),
ready AS (SELECT img, px, py, CASE WHEN NOT inside THEN bg WHEN img % 3 = 2 THEN v ELSE (v - m) * slope + fm END AS v FROM both_ JOIN st USING (img))"""
_DRIVER5 = _VIEW5 + _TRI.replace(_I, "", 1).replace("any_value(label) AS label, ", "").replace("FROM images, ks", "FROM ready, ks")


def seen_projections(spark, sf):
    """Three images for each projection with the region of its view: 9 tilts, an x tilt, and a box for all."""
    gone = spark.createDataFrame([(4,), (10,)], "proj long")
    three = arrays(spark, sf, 3).withColumnsRenamed({"run": "proj", "v1": "input", "v2": "miss", "v3": "full"})
    tilts = cv.selected(three, gone, 2).withColumns({"tilt": F.col("proj") % 9 * 12.0 - 48, "xtilt": F.degrees(F.lit(0.05))})
    return cv.view_regions(cv.tilt_views(tilts), (3.5, 3.5, 3.5), start=(1.0, 2.0, 1.0), size=(5.0, 4.0, 7.0))


@query("n35_views", _DRIVER5 + f" SELECT proj, idx, round({_RATIO.format(low=0)}, 3) + 0.0 AS value FROM sums WHERE abs(cf) > 1e-4 AND mm > 1e-4")
def n35_views(spark, sf):
    """Each projection masked by the footprint of its own view, lines fitted within it."""
    sums = cv.cross_validate_views(seen_projections(spark, sf), (8, 8), "line", count=SHELLS_2D).filter("abs(cf) > 1e-4 and mm > 1e-4")
    return cv.nloo_ratio(sums).select("proj", "idx", clean0(F.col("value"), 3).alias("value"))


@query("n35_footprint_spans", _VIEW5 + " SELECT proj, py, min(px)::INT AS first, max(px)::INT AS last FROM covered WHERE inside AND img % 3 = 2 GROUP BY ALL")
def n35_spans(spark, sf):
    return cv.footprint_spans(seen_projections(spark, sf), (8, 8), ["proj"])


_BALL3 = "(z - 2) ** 2 + (x - 2) ** 2 + (y - 2) ** 2"
# v1 rescaled to v2 in a ball of radius 2, both with an edge of 0.3 at its border
_HALVES = _PLAIN.replace("FROM (SELECT *, 1 AS w FROM voxels)", f"""FROM (SELECT i.vol_id, z, x, y, 1 AS w, CASE WHEN {_BALL3} > 4 THEN l.bg ELSE (CASE WHEN i.vol_id % 2 = 1 THEN v ELSE (v - s.m) / s.sd * l.sd + l.m END - l.bg) * CASE WHEN 2 - sqrt({_BALL3}) < 0.3 THEN 0.5 - 0.5 * cos(pi() * (2 - sqrt({_BALL3})) / 0.3) ELSE 1 END + l.bg END AS v
  FROM voxels i JOIN hs s ON s.vol_id = i.vol_id JOIN hs l ON l.vol_id = i.vol_id // 2 * 2 + 1)""").replace(", ks AS", f", hs AS (SELECT vol_id, avg(v) FILTER ({_BALL3} <= 4) AS m, stddev_pop(v) FILTER ({_BALL3} <= 4) AS sd, avg(v) FILTER ({_BALL3} > 4) AS bg FROM voxels GROUP BY vol_id), ks AS", 1)
_EVEN_ODD = _HALVES + _shelled(_R, SHELLS_3D).replace("{src}", f"(SELECT * FROM fts WHERE NOT ({_WEDGE}))") + ", p AS (SELECT run, idx::INT AS idx, sum(re1 * re2 + im1 * im2) AS c, sum(re1 ** 2 + im1 ** 2) AS c1, sum(re2 ** 2 + im2 ** 2) AS c2 FROM e GROUP BY ALL), q AS (SELECT run, idx, CASE WHEN idx = 0 THEN 1 ELSE greatest(least(coalesce(c / nullif(sqrt(c1 * c2), 0), 0), 1), 0) END AS value FROM p)"


@query("n36_even_odd_driver", _EVEN_ODD + ", c AS (SELECT run, idx, idx / 4 AS s, round(CASE WHEN idx = 0 THEN 1 ELSE 2 * value / (value + 1) END, 6) AS value FROM q), st AS (SELECT *, lag(value) OVER (PARTITION BY run ORDER BY idx) AS v0, lag(s) OVER (PARTITION BY run ORDER BY idx) AS s0 FROM c) SELECT run, round(coalesce(1 / arg_max(s0 + (s - s0) * (v0 - 0.3) / (v0 - value), idx) FILTER (v0 >= 0.3 AND value < 0.3), 0), 2) AS res FROM st GROUP BY run")
def n36(spark, sf):
    """Rescaled halves with an edge, correlation of the whole from that of the halves without the wedge, last crossing."""
    z, x, y = np.mgrid[0:4, 0:4, 0:4] - 2
    r = np.sqrt(z * z + x * x + y * y)
    edge = (2 - r, cv.taper_size((2.0,), radius=True))
    curve = cv.even_odd_resolution(arrays(spark, sf), "run", (4, 4, 4), r <= 2, edge, _WEDGE_RANGE, count=SHELLS_3D)
    curve = curve.select("run", "idx", (F.col("idx") / 4).alias("s"), F.round("value", 6).alias("value"))
    return cv.last_crossings(curve, ["run"], [0.3]).select("run", F.round("res", 2).alias("res"))


_BOX3 = "(z BETWEEN 0 AND 6 AND x BETWEEN 1 AND 7 AND y BETWEEN 0 AND 7)"
_NEAR3 = "least(z, 6 - z, x - 1, 7 - x, y, 7 - y)"
_HALVES8 = f"""WITH {_CUBES}, st AS (SELECT vol_id, avg(v) FILTER ({_BOX3}) AS m, stddev_pop(v) FILTER ({_BOX3}) AS sd, avg(v) FILTER (NOT {_BOX3}) AS bg FROM big GROUP BY vol_id),
ready AS (SELECT i.vol_id, z, x, y, CASE WHEN NOT {_BOX3} THEN l.bg ELSE ((CASE WHEN i.vol_id % 2 = 1 THEN v ELSE (v - s.m) / s.sd * l.sd + l.m END) - l.bg) * CASE WHEN {_NEAR3} < 0.525 THEN 0.5 - 0.5 * cos(pi() * {_NEAR3} / 0.525) ELSE 1 END + l.bg END AS v
  FROM big i JOIN st s ON s.vol_id = i.vol_id JOIN st l ON l.vol_id = i.vol_id // 2 * 2 + 1),
ks AS (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3]) AS k),
fy AS (SELECT vol_id, z, x, k AS ky, sum(v * cos(2 * pi() * k * y / 8)) AS re, sum(-v * sin(2 * pi() * k * y / 8)) AS im FROM ready, ks GROUP BY ALL),
fx AS (SELECT vol_id, z, k AS kx, ky, sum(re * cos(2 * pi() * k * x / 8) + im * sin(2 * pi() * k * x / 8)) AS re, sum(im * cos(2 * pi() * k * x / 8) - re * sin(2 * pi() * k * x / 8)) AS im FROM fy, ks GROUP BY ALL),
ft AS (SELECT vol_id, k AS kz, kx, ky, sum(re * cos(2 * pi() * k * z / 8) + im * sin(2 * pi() * k * z / 8)) AS re, sum(im * cos(2 * pi() * k * z / 8) - re * sin(2 * pi() * k * z / 8)) AS im FROM fx, ks GROUP BY ALL),
fts AS (SELECT a.vol_id // 2 AS run, a.kz, a.kx, a.ky, a.re AS re1, a.im AS im1, b.re AS re2, b.im AS im2 FROM ft a JOIN ft b ON b.vol_id = a.vol_id + 1 AND a.kz = b.kz AND a.kx = b.kx AND a.ky = b.ky WHERE a.vol_id % 2 = 0)"""
SHELLS_8 = 6
_EVEN_ODD8 = _HALVES8 + _shelled(_R, SHELLS_8).replace("{src}", f"(SELECT * FROM fts WHERE NOT ({_WEDGE}))") + ", p AS (SELECT run, idx::INT AS idx, sum(re1 * re2 + im1 * im2) AS c, sum(re1 ** 2 + im1 ** 2) AS c1, sum(re2 ** 2 + im2 ** 2) AS c2 FROM e GROUP BY ALL), q AS (SELECT run, idx, CASE WHEN idx = 0 THEN 1 ELSE greatest(least(coalesce(c / nullif(sqrt(c1 * c2), 0), 0), 1), 0) END AS value FROM p)"


def pairs_of_cubes(spark, sf):
    ids = cubes(spark, sf).select("vol_id").distinct()
    odd = ids.select((F.col("vol_id") - 1).alias("a"), F.col("vol_id").alias("b")).filter("b % 2 = 1")
    return odd.join(ids.withColumnRenamed("vol_id", "a"), "a", "left_semi").select(F.floor(F.col("a") / 2).alias("run"), "a", "b")


@query("n36_even_odd_bricks", _EVEN_ODD8 + " SELECT run, idx, round(CASE WHEN idx = 0 THEN 1 ELSE 2 * value / (value + 1) END, 4) + 0.0 AS value FROM q")
def n36_bricks(spark, sf):
    """Half-data volumes of eight bricks each, rescaled within a box with an edge, transformed section by section and block by block."""
    region = vo.Region(start=(0.0, 1.0, 0.0), size=(7.0, 7.0, 8.0))
    curve = vo.even_odd_curve(cubes(spark, sf), pairs_of_cubes(spark, sf), EIGHT, region, _WEDGE_RANGE, count=SHELLS_8, block=4)
    return curve.select("run", "idx", clean0(F.col("value"), 4).alias("value"))


_FTS8 = _HALVES8.replace("FROM ready, ks", "FROM big, ks")


@query("n05_correlation_bricks", _FTS8 + " SELECT run, kz, kx, ky, round(greatest(least((re1 * re2 + im1 * im2) / sqrt((re1 ** 2 + im1 ** 2) * (re2 ** 2 + im2 ** 2)), 1), 0), 3) + 0.0 AS c FROM (SELECT * REPLACE (abs(ky) AS ky) FROM fts WHERE ky >= 0 OR ky = -4) WHERE (re1 ** 2 + im1 ** 2) * (re2 ** 2 + im2 ** 2) > 1e-9")
def n05_bricks(spark, sf):
    found = vo.frequency_correlations(cubes(spark, sf), pairs_of_cubes(spark, sf), EIGHT, block=4)
    return found.select("run", "kz", "kx", F.abs("ky").alias("ky"), clean0(F.col("c"), 3).alias("c"))


@query("v28_crop_bricks", _FTS8 + " SELECT vol_id, kz, kx, abs(ky)::INT AS ky, round(re, 4) + 0.0 AS re, round(CASE WHEN ky = -4 THEN -im ELSE im END, 4) + 0.0 AS im FROM ft WHERE kz BETWEEN -2 AND 1 AND kx BETWEEN -3 AND 2 AND ky BETWEEN 0 AND 1")
def v28_bricks(spark, sf):
    found = vo.cropped_transforms(cubes(spark, sf), EIGHT, (4, 6, 4), block=4).filter("ky >= 0")
    return found.select("vol_id", "kz", "kx", "ky", clean0(F.col("re"), 4).alias("re"), clean0(F.col("im"), 4).alias("im"))


@query("n37_resolution_limit", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE END, p_retailprice / (p_size + 1)) AS res FROM part")
def n37(spark, sf):
    option = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double"))
    return table(spark, sf, "part").select("p_partkey", cv.resolution_limit(option, F.col("p_retailprice"), F.col("p_size") + 1).alias("res"))


# the region of each image comes with it, on data binned by 1 or 2
@query("n38_fill_ratio", f"{_I}, b AS (SELECT *, (img % 5 + 2) / (1 + img % 2)::DOUBLE AS size, (img % 3) / (1 + img % 2)::DOUBLE AS start FROM images) SELECT img, round(count(*) FILTER (px BETWEEN start AND start + size - 1 AND py BETWEEN start AND start + size - 1 AND v > -0.1) / count(*), 6) AS ratio FROM b GROUP BY img")
def n38(spark, sf):
    shapes = images(spark, sf).withColumns({"size": F.col("img") % 5 + 2, "start": F.col("img") % 3})
    binned = cv.scale_region(shapes, 1 + F.col("img") % 2, ["size", "start"])
    region = cv.inside_box([(F.col(a), F.col("start"), F.col("size")) for a in ("px", "py")]) & (F.col("v") > -0.1)
    return cv.fill_ratio(binned, ["img"], region).withColumn("ratio", F.round("ratio", 6))

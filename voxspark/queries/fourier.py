"""F: Fourier shell correlation on cubes and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import fourier as fo
from .proxies import IMAGES_SQL, VOXELS_SQL, images, voxels
from .registry import query, table

_V = f"WITH {VOXELS_SQL}"
AXES = [("z", 4), ("x", 4), ("y", 4)]
PAIR = ["run"]


def clean0(c, digits):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + 0.0


def tiles(spark, sf):
    return voxels(spark, sf).withColumnsRenamed({"z": "dz", "x": "dx", "y": "dy"})


def halves(df, key, columns):
    """Values of volumes 2k and 2k + 1 side by side, by ``run`` = k and ``columns``; one shuffle."""
    side = F.col(key) % 2
    values = [c for c in df.columns if c not in (key, "label", *columns)]
    out = df.groupBy(F.floor(F.col(key) / 2).alias("run"), *columns).agg(
        *[F.max(F.when(side == i, F.col(c))).alias(f"{c}{i + 1}") for c in values for i in (0, 1)], F.count(F.lit(1)).alias("sides"))
    return out.filter("sides = 2").drop("sides")


_PAIRS = f"""{_V}, pairs AS (SELECT a.vol_id // 2 AS run, a.z, a.x, a.y, a.v AS v1, b.v AS v2 FROM voxels a JOIN voxels b ON b.vol_id = a.vol_id + 1 AND a.z = b.z AND a.x = b.x AND a.y = b.y WHERE a.vol_id % 2 = 0)"""
_FT = _PAIRS + """, ks AS (SELECT unnest([-2, -1, 0, 1]) AS k),
freq AS (SELECT a.k AS kz, b.k AS kx, c.k AS ky FROM ks a, ks b, ks c),
ft AS (SELECT vol_id, kz, kx, ky, sum(v * w * cos(2 * pi() * (kz * z + kx * x + ky * y) / 4)) AS re, sum(-v * w * sin(2 * pi() * (kz * z + kx * x + ky * y) / 4)) AS im
  FROM (SELECT *, {window} AS w FROM voxels), freq GROUP BY ALL),
fts AS (SELECT a.vol_id // 2 AS run, a.kz, a.kx, a.ky, a.re AS re1, a.im AS im1, b.re AS re2, b.im AS im2 FROM ft a JOIN ft b ON b.vol_id = a.vol_id + 1 AND a.kz = b.kz AND a.kx = b.kx AND a.ky = b.ky WHERE a.vol_id % 2 = 0),
idx AS (SELECT *, round_even(sqrt(kz * kz + kx * kx + ky * ky), 0)::INT AS index FROM fts),
shells AS (SELECT run, f, sum(re1 * re2 + im1 * im2) AS cr, sum(im1 * re2 - re1 * im2) AS ci, sum(re1 * re1 + im1 * im1) AS c1, sum(re2 * re2 + im2 * im2) AS c2, count(*) AS npts
  FROM idx, (SELECT unnest([0, 1, 2]) AS f) r WHERE abs(index - f) <= {rings} // 2 GROUP BY ALL),
curve AS (SELECT *, sqrt(cr * cr + ci * ci) / nullif(sqrt(c1 * c2), 0) AS fsc,
  ({s} + 2 * sqrt({s}) / sqrt(npts + 2.220446049250313e-16) + 1 / sqrt(npts)) / ({s} + 2 * sqrt({s}) / sqrt(npts + 2.220446049250313e-16) + 1) AS t FROM shells)"""
_PLAIN = _FT.replace("{window}", "1").replace("{rings}", "0").replace("{s}", "0.2071::DOUBLE")


def arrays(spark, sf, members=2):
    """``run, v1, v2, ...``: vectors ``members * run``, the next one and so on, of runs that have them all."""
    side = F.col("vec_id") % members
    out = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / members).alias("run")).agg(
        *[F.max(F.when(side == i, F.col("embedding"))).alias(f"v{i + 1}") for i in range(members)], F.count(F.lit(1)).alias("sides"))
    return out.filter(F.col("sides") == members).drop("sides")


def pairs_ft(spark, sf):
    return fo.frequencies(fo.fft_arrays(arrays(spark, sf), "run", ["v1", "v2"], (4, 4, 4)), PAIR, AXES)


def curve(spark, sf, rings=0, snr=0.2071):
    return fo.fsc(fo.shell_sums(pairs_ft(spark, sf), PAIR, fo.shell_index(AXES), rings, 2), snr)


def bricks(spark, sf):
    """Each vector as the one brick of a 4 x 4 x 4 volume."""
    zeros, fours = [F.lit(0).alias(c) for c in ("bz", "bx", "by", "z0", "x0", "y0")], [F.lit(4).alias(c) for c in ("nz", "nx", "ny")]
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("vol_id"), *zeros, *fours, F.col("embedding").alias("data"))


def pairs_of(spark, sf):
    k = F.col("vec_id")
    return table(spark, sf, "embeddings").filter(k % 2 == 0).select(F.floor(k / 2).alias("tile"), k.alias("a"), (k + 1).alias("b"), *[F.lit(0).alias(a) for a in "zxy"])


@query("f01_crop_tiles", _V + " SELECT vol_id * 8 + a.tz * 4 + a.tx * 2 + a.ty AS tile, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM voxels, (SELECT tz, tx, ty FROM (SELECT unnest([0, 1]) AS tz) p, (SELECT unnest([0, 1]) AS tx) q, (SELECT unnest([0, 1]) AS ty) r) a WHERE z BETWEEN tz * 2 AND tz * 2 + 1 AND x BETWEEN tx AND tx + 1 AND y BETWEEN ty AND ty + 1 GROUP BY 1")
def f01(spark, sf):
    two = F.array(F.lit(0), F.lit(1))
    plan = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vol_id")).withColumn("tz", F.explode(two)).withColumn("tx", F.explode(two)).withColumn("ty", F.explode(two))
    plan = plan.select((F.col("vol_id") * 8 + F.col("tz") * 4 + F.col("tx") * 2 + F.col("ty")).alias("tile"), "vol_id", (F.col("tz") * 2).alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"))
    parts = fo.crop_bricks(bricks(spark, sf), plan.withColumn("side", F.lit(1)), (4, 4, 4), (2, 2, 2))
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return parts.groupBy("tile").agg(F.sum(F.size("values")).alias("n"), clean0(F.sum(total), 6).alias("total"))


@query("f02_tile_centres", "SELECT l_orderkey, l_linenumber, l_partkey % 400 + floor(size / 2.0)::INT AS z FROM (SELECT *, CASE WHEN l_linenumber > 5 THEN -1 ELSE l_linenumber * 15 END AS size FROM lineitem)")
def f02(spark, sf):
    size = F.when(F.col("l_linenumber") > 5, -1).otherwise(F.col("l_linenumber") * 15)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 400 + C.half(size)).alias("z"))


_STATS = _PAIRS + """, s AS (SELECT run, count(*) AS n, avg(v1) AS m1, avg(v2) AS m2, max(v1) AS max1, max(v2) AS max2, covar_pop(v1, v2) AS c, var_pop(v1) AS a, var_pop(v2) AS b FROM pairs GROUP BY run)
SELECT run, {what} FROM s"""


def stats(spark, sf):
    return fo.pair_stats(halves(voxels(spark, sf), "vol_id", ["z", "x", "y"]), PAIR)


@query("f03_mean_pixel", _STATS.format(what="round((m1 + m2) / 2, 8) + 0.0 AS mean_pix"))
def f03(spark, sf):
    return stats(spark, sf).select("run", clean0(F.col("mean_pix"), 8).alias("mean_pix"))


@query("f04_empty_guard", _STATS.format(what="CASE WHEN max1 > 0.3 AND max2 > 0.3 THEN 'ok' ELSE 'empty' END AS status"))
def f04(spark, sf):
    # the vectors are centred on 0, so the maxima are taken above 0.3
    shifted = voxels(spark, sf).withColumn("v", F.col("v") - 0.3)
    return fo.pair_stats(halves(shifted, "vol_id", ["z", "x", "y"]), PAIR).select("run", "status")


@query("f05_pearson", _STATS.format(what="round(c / nullif(sqrt(a * b), 0), 8) + 0.0 AS corr"))
def f05(spark, sf):
    return stats(spark, sf).select("run", clean0(F.col("corr"), 8).alias("corr"))


_C8 = "CASE WHEN r <= 1 THEN 1.0 WHEN r >= 4 THEN 0.0 ELSE 0.5 + 0.5 * cos(pi() * (r - 1) / 3) END"


@query("f06_circular_window", f"WITH {IMAGES_SQL}, w AS (SELECT *, sqrt((px - 4) ** 2 + (py - 4) ** 2) AS r FROM images) SELECT img, round(sum(v * {_C8}), 7) + 0.0 AS total FROM w GROUP BY img")
def f06(spark, sf):
    w = fo.circle(8, 8, F.col("px"), F.col("py"), 3)
    return images(spark, sf).groupBy("img").agg(clean0(F.sum(F.col("v") * w), 7).alias("total"))


def _hann(i, n=8):
    return f"(0.5 - 0.5 * cos(2 * pi() * {i} / {n - 1}))"


# the windows as they are written down for the measurement: period n from the corner; with 4 flat points a period of
# 8 + 1 - 4 from place floor((4 - 1) / 2) on, and ones before that place
def _corner(i):
    return f"((1 + cos(2 * pi() * {i} / 8)) / 2)"


def _flat4(i):
    return f"CASE WHEN {i} < 1 THEN 1.0 ELSE (1 + cos(2 * pi() * ({i} - 1) / 5)) / 2 END"


@query("f07_fractional_hann", f"WITH {IMAGES_SQL} SELECT img, round(sum(v * {_corner('px')} * {_corner('py')}), 7) + 0.0 AS whole, round(sum(v * {_flat4('px')} * {_flat4('py')}), 7) + 0.0 AS edge FROM images GROUP BY img")
def f07(spark, sf):
    whole = fo.fractional_hann(8, F.col("px")) * fo.fractional_hann(8, F.col("py"))
    edge = fo.fractional_hann(8, F.col("px"), 4) * fo.fractional_hann(8, F.col("py"), 4)
    return images(spark, sf).groupBy("img").agg(clean0(F.sum(F.col("v") * whole), 7).alias("whole"), clean0(F.sum(F.col("v") * edge), 7).alias("edge"))


def _padded(i):
    """Six places from 1 on, 2 of them flat, rolled by three so that the top is in the middle."""
    return f"CASE WHEN {i} BETWEEN 1 AND 6 THEN (1 + cos(2 * pi() * (({i} - 1 + 3) % 6) / 5)) / 2 ELSE 0 END"


@query("f08_padded_hann", f"WITH {IMAGES_SQL} SELECT img, round(sum(v * {_padded('px')} * {_padded('py')}), 7) + 0.0 AS total FROM images GROUP BY img")
def f08(spark, sf):
    w = fo.hann_padded(8, 6, F.col("px"), 2) * fo.hann_padded(8, 6, F.col("py"), 2)
    return images(spark, sf).groupBy("img").agg(clean0(F.sum(F.col("v") * w), 7).alias("total"))


_W4 = "(CASE WHEN sqrt((x - 2) ** 2 + (y - 2) ** 2) <= 1 THEN 1.0 WHEN sqrt((x - 2) ** 2 + (y - 2) ** 2) >= 2 THEN 0.0 ELSE 0.5 + 0.5 * cos(pi() * (sqrt((x - 2) ** 2 + (y - 2) ** 2) - 1)) END * (1 + cos(2 * pi() * ((z + 2) % 4) / 3)) / 2)"


@query("f09_window_3d", f"{_V} SELECT vol_id, round(sum(v * {_W4}), 7) + 0.0 AS total FROM voxels GROUP BY vol_id")
def f09(spark, sf):
    w = fo.window3d(4, 4, 4, 1, 1)
    return tiles(spark, sf).groupBy("vol_id").agg(clean0(F.sum(F.col("v") * w), 7).alias("total"))


@query("f10_separable_hann", f"{_V} SELECT vol_id, round(sum(v * {_hann('z', 4)} * {_hann('x', 4)} * {_hann('y', 4)}), 7) + 0.0 AS total FROM voxels GROUP BY vol_id")
def f10(spark, sf):
    w = fo.plain_hann(4, F.col("z")) * fo.plain_hann(4, F.col("x")) * fo.plain_hann(4, F.col("y"))
    return voxels(spark, sf).groupBy("vol_id").agg(clean0(F.sum(F.col("v") * w), 7).alias("total"))


_DFT_OUT = " SELECT vol_id, kz, kx, ky, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ft"


@query("f11_dft_relational", _PLAIN + _DFT_OUT)
def f11(spark, sf):
    return fo.dft(tiles(spark, sf), ["vol_id"], AXES).select("vol_id", "kz", "kx", "ky", clean0(F.col("re"), 5).alias("re"), clean0(F.col("im"), 5).alias("im"))


@query("f11_fft_kernel", _PLAIN + _DFT_OUT)
def f11_kernel(spark, sf):
    made = fo.fft_kernel(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "vol_id"), "vol_id", "embedding", (4, 4, 4))
    flat = made.select("vol_id", F.posexplode(F.arrays_zip("re", "im")).alias("i", "c"))
    i = F.col("i")
    k = [(F.floor(i / 16) - 2).alias("kz"), (F.floor(i / 4) % 4 - 2).alias("kx"), (i % 4 - 2).alias("ky")]
    return flat.select("vol_id", *[c.cast("int").alias(n) for c, n in zip(k, ("kz", "kx", "ky"))], clean0(F.col("c.re"), 5).alias("re"), clean0(F.col("c.im"), 5).alias("im"))


@query("f12_shell_index", _PLAIN + " SELECT run, index, count(*) AS n, round(sum(re1 * (1 + ky)), 4) + 0.0 AS re FROM idx GROUP BY run, index")
def f12(spark, sf):
    return pairs_ft(spark, sf).groupBy("run", fo.shell_index(AXES).alias("index")).agg(F.count(F.lit(1)).alias("n"), clean0(F.sum(F.col("re1") * (1 + F.col("ky"))), 4).alias("re"))


@query("f13_nyquist_axis", "SELECT p_partkey, unnest(range(0, greatest(20 + p_size, 45) // 2 + 1))::INT AS f FROM part")
def f13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(fo.nyquist_axis(F.col("p_size") + 20, F.lit(45))).alias("f"))


@query("f14_overlapping_rings", _FT.replace("{window}", "1").replace("{rings}", "2").replace("{s}", "0.2071::DOUBLE") + " SELECT run, f, npts, round(cr, 4) + 0.0 AS cr, round(c1, 4) AS c1 FROM shells")
def f14(spark, sf):
    return curve(spark, sf, rings=2).select("run", "f", "npts", clean0(F.col("cr"), 4).alias("cr"), F.round("c1", 4).alias("c1"))


@query("f15_shell_sums", _PLAIN + " SELECT run, f, npts, round(cr, 5) + 0.0 AS cr, round(c1, 5) + 0.0 AS c1, round(c2, 5) + 0.0 AS c2, round(fsc, 5) + 0.0 AS fsc FROM curve")
def f15(spark, sf):
    return curve(spark, sf).select("run", "f", "npts", *[clean0(F.col(c), 5).alias(c) for c in ("cr", "c1", "c2", "fsc")])


@query("f16_threshold", _PLAIN.replace("0.2071", "0.5") + " SELECT run, f, npts, round(t, 8) AS t, round(fsc - t, 4) + 0.0 AS over FROM curve")
def f16(spark, sf):
    return curve(spark, sf, snr=0.5).select("run", "f", "npts", F.round("t", 8).alias("t"), clean0(F.col("fsc") - F.col("t"), 4).alias("over"))


_CROSS = """, d AS (SELECT *, fsc - t AS d, lag(fsc - t) OVER (PARTITION BY run ORDER BY f) AS before FROM curve),
hit AS (SELECT run, min(f) FILTER (d < 0) AS f FROM d GROUP BY run),
x AS (SELECT hit.run, hit.f, CASE WHEN hit.f >= 1 THEN (hit.f - 1 + d.before / (d.before - d.d)) / 2 END AS x FROM hit LEFT JOIN d ON d.run = hit.run AND d.f = hit.f)"""


def crossings(spark, sf, **options):
    return fo.crossing(curve(spark, sf), PAIR, F.lit(2), **options)


@query("f17_first_crossing", _PLAIN + _CROSS + " SELECT run, round(x, 4) AS x, CASE WHEN f >= 1 THEN 'ok' ELSE 'no_crossing' END AS status FROM x")
def f17(spark, sf):
    return crossings(spark, sf).select("run", F.round("x", 4).alias("x"), "status")


@query("f18_crossing_compat", _PLAIN + _CROSS + ", e AS (SELECT run, arg_min(d, f) AS d0, arg_max(d, f) AS dn FROM d GROUP BY run) SELECT run, round(coalesce(x, 1 - dn / (dn - d0)), 3) + 0.0 AS x FROM x JOIN e USING (run)")
def f18(spark, sf):
    return crossings(spark, sf, compat=True).select("run", clean0(F.col("x"), 3).alias("x"))


@query("f19_resolution", _PLAIN + _CROSS + " SELECT run, round(4.9::DOUBLE / nullif(round(x, 4), 0), 6) AS res FROM x")
def f19(spark, sf):
    # the innermost ring has one point and a threshold of 1, so that crossings at 0 come with rounding errors only
    found = crossings(spark, sf).withColumn("x", F.round("x", 4))
    return fo.to_resolution(found, F.lit(4.9)).select("run", F.round("res", 6).alias("res"))


@query("f20_shape_check", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size % 3 = b.p_size % 3")
def f20(spark, sf):
    k = F.col("p_partkey")
    shape = (F.col("p_size") % 3 + 40).alias
    headers = table(spark, sf, "part").select(k.alias("vol_id"), shape("nz"), shape("nx"), shape("ny"))
    pairs = headers.select(F.col("vol_id").alias("a"), (F.col("vol_id") + 1).alias("b"))
    return fo.same_shape(headers, pairs)[0]


def _job_sql(rings, snr):
    return _FT.replace("{window}", _W4).replace("{rings}", str(rings)).replace("{s}", f"{snr}::DOUBLE") + _CROSS + """, s AS (SELECT run, avg(v1) / 2 + avg(v2) / 2 AS m, max(v1) AS a, max(v2) AS b, covar_pop(v1, v2) / nullif(sqrt(var_pop(v1) * var_pop(v2)), 0) AS corr FROM pairs GROUP BY run)
SELECT run, CASE WHEN NOT (a > 0 AND b > 0) THEN -1 ELSE round(4.9::DOUBLE / x, 3) END AS res, round(m, 6) + 0.0 AS mean, round(corr, 6) + 0.0 AS corr FROM x JOIN s USING (run)"""


@query("f21_resolution_job", _job_sql(2, 0.2071))
def f21(spark, sf):
    found = fo.resolution_measure(bricks(spark, sf), pairs_of(spark, sf), (4, 4, 4), (4, 4, 4), 4.9, ring=2, rad=1, ax=1)
    whole = found.filter("status <> 'incomplete'")
    return whole.select(F.col("tile").alias("run"), F.round("res", 3).alias("res"), clean0(F.col("mean"), 6).alias("mean"), clean0(F.col("corr"), 6).alias("corr"))


_SWEPT = [(2, 0.2071), (2, 0.5), (4, 0.2071)]


@query("p13_sweep_job", " UNION ALL ".join(f"SELECT *, {r} AS ring, {t}::DOUBLE AS snr FROM ({_job_sql(r, t)})" for r, t in _SWEPT))
def p13_job(spark, sf):
    """Every pair with each of three settings of rings and threshold, as one job."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(t).alias("snr")) for r, t in _SWEPT]))
    plan = pairs_of(spark, sf).withColumnRenamed("tile", "run").withColumn("e", each).select("*", "e.ring", "e.snr").drop("e")
    plan = plan.withColumns({"tile": F.concat_ws("|", F.col("run").cast("string"), F.col("ring").cast("string"), F.col("snr").cast("string")), **{f"s{a}": F.lit(4) for a in "zxy"}, "rad": F.lit(1), "ax": F.lit(1)})
    found = fo.resolution_sweep(bricks(spark, sf), plan, (4, 4, 4), 4.9).filter("status <> 'incomplete'").join(plan.select("tile", "run", "ring", "snr"), "tile")
    return found.select("run", "ring", "snr", F.round("res", 3).alias("res"), clean0(F.col("mean"), 6).alias("mean"), clean0(F.col("corr"), 6).alias("corr"))


@query("f22_curve", _PLAIN + " SELECT run, f / 2 AS x, round(fsc, 5) + 0.0 AS fsc, round(t, 5) AS t FROM curve")
def f22(spark, sf):
    return curve(spark, sf).select("run", (F.col("f") / 2).alias("x"), clean0(F.col("fsc"), 5).alias("fsc"), F.round("t", 5).alias("t"))


@query("f23_slice_frc", f"""{_V}, ks AS (SELECT unnest([-2, -1, 0, 1]) AS k), ft AS (SELECT vol_id, z, a.k AS kx, b.k AS ky, sum(v * cos(2 * pi() * (a.k * x + b.k * y) / 4)) AS re, sum(-v * sin(2 * pi() * (a.k * x + b.k * y) / 4)) AS im FROM voxels, ks a, ks b GROUP BY ALL),
p AS (SELECT a.vol_id // 2 AS run, a.z, round_even(sqrt(a.kx ** 2 + a.ky ** 2), 0)::INT AS f, a.re AS re1, a.im AS im1, b.re AS re2, b.im AS im2 FROM ft a JOIN ft b ON b.vol_id = a.vol_id + 1 AND a.z = b.z AND a.kx = b.kx AND a.ky = b.ky WHERE a.vol_id % 2 = 0)
SELECT run, z, f, round(sqrt(sum(re1 * re2 + im1 * im2) ** 2 + sum(im1 * re2 - re1 * im2) ** 2) / nullif(sqrt(sum(re1 * re1 + im1 * im1) * sum(re2 * re2 + im2 * im2)), 0), 4) AS fsc FROM p WHERE f <= 2 GROUP BY ALL""")
def f23(spark, sf):
    # each slice of a vector is an image of 16 values; the two halves of a run are transformed in one call
    cut = lambda c: F.slice(c, F.col("z") * 16 + 1, F.lit(16))
    slices = arrays(spark, sf).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(3)))).select((F.col("run") * 4 + F.col("z")).alias("id"), cut("v1").alias("v1"), cut("v2").alias("v2"))
    flat = fo.frequencies(fo.fft_arrays(slices, "id", ["v1", "v2"], (4, 4)), ["id"], AXES[1:])
    ft = flat.withColumns({"run": F.floor(F.col("id") / 4), "z": (F.col("id") % 4).cast("int")})
    rings = fo.fsc(fo.shell_sums(ft, ["run", "z"], fo.shell_index(AXES[1:]), 0, 2))
    return rings.select("run", "z", "f", F.round("fsc", 4).alias("fsc"))

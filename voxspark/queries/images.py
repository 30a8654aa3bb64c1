"""V: voxel-wise image algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imageops as io
from ..operators.fourier import fft_kernel, frequencies
from .fourier import _PLAIN, AXES, arrays, clean0, halves, pairs_ft
from .proxies import IMAGES_SQL, VOXELS_SQL, images, voxels
from .registry import query, table

_I = f"WITH {IMAGES_SQL}"
_P = _I + ", pairs AS (SELECT a.img // 2 AS run, a.px, a.py, a.v AS v1, b.v AS v2 FROM images a JOIN images b ON b.img = a.img + 1 AND a.px = b.px AND a.py = b.py WHERE a.img % 2 = 0)"
_S = _I + ", st AS (SELECT img, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS sd FROM images GROUP BY img), s AS (SELECT * FROM images JOIN st USING (img))"
RUN = ["run"]


def pairs(spark, sf):
    return halves(images(spark, sf), "img", ["px", "py"])


def total(df, by, v="v", digits=6):
    """A number for each image: values weighted by their place, so that misplaced ones show."""
    return df.groupBy(*by).agg(clean0(F.sum(F.col(v) * (1 + F.col("px") * 8 + F.col("py"))), digits).alias("total"))


_T = "round(sum({v} * (1 + px * 8 + py)), 6) + 0.0 AS total"


def both(name, expression, column):
    """Registers a voxel-wise operation on pairs; ``expression``: SQL, ``column``: the same as a Column."""

    @query(name, f"{_P} SELECT run, {_T.format(v='(' + expression + ')')} FROM pairs GROUP BY run")
    def run(spark, sf):
        return total(pairs(spark, sf).withColumn("v", column(F.col("v1"), F.col("v2"))), RUN)


def single(name, expression, column):
    """The same on single images with their statistics ``min, max, avg, std``."""

    @query(name, f"{_S} SELECT img, {_T.format(v='(' + expression + ')')} FROM s GROUP BY img")
    def run(spark, sf):
        return total(io.with_stats(images(spark, sf), ["img"]).withColumn("v", column(F.col("v"))), ["img"])




@query("v01_compatible", "SELECT a.p_partkey AS a FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND b.p_size = a.p_size")
def v01(spark, sf):
    part = table(spark, sf, "part")
    pairs = part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return io.compatible(part, "p_partkey", ["p_size"], pairs).select("a")


both("v02_add_scaled", "v1 + v2 * 1.5 + 0.25", lambda v1, v2: io.add_scaled(v1, v2, 1.5, 0.25))


@query("v03_weighted_sum", _S + ", w AS (SELECT label, px, py, sum((v - m) / sd * (1 + img % 3)) AS s, sum(((v - m) / sd) ** 2 * (1 + img % 3)) AS q, sum(1 + img % 3) AS w FROM s GROUP BY ALL) SELECT label, px, py, round(s / w, 5) + 0.0 AS v, round(sqrt(greatest(q / w - (s / w) ** 2, 0)), 5) AS sd FROM w")
def v03(spark, sf):
    weighted = images(spark, sf).withColumn("w", F.col("img") % 3 + 1)
    out = io.weighted_sum(weighted, ["label", "px", "py"], "w", ["img"])
    return out.select("label", "px", "py", clean0(F.col("v"), 5).alias("v"), F.round("sd", 5).alias("sd"))


@query("v04_place_small", _P + f", m AS (SELECT a.run, a.px, a.py, CASE WHEN (a.px - 4) ** 2 + (a.py - 4) ** 2 <= 9 THEN least(a.v1, coalesce(b.v2, a.v1)) ELSE a.v1 END AS v FROM pairs a LEFT JOIN pairs b ON a.run = b.run AND b.px + 2 = a.px AND b.py + 3 = a.py AND b.px < 4 AND b.py < 4) SELECT run, {_T.format(v='v')} FROM m GROUP BY run")
def v04(spark, sf):
    p = pairs(spark, sf)
    inside = (F.col("px") - 4) * (F.col("px") - 4) + (F.col("py") - 4) * (F.col("py") - 4) <= 9
    small = p.filter("px < 4 and py < 4").select("run", "px", "py", F.col("v2").alias("v"))
    return total(io.place_small(p.select("run", "px", "py", F.col("v1").alias("v")), small, ["run", "px", "py"], inside, {"px": 2, "py": 3}), RUN)


both("v05_multiply_scaled", "v1 * (v2 * 2 + 0.5)", lambda v1, v2: io.multiply_scaled(v1, v2, 2, 0.5))
both("v06_largest_smallest", "greatest(v1, v2) + 2 * least(v1, v2)", lambda v1, v2: io.largest(v1, v2) + 2 * io.smallest(v1, v2))

_FIT = "SELECT {by}, regr_slope(v2, v1) AS b, regr_intercept(v2, v1) AS a, regr_syy(v2, v1) AS syy, regr_sxy(v2, v1) AS sxy FROM {src} GROUP BY ALL"
_FITTED = "SELECT run, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(sqrt(greatest(syy - b * sxy, 0) / syy), 6) AS r FROM "


def fitted(df):
    return df.select("run", clean0(F.col("a"), 6).alias("a"), clean0(F.col("b"), 6).alias("b"), F.round("r", 6).alias("r"))


@query("v07_linear_fit", _P + ", f AS (" + _FIT.format(by="run", src="pairs") + ") " + _FITTED + "f")
def v07(spark, sf):
    return fitted(io.linear_fit(pairs(spark, sf), RUN))


def _best_fit_sql(steps):
    """The fits with 0, 1, 2 ... % left out, one after the other; the best of them and its difference image."""
    out = _P + ", k0 AS (SELECT *, true AS kept FROM pairs)"
    for k in range(steps):
        out += f""", f{k} AS (SELECT run, regr_slope(v2, v1) AS b, regr_intercept(v2, v1) AS a, count(*) AS n FROM k{k} WHERE kept GROUP BY run),
o{k} AS (SELECT k{k}.*, a, b, n, a + b * v1 - v2 AS d FROM k{k} JOIN f{k} USING (run)),
r{k} AS (SELECT run, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, sqrt(sum(d * d) FILTER (kept) / ((var_pop(v2) FILTER (kept)) * any_value(n))) AS r, max(abs(d)) AS top FROM o{k} GROUP BY run),
b{k} AS (SELECT run, o{k}.v1, v2, px, py, d, top, least(floor(1000 * abs(d) / top), 999) AS bin, row_number() OVER (PARTITION BY run ORDER BY least(floor(1000 * abs(d) / top), 999) DESC) AS rank FROM o{k} JOIN r{k} USING (run)),
c{k} AS (SELECT run, greatest({999 if k == 0 else f"max(bin) FILTER (rank = ceil(64 * {k} / 100))"}, 1) AS cut FROM b{k} GROUP BY run),
k{k + 1} AS (SELECT run, px, py, v1, v2, abs(d) <= cut * top / 1000 AS kept FROM b{k} JOIN c{k} USING (run))"""
    return out + ", fits AS (" + " UNION ALL ".join(f"SELECT {k} AS step, run, a, b, n, r FROM r{k}" for k in range(steps)) + "), best AS (SELECT run, arg_min(a, (r, step)) AS a, arg_min(b, (r, step)) AS b, min(r) AS r, 64 - arg_min(n, (r, step)) AS n_left_out FROM fits GROUP BY run)"


@query("v07_robust_fit", _best_fit_sql(6) + f" SELECT run, round(any_value(a), 5) + 0.0 AS a, round(any_value(b), 5) + 0.0 AS b, round(any_value(r), 5) AS r, any_value(n_left_out) AS n_left_out, round(sum((a + b * v1 - v2) * (1 + px * 8 + py)), 3) + 0.0 AS total FROM best JOIN pairs USING (run) GROUP BY run")
def v07_robust(spark, sf):
    fit = io.robust_fit(arrays(spark, sf), "run", 0.05)
    weighted = F.aggregate(F.transform("difference", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return fit.select("run", clean0(F.col("a"), 5).alias("a"), clean0(F.col("b"), 5).alias("b"), F.round("r", 5).alias("r"), "n_left_out", clean0(weighted, 3).alias("total"))


@query("v07_robust_fit_rows", _best_fit_sql(4) + " SELECT run, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(r, 5) AS r, n_left_out FROM best")
def v07_robust_rows(spark, sf):
    """The same where an image is too large for a row: pixels are rows."""
    fit = io.robust_fit_rows(pairs(spark, sf), RUN, 0.03)
    return fit.select("run", clean0(F.col("a"), 5).alias("a"), clean0(F.col("b"), 5).alias("b"), F.round("r", 5).alias("r"), "n_left_out")


@query("v08_r_factor", _P + " SELECT run, round(sum(abs(v1 - v2)) / sum(abs(v1)), 7) AS r FROM pairs GROUP BY run")
def v08(spark, sf):
    return io.r_factor(pairs(spark, sf), RUN).select("run", F.round("r", 7).alias("r"))


_CORR = "round(covar_pop(v1, v2) / nullif(sqrt(var_pop(v1) * var_pop(v2)), 0), 6) + 0.0 AS corr"


@query("v09_correlation", _P + f" SELECT run, {_CORR} FROM pairs GROUP BY run")
def v09(spark, sf):
    return io.pearson(pairs(spark, sf), RUN).select("run", clean0(F.col("corr"), 6).alias("corr"))


@query("v10_correlation_in_radii", _P + f" SELECT run, {_CORR} FROM pairs WHERE (px - 4) ** 2 + (py - 4) ** 2 BETWEEN 1 AND 9 GROUP BY run")
def v10(spark, sf):
    kept = pairs(spark, sf).filter(io.within_radii([(F.col("px"), 4), (F.col("py"), 4)], 1, 3))
    return io.pearson(kept, RUN).select("run", clean0(F.col("corr"), 6).alias("corr"))


both("v11_correlation_image", "(v1 - 0.1) * (v2 + 0.2)", lambda v1, v2: io.correlation_product(v1, v2, 0.1, -0.2))


@query("v12_histogram_match", _P + f""", rg AS (SELECT run, min(v1) AS lo1, max(v1) AS hi1, min(v2) AS lo2, max(v2) AS hi2 FROM pairs GROUP BY run),
pl AS (SELECT pairs.*, lo1, hi1, least(floor((v1 - lo1) * 16 / (hi1 - lo1)), 15)::INT AS b1, least(floor((v2 - lo2) * 16 / (hi2 - lo2)), 15)::INT AS b2 FROM pairs JOIN rg USING (run)),
h AS (SELECT run, [count(*) FILTER (b1 >= i) FOR i IN range(0, 1)] AS x FROM pl GROUP BY run),
ha AS (SELECT run, i, count(*) FILTER (b1 >= i) AS h1, count(*) FILTER (b2 >= i) AS h2 FROM pl, (SELECT unnest(range(17)) AS i) GROUP BY run, i),
mp AS (SELECT a.run, a.i, greatest((SELECT count(*) FROM ha c WHERE c.run = a.run AND c.i < 16 AND c.h1 > a.h2) - 1, 0) AS m FROM ha a WHERE a.i < 16),
ds AS (SELECT mp.run, mp.i, m, mp.i + coalesce((a.h2 - o.h1)::DOUBLE / nullif(CASE WHEN mp.i < 15 THEN o1.h1 - o.h1 - n1.h2 + a.h2 ELSE o.h1 - o0.h1 - a.h2 + n0.h2 END, 0), 0.5) AS place FROM mp
  JOIN ha a ON a.run = mp.run AND a.i = mp.i JOIN ha o ON o.run = mp.run AND o.i = m JOIN ha o1 ON o1.run = mp.run AND o1.i = m + 1 JOIN ha n1 ON n1.run = mp.run AND n1.i = mp.i + 1
  JOIN ha o0 ON o0.run = mp.run AND o0.i = greatest(m - 1, 0) JOIN ha n0 ON n0.run = mp.run AND n0.i = greatest(mp.i - 1, 0))
SELECT run, {_T.format(v='(q.place * (hi1 - lo1) / 16 + lo1)')} FROM pl JOIN ds d USING (run) JOIN ds q USING (run) WHERE d.i = b2 AND q.i = d.m GROUP BY run""".replace("h AS (SELECT run, [count(*) FILTER (b1 >= i) FOR i IN range(0, 1)] AS x FROM pl GROUP BY run),\n", ""))
def v12(spark, sf):
    return total(io.histogram_match(pairs(spark, sf), RUN, 16), RUN)


both("v13_mask_by_threshold", "CASE WHEN v2 > 0.05 THEN v1 ELSE 0 END", lambda v1, v2: io.mask_by_threshold(v1, v2, 0.05))


@query("v14_blend", _P + f", s AS (SELECT *, unnest(range(5)) AS step FROM pairs) SELECT run, step::INT AS step, {_T.format(v='(v1 + (v2 - v1) * step / 4)')} FROM s GROUP BY run, step")
def v14(spark, sf):
    return total(io.blend(pairs(spark, sf), 5), ["run", "step"])


single("v15_invert", "lo + hi - v", lambda v: io.invert(v, F.col("min"), F.col("max")))


@query("v15_to_min_max", f"{_S} SELECT img, {_T.format(v='(10 + (v - lo) * 90 / (hi - lo))')} FROM s GROUP BY img")
def v15_min_max(spark, sf):
    return total(io.to_min_max(images(spark, sf), ["img"], 10.0, 100.0), ["img"])


@query("v15_to_avg_std", f"{_S} SELECT img, {_T.format(v='((v - m) * 2 / sd + 5)')} FROM s GROUP BY img")
def v15_avg_std(spark, sf):
    return total(io.rescale_to(images(spark, sf), ["img"], 5.0, 2.0), ["img"])


single("v16_square_log", "v * v + ln(v + 2)", lambda v: io.square(v) + io.log_of(v, 2.0))
single("v17_truncate", "CASE WHEN v < -0.1 THEN -0.1 WHEN v > 0.1 THEN 0.1 ELSE v END + CASE WHEN v < -0.2 OR v > 0.2 THEN m ELSE v END", lambda v: io.truncate(v, -0.1, 0.1) + io.truncate(v, -0.2, 0.2, F.col("avg"), F.col("avg")))
single("v18_quantise", "255.0 / 15 * floor((v - lo) * (0.999 * 16) / (hi - lo))", lambda v: io.quantise(v, F.col("min"), F.col("max"), 16))


@query("v19_statistics", _S.replace(", s AS (SELECT * FROM images JOIN st USING (img))", "") + " SELECT img, round(lo, 7) AS min, round(hi, 7) AS max, round(m, 7) + 0.0 AS avg, round(sd, 7) AS std FROM st")
def v19(spark, sf):
    return io.image_stats(images(spark, sf), ["img"]).select("img", *[clean0(F.col(c), 7).alias(c) for c in ("min", "max", "avg", "std")])


@query("v19_statistics_in_radii", _I + " SELECT img, floor(sqrt((px - 4) ** 2 + (py - 4) ** 2))::INT AS ring, round(avg(v), 7) + 0.0 AS avg, round(stddev_pop(v), 7) AS std, count(*) AS n FROM images GROUP BY ALL")
def v19_radii(spark, sf):
    out = io.ring_statistics(images(spark, sf), ["img"], [("px", 4), ("py", 4)])
    return out.select("img", "ring", clean0(F.col("avg"), 7).alias("avg"), F.round("std", 7).alias("std"), "n")


RI = ("re1", "im1", "re2", "im2")


def complex_(name, re, im, sql):
    @query(name, _PLAIN + f" SELECT run, {sql} FROM fts GROUP BY run")
    def run(spark, sf):
        return pairs_ft(spark, sf).groupBy("run").agg(clean0(F.sum(re(*map(F.col, RI))), 4).alias("a"), clean0(F.sum(im(*map(F.col, RI))), 4).alias("b"))


_AB = "round(sum({a}), 4) + 0.0 AS a, round(sum({b}), 4) + 0.0 AS b"
complex_("v20_complex_product", lambda r1, i1, r2, i2: r1 * r2 + i1 * i2, lambda r1, i1, r2, i2: (i1 * r2 - r1 * i2) * (i1 * r2 - r1 * i2), _AB.format(a="re1 * re2 + im1 * im2", b="(im1 * re2 - re1 * im2) ** 2"))
complex_("v20_amplitude_intensity", lambda r1, i1, r2, i2: F.hypot(r1, i1), lambda r1, i1, r2, i2: r2 * r2 + i2 * i2, _AB.format(a="sqrt(re1 * re1 + im1 * im1)", b="re2 * re2 + im2 * im2"))


@query("v20_phases_polar", _PLAIN + " SELECT run, round(sum(sqrt(re1 ** 2 + im1 ** 2) * cos(atan2(im1, re1) + 0.5)) FILTER (ky >= 0), 3) + 0.0 AS re, round(sum(sqrt(re1 ** 2 + im1 ** 2) * sin(atan2(im1, re1) + 0.5)) FILTER (ky >= 0), 3) + 0.0 AS im FROM fts GROUP BY run")
def v20_polar(spark, sf):
    first = pairs_ft(spark, sf).filter("ky >= 0").withColumnsRenamed({"re1": "re", "im1": "im"})
    turned = io.cartesian(io.polar(first).withColumn("phi", F.col("phi") + 0.5))
    return turned.groupBy("run").agg(clean0(F.sum("re"), 3).alias("re"), clean0(F.sum("im"), 3).alias("im"))


@query("v20_masked_product", _PLAIN + " SELECT run, round(sum(CASE WHEN kz * kz + kx * kx + ky * ky <= 2 THEN re1 * re2 + im1 * im2 ELSE 0 END), 4) + 0.0 AS re, round(sum(CASE WHEN kz * kz + kx * kx + ky * ky <= 2 THEN (im1 * re2 - re1 * im2) * (1 + kz) ELSE 0 END), 4) + 0.0 AS im FROM fts GROUP BY run")
def v20_mask(spark, sf):
    made = io.complex_product(pairs_ft(spark, sf), F.expr("kz * kz + kx * kx + ky * ky <= 2"))
    return made.groupBy("run").agg(clean0(F.sum("re"), 4).alias("re"), clean0(F.sum(F.col("im") * (1 + F.col("kz"))), 4).alias("im"))


@query("v22_cross_correlation_shift", f"""WITH {IMAGES_SQL}, p AS (SELECT a.img // 2 AS run, (b.px - a.px + 8) % 8 AS sx, (b.py - a.py + 8) % 8 AS sy, sum(a.v * b.v) AS c FROM images a JOIN images b ON b.img = a.img + 1 WHERE a.img % 2 = 0 GROUP BY ALL)
SELECT run, arg_max(CASE WHEN sx > 4 THEN sx - 8 ELSE sx END, c)::INT AS sx, arg_max(CASE WHEN sy > 4 THEN sy - 8 ELSE sy END, c)::INT AS sy, round(max(c), 6) + 0.0 AS peak FROM p GROUP BY run""")
def v22(spark, sf):
    from ..operators.crossval import best_shift

    found = best_shift(arrays(spark, sf), "run", (8, 8))
    # half a size to either side is the same shift
    at = lambda i: F.when(F.get("shift", F.lit(i)) == -4, 4).otherwise(F.get("shift", F.lit(i))).cast("int")
    return found.select("run", at(0).alias("sx"), at(1).alias("sy"), clean0(F.col("peak"), 6).alias("peak"))


@query("v23_phase_difference", _PLAIN + ", d AS (SELECT *, sqrt((re1 ** 2 + im1 ** 2) * (re2 ** 2 + im2 ** 2)) AS n FROM fts WHERE kz ** 2 + kx ** 2 + ky ** 2 BETWEEN 1 AND 4) SELECT run, round(avg(acos(greatest(least((re1 * re2 + im1 * im2) / n, 1), -1))), 3) AS phase FROM d WHERE n > 1e-9 GROUP BY run")
def v23(spark, sf):
    band = pairs_ft(spark, sf).filter("kz * kz + kx * kx + ky * ky between 1 and 4")
    return io.phase_difference(band).groupBy("run").agg(F.round(F.avg("phase"), 3).alias("phase"))


@query("v24_extract_region", _I + f" SELECT img, {_T.format(v='v').replace('px', '(px - 2)').replace('py', '(py - 3)')} FROM images WHERE px BETWEEN 2 AND 5 AND py BETWEEN 3 AND 6 GROUP BY img")
def v24(spark, sf):
    return total(io.extract_region(images(spark, sf), {"px": (2, 4), "py": (3, 4)}), ["img"])


@query("v25_median_bin", _I + " SELECT img, px // 2 AS px, py // 2 AS py, round(quantile_cont(v, 0.5), 7) + 0.0 AS v FROM images GROUP BY ALL")
def v25(spark, sf):
    return io.median_bin(images(spark, sf), ["img"], ["px", "py"], 2).withColumn("v", clean0(F.col("v"), 7))


# places 0, 2, 4, 6 and 8 of the old grid would be the new ones' middles: sizes 3, the middles at 2, 4 and 6
@query("v25_triangle_sample", _I + ", k AS (SELECT *, unnest([0, 1, 2]) AS kx FROM images), l AS (SELECT *, unnest([0, 1, 2]) AS ky FROM k) SELECT img, kx::INT AS px, ky::INT AS py, round(sum(v * (2 - abs(px - 2 - 2 * kx)) * (2 - abs(py - 2 - 2 * ky)) / 16), 7) + 0.0 AS v FROM l WHERE abs(px - 2 - 2 * kx) < 2 AND abs(py - 2 - 2 * ky) < 2 GROUP BY ALL")
def v25_triangle(spark, sf):
    return io.triangle_sample(images(spark, sf), ["img"], {"px": 8, "py": 8}, 2).select("img", "px", "py", clean0(F.col("v"), 7).alias("v"))


@query("v26_rotate", _I + """, a AS (SELECT img, v, round((px - 3.5) * cos(radians(30)) - (py - 3.5) * sin(radians(30)) + 4, 9) AS ax, round((px - 3.5) * sin(radians(30)) + (py - 3.5) * cos(radians(30)) + 3.5, 9) AS ay FROM images),
s AS (SELECT img, v, (floor(ax) + i)::INT AS px, (floor(ay) + j)::INT AS py, CASE i WHEN 0 THEN 1 - (ax - floor(ax)) ELSE ax - floor(ax) END * CASE j WHEN 0 THEN 1 - (ay - floor(ay)) ELSE ay - floor(ay) END AS w FROM a, (SELECT unnest([0, 1]) AS i) p, (SELECT unnest([0, 1]) AS j) q)
SELECT img, px, py, round(sum(v * w) / sum(w), 6) + 0.0 AS v FROM s WHERE w > 1e-9 AND px BETWEEN 0 AND 7 AND py BETWEEN 0 AND 7 GROUP BY ALL""")
def v26_rotate(spark, sf):
    return io.rotate(images(spark, sf), ["img"], (8, 8), 30.0, move=(0.5, 0.0)).select("img", "px", "py", clean0(F.col("v"), 6).alias("v"))


@query("v26_integer_shift", _I + f" SELECT img, {_T.format(v='v').replace('px', '((px + 3) % 8)').replace('py', '((py + 6) % 8)')} FROM images GROUP BY img")
def v26(spark, sf):
    return total(io.shift_image(images(spark, sf), {"px": 3, "py": -2}, {"px": 8, "py": 8}), ["img"])


@query("v27_merge_amplitude_phase", _PLAIN + " SELECT run, round(sum(sqrt(re1 ** 2 + im1 ** 2) * re2 / sqrt(re2 ** 2 + im2 ** 2)), 3) + 0.0 AS re FROM fts WHERE sqrt(re2 ** 2 + im2 ** 2) > 1e-9 GROUP BY run")
def v27(spark, sf):
    return io.merge_amplitude_phase(pairs_ft(spark, sf).filter(F.hypot(F.col("re2"), F.col("im2")) > 1e-9)).groupBy("run").agg(clean0(F.sum("re"), 3).alias("re"))


def spectrum(spark, sf):
    volumes = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "vol_id")
    return frequencies(fft_kernel(volumes, "vol_id", "embedding", (4, 4, 4)), ["vol_id"], AXES)


@query("v28_crop_transform", _PLAIN + " SELECT vol_id, count(*) AS n, round(sum(re * re + im * im), 4) AS power FROM ft WHERE greatest(abs(kz), abs(kx), abs(ky)) <= 1 GROUP BY vol_id")
def v28(spark, sf):
    kept = io.resize_transform(spectrum(spark, sf), ["vol_id"], {a: (4, 3) for a in "zxy"})
    return kept.groupBy("vol_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 4).alias("power"))


@query("v28_pad_transform", _PLAIN + " SELECT vol_id, 216::BIGINT AS n, round(sum(re * (1 + kz * kz)), 4) + 0.0 AS re FROM ft WHERE kz BETWEEN -2 AND 1 GROUP BY vol_id")
def v28_pad(spark, sf):
    padded = io.resize_transform(spectrum(spark, sf), ["vol_id"], {a: (4, 6) for a in "zxy"})
    return padded.groupBy("vol_id").agg(F.count(F.lit(1)).alias("n"), clean0(F.sum(F.col("re") * (1 + F.col("kz") * F.col("kz"))), 4).alias("re"))


@query("v29_clamped_cast", "SELECT o_orderkey, greatest(least(trunc(o_totalprice / 1000 - 50), 255), 0)::SMALLINT AS byte, greatest(least(trunc(o_totalprice - 1e5), 32767), -32768)::SMALLINT AS short FROM orders")
def v29(spark, sf):
    price = F.col("o_totalprice")
    byte, short = io.clamped_cast(price / 1000 - 50, 0, 255), io.clamped_cast(price - 1e5, -32768, 32767)
    return table(spark, sf, "orders").select("o_orderkey", byte.cast("short").alias("byte"), short.cast("short").alias("short"))


@query("v30_slices_as_images", f"WITH {VOXELS_SQL} SELECT vol_id * 4 + z AS img, count(*) AS n, round(sum(v * (1 + x * 4 + y)), 6) + 0.0 AS total FROM voxels GROUP BY 1")
def v30(spark, sf):
    flat = io.slices_as_images(voxels(spark, sf), 4)
    return flat.groupBy("img").agg(F.count(F.lit(1)).alias("n"), clean0(F.sum(F.col("v") * (1 + F.col("x") * 4 + F.col("y"))), 6).alias("total"))


@query("v31_metadata", "SELECT p_partkey, (19 + p_size)::DOUBLE / 2 AS oz, least(p_retailprice / 1000, 1 + p_size % 3)::DOUBLE AS unit, (least(p_size + 20, 40) // 2)::INT AS radius FROM part WHERE p_retailprice > 0")
def v31(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice") / 1000
    headers = table(spark, sf, "part").filter("p_retailprice > 0").select("p_partkey", (size + 20).alias("nz"), F.lit(40).alias("nx"), F.lit(40).alias("ny"), price.alias("uz"), (1.0 + size % 3).alias("ux"), price.alias("uy"))
    return io.metadata(headers).select("p_partkey", "oz", "unit", "radius")


@query("v32_frequency_layout", _PLAIN + " SELECT vol_id, (kz + 4) % 4 AS kz, (kx + 4) % 4 AS kx, (ky + 4) % 4 AS ky, round(re, 5) + 0.0 AS re FROM ft WHERE kx >= 0")
def v32(spark, sf):
    half_ = spectrum(spark, sf).filter("kx >= 0")
    return half_.select("vol_id", *[io.standard(F.col(f"k{a}"), 4).alias(f"k{a}") for a in "zxy"], clean0(F.col("re"), 5).alias("re"))


@query("v32_whole_spectrum", _PLAIN + " SELECT vol_id, kz, kx, ky, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ft")
def v32_whole(spark, sf):
    half_ = spectrum(spark, sf).filter("ky >= 0 or ky = -2")
    return io.whole_spectrum(half_, ["vol_id"], {"z": 4, "x": 4, "y": 4}).select("vol_id", "kz", "kx", "ky", clean0(F.col("re"), 5).alias("re"), clean0(F.col("im"), 5).alias("im"))

"""P: plans, grids, pairing, splits and label parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import grids
from .registry import query, table

_VOLS = "vols AS (SELECT p_partkey AS vol, (20 + p_size)::INT AS nz, (100 + p_partkey % 90)::INT AS nx, (90 + p_partkey % 70)::INT AS ny FROM part)"
_POINTS = "points AS (SELECT o_custkey % 16 AS tomogram, o_orderkey AS bead_id, (o_orderkey * 7 % 100)::INT AS x, (o_custkey * 11 % 100)::INT AS y, (o_orderkey % 60)::INT AS z FROM orders)"


def volumes(spark, sf):
    k = F.col("p_partkey")
    zero = F.lit(0)
    return table(spark, sf, "part").select(k.alias("vol"), zero.alias("z0"), zero.alias("x0"), zero.alias("y0"), (F.col("p_size") + 20).cast("int").alias("nz"), (k % 90 + 100).cast("int").alias("nx"), (k % 70 + 90).cast("int").alias("ny"))


def points(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    made = table(spark, sf, "orders").select((c % 16).alias("tomogram"), o.alias("bead_id"), (o * 7 % 100).cast("int").alias("x"), (c * 11 % 100).cast("int").alias("y"), (o % 60).cast("int").alias("z"))
    return made.withColumn("nx", F.lit(100)).withColumn("ny", F.lit(100)).withColumn("nz", F.lit(60))


@query("p01_cube_tiles", f"WITH {_VOLS} SELECT vol, z, x, y FROM (SELECT *, unnest(range(0, nx - 45 + 1, 45)) AS x FROM vols) a, LATERAL (SELECT unnest(range(0, ny - 45 + 1, 90)) AS y) b, LATERAL (SELECT unnest(range(0, nz - 45 + 1, 45)) AS z) c".replace("AS x FROM", "::INT AS x FROM").replace("AS y)", "::INT AS y)").replace("AS z)", "::INT AS z)"))
def p01(spark, sf):
    return grids.plan_tiles(volumes(spark, sf), 45, (1, 1, 2)).select("vol", "z", "x", "y")


@query("p02_beam_tiles", f"WITH {_VOLS} SELECT vol, z::INT AS z, x::INT AS x, y::INT AS y FROM (SELECT *, unnest(range(0, nx - 50, 50)) AS x FROM vols) a, LATERAL (SELECT unnest(range(0, ny - 50, 50)) AS y) b, LATERAL (SELECT unnest(range(0, nz, 20)) AS z) c")
def p02(spark, sf):
    return grids.plan_tiles(volumes(spark, sf), 50, (20, 1, 1), "beam").select("vol", "z", "x", "y")


@query("p03_tilt_tiles", f"WITH {_VOLS} SELECT vol, z::INT AS z, x::INT AS x, y::INT AS y FROM (SELECT *, unnest(range(0, nx, 40)) AS x FROM vols) a, LATERAL (SELECT unnest(range(0, ny - 30, 30)) AS y) b, LATERAL (SELECT unnest(range(0, nz - 30, 30)) AS z) c")
def p03_tilt(spark, sf):
    return grids.plan_tiles(volumes(spark, sf), 30, plane="tilt", slice_step=40).select("vol", "z", "x", "y")


@query("p03_edge_tiles", f"WITH {_VOLS} SELECT vol, z::INT AS z, x::INT AS x, y::INT AS y FROM (SELECT *, unnest(range(0, nx - 30, 30)) AS x FROM vols) a, LATERAL (SELECT unnest(range(0, ny, 40)) AS y) b, LATERAL (SELECT unnest(range(0, nz - 30, 30)) AS z) c")
def p03_edge(spark, sf):
    return grids.plan_tiles(volumes(spark, sf), 30, plane="edge", slice_step=40).select("vol", "z", "x", "y")


@query("p04_whole_slices", f"WITH {_VOLS} SELECT vol, unnest(range(0, nz, 3))::INT AS z FROM vols")
def p04(spark, sf):
    return grids.plan_tiles(volumes(spark, sf), -1, (3, 1, 1), "beam").select("vol", "z")


@query("p05_centred_region", f"WITH {_VOLS} SELECT vol, CASE WHEN part > 0 THEN floor((nx - part) / 2.0) ELSE 0 END::INT AS st, CASE WHEN part > 0 THEN part ELSE nx END::INT AS size FROM (SELECT *, (vol % 7 - 2) * 15 AS part FROM vols)")
def p05(spark, sf):
    st, size = grids.centre_region(F.col("nx"), F.col("part"))
    return volumes(spark, sf).withColumn("part", (F.col("vol") % 7 - 2) * 15).select("vol", st.alias("st"), size.alias("size"))


@query("p06_z_clip", f"""WITH {_VOLS}, clip AS (SELECT *, (vol % 10)::INT AS z0c, (nz - vol % 5)::INT AS z1c, (vol % 3 * 8)::INT AS part FROM vols)
SELECT vol, CASE WHEN part > 0 THEN floor((z1c - z0c - part) / 2.0) ELSE z0c END::INT AS st, CASE WHEN part > 0 THEN part ELSE z1c - z0c END::INT AS size FROM clip""")
def p06(spark, sf):
    k = F.col("vol")
    clip = volumes(spark, sf).withColumn("z0c", (k % 10).cast("int")).withColumn("z1c", (F.col("nz") - k % 5).cast("int")).withColumn("part", k % 3 * 8)
    # a region of z starts anew from the clipped size, without the clip's offset
    st, size = grids.centre_region(F.col("z1c") - F.col("z0c"), F.col("part"), F.col("z0c"))
    return clip.select("vol", st.alias("st"), size.alias("size"))


_FACTORS = [("3.3k", "250nm", 1), ("3.3k", "500nm", 2), ("3.3k", "750nm", 3), ("3.3k", "1000nm", 4), ("11k", "250nm", 3), ("11k", "500nm", 6), ("11k", "750nm", 9), ("11k", "1000nm", 12)]
_CATALOG = "catalog AS (SELECT p_partkey AS tomogram, CASE WHEN p_size > 25 THEN '11k' ELSE '3.3k' END AS magnification, CASE p_partkey % 5 WHEN 0 THEN '250nm' WHEN 1 THEN '500nm' WHEN 2 THEN '750nm' WHEN 3 THEN '1000nm' ELSE '1um' END AS thickness, (p_size * 3)::INT AS z_min, (p_size * 9 + p_partkey % 4 + 100)::INT AS z_max FROM part)"
_FACTORS_SQL = "factors(magnification, thickness, factor) AS (VALUES " + ", ".join(str(f) for f in _FACTORS) + ")"


def catalog(spark, sf):
    k = F.col("p_partkey")
    thickness = F.element_at(F.array(*[F.lit(t) for t in ("250nm", "500nm", "750nm", "1000nm", "1um")]), (k % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(k.alias("tomogram"), F.when(F.col("p_size") > 25, "11k").otherwise("3.3k").alias("magnification"), thickness.alias("thickness"), (F.col("p_size") * 3).cast("int").alias("z_min"), (F.col("p_size") * 9 + k % 4 + 100).cast("int").alias("z_max"))


@query("p07_z_clip_from_catalog", f"""WITH {_CATALOG}, {_FACTORS_SQL}
SELECT tomogram, (floor(floor((z_max + z_min) / 2.0) - factor * 45 / 2.0) + 1)::INT AS z_first, floor(floor((z_max + z_min) / 2.0) + factor * 45 / 2.0)::INT AS z_last
FROM catalog JOIN factors USING (magnification, thickness)""")
def p07(spark, sf):
    factors = spark.createDataFrame(_FACTORS, "magnification string, thickness string, factor int")
    return grids.z_clip_from_catalog(catalog(spark, sf), factors, 45)[0].select("tomogram", "z_first", "z_last")


@query("p07_rejected", f"WITH {_CATALOG}, {_FACTORS_SQL} SELECT tomogram, thickness FROM catalog ANTI JOIN factors USING (magnification, thickness)")
def p07_rejected(spark, sf):
    factors = spark.createDataFrame(_FACTORS, "magnification string, thickness string, factor int")
    return grids.z_clip_from_catalog(catalog(spark, sf), factors, 45)[1].select("tomogram", "thickness")


_NUM, _MAX = [11, 21, 31, 41, 61, 121], [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]


@query("p08_parameter_grid", f"WITH {_CATALOG} SELECT tomogram, num_ang, max_ang::DOUBLE AS max_ang FROM catalog, (SELECT unnest({_NUM})::INT AS num_ang) a, (SELECT unnest({_MAX}) AS max_ang) b WHERE NOT (num_ang = 121 AND max_ang = 10)")
def p08(spark, sf):
    grid = grids.param_grid(spark, _NUM, _MAX, [(121, 10.0)])
    return catalog(spark, sf).select("tomogram").crossJoin(F.broadcast(grid))  # 35 rows


@query("p09_constant_increment", f"WITH {_CATALOG} SELECT tomogram, unnest({_NUM})::INT AS num_ang, unnest({_MAX})::DOUBLE AS max_ang FROM catalog")
def p09(spark, sf):
    pairs = F.arrays_zip(F.array(*map(F.lit, _NUM)).alias("num_ang"), F.array(*map(F.lit, _MAX)).alias("max_ang"))
    return catalog(spark, sf).select("tomogram", F.inline(pairs)).toDF("tomogram", "num_ang", "max_ang")


_FILES = "files AS (SELECT l_orderkey AS run, CASE l_linenumber % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'full_a' ELSE 'full_b' END AS role, concat('microscopy_', l_partkey::VARCHAR) AS path FROM lineitem)"
_ROLES = ("a", "b", "full_a", "full_b")
_EXPECTED = "expected AS (SELECT o_orderkey AS run, unnest(['a', 'b', 'full_a', 'full_b']) AS role FROM orders), n AS (SELECT e.run, e.role, count(path) AS n, min(path) AS path FROM expected e LEFT JOIN files f ON e.run = f.run AND e.role = f.role GROUP BY e.run, e.role)"


def files(spark, sf):
    """A run for each order, a file for each of its lines: roles lack files or have several as it comes."""
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), (F.pmod(F.col("l_linenumber") - 1, F.lit(4)) + 1).cast("int"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), role.alias("role"), F.format_string("microscopy_%d", "l_partkey").alias("path"))


def expected(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.explode(F.array(*[F.lit(r) for r in _ROLES])).alias("role"))


for _mode, _first, _second in (("ab", "a", "b"), ("refa", "b", "full_a"), ("refb", "a", "full_b")):

    @query(f"p10_pairs_{_mode}", f"WITH {_FILES} SELECT f.run, f.path AS path1, g.path AS path2 FROM files f JOIN files g ON f.run = g.run WHERE f.role = '{_first}' AND g.role = '{_second}'")
    def p10(spark, sf, mode=_mode):
        return grids.pair_runs(files(spark, sf), ["run"], mode)


@query("p11_path_template", "SELECT o_orderkey, concat('/data/ccdb', o_custkey::VARCHAR, '/microscopy_', o_orderkey::VARCHAR, '/', (o_orderkey % 6 * 10 + 11)::VARCHAR, '-limited[', (o_custkey % 6 * 10 + 10)::VARCHAR, '.0_-', (o_custkey % 6 * 10 + 10)::VARCHAR, '.0]') AS path FROM orders")
def p11(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    angle = (c % 6 * 10 + 10).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", grids.path_of(c, k, k % 6 * 10 + 11, angle).alias("path"))


@query("p11_run_paths", "SELECT s_suppkey AS mpid, num_ang, max_ang, printf('/data/ccdb%d/microscopy_%d/%d-limited[%.1f_-%.1f]', s_nationkey, s_suppkey, num_ang, max_ang, max_ang) AS path FROM supplier, (SELECT unnest([121, 33, 5]) AS num_ang, unnest([60.0, 40.5, 10.0])::DOUBLE AS max_ang)")
def p11_runs(spark, sf):
    catalog = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mpid"), F.col("s_nationkey").alias("ccdbprod"))
    return grids.run_paths(catalog, [(121, 60.0), (33, 40.5), (5, 10.0)]).select("mpid", "num_ang", "max_ang", "path")


@query("p12_exactly_one", f"WITH {_FILES}, {_EXPECTED} SELECT run, role, path FROM n WHERE n = 1")
def p12(spark, sf):
    return grids.exactly_one(files(spark, sf), ["run", "role"], expected(spark, sf))[0]


@query("k10_quarantine", f"WITH {_FILES}, {_EXPECTED} SELECT run, role, n, CASE n WHEN 0 THEN 'no file' ELSE 'several files' END AS reason FROM n WHERE n <> 1")
def k10(spark, sf):
    return grids.exactly_one(files(spark, sf), ["run", "role"], expected(spark, sf))[1]


@query("p13_parameter_sweep", f"WITH {_VOLS} SELECT vol, 'cube_size' AS param, unnest(range(50, 751, 100))::INT AS value FROM vols UNION ALL SELECT vol, 'apod', unnest(range(10, 911, 100))::INT FROM vols UNION ALL SELECT vol, 'rt', unnest(range(2, 13, 2))::INT FROM vols")
def p13(spark, sf):
    return grids.sweep_plan(volumes(spark, sf).select("vol"))


@query("p14_box_grid", f"WITH {_VOLS}, w AS (SELECT *, floor((nx - 80) / 2.0)::INT AS xs, floor((ny - 80) / 2.0)::INT AS ys FROM vols) SELECT vol, x::INT AS x, y::INT AS y, z::INT AS z, concat(x::VARCHAR, '_', y::VARCHAR, '_', z::VARCHAR) AS box_id FROM (SELECT *, unnest(range(xs, xs + 80 - 20 + 1, 40)) AS x FROM w) a, LATERAL (SELECT unnest(range(ys, ys + 80 - 20 + 1, 40)) AS y) b, LATERAL (SELECT unnest(range(0, nz - 20 + 1, 40)) AS z) c")
def p14(spark, sf):
    return grids.box_grid(volumes(spark, sf), 20, 2, 80).select("vol", "x", "y", "z", "box_id")


@query("p14_box_counts", f"WITH {_VOLS} SELECT vol, (len(range(floor((nx - 80) / 2.0)::BIGINT, floor((nx - 80) / 2.0)::BIGINT + 61, 40)) * len(range(floor((ny - 80) / 2.0)::BIGINT, floor((ny - 80) / 2.0)::BIGINT + 61, 40)) * len(range(0, nz - 19, 40)))::BIGINT AS n_boxes FROM vols")
def p14_counts(spark, sf):
    vols = volumes(spark, sf)
    return grids.box_counts(vols, grids.box_grid(vols, 20, 2, 80), "vol")


_PROJ = "proj AS (SELECT o_custkey AS series, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS proj FROM orders), gone AS (SELECT 3 AS proj UNION ALL SELECT 8)"


def projections(spark, sf):
    return grids.numbered(table(spark, sf, "orders").select(F.col("o_custkey").alias("series"), "o_orderkey"), ["series"], ["o_orderkey"]).select("series", F.col("i").alias("proj"))


def excluded(spark):
    return spark.createDataFrame([(3,), (8,)], "proj int")


@query("p15_even_odd", f"WITH {_PROJ} SELECT series, count(*) FILTER (proj % 2 = 0) AS n_even, count(*) FILTER (proj % 2 = 1) AS n_odd FROM proj ANTI JOIN gone USING (proj) GROUP BY series")
def p15(spark, sf):
    return grids.split_even_odd(projections(spark, sf), excluded(spark)).groupBy("series").agg(F.count_if(F.col("half") == 0).alias("n_even"), F.count_if(F.col("half") == 1).alias("n_odd"))


@query("p16_leave_one_out", f"WITH {_PROJ}, u AS (SELECT * FROM proj ANTI JOIN gone USING (proj)) SELECT a.series, a.proj::INT AS left_out, string_agg(b.proj::VARCHAR, ',' ORDER BY b.proj) AS members FROM u a JOIN u b ON a.series = b.series AND a.proj % 4 = b.proj % 4 WHERE a.proj % 2 = 0 GROUP BY 1, 2")
def p16(spark, sf):
    groups = grids.loo_groups(projections(spark, sf), 4, excluded(spark), 2)
    return groups.select("series", "left_out", F.concat_ws(",", F.col("group").cast("array<string>")).alias("members"))


@query("p17_task_split", """WITH n AS (SELECT count(*) AS n FROM orders), s AS (SELECT o_orderkey, (n // 7) AS q, (7 - n % 7) AS few FROM orders, n)
SELECT part, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, (CASE WHEN o_orderkey < few * q THEN o_orderkey // q ELSE few + (o_orderkey - few * q) // (q + 1) END)::INT AS part FROM s) GROUP BY part""")
def p17(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    split = grids.task_split(orders.crossJoin(F.broadcast(total)), "o_orderkey", F.col("total"), 7)  # one row
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("p18_tilt_series", "SELECT s_suppkey, proj, CASE WHEN raw >= 0 THEN floor(raw + 0.5) ELSE ceil(raw - 0.5) END / 10 AS tilt FROM (SELECT s_suppkey, proj::INT AS proj, (amin + proj * step) * 10 AS raw FROM (SELECT s_suppkey, amin, step, unnest(range(0, floor((60.0 - amin) / step + 0.5)::INT + 1)) AS proj FROM (SELECT s_suppkey, (-60 + s_suppkey % 20)::DOUBLE AS amin, (1 + s_suppkey % 4)::DOUBLE AS step FROM supplier)))")
def p18(spark, sf):
    k = F.col("s_suppkey")
    runs = table(spark, sf, "supplier").select(k, (k % 20 - 60).cast("double").alias("amin"), F.lit(60.0).alias("amax"), (k % 4 + 1).cast("double").alias("step"))
    return grids.tilt_series(runs).select("s_suppkey", "proj", "tilt")


@query("p19_roi_padded", f"WITH {_POINTS} SELECT bead_id, greatest(x - 18, 0) AS x0, greatest(least(x + 18, 100) - greatest(x - 18, 0), 0) AS x_size, greatest(x - 18, 0) - (x - 18) AS x_paste, greatest(z - 18, 0) AS z0, greatest(least(z + 18, 60) - greatest(z - 18, 0), 0) AS z_size FROM points")
def p19(spark, sf):
    return grids.roi_plan(points(spark, sf), 36).select("bead_id", "x0", "x_size", "x_paste", "z0", "z_size")


@query("p20_roi_shifted", f"WITH {_POINTS} SELECT bead_id, greatest(least(x + 18, 99) - 36, 0) AS x0, greatest(least(y + 18, 99) - 36, 0) AS y0, greatest(least(z + 18, 59) - 36, 0) AS z0, true AS fits FROM points")
def p20(spark, sf):
    return grids.roi_plan(points(spark, sf), 36, "shift").select("bead_id", "x0", "y0", "z0", "fits")


@query("p21_roi_plain", f"WITH {_POINTS} SELECT bead_id, x - 18 AS x0, y - 18 AS y0, z - 18 AS z0 FROM points")
def p21(spark, sf):
    return grids.roi_plan(points(spark, sf), 36, "plain").select("bead_id", "x0", "y0", "z0")


@query("p22_normalised_points", "SELECT o_orderkey, trunc(o_totalprice / 1000)::INT AS x, trunc(-o_totalprice / 777)::INT AS y, (o_orderkey % 60)::INT AS z FROM orders")
def p22(spark, sf):
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    as_struct = F.when(k % 2 == 0, F.struct((price / 1000).alias("x"), (-price / 777).alias("y"), (k % 60).cast("double").alias("z")))
    as_tuple = F.array(price / 1000, -price / 777, (k % 60).cast("double"))
    rows = table(spark, sf, "orders").select("o_orderkey", as_struct.alias("position"), as_tuple.alias("xyz"))
    return grids.normalise_points(rows)


@query("p23_safe_names", r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_.-]', '_', 'g') AS name FROM pages")
def p23(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.safe_name(F.col("url")).alias("name"))


_LABEL = "labels_ AS (SELECT o_orderkey, concat('https://x.org/', o_custkey::VARCHAR, '/tomo', (o_orderkey % 30)::VARCHAR, CASE o_orderkey % 4 WHEN 0 THEN 'a_11_lim15_16bit#view' WHEN 1 THEN 'b-21 LIM 30?x=9_lim9' WHEN 2 THEN '_31lim45_7_lim8' ELSE '_plain' END) AS label FROM orders)"


def labels(spark, sf):
    k = F.col("o_orderkey")
    tail = F.element_at(F.array(*[F.lit(t) for t in ("a_11_lim15_16bit#view", "b-21 LIM 30?x=9_lim9", "_31lim45_7_lim8", "_plain")]), (k % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select(k, F.concat(F.lit("https://x.org/"), F.col("o_custkey").cast("string"), F.lit("/tomo"), (k % 30).cast("string"), tail).alias("label"))


@query("p24_recon_labels", f"WITH {_LABEL}, s AS (SELECT o_orderkey, regexp_extract(regexp_replace(label, '[#?].*$', ''), '([^/]*)/*$', 1) AS seg FROM labels_) SELECT o_orderkey, (regexp_extract_all(seg, '(?i)(\\d+)\\s*[_-]*\\s*lim\\s*(\\d+)', 1))[-1]::DOUBLE AS num_proj, (regexp_extract_all(seg, '(?i)(\\d+)\\s*[_-]*\\s*lim\\s*(\\d+)', 2))[-1]::DOUBLE AS max_angle FROM s")
def p24(spark, sf):
    num, angle = C.parse_recon_label(F.col("label"))
    return labels(spark, sf).select("o_orderkey", num.alias("num_proj"), angle.alias("max_angle"))


@query("p25_recon_labels_legacy", f"WITH {_LABEL} SELECT o_orderkey, coalesce(nullif(regexp_extract(label, '(\\d+)_lim(\\d+)', 1), ''), nullif(regexp_extract(label, '(\\d+)[^\\d]+lim(\\d+)', 1), ''))::DOUBLE AS num_proj, coalesce(nullif(regexp_extract(label, '(\\d+)_lim(\\d+)', 2), ''), nullif(regexp_extract(label, '(\\d+)[^\\d]+lim(\\d+)', 2), ''))::DOUBLE AS max_angle FROM labels_")
def p25(spark, sf):
    num, angle = C.parse_recon_label_legacy(F.col("label"))
    return labels(spark, sf).select("o_orderkey", num.alias("num_proj"), angle.alias("max_angle"))


@query("p26_angles", f"WITH {_LABEL} SELECT o_orderkey, nullif(regexp_extract(label, 'lim(\\d+)', 1), '')::DOUBLE AS max_angle FROM labels_")
def p26(spark, sf):
    return labels(spark, sf).select("o_orderkey", C.angle_of(F.col("label")).alias("max_angle"))


@query("p27_common_prefix", "SELECT a.page_id, left(a.url, (SELECT coalesce(max(n), 0) FROM unnest(range(1, length(a.url) + 1)) t(n) WHERE starts_with(b.url, left(a.url, n)))::BIGINT) AS prefix FROM pages a JOIN pages b ON b.page_id = a.page_id + 1")
def p27(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    other = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return pages.join(other, "page_id").select("page_id", C.common_prefix(F.col("url"), F.col("other")).alias("prefix"))

"""Planted truth, invariants and file round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.functions import columns as C
from voxspark.operators import beads, crossval, fourier, imageops, report
from voxspark.plans import grids
from voxspark.sources import mrc, results


def test_fit_finds_planted_parameters_with_noise_and_holes():
    rng = np.random.default_rng(1)
    x = np.arange(36)
    truth = np.stack([rng.uniform(-5, 5, 200), rng.uniform(12, 24, 200), rng.uniform(1.5, 5, 200), rng.uniform(0, 10, 200)], axis=1)
    truth[:, 0] = np.where(np.abs(truth[:, 0]) < 1, 2, -np.abs(truth[:, 0]))  # mostly dark beads
    y = truth[:, :1] * np.exp(-((x - truth[:, 1:2]) ** 2) / (2 * truth[:, 2:3] ** 2)) + truth[:, 3:4]
    y[::7, 20] = np.nan
    p, good = beads.fit_batch(y)
    dark = truth[:, 0] < 0
    assert good[dark].mean() > 0.97
    assert np.allclose(np.abs(p[good & dark][:, 2]), truth[good & dark][:, 2], atol=1e-6)


def test_constant_profile_has_no_r2(spark):
    df = spark.createDataFrame([(1, [2.0] * 10), (2, None), (3, [1.0, None, 2.0])], "bead long, samples array<double>")
    out = {r["bead"]: r for r in beads.fit_gaussians(df, ["bead"]).collect()}
    assert out[1]["r2"] is None and out[2]["sigma"] is None and out[3]["sigma"] is None


def test_dft_equals_fft_on_unequal_axes(spark):
    cube = np.random.default_rng(2).normal(size=(7, 6, 5))
    rows = [(1, int(z), int(x), int(y), float(cube[z, x, y])) for z, x, y in np.ndindex(cube.shape)]
    tiles = spark.createDataFrame(rows, "tile long, dz int, dx int, dy int, v double")
    got = fourier.dft(tiles, ["tile"], [("z", 7), ("x", 6), ("y", 5)]).collect()
    want = np.fft.fftn(cube)
    assert len(got) == cube.size
    assert all(abs(complex(r["re"], r["im"]) - want[r["kz"] % 7, r["kx"] % 6, r["ky"] % 5]) < 1e-9 for r in got)
    flat = spark.createDataFrame([(1, cube.ravel().tolist())], "tile long, v array<double>")
    kernel = fourier.fft_kernel(flat, "tile", "v", cube.shape).first()
    assert np.allclose(np.array(kernel["re"]) + 1j * np.array(kernel["im"]), np.fft.fftshift(want).ravel())


def test_equal_volumes_never_cross(spark):
    curve = spark.createDataFrame([(1, f, 1.0, 0.5) for f in range(5)] + [(2, 0, 0.9, 0.5), (2, 1, 0.7, 0.5), (2, 2, 0.1, 0.5), (2, 3, 0.8, 0.5), (2, 4, 0.2, 0.5)], "run int, f int, fsc double, t double")
    first = {r["run"]: r for r in fourier.crossing(curve, ["run"], F.lit(4)).collect()}
    last = {r["run"]: r for r in fourier.crossing(curve, ["run"], F.lit(4), mode="last").collect()}
    wrapped = {r["run"]: r for r in fourier.crossing(curve, ["run"], F.lit(4), compat=True).collect()}
    assert first[1]["x"] is None and first[1]["status"] == "no_crossing"
    assert first[2]["x"] == pytest.approx((1 + 0.2 / 0.6) / 4) and last[2]["x"] == pytest.approx((3 + 0.3 / 0.6) / 4)
    assert wrapped[2]["x"] == first[2]["x"]


def test_weights_over_tilt_add_up(spark):
    tilts = spark.createDataFrame([(1, p, -60.0 + 3 * p) for p in range(9)] + [(2, 0, 5.0)], "run int, proj int, tilt double")
    sums = crossval.tilt_weights(tilts, ["run"], 5).groupBy("run", "centre").agg(F.sum("w").alias("w"), F.count("w").alias("n")).collect()
    assert len(sums) == 10 and all(r["w"] == pytest.approx(1.0) for r in sums)
    assert {r["n"] for r in sums} == {1, 3, 4, 5}


def test_tiles_of_a_volume_smaller_than_a_tile(spark):
    one = spark.createDataFrame([(1, 0, 0, 0, 10, 200, 44)], "vol int, z0 int, x0 int, y0 int, nz int, nx int, ny int")
    assert grids.plan_tiles(one, 45).count() == 0


def test_crop_meets_tiles_that_lie_across_blocks(spark):
    voxels = spark.createDataFrame([(1, z, x, y, float(z * 100 + x * 10 + y)) for z in range(6) for x in range(6) for y in range(6)], "vol_id long, z int, x int, y int, v double")
    plan = spark.createDataFrame([(0, 1, 1, 2, 3), (1, 1, 4, 4, 4)], "tile int, vol_id long, z int, x int, y int")
    got = {r["tile"]: r for r in fourier.crop(voxels, plan, 3).groupBy("tile").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert (got[0]["n"], got[0]["lo"], got[0]["hi"]) == (27, 123.0, 345.0) and got[1]["n"] == 8


@pytest.mark.parametrize(("label", "want"), [("11_lim15_tomo10a_16bit", (11.0, 15.0)), ("http://x/a/21-LIM 30_b#view", (21.0, 30.0)), ("none", (None, None)), (None, (None, None))])
def test_labels(spark, label, want):
    df = spark.createDataFrame([(label,)], "l string")
    assert tuple(df.select(*C.parse_recon_label(F.col("l"))).first()) == want


def test_result_files_of_all_kinds(spark, tmp_path):
    names = {"FSC3D_refa_500nm_Mouse_tomo26_11-limited[10.0_-10.0].csv": "172, 77, 797, 4.1, 91.7, 0.08\n172, 77, 77, -1, 34.7, nan\n", "dtFSC2D_1um_Mouse_tomo1_17-limited[10.0_-10.0].csv": "0, -1, -1, 27.7, 36.0\n", "FSC3D_1.25um_Mouse_tomo1_11-limited[30.0_-30.0]": "80, 984, 988, 42.5 31.6\n\n"}
    for name, text in names.items():
        (tmp_path / name).write_text(text)
    rows = results.read_fsc_results(spark, str(tmp_path)).collect()
    assert sorted((r["kind"], r["thickness"], r["num_ang"], r["max_ang"], r["res"]) for r in rows) == [("2d", "1um", 17, 10.0, 27.7), ("3d", "500nm", 11, 10.0, -1.0), ("3d", "500nm", 11, 10.0, 4.1), ("cli", "1.25um", 11, 30.0, 42.5)]


def test_catalogs_of_differing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Tomogram,Label,PID,,Notes,Pixel Size bin 4 (nm)\nt1,l,5,,x,1.4\n")
    (tmp_path / "b.csv").write_text("Tomogram,z_min,z_max,Thickness\nt2,10,90,250nm\n")
    rows = results.read_catalog(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("tomogram").collect()
    assert (rows[0]["pid"], rows[0]["pixel_size_nm"], rows[0]["z_min"], rows[1]["z_max"], rows[1]["thickness"]) == (5, 1.4, None, 90, "250nm")


def test_tilt_list(spark, tmp_path):
    (tmp_path / "a.tlt").write_text("-60.0\n-57.5\n0\n")
    assert [r["tilt"] for r in results.read_tilt_angles(spark, str(tmp_path / "a.tlt")).orderBy("proj").collect()] == [-60.0, -57.5, 0.0]


def test_mrc_volume_as_bricks(spark, tmp_path):
    cube = np.random.default_rng(3).normal(size=(5, 7, 6)).astype("<f4")
    header = np.zeros(256, "<i4")
    header[:4] = (6, 7, 5, 2)
    (tmp_path / "v.mrc").write_bytes(header.tobytes() + cube.tobytes())
    spark.dataSource.register(mrc.MrcSource)
    bricks = spark.read.format("mrc").option("brick", 4).option("slab", 4).load(f"{tmp_path}/v.mrc")
    voxels = mrc.explode_bricks(bricks).collect()
    assert len(voxels) == cube.size and all(cube[r["z"], r["x"], r["y"]] == np.float32(r["v"]) for r in voxels)


def test_stream_drops_repeated_runs(spark, tmp_path):
    from voxspark.streaming.results import first_of_runs, stream_results

    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 2.0), (1, "2024-01-01 00:05:00", 3.0), (2, "2024-01-01 01:00:00", 4.0)], "run int, at string, res double").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    once = first_of_runs(stream_results(spark, f"{tmp_path}/in", df.schema), ["run"], "at")
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["run"] for r in spark.table("once").collect()) == [1, 2]


def test_batches_of_a_stream_refresh_the_report(spark, tmp_path):
    from voxspark.streaming.results import append_and_report, stream_results

    df = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", 7.0)], "run string, res double")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second time there is nothing new
        stream = stream_results(spark, f"{tmp_path}/in", df.schema, per_trigger=1)
        append_and_report(stream, f"{tmp_path}/table", f"{tmp_path}/report", ["run"], "res", f"{tmp_path}/checkpoint").awaitTermination()
        rows = {r["run"]: (r["estimate"], r["low"], r["high"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/report").collect()}
        assert rows == {"a": (2.0, 1.0, 3.0, 5), "b": (7.0, 7.0, 7.0, 1)} and spark.read.parquet(f"{tmp_path}/table").count() == 6


def test_a_batch_costs_its_own_rows_and_the_state(spark, tmp_path):
    from voxspark.operators.report import point_stats
    from voxspark.streaming.results import append_and_report, stream_results

    rng = np.random.default_rng(3)
    schema = "run string, res double"

    def arrive(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def follow():
        stream = stream_results(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, per_trigger=1)
        append_and_report(stream, f"{tmp_path}/table", f"{tmp_path}/report", ["run"], "res", f"{tmp_path}/checkpoint", "median").awaitTermination()

    rows = [(f"r{k % 3}", float(np.round(v, 1))) for k, v in enumerate(rng.normal(5, 2, 400))] + [("r0", float("nan")), ("r9", None)]
    arrive(0, rows[:250])
    follow()
    arrive(1, rows[250:] + rows[:20])  # later, and partly repeated
    before = sorted(p.name for p in (tmp_path / "table").iterdir())
    old = tmp_path / "table" / before[0]
    hidden = tmp_path / "hidden"
    old.rename(hidden)  # the second batch cannot read the rows of the first
    follow()
    hidden.rename(old)
    everything = spark.createDataFrame(rows + rows[:20], schema)
    want = {r["run"]: (r["estimate"], r["low"], r["high"], r["n"]) for r in point_stats(everything, ["run"], "res", "median").collect() if r["n"]}
    got = {r["run"]: (r["estimate"], r["low"], r["high"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/report").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert spark.read.parquet(f"{tmp_path}/table").count() == len(rows) + 20
    # a batch that runs again after a failure gives the same
    import shutil

    shutil.rmtree(f"{tmp_path}/checkpoint/commits")
    follow()
    again = {r["run"]: (r["estimate"], r["low"], r["high"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/report").collect()}
    assert all(again[k] == pytest.approx(want[k]) for k in want)


# --- windows and the measurement ------------------------------------------------------------------------


def hann_by_hand(n, flat):
    """One axis of the window as it is defined, its top at place 0."""
    i = np.arange(n)
    if flat == 0:
        return (1 + np.cos(2 * np.pi * i / n)) / 2
    first = int(np.floor((flat - 1) / 2))
    w = (1 + np.cos(2 * np.pi * (i - first) / (n + 1 - flat))) / 2
    if first > 0:
        w[:first] = 1
    w[first + n + 3 - flat :] = 1
    return w


@pytest.mark.parametrize(("n", "flat"), [(8, 0), (8, 4), (45, 0), (45, 4), (45, 33)])
def test_windows(spark, n, flat):
    i = spark.range(n).select(F.col("id").cast("int").alias("i"))
    rows = i.select(fourier.fractional_hann(n, F.col("i"), flat).alias("a"), fourier.hann_padded(n, n, F.col("i"), flat).alias("b"), "i").orderBy("i").collect()
    want = hann_by_hand(n, flat)
    assert np.allclose([r["a"] for r in rows], want) and np.allclose([r["b"] for r in rows], np.fft.fftshift(want))


def test_window_of_a_box_as_columns_and_as_an_array(spark):
    shape = (6, 7, 8)
    cells = spark.range(6 * 7 * 8).select((F.floor(F.col("id") / 56)).alias("dz"), (F.floor(F.col("id") / 8) % 7).alias("dx"), (F.col("id") % 8).alias("dy"), "id")
    got = [r["w"] for r in cells.select(fourier.window3d(*shape, 2, 2).alias("w"), "id").orderBy("id").collect()]
    assert np.allclose(np.reshape(got, shape), fourier.window_array(shape, 2, 2))


def bricks_of(name, cube, edge):
    for z in range(0, cube.shape[0], edge):
        for x in range(0, cube.shape[1], edge):
            for y in range(0, cube.shape[2], edge):
                part = cube[z : z + edge, x : x + edge, y : y + edge].astype("<f4")
                yield (name, z // edge, x // edge, y // edge, z, x, y, *part.shape, bytearray(part.tobytes()))


def resolution_by_hand(a, b, pixel, ring, rad, ax, compat):
    """Every ring by a scan of the whole cube."""
    n = a.shape[0]
    w = fourier.window_array(a.shape, rad, ax)
    shift = np.fft.ifftshift if compat else np.fft.fftshift
    f1, f2 = (shift(np.fft.fftn(np.fft.fftshift(v * w))) for v in (a, b))
    k = np.arange(-(n // 2), (n + 1) // 2)
    index = np.round(np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2))
    d = []
    for f in range(n // 2 + 1):
        m = abs(index - f) <= ring // 2
        c = abs((f1[m] * np.conj(f2[m])).sum()) / np.sqrt((abs(f1[m]) ** 2).sum() * (abs(f2[m]) ** 2).sum())
        s, npts = 0.2071, m.sum()
        t = (s + 2 * np.sqrt(s) / np.sqrt(npts + np.spacing(1)) + 1 / np.sqrt(npts)) / (s + 2 * np.sqrt(s) / np.sqrt(npts + np.spacing(1)) + 1)
        d.append(c - t)
    hit = next((i for i, v in enumerate(d) if v < 0), None)
    return None if not hit else pixel / ((hit - 1 + d[hit - 1] / (d[hit - 1] - d[hit])) / (n // 2))


@pytest.mark.parametrize("compat", [False, True])
def test_resolution_of_tiles_cut_from_bricks(spark, compat):
    from voxspark.schemas import BRICKS

    rng = np.random.default_rng(4)
    k = np.fft.fftfreq(54)
    low = 1 / (1 + (np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2) / 0.12) ** 8)
    signal = np.fft.ifftn(np.fft.fftn(rng.normal(size=(54, 54, 54))) * low).real
    a, b = (signal + 0.25 * signal.std() * rng.normal(size=signal.shape) for _ in range(2))
    bricks = spark.createDataFrame([*bricks_of("a", a, 20), *bricks_of("b", b, 20), *bricks_of("zero", np.zeros((54, 54, 54)), 20)], BRICKS)
    pairs = spark.createDataFrame([(1, "a", "b", 0, 0, 0), (2, "a", "b", 9, 5, 7), (3, "a", "zero", 0, 0, 0), (4, "a", "b", 20, 0, 0), (5, "a", "a", 0, 0, 0)], "tile long, a string, b string, z int, x int, y int")
    got = {r["tile"]: r for r in fourier.resolution_measure(bricks, pairs, (20, 20, 20), (45, 45, 45), 4.9, ring=6, rad=60, ax=60, compat=compat).collect()}
    for tile, (z, x, y) in ((1, (0, 0, 0)), (2, (9, 5, 7))):
        parts = [v.astype(np.float32).astype(float)[z : z + 45, x : x + 45, y : y + 45] for v in (a, b)]
        want = resolution_by_hand(*parts, 4.9, 6, 60, 60, compat)
        r = got[tile]
        assert r["status"] == "ok" and r["res"] == pytest.approx(want, rel=1e-6) and (r["z"], r["x"], r["y"]) == (z + 22, x + 22, y + 22)
        assert r["corr"] == pytest.approx(np.corrcoef(parts[0].ravel(), parts[1].ravel())[0, 1], rel=1e-6) and r["mean"] == pytest.approx((parts[0].mean() + parts[1].mean()) / 2, abs=1e-6)
    assert (got[3]["res"], got[3]["status"]) == (-1.0, "empty") and (got[4]["res"], got[4]["status"]) == (None, "incomplete")
    assert got[5]["status"] == "no_crossing" and (got[5]["res"] is not None) == compat
    flat = fourier.resolution_measure(bricks, pairs.filter("tile = 2"), (20, 20, 20), (1, 40, 40), 4.9, ring=2, rad=10).first()
    assert flat["status"] in ("ok", "no_crossing") and flat["z"] == 9


def test_boxes_of_bricks_hold_nan_beyond_the_volume(spark):
    from voxspark.schemas import BRICKS

    cube = np.arange(7 * 7 * 7, dtype=np.float32).reshape(7, 7, 7)
    bricks = spark.createDataFrame(list(bricks_of("v", cube, 4)), BRICKS)
    boxes = spark.createDataFrame([(1, "v", 2, 1, 3), (2, "v", -2, 5, 0), (3, "v", 40, 0, 0)], "bead long, vol_id string, z0 int, x0 int, y0 int")
    padded = np.full((60, 60, 60), np.nan, np.float32)
    padded[10:17, 10:17, 10:17] = cube
    rows = {r["bead"]: r for r in beads.roi_arrays(bricks, boxes, (4, 4, 4), 4).collect()}
    for bead, (z, x, y) in {1: (2, 1, 3), 2: (-2, 5, 0), 3: (40, 0, 0)}.items():
        want = padded[z + 10 : z + 14, x + 10 : x + 14, y + 10 : y + 14]
        assert np.array_equal(np.array(rows[bead]["values"], np.float32).reshape(4, 4, 4), want, equal_nan=True)


def test_beads_that_lack_a_reconstruction_or_fail_in_x_or_z(spark):
    rows = [("t", r, b, 0.9, 0.1, 0.9) for r in "pq" for b in range(5)] + [("t", "p", 5, 0.9, 0.9, 0.9), ("u", "p", 0, 0.9, 0.9, 0.9)]
    rows = [(t, r, b, None if b == 1 and r == "q" else x, y, 0.2 if b == 2 and r == "p" else float("nan") if b == 3 else z) for t, r, b, x, y, z in rows]
    fits = spark.createDataFrame(rows, "tomogram string, recon string, bead int, r2_x double, r2_y double, r2_z double")
    assert sorted(map(tuple, beads.skip_beads(fits, 0.6).collect())) == [("t", 1), ("t", 2), ("t", 3), ("t", 5)]


# --- images and peaks -----------------------------------------------------------------------------------


def best_fit_by_hand(x, y, most):
    """As it is told: 0, 1, 2 ... % of the voxels are cut off by a histogram of the residuals, again and again."""
    keep, best = [True] * len(x), (0, 0, 1e30, 0)
    for step in range(round(most * 100) + 1):
        xs, ys = [a for a, k in zip(x, keep) if k], [b for b, k in zip(y, keep) if k]
        b = np.cov(xs, ys, bias=True)[0, 1] / np.var(xs)
        a = np.mean(ys) - b * np.mean(xs)
        r = np.sqrt(sum((a + b * u - v) ** 2 for u, v in zip(xs, ys)) / sum((v - np.mean(ys)) ** 2 for v in ys))
        if r < best[2]:
            best = a, b, r, len(x) - len(xs)
        off = [abs(a + b * u - v) for u, v in zip(x, y)]
        bins = [min(int(1000 * o / max(off)), 999) for o in off]
        i, j = 999, bins.count(999)
        while i > 1 and j < len(x) * step / 100 - 1e-9:
            i -= 1
            j += bins.count(i)
        keep = [o <= i * max(off) / 1000 for o in off]
    return best


def test_best_fit_leaves_out_the_worst(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = 2 + 3 * x + 0.1 * rng.normal(size=300)
    y[::20] += 30
    want = best_fit_by_hand(x.tolist(), y.tolist(), 0.1)
    mask = [1.0] * 300
    df = spark.createDataFrame([(1, x.tolist(), y.tolist(), mask), (2, [*x.tolist(), 5.0], [*y.tolist(), 900.0], [*mask, 0.0])], "run long, v1 array<double>, v2 array<double>, m array<double>")
    for r in imageops.robust_fit(df, "run", 0.1, "m").collect():
        assert (r["a"], r["b"], r["r"], r["n_left_out"]) == pytest.approx(want)
        assert r["difference"][7] == pytest.approx(want[0] + want[1] * x[7] - y[7]) and (r["run"] == 1 or r["difference"][-1] == 0)


def test_best_fit_of_images_dealt_over_partitions(spark):
    rng = np.random.default_rng(13)
    images = {}
    for k in range(3):
        x = rng.normal(0, 1, 900)
        y = 2 * x - 1 + rng.normal(0, 0.1, 900)
        y[rng.random(900) < 0.1 * k] += rng.normal(0, 8)
        images[k] = x, y
    images[3] = np.arange(50.0), 3 * np.arange(50.0) + 1  # a perfect line
    rows = [(k, float(a), float(b)) for k, (x, y) in images.items() for a, b in zip(x, y)]
    got = {r["run"]: r for r in imageops.robust_fit_rows(spark.createDataFrame(rows, "run long, v1 double, v2 double").repartition(7), ["run"], 0.06).collect()}
    for k, (x, y) in images.items():
        a, b, r, left, _ = imageops.best_fit(x, y, 0.06)
        assert got[k]["a"] == pytest.approx(a, abs=1e-7) and got[k]["b"] == pytest.approx(b, abs=1e-7) and got[k]["r"] == pytest.approx(r, abs=1e-6)
        assert k == 3 or got[k]["n_left_out"] == left


def test_shift_is_found_and_refined(spark):
    n = 32
    g = lambda cx, cy: np.exp(-((np.arange(n)[:, None] - cx) ** 2 + (np.arange(n)[None, :] - cy) ** 2) / 18)
    df = spark.createDataFrame([(1, g(16, 16).ravel().tolist(), g(19.3, 12).ravel().tolist())], "run long, v1 array<double>, v2 array<double>")
    assert crossval.best_shift(df, "run", (n, n)).first()["shift"] == [3.0, -4.0]
    fine = crossval.best_shift(df, "run", (n, n), band=(0, 8), refine=True).first()["shift"]
    assert fine == pytest.approx([3.3, -4.0], abs=0.15)
    assert crossval.best_shift(df, "run", (n, n), within=2).first()["shift"] != [3.0, -4.0]
    assert crossval.best_shift(df.withColumn("v2", F.col("v1")), "run", (n, n)).first()["shift"] == [0.0, 0.0]


def test_erasing_with_noise_stays_within_the_disc(spark):
    images = spark.createDataFrame([(1, x, y, 100.0 if (x - 10) ** 2 + (y - 10) ** 2 < 9 else float((x * 7 + y * 3) % 5)) for x in range(21) for y in range(21)], "img int, px int, py int, v double")
    centres = spark.createDataFrame([(1, 1, 10, 10)], "img int, bead int, cx int, cy int")
    old = {(r["px"], r["py"]): r["v"] for r in images.collect()}
    new = {(r["px"], r["py"]): r["v"] for r in crossval.erase_beads(images, centres, ["img"], 3, noise=1).collect()}
    disc = {p for p in old if (p[0] - 10) ** 2 + (p[1] - 10) ** 2 < 3.6**2}
    assert {p for p in old if old[p] != new[p]} <= disc and max(new[p] for p in disc) < 20 and len({new[p] for p in disc}) == len(disc)


def test_counts_that_differ_and_volumes_without_boxes_are_errors(spark):
    p = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "run int, proj int")
    a = spark.createDataFrame([(1, 0.0), (1, 3.0), (2, 0.0), (2, 3.0)], "run int, tilt double")
    assert crossval.assert_counts(p.filter("run = 1"), a.filter("run = 1"), ["run"]).first()["n_proj"] == 2
    with pytest.raises(Exception, match="1 projections but 2 angles"):
        crossval.assert_counts(p, a, ["run"]).collect()
    vols = spark.createDataFrame([(1,), (2,)], "vol int")
    with pytest.raises(Exception, match="volume 2 has no box"):
        grids.box_counts(vols, spark.createDataFrame([(1, "x")], "vol int, box_id string"), "vol").collect()


def test_runs_without_any_file_are_rejected(spark):
    files = spark.createDataFrame([(1, "a", "p"), (1, "b", "q"), (1, "b", "r")], "run int, role string, path string")
    wanted = spark.createDataFrame([(r, x) for r in (1, 2) for x in "ab"], "run int, role string")
    good, bad = grids.exactly_one(files, ["run", "role"], wanted)
    assert [tuple(r) for r in good.collect()] == [(1, "a", "p")]
    assert sorted(map(tuple, bad.collect())) == [(1, "b", 2, "several files"), (2, "a", 0, "no file"), (2, "b", 0, "no file")]


def test_approximate_percentiles_come_near(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 5003).cast("double").alias("v"))
    for exact, near in zip(report.point_stats(df, ["g"], "v", "median").orderBy("g").collect(), report.point_stats(df, ["g"], "v", "median", exact=False).orderBy("g").collect()):
        assert near["n"] == exact["n"] and all(near[c] == pytest.approx(exact[c], abs=6) for c in ("estimate", "low", "high"))


def test_refined_percentiles_are_exact(spark):
    rng = np.random.default_rng(11)
    rows = [("a", float(v)) for v in rng.lognormal(0, 3, 3000)] + [("b", 5.0)] * 2000 + [("b", float(v)) for v in rng.normal(5, 1e-6, 1001)] + [("c", 1.0), ("c", None), (None, 2.0), (None, 4.0), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    for estimator in ("mean", "median"):
        want = {r["g"]: r for r in report.point_stats(df, ["g"], "v", estimator).collect()}
        got = {r["g"]: r for r in report.point_stats(df, ["g"], "v", estimator, exact="refined").collect()}
        assert set(got) == set(want) and all(got[g]["n"] == want[g]["n"] for g in want)
        for g in set(want) - {"d"}:
            assert all(got[g][c] == pytest.approx(want[g][c], rel=1e-12) for c in ("estimate", "low", "high"))
        assert got["d"]["low"] is None


# --- files ------------------------------------------------------------------------------------------------


def test_big_endian_volumes_and_stacks(spark, tmp_path):
    cube = np.random.default_rng(3).integers(-500, 500, size=(3, 5, 4)).astype(">i2")
    header = bytearray(1024)
    header[:16] = np.array((4, 5, 3, 1), ">i4").tobytes()
    header[212:214] = b"\x11\x11"
    (tmp_path / "b.mrc").write_bytes(bytes(header) + cube.tobytes())
    spark.dataSource.register(mrc.MrcSource)
    bricks = spark.read.format("mrc").option("brick", 2).option("slab", 2).load(f"{tmp_path}/b.mrc")
    voxels = mrc.explode_bricks(bricks).collect()
    assert len(voxels) == cube.size and all(cube[r["z"], r["x"], r["y"]] == r["v"] for r in voxels)
    images = {r["proj"]: r for r in mrc.read_projections(spark, f"{tmp_path}/b.mrc").collect()}
    assert set(images) == {0, 1, 2} and np.array_equal(np.frombuffer(images[1]["data"], "<f4").reshape(5, 4), cube[1])


def test_settings_files(spark, tmp_path):
    (tmp_path / "a.com").write_text("# tilt\nTHICKNESS 200\nLOG 1.5\nXAXISTILT -2.5\nEXCLUDELIST 1-3, 9\nTHICKNESS 300\n")
    (tmp_path / "b.com").write_text("MODE 2\n")
    rows = {r["file"]: r for r in results.read_tilt_configs(spark, str(tmp_path)).collect()}
    assert (rows["a.com"]["THICKNESS"], rows["a.com"]["log_base"], rows["a.com"]["x_tilt"], rows["a.com"]["excluded"]) == ("300", 1.5, -2.5, [1, 2, 3, 9])
    assert rows["b.com"]["MODE"] == "2" and rows["b.com"]["LOG"] is None


def test_bead_configuration(spark, tmp_path):
    entries = {"tomograms": [{"tomogram": "t", "thickness": 250, "pxl_size": 4.9, "recon_labels": ["11_lim15", "21_lim30"]}, {"tomogram": "u", "box_size": 20, "recon_labels": []}]}
    rows = results.config_labels(results.bead_config(spark, entries)).collect()
    assert [(r["tomogram"], r["box_size"], r["pos"], r["label"], r["thickness"]) for r in rows] == [("t", 36, 0, "11_lim15", 250.0), ("t", 36, 1, "21_lim30", 250.0)]
    with pytest.raises(ValueError, match="tomograms"):
        results.bead_config(spark, {})
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("tomograms:\n- tomogram: t\n  pxl_size: 1.4\n  recon_labels: [a, b]\n")
    assert results.read_bead_config(spark, str(tmp_path / "c.yaml")).first()["recon_labels"] == ["a", "b"]


def test_boxes_written_read_and_imported(spark, tmp_path):
    rng = np.random.default_rng(6)
    (tmp_path / "npz" / "tomo 1").mkdir(parents=True)
    stack, points = rng.normal(size=(3, 4, 4, 4)).astype(np.float32), np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    np.savez_compressed(tmp_path / "npz" / "tomo 1" / "11_lim15.npz", subvolumes=stack, points=points)
    results.write_roi(results.import_roi(spark, str(tmp_path / "npz")), str(tmp_path / "roi"))
    rows = results.read_roi(spark, str(tmp_path / "roi"), "tomo 1", "11_lim15").orderBy("bead").collect()
    assert [(r["bead"], r["x"], r["z"], r["size"]) for r in rows] == [(0, 1, 3, 4), (1, 4, 6, 4), (2, 7, 9, 4)]
    assert np.array_equal(np.array(rows[2]["values"], np.float32).reshape(4, 4, 4), stack[2])
    assert results.read_roi(spark, str(tmp_path / "roi"), "other").count() == 0


def test_curves_tilts_and_parameters_round_trip(spark, tmp_path):
    rows = [("r", p, -60.0 + 3 * p, i, i / 100, 100 / max(i, 1), 1 - i / 10) for p in range(3) for i in range(5)]
    curves = spark.createDataFrame(rows, "run string, proj int, tilt double, idx int, s double, res double, value double")
    results.write_curves(curves, ["run", "proj", "tilt"], str(tmp_path / "curves"), titled=True)
    lines = [p for p in (tmp_path / "curves" / "run=r").iterdir() if p.name.startswith("part")]
    assert len(lines) == 1 and lines[0].read_text().splitlines()[:3] == ["Projection # 1 - Tilt angle: -60.00", "Radius\ts(1/A)\tRes(A)\tNLOO2D", "0\t0.00000\t  100.000\t  1.0000"]
    back = results.read_nloo2d(spark, str(tmp_path / "curves" / "run=r")).collect()
    assert sorted((r["proj"] - 1, r["idx"], r["value"]) for r in back) == sorted((p, i, round(v, 4)) for _, p, _, i, _, _, v in rows)
    tilts = spark.createDataFrame([(0, -60.04), (1, -0.04), (2, 0.06), (3, 59.96)], "proj int, tilt double")
    results.write_tilt_angles(tilts, str(tmp_path / "tilts"))
    text = next(p for p in (tmp_path / "tilts").iterdir() if p.name.startswith("part")).read_text()
    assert [float(x) for x in text.split()] == [-60.0, 0.0, 0.1, 60.0]
    results.write_params(spark, {"cube_size": 45, "rt": 6}, str(tmp_path / "params"))
    assert results.use_params(spark, str(tmp_path / "params"), {"rt": 2, "snr": 0.5}) == {"cube_size": 45, "rt": 6, "snr": 0.5}


def test_results_written_as_text_and_by_run(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 4.5, 6.0, None, "3.3k", 11), (1.0, 2.0, 9.0, -1.0, 6.0, 0.5, "11k", 21)], "z double, x double, y double, res double, mean double, corr double, magnification string, num_ang int")
    results.write_results(rows, str(tmp_path / "FSC3D_text"), text=True)
    text = "".join(p.read_text() for p in (tmp_path / "FSC3D_text").iterdir() if p.name.startswith("part"))
    assert sorted(text.splitlines()) == ["1.0, 2.0, 3.0, 4.5, 6.0, nan", "1.0, 2.0, 9.0, -1.0, 6.0, 0.5"]
    keys = ["magnification", "num_ang"]
    results.write_results(rows, str(tmp_path / "table"))
    results.overwrite_runs(rows.filter("num_ang = 21").withColumn("res", F.lit(7.0)), str(tmp_path / "table"), keys)
    assert sorted((r["num_ang"], r["res"]) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [(11, 4.5), (21, 7.0)]


# --- files, sweeps, peaks ---------------------------------------------------------------------------------


def volume_file(path, cube):
    header = np.zeros(256, "<i4")
    header[:4] = (cube.shape[2], cube.shape[1], cube.shape[0], 2)
    path.write_bytes(header.tobytes() + cube.astype("<f4").tobytes())


def test_a_tile_reads_the_slabs_that_it_touches(spark, tmp_path):
    rng = np.random.default_rng(1)
    cubes = {n: rng.normal(size=(200, 6, 5)).astype("<f4") for n in ("a", "b")}
    for n, c in cubes.items():
        volume_file(tmp_path / f"{n}.mrc", c)
    paths = [f"{tmp_path}/{n}.mrc" for n in cubes]
    plan = spark.createDataFrame([(1, 1, paths[1], 18, 1, 0)], "tile long, side int, vol_id string, z int, x int, y int")
    bricks = mrc.read_bricks(spark, paths, brick=10, slab=10, plan=plan, size=4)
    assert bricks.rdd.getNumPartitions() == 2  # of 40
    part = {tuple(r["places"][:1]): np.reshape(r["values"], r["places"][3:]) for r in fourier.crop_bricks(bricks, plan, (10, 10, 10), (4, 4, 4)).collect()}
    assert np.array_equal(np.concatenate([part[0,], part[2,]]), cubes["b"][18:22, 1:5, 0:4])
    # the conditions reach the reader, and the bytes that it reads are those of two slabs
    reader = mrc.PruningReader({"paths": mrc.json.dumps(paths), "brick": "10", "slab": "10"})
    rest = list(reader.pushFilters([mrc.EqualTo(("vol_id",), paths[1]), mrc.In(("bz",), (1, 2)), mrc.GreaterThan(("nz",), 3)]))
    assert [f.attribute for f in rest] == [("nz",)]
    slabs, read, real = reader.partitions(), [], mrc._open

    class Counting:
        def __init__(self, path):
            self.inner = real(path)

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.inner.close()

        def seek(self, n):
            self.inner.seek(n)

        def read(self, n):
            read.append(n)
            return self.inner.read(n)

    mrc._open = Counting
    try:
        rows = [r for s in slabs for r in reader.read(s)]
    finally:
        mrc._open = real
    assert [(s.start, s.stop) for s in slabs] == [(10, 20), (20, 30)] and len(rows) == 2
    assert sum(n for n in read if n > 1024) <= 2 * 10 * 6 * 5 * 4 and sum(read) <= 2 * (10 * 6 * 5 * 4 + 2 * 1024)


def test_a_sweep_equals_single_runs(spark):
    from voxspark.schemas import BRICKS

    rng = np.random.default_rng(9)
    signal = np.cumsum(rng.normal(size=(24, 24, 24)), axis=0)
    a, b = (signal + rng.normal(size=signal.shape) for _ in range(2))
    bricks = spark.createDataFrame([*bricks_of("a", a, 10), *bricks_of("b", b, 10)], BRICKS)
    pairs = spark.createDataFrame([(1, "a", "b", 24, 24, 24)], "pair long, a string, b string, nz int, nx int, ny int")
    swept = spark.createDataFrame([(1, "cube_size", 11), (1, "cube_size", 16), (1, "cube_size", 90), (1, "apod", 2), (1, "apod", 5), (1, "rt", 2), (1, "rt", 4)], "pair long, param string, value int")
    plan = fourier.sweep_tiles(pairs, swept, cube=14, ring=6, apod=3)
    got = {r["tile"]: r for r in fourier.resolution_sweep(bricks, plan, (10, 10, 10), 2.0).collect()}
    assert len(got) == 7 and got["1|cube_size|90"]["status"] == "incomplete"
    for r in plan.filter("sz < 90").collect():
        tile = spark.createDataFrame([(1, "a", "b", r["z"], r["x"], r["y"])], "tile long, a string, b string, z int, x int, y int")
        one = fourier.resolution_measure(bricks, tile, (10, 10, 10), (r["sz"],) * 3, 2.0, ring=r["ring"], rad=r["rad"], ax=r["ax"]).first()
        mine = got[r["tile"]]
        assert [mine[c] for c in ("z", "x", "y", "status")] == [one[c] for c in ("z", "x", "y", "status")]
        assert all(mine[c] == pytest.approx(one[c]) for c in ("res", "mean", "corr"))


def greedy(values, radius):
    """The strongest first; what it beats is gone and beats nothing."""
    left, kept = sorted(values.items(), key=lambda p: (-p[1], p[0])), []
    for place, v in left:
        if all(sum((a - b) ** 2 for a, b in zip(place, k)) >= radius**2 for k, _ in kept):
            kept.append((place, v))
    return dict(kept)


def test_chains_of_peaks_keep_what_only_a_beaten_peak_beats(spark):
    rows = [(1, 5, 7, 9.0), (1, 5, 9, 8.0), (1, 5, 12, 7.0)]  # A beats B, B would beat C
    score = spark.createDataFrame(rows, "img int, px int, py int, v double")
    got = crossval.pick_peaks(score, ["img"], {"px": 40, "py": 40}, 4, F.lit(0.0))
    assert sorted((r["px"], r["py"]) for r in got.collect()) == [(5, 7), (5, 12)]
    rng = np.random.default_rng(2)
    for radius, tiled in ((3, 40), (5, 40)):
        grid = rng.permutation(1600).reshape(40, 40).astype(float)
        grid[10:14, 10:14] = 500.5  # ties
        score = spark.createDataFrame([(1, x, y, float(grid[x, y])) for x in range(40) for y in range(40)], "img int, px int, py int, v double")
        maxima = {}
        for x in range(40):
            for y in range(40):
                tx, ty = (x - radius) // radius, (y - radius) // radius
                if grid[x, y] > 50 and min(x, y) >= radius and radius + tx * radius < 40 - radius and radius + ty * radius < 40 - radius:
                    best = maxima.get((tx, ty))
                    if best is None or (-grid[x, y], (x, y)) < (-best[1], best[0]):
                        maxima[tx, ty] = ((x, y), grid[x, y])
        want = greedy(dict(maxima.values()), radius)
        got = {(r["px"], r["py"]): r["v"] for r in crossval.pick_peaks(score, ["img"], {"px": tiled, "py": tiled}, radius, F.lit(50.0)).collect()}
        assert got == want

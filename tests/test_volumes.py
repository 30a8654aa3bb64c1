"""Volumes of bricks against numpy on whole arrays, and what was wrong with boxes, views and references before."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.operators import beads, crossval, imageops, report, volumes
from voxspark.operators.volumes import Region

BRICKS = "vol_id long, bz long, bx long, by long, z0 long, x0 long, y0 long, nz long, nx long, ny long, data array<double>, series long"


def bricks_of(vol_id, cube, edges, series=0):
    out = []
    for z in range(0, cube.shape[0], edges[0]):
        for x in range(0, cube.shape[1], edges[1]):
            for y in range(0, cube.shape[2], edges[2]):
                part = cube[z : z + edges[0], x : x + edges[1], y : y + edges[2]]
                out.append((vol_id, z // edges[0], x // edges[1], y // edges[2], z, x, y, *part.shape, part.ravel().tolist(), series))
    return out


def as_volume(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["z0"] : r["z0"] + r["nz"], r["x0"] : r["x0"] + r["nx"], r["y0"] : r["y0"] + r["ny"]] = np.reshape(r["data"], (r["nz"], r["nx"], r["ny"]))
    return out


def whole_curve(a, b, region, wedge, count, bin_size, line, whole=True):
    """The even/odd curve of two arrays, as it is defined."""
    grid = np.meshgrid(*[np.arange(n) for n in a.shape], indexing="ij")
    distance = region.distance(*grid)
    inside = distance >= 0
    background = b[~inside].mean() if (~inside).any() else 0.0
    if line:
        slope, offset = np.polyfit(a[inside], b[inside], 1)
        a = offset + slope * a
    else:
        a = (a - a[inside].mean()) * b[inside].std() / a[inside].std() + b[inside].mean()
    width = region.edge_width()
    edge = np.where(distance < width, 0.5 - 0.5 * np.cos(np.pi * np.clip(distance, 0, None) / width), 1)
    f1, f2 = (np.fft.fftn(np.where(inside, (v - background) * edge + background, background)) for v in (a, b))
    k = np.meshgrid(*[np.fft.fftfreq(n, 1 / n) * max(a.shape) / n for n in a.shape], indexing="ij")
    r = np.sqrt(sum(x**2 for x in k))
    use = np.ones(a.shape, bool) if wedge is None else ~volumes.wedge_angles(*k, *wedge)
    out = {}
    for i in range(count):
        low, high = np.floor(r - bin_size / 2 + 1), np.floor(r + bin_size / 2)
        at = use & (np.floor(r) + 1 < count) & (np.where(r == 0, 0, low) <= i) & (i <= np.where(r == 0, 0, np.minimum(high, count - 1))) & ((i > 0) | (r == 0))
        if at.any():
            c = np.clip((f1 * np.conj(f2)).real[at].sum() / np.sqrt((np.abs(f1[at]) ** 2).sum() * (np.abs(f2[at]) ** 2).sum()), 0, 1)
            out[i] = 1.0 if i == 0 else 2 * c / (c + 1) if whole else c
    return out


@pytest.fixture(scope="module")
def halves():
    rng = np.random.default_rng(11)
    shape = (33, 54, 40)
    grid = np.meshgrid(*[np.arange(n) for n in shape], indexing="ij")
    signal = sum(np.sin(g / (2 + d)) for d, g in enumerate(grid)) * 3
    return signal + rng.normal(0, 1, shape), 2 * signal + rng.normal(5, 2, shape)


@pytest.mark.parametrize(
    ("region", "wedge", "bin_size", "rescale"),
    [
        (Region.whole((33, 54, 40)), None, 1.0, "stats"),
        (Region(start=(3, 5, 4), size=(25, 40, 31)), (-1.0, 1.0, 0.1), 1.0, "line"),
        (Region.largest_sphere((33, 54, 40)), (-0.9, 1.1, 0.0), 2.5, "stats"),
        (Region(start=(1, 1, 1), size=(31, 50, 37), inner=Region(centre=(16.0, 27.0, 20.0), radius=6.0)), None, 1.0, "line"),
    ],
)
def test_even_odd_curve_of_bricks_equals_numpy(spark, halves, region, wedge, bin_size, rescale):
    a, b = halves
    df = spark.createDataFrame(bricks_of(1, a, (16, 20, 17)) + bricks_of(2, b, (16, 20, 17)), BRICKS)
    pairs = spark.createDataFrame([(7, 1, 2)], "run long, a long, b long")
    count = 22
    rows = volumes.even_odd_curve(df, pairs, a.shape, region, wedge, bin_size=bin_size, count=count, rescale=rescale, block=16).collect()
    want = whole_curve(a, b, region, wedge, count, bin_size, rescale == "line")
    assert {r["run"] for r in rows} == {7}
    got = {r["idx"]: r["value"] for r in rows}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_transforms_of_bricks_equal_numpy(spark, halves):
    a, b = (v[:12, :15, :14] for v in halves)
    df = spark.createDataFrame(bricks_of(1, a, (5, 8, 14)) + bricks_of(2, b, (5, 8, 14)), BRICKS)
    f1, f2 = np.fft.fftn(a), np.fft.fftn(b)
    to = (6, 9, 8)
    rows = volumes.cropped_transforms(df, a.shape, to, block=4).filter("vol_id = 1").collect()
    got = {(r["kz"], r["kx"], r["ky"]): r["re"] + 1j * r["im"] for r in rows}
    assert set(got) == {(z, x, y) for z in range(-3, 3) for x in range(-4, 5) for y in range(0, 4)}
    assert all(abs(v - f1[k]) < 1e-8 for k, v in got.items())
    pairs = spark.createDataFrame([("p", 1, 2)], "run string, a long, b long")
    found = volumes.frequency_correlations(df, pairs, a.shape, block=5).collect()
    assert len(found) == 12 * 15 * 8
    for r in found[::37]:
        k = (r["kz"], r["kx"], r["ky"])
        assert r["c"] == pytest.approx(float(np.clip((f1[k] * np.conj(f2[k])).real / (abs(f1[k]) * abs(f2[k])), 0, 1)), abs=1e-9)


def test_volumes_that_lack_bricks_are_errors(spark, halves):
    a = halves[0][:8, :8, :8]
    pairs = spark.createDataFrame([(1, 1, 2)], "run long, a long, b long")
    df = spark.createDataFrame(bricks_of(1, a, (4, 4, 4)) + bricks_of(2, a, (4, 4, 4))[1:], BRICKS)
    with pytest.raises(Exception, match="voxels"):
        volumes.even_odd_curve(df, pairs, a.shape, Region.whole(a.shape)).collect()
    with pytest.raises(Exception, match="lacks neighbours"):
        volumes.bead_score_bricks(df, a.shape, (4, 4, 4), 2.0).collect()
    with pytest.raises(ValueError, match="fit"):
        volumes.even_odd_curve(df, pairs, a.shape, Region(centre=(4, 4, 4), radius=5.0))


@pytest.mark.parametrize(("shape", "edges", "diameter"), [((13, 20, 17), (5, 8, 6), 5.0), ((8, 8, 8), (4, 4, 4), 2.0), ((6, 9, 7), (6, 9, 7), 4.5), ((9, 9, 9), (2, 3, 2), 6.0)])
def test_bead_score_over_bricks_equals_one_transform(spark, shape, edges, diameter):
    rng = np.random.default_rng(5)
    cube = rng.normal(0, 0.2, shape)
    for centre in ((edges[0] - 1, edges[1], 1), (1, 1, shape[2] - 1)):  # beads on the borders of bricks and of the volume
        for z, x, y in volumes.ball_offsets(diameter * 0.8):
            cube[(centre[0] + z) % shape[0], (centre[1] + x) % shape[1], (centre[2] + y) % shape[2]] -= 3
    df = spark.createDataFrame(bricks_of(4, cube, edges), BRICKS)
    score = volumes.bead_score_bricks(df, shape, edges, diameter)
    got = as_volume(score.collect(), shape)
    one = crossval.bead_score(spark.createDataFrame([(4, cube.ravel().tolist())], "vol_id long, v array<double>"), "vol_id", "v", shape, diameter)
    whole = np.reshape(one.first()["score"], shape)
    if diameter < min(shape):  # else the ball overlaps itself, which one transform counts once
        assert np.allclose(got, whole, atol=1e-8)
    strong = {(r["z"], r["x"], r["y"]): r["v"] for r in volumes.strong_voxels(score, 1.5).collect()}
    want = np.argwhere(got > got.mean() + 1.5 * got.std())
    assert set(strong) == set(map(tuple, want.tolist())) and all(v == pytest.approx(got[k]) for k, v in strong.items())


@pytest.mark.parametrize(("shape", "edges"), [((13, 20, 17), (5, 8, 6)), ((8, 10, 12), (4, 4, 5))])
def test_bead_score_without_the_wedge_equals_one_transform(spark, shape, edges):
    rng = np.random.default_rng(15)
    cube = rng.normal(0, 1, shape)
    wedge = (-0.9, 1.0, 0.1)
    one = crossval.bead_score(spark.createDataFrame([(4, cube.ravel().tolist())], "vol_id long, v array<double>"), "vol_id", "v", shape, 3.5, wedge)
    got = as_volume(volumes.bead_score_wedge(spark.createDataFrame(bricks_of(4, cube, edges), BRICKS), shape, 3.5, wedge, block=6).collect(), shape)
    assert np.allclose(got, np.reshape(one.first()["score"], shape), atol=1e-9)


def test_projections_of_bricks_equal_those_of_voxels(spark):
    rng = np.random.default_rng(6)
    cube = rng.normal(0, 1, (9, 20, 14))
    views = crossval.tilt_views(spark.createDataFrame([(0, k, t, x) for k, (t, x) in enumerate(((0.0, 0.0), (33.0, 2.0), (-58.5, -7.0)))], "series long, proj int, tilt double, xtilt double"))
    df = spark.createDataFrame(bricks_of(3, cube, (4, 7, 5)), BRICKS)
    flat = spark.createDataFrame([(3, 0, *map(int, i), float(v)) for i, v in np.ndenumerate(cube) for i in [i]], "vol_id long, series long, z int, x int, y int, v double")
    region = Region(start=(1, 2, 1), size=(7, 15, 12))
    inside = crossval.inside_box([(F.col(a), F.lit(s), F.lit(n)) for a, s, n in zip("zxy", region.start, region.size)])
    for inside_, region_, exponent in ((inside, region, None), (None, None, (-3.0, 4.0))):
        want = crossval.reproject(flat, views, ["vol_id"], (9.5, 6.5, 4.0), (20, 14), inside_, 0.25, exponent).collect()
        got = volumes.project_bricks(df, views, (9.5, 6.5, 4.0), (20, 14), region_, 0.25, exponent, tile=6).collect()
        got = {(r["proj"], r["px"], r["py"]): r["v"] for r in got}
        assert set(got) == {(r["proj"], r["px"], r["py"]) for r in want} and all(got[r["proj"], r["px"], r["py"]] == pytest.approx(r["v"]) for r in want)


def test_projections_shuffle_a_piece_for_each_brick_and_view(spark):
    views = crossval.tilt_views(spark.createDataFrame([(0, k, 10.0 * k, 0.0) for k in range(3)], "series long, proj int, tilt double, xtilt double"))
    df = spark.createDataFrame(bricks_of(3, np.ones((8, 16, 16)), (4, 8, 8)), BRICKS)
    plan = volumes.project_bricks(df, views, (7.5, 7.5, 3.5), (16, 16))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInPandas") == 2 and "Window" not in plan


# --- boxes, views, rescaling, references --------------------------------------------------------------------


def test_equal_bead_numbers_in_two_volumes_are_two_boxes(spark):
    df = spark.createDataFrame(bricks_of(1, np.full((4, 4, 4), 1.0), (4, 4, 4)) + bricks_of(2, np.full((4, 4, 4), 2.0), (4, 4, 4)), BRICKS)
    boxes = spark.createDataFrame([(7, 1, 1, 1, 1), (7, 2, 1, 1, 1), (8, 2, 0, 0, 0)], "bead long, vol_id long, z0 long, x0 long, y0 long")
    got = {(r["bead"], r["vol_id"]): set(r["values"]) for r in beads.roi_arrays(df, boxes, (4, 4, 4), 2).collect()}
    assert got == {(7, 1): {1.0}, (7, 2): {2.0}, (8, 2): {2.0}}


def test_a_projected_frequency_comes_back_where_it_was(spark):
    triples = spark.createDataFrame([(1, kx, ky, 30.0, xt, *[1.0] * 6) for xt in (0.0, 5.0) for kx in range(-4, 4) for ky in range(-4, 4)], "run long, kx int, ky int, tilt double, xtilt double, re0 double, im0 double, re1 double, im1 double, re2 double, im2 double")
    tilted = crossval.tilt_views(triples)
    plain = crossval.nloo_volume(tilted.filter("xtilt = 0"), ["run"], (8, 8, 8)).collect()
    assert {(r["hx"], r["hz"]) for r in plain if r["hy"] == 0} >= {(2, -1), (-3, 2), (0, 0)} and not any(r["hx"] * r["hz"] > 0 for r in plain)
    one = crossval.tilt_views(spark.createDataFrame([(1, 4, 0, 30.0, 0.0, *[1.0] * 6)], triples.schema))
    assert [(r["hx"], r["hy"], r["hz"]) for r in crossval.nloo_volume(one, ["run"], (10, 10, 10)).collect()] == [(3, 0, -2)]
    # where a view sends a turned-back frequency is where it came from
    for r in tilted.collect():
        m = np.array([[r[f"m{i}{j}"] for j in range(3)] for i in range(3)])
        assert np.allclose(m @ (m.T @ [r["kx"], r["ky"], 0]), [r["kx"], r["ky"], 0])
    binned = crossval.nloo_volume(tilted.filter("xtilt = 5"), ["run"], (8, 8, 4), 2.0).collect()
    assert all(-2 <= r["hz"] <= 1 and -4 <= r["hx"] <= 3 for r in binned)


def test_rescaling_cuts_towards_zero_within_the_type(spark):
    df = spark.createDataFrame([(v,) for v in (-300.0, -2.7, -0.4, 0.6, 2.7, 400.0)], "v double")
    got = {k: [r[0] for r in df.select(crossval.rescale(F.col("v"), 1.0, 0.0, k)).collect()] for k in ("int8", "uint8", "float")}
    assert got == {"int8": [-128, -2, 0, 0, 2, 127], "uint8": [0, 0, 0, 0, 2, 255], "float": [-300.0, -2.7, -0.4, 0.6, 2.7, 400.0]}
    with pytest.raises(ValueError, match="voxel type"):
        crossval.rescale(F.col("v"), 1.0, 0.0, "byte")


def test_a_weighted_sum_is_divided_by_the_weights(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 2.0), (0, 3.0, 3.0), (1, 5.0, 0.0)], "p int, v double, w double")
    got = {r["p"]: r["v"] for r in imageops.weighted_sum(df, ["p"], "w").collect()}
    assert got == {0: pytest.approx(14 / 6), 1: None}


def test_shells_end_before_the_last(spark):
    df = spark.createDataFrame([(float(r),) for r in (0.0, 0.4, 0.6, 1.5, 2.2, 2.6, 3.0, 7.0)], "r double")
    assert [r[0] for r in df.select(crossval.physical_shells(F.col("r"), 1.0, 4)).collect()] == [[0], [], [1], [2], [2], [3], [], []]


def test_references_that_do_not_match_are_errors(spark):
    a = spark.createDataFrame([("t1", 1.0), ("t2", 2.0)], "name string, res double")
    b = spark.createDataFrame([("t1", 3.0), ("t3", 4.0)], "name string, res double")
    assert sorted(tuple(r) for r in report.unmatched_refs(a, b, ["name"]).collect()) == [("t2", "a"), ("t3", "b")]
    with pytest.raises(Exception, match="only one reference"):
        report.average_refs(a, b, ["name"], ["res"]).collect()
    assert [tuple(r) for r in report.average_refs(a.filter("name = 't1'"), b.filter("name = 't1'"), ["name"], ["res"]).collect()] == [("t1", 2.0)]


def test_regions():
    grid = np.meshgrid(*[np.arange(6)] * 3, indexing="ij")
    box = Region(start=(1, 1, 1), size=(4, 4, 4), inner=Region(centre=(2.5, 2.5, 2.5), radius=1.0))
    d = box.distance(*grid)
    assert d[1, 1, 1] == 0 and d[0, 3, 3] < 0 and d[2, 2, 2] < 0 and d[2, 2, 1] == 0
    assert Region.largest_sphere((8, 10, 12)).radius == 3 and Region.largest_sphere((8, 10, 12)).check((8, 10, 12))
    assert (Region.whole((6, 6, 6)).distance(*grid) >= 0).all()
    assert math.isclose(Region(centre=(3, 3, 3), radius=2.0).edge_width(), crossval.taper_size((2.0,), radius=True))


# --- footprints of views -----------------------------------------------------------------------------------


@pytest.mark.parametrize("sphere", [False, True])
def test_footprints_are_the_shadows_of_their_regions(spark, sphere):
    shape, centre = (20, 18), (9.5, 8.5, 7.0)
    views = crossval.tilt_views(spark.createDataFrame([(0, k, t, x) for k, (t, x) in enumerate(((0.0, 0.0), (41.0, 3.0), (-60.0, -8.0)))], "series long, proj int, tilt double, xtilt double"))
    given = {"middle": (9.0, 9.0, 7.0), "radius": 5.0} if sphere else {"start": (4.0, 5.0, 3.0), "size": (9.0, 7.0, 6.0)}
    seen = crossval.view_regions(views, centre, **given)
    pixels = crossval.sphere_footprint(views, given["middle"], 5.0, centre, shape) if sphere else crossval.box_footprint(views, given["start"], given["size"], centre, shape)
    want = {}
    for r in pixels.collect():
        low, high = want.get((r["proj"], r["py"]), (99, -1))
        want[r["proj"], r["py"]] = (min(low, r["px"]), max(high, r["px"]))
    got = {(r["proj"], r["py"]): (r["first"], r["last"]) for r in crossval.footprint_spans(seen, shape).collect()}
    assert got == want
    for r in seen.collect():  # distances are those to the lines about the shadow
        d, width = crossval.footprint_distance(r["region"].asDict(), shape)
        assert width > 0 and {(r["proj"], y) for x, y in np.argwhere(d >= -1e-6)} == {k for k in want if k[0] == r["proj"]}


def test_cross_validation_by_view_equals_numpy(spark):
    rng = np.random.default_rng(8)
    shape = (12, 10)
    base = rng.normal(size=shape)
    rows = [(p, *[(base * (k + 1) + rng.normal(0, 0.3, shape) + k).ravel().tolist() for k in range(3)], float(t), 0.0) for p, t in enumerate((-50.0, 0.0, 35.0))]
    df = spark.createDataFrame(rows, "proj long, input array<double>, miss array<double>, full array<double>, tilt double, xtilt double")
    seen = crossval.view_regions(crossval.tilt_views(df), (5.5, 4.5, 4.0), start=(2.0, 2.0, 1.0), size=(7.0, 6.0, 6.0))
    regions = {r["proj"]: r["region"].asDict() for r in seen.collect()}
    r = np.hypot(*np.meshgrid(np.fft.fftfreq(12, 1 / 12), np.fft.fftfreq(10, 1 / 10) * 1.2, indexing="ij"))
    for rescale, taper in (("stats", False), ("line", True)):
        got = {(x["proj"], x["idx"]): [x[c] for c in ("cm", "mm", "cf", "ff")] for x in crossval.cross_validate_views(seen, shape, rescale, taper, count=7).collect()}
        masks = set()
        for p, *images, _, _ in rows:
            distance, width = crossval.footprint_distance(regions[p], shape)
            inside = distance >= -1e-6
            masks.add(inside.sum())
            images = [np.reshape(v, shape) for v in images]
            background, made = images[2][~inside].mean(), []
            for k, v in enumerate(images):
                if k < 2:
                    a, b = np.polyfit(v[inside], images[2][inside], 1) if rescale == "line" else (images[2][inside].std() / v[inside].std(), None)
                    v = a * v + b if rescale == "line" else (v - v[inside].mean()) * a + images[2][inside].mean()
                if taper:
                    edge = 0.5 * width * crossval.TAPER_SHARE
                    v = background + (v - background) * np.where(distance < edge, 0.5 - 0.5 * np.cos(np.pi * np.clip(distance, 0, None) / edge), 1)
                made.append(np.fft.fft2(np.where(inside, v, background)))
            for i in range(7):
                at = (np.floor(r + 0.5) == i) & (np.floor(r) + 1 < 7)
                if at.any():
                    want = [(made[0] * np.conj(made[1])).real[at].sum(), (abs(made[1]) ** 2)[at].sum(), (made[0] * np.conj(made[2])).real[at].sum(), (abs(made[2]) ** 2)[at].sum()]
                    assert got[p, i] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert len(masks) > 1  # views differ in their masks

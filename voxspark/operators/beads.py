"""Point-source resolution: boxes about beads, axis profiles, Gaussian fits, quality filters, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FWHM_PER_SIGMA, deconvolve, finite, gaussian, parse_recon_label, trim_nan
from ..plans.grids import roi_plan
from .fourier import assemble, crop_bricks

KEYS = ("tomogram", "recon", "bead")


def roi_arrays(bricks: DataFrame, boxes: DataFrame, edges: tuple[int, int, int], size: int) -> DataFrame:
    """``bead, vol_id, values`` (row-major, z first) of the box of ``size`` voxels at ``z0, x0, y0`` of each row of
    ``boxes`` (bead, vol_id, ...). Places outside the volume are NaN; beads keep their ids.

    A box is known by its bead and its volume together: bead numbers start anew in each tomogram, and each
    reconstruction of it is a volume of its own. Boxes meet bricks by number (``fourier.crop_bricks``), so only voxels
    of boxes are shuffled.
    """
    plan = boxes.select(F.col("bead").alias("tile"), F.lit(1).alias("side"), "vol_id", *[F.col(f"{a}0").alias(a) for a in "zxy"])
    parts = crop_bricks(bricks, plan, edges, (size,) * 3).groupBy("vol_id", "tile").agg(F.collect_list(F.struct("side", "places", "values")).alias("parts"))
    placed = boxes.select("vol_id", F.col("bead").alias("tile")).join(parts, ["vol_id", "tile"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cubes = [assemble(p if p is not None else [], (size,) * 3, 1)[0].ravel() for p in frame["parts"]]
            yield pd.DataFrame({"bead": frame["tile"], "vol_id": frame["vol_id"], "values": cubes})

    ids = {f.name: f.dataType.simpleString() for f in boxes.select("bead", "vol_id").schema}
    return placed.mapInPandas(run, f"bead {ids['bead']}, vol_id {ids['vol_id']}, values array<float>")


def roi_voxels(boxes: DataFrame, size: int) -> DataFrame:
    """``dz, dx, dy, v`` of the rows of ``roi_arrays``; null in place of NaN."""
    flat = boxes.select("bead", "vol_id", F.posexplode("values").alias("i", "v"))
    place = [(F.floor(F.col("i") / size**k) % size).cast("int").alias(f"d{a}") for a, k in zip("zxy", (2, 1, 0))]
    return flat.select("bead", "vol_id", *place, F.when(~F.isnan("v"), F.col("v").cast("double")).alias("v"))


def plan_all_recons(config: DataFrame, points: DataFrame, size: int, mode: str = "pad") -> DataFrame:
    """A box for each point and each reconstruction label of its tomogram, in one plan.

    ``config``: tomogram, recon_labels; ``points``: tomogram, bead_id, x, y, z, nx, ny, nz. ``order`` is the label's place.
    """
    labels = config.select("tomogram", F.posexplode("recon_labels").alias("order", "recon_label"))
    return roi_plan(points.join(labels, "tomogram"), size, mode)


def centre_profiles(roi: DataFrame, by: Sequence[str], size: int, linewidth: int = 1, exact: bool = False) -> DataFrame:
    """``axis, samples``: values along each axis through index ``size // 2``, averaged over ``linewidth``.

    The plain form takes the centre +- linewidth // 2, so that 2 gives three voxels; ``exact`` takes just ``linewidth``
    voxels, more of them below the centre where that is even. A NaN spreads to its mean.
    """
    c = size // 2
    low, high = (c - linewidth // 2, c - linewidth // 2 + linewidth - 1) if exact else (c - linewidth // 2, c + linewidth // 2)
    if linewidth <= 1:
        low = high = c
    parts = []
    for axis in "xyz":
        others = [a for a in "xyz" if a != axis]
        near = F.lit(True)
        for o in others:
            near = near & F.col(f"d{o}").between(low, high)
        mean = roi.filter(near).groupBy(*by, F.col(f"d{axis}").alias("i")).agg(F.avg("v").alias("v"))
        parts.append(mean.withColumn("axis", F.lit(axis)))
    flat = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    return flat.groupBy(*by, "axis").agg(ordered.alias("samples"))


# --- fits -------------------------------------------------------------------------------------------


def guess(samples: Column) -> Column:
    """Amplitude max - min, centre at the minimum, sigma 3, offset max."""
    low, high = F.array_min(samples), F.array_max(samples)
    return F.struct((high - low).alias("amplitude"), (F.array_position(samples, low) - 1).cast("double").alias("centre"), F.lit(3.0).alias("sigma"), high.alias("offset"))


def fit_batch(y: np.ndarray, most: int = 100, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares Gaussians of the rows of ``y`` (NaN: no sample): parameters (amplitude, centre, sigma, offset)
    and whether each converged. Levenberg-Marquardt for all rows at once; amplitude and offset start as the best for
    a centre at the minimum and a sigma of 3, which also gives the sign."""
    n, m = y.shape
    x = np.arange(m, dtype=float)[None, :]
    seen = np.isfinite(y)
    values = np.where(seen, y, 0.0)
    enough = seen.sum(axis=1) >= 5
    centre = np.where(seen, y, np.inf).argmin(axis=1).astype(float)
    p = np.stack([np.zeros(n), centre, np.full(n, 3.0), np.zeros(n)], axis=1)
    g = np.exp(-((x - p[:, 1:2]) ** 2) / 18.0) * seen
    k, sg, sy = seen.sum(axis=1), g.sum(axis=1), values.sum(axis=1)
    det = k * (g * g).sum(axis=1) - sg**2
    det = np.where(np.abs(det) < 1e-300, 1.0, det)
    p[:, 0] = (k * (g * values).sum(axis=1) - sg * sy) / det
    p[:, 3] = (sy - p[:, 0] * sg) / np.maximum(k, 1)

    def model(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = x - q[:, 1:2]
        e = np.exp(-(d**2) / (2 * q[:, 2:3] ** 2)) * seen
        jac = np.stack([e, q[:, 0:1] * e * d / q[:, 2:3] ** 2, q[:, 0:1] * e * d**2 / q[:, 2:3] ** 3, seen.astype(float)], axis=2)
        return values - (q[:, 0:1] * e + q[:, 3:4] * seen), jac

    damping, done = np.full(n, 1e-3), ~enough
    rest, jac = model(p)
    cost = (rest**2).sum(axis=1)
    for _ in range(most):
        if done.all():
            break
        a = np.einsum("nmi,nmj->nij", jac, jac)
        b = np.einsum("nmi,nm->ni", jac, rest)
        diagonal = np.maximum(np.einsum("nii->ni", a), 1e-12)
        step = np.linalg.solve(a + (damping[:, None] * diagonal)[:, :, None] * np.eye(4), b[:, :, None])[:, :, 0]
        trial = p + np.where(done[:, None], 0, step)
        trial[:, 2] = np.where(np.abs(trial[:, 2]) < 1e-3, 1e-3, trial[:, 2])
        new_rest, new_jac = model(trial)
        new_cost = (new_rest**2).sum(axis=1)
        better = (new_cost <= cost) & np.isfinite(new_cost) & ~done
        small = np.abs(step).max(axis=1) <= tolerance * (np.abs(p).max(axis=1) + tolerance) + 1e-13
        flat = better & (cost - new_cost <= tolerance * np.maximum(cost, 1e-30)) & (np.abs(step).max(axis=1) < 1e-7)
        p[better], rest[better], jac[better] = trial[better], new_rest[better], new_jac[better]
        cost = np.where(better, new_cost, cost)
        damping = np.where(better, np.maximum(damping / 10, 1e-12), np.minimum(damping * 10, 1e12))
        done = done | small | flat | (damping >= 1e12) | (cost < 1e-24)
    good = enough & done & np.isfinite(p).all(axis=1)
    return p, good


def fit_gaussians(profiles: DataFrame, by: Sequence[str], samples: str = "samples") -> DataFrame:
    """``amplitude, centre, sigma, offset, r2`` for each row of ``profiles``; null where a fit fails.

    Rows go to Python in Arrow batches and are fitted together by length; sigma is positive.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in profiles.select(*by).schema) + ", amplitude double, centre double, sigma double, offset double, r2 double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [np.array([np.nan if v is None else v for v in s], dtype=float) if s is not None else np.zeros(0) for s in frame[samples]]
            width = max([5, *map(len, lists)])
            y = np.full((len(lists), width), np.nan)
            for i, s in enumerate(lists):
                y[i, : len(s)] = s
            p, good = fit_batch(y) if len(lists) else (np.zeros((0, 4)), np.zeros(0, bool))
            x = np.arange(width)[None, :]
            fitted = p[:, 0:1] * np.exp(-((x - p[:, 1:2]) ** 2) / (2 * p[:, 2:3] ** 2)) + p[:, 3:4]
            seen = np.isfinite(y)
            count = np.maximum(seen.sum(axis=1), 1)
            mean = np.where(seen, y, 0).sum(axis=1) / count
            total = np.where(seen, (y - mean[:, None]) ** 2, 0).sum(axis=1)
            left = np.where(seen, (y - fitted) ** 2, 0).sum(axis=1)
            r2 = np.where(total > 0, 1 - left / np.where(total > 0, total, 1), np.nan)
            out = frame[list(by)].reset_index(drop=True)
            for name, value in (("amplitude", p[:, 0]), ("centre", p[:, 1]), ("sigma", np.abs(p[:, 2])), ("offset", p[:, 3]), ("r2", r2)):
                out[name] = pd.array([v if g and np.isfinite(v) else None for v, g in zip(value, good)], dtype="Float64")
            yield out

    return profiles.select(*by, samples).mapInPandas(run, schema)


def fwhm(sigma: Column) -> Column:
    return FWHM_PER_SIGMA * F.abs(sigma)


# --- quality ----------------------------------------------------------------------------------------


def keep_good(fits: DataFrame, cutoff: float, axes: Sequence[str] = ("x", "z")) -> DataFrame:
    """Beads, a row for each with ``r2_<axis>`` columns, whose fits along ``axes`` reach the cutoff."""
    good = F.lit(True)
    for a in axes:
        good = good & (F.coalesce(F.col(f"r2_{a}"), F.lit(-1.0)) >= cutoff)
    return fits.filter(good)


def skip_beads(fits: DataFrame, cutoff: float, axes: Sequence[str] = ("x", "z"), recons: DataFrame | None = None) -> DataFrame:
    """``tomogram, bead`` of beads that fail along one of ``axes`` in some reconstruction, or lack one.

    ``recons`` (tomogram, wanted): how many reconstructions there should be; by default those that ``fits`` has.
    """
    judged = fits.groupBy("tomogram", "bead").agg(F.bool_or(_fails(cutoff, axes)).alias("bad"), F.count_distinct("recon").alias("n"))
    if recons is None:
        recons = fits.groupBy("tomogram").agg(F.count_distinct("recon").alias("wanted"))
    return judged.join(recons, "tomogram").filter(F.col("bad") | (F.col("n") < F.col("wanted"))).select("tomogram", "bead")


def _fails(cutoff: float, axes: Sequence[str]) -> Column:
    bad = F.lit(False)
    for a in axes:
        bad = bad | ~(F.coalesce(finite(F.col(f"r2_{a}")), F.lit(-1.0)) >= cutoff)
    return bad


def exclude(df: DataFrame, skip: DataFrame) -> DataFrame:
    return df.join(skip.select("tomogram", "bead").distinct(), ["tomogram", "bead"], "left_anti")


def by_axis(fits: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each bead, with ``<value>_<axis>`` columns."""
    return fits.groupBy(*by).agg(*[F.max(F.when(F.col("axis") == a, F.col(v))).alias(f"{v}_{a}") for v in values for a in "xyz"])


def fit_beads(roi: DataFrame, by: Sequence[str], size: int, linewidth: int = 1, exact: bool = False, diameter_nm: float = 0.0, pixel_nm: Column | None = None) -> DataFrame:
    """``fwhm_<axis>, r2_<axis>`` of the beads of ``roi`` (by..., dz, dx, dy, v): profiles through the centre, trimmed, fitted.

    A profile of fewer than seven samples, or a fit that fails, gives null. With a diameter, widths are in nm and
    without its top hat; ``pixel_nm`` is then a column of ``by``.
    """
    profiles = centre_profiles(roi, by, size, linewidth, exact).withColumn("samples", trim_nan(F.col("samples")))
    fits = fit_gaussians(profiles, [*by, "axis"])
    width = fwhm(F.col("sigma")) if not diameter_nm else deconvolve(fwhm(F.col("sigma")), F.lit(float(diameter_nm)), pixel_nm)
    return by_axis(fits.withColumn("fwhm", width), by, ["fwhm", "r2"])


def linewidth_scan(roi: DataFrame, by: Sequence[str], size: int, widths: Sequence[int]) -> DataFrame:
    """``fit_beads`` for each of ``widths``, a few numbers."""
    parts = [fit_beads(roi, by, size, w, exact=True).withColumn("linewidth", F.lit(w)) for w in widths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


BEAD_TABLE = ("tomogram", "thickness", "pxl_size", "recon_label", "num_proj", "max_angle", "bead_id", "n_beads_total", "n_beads_pass", "fwhm_x", "fwhm_y", "fwhm_z", "res_nm_x", "res_nm_y", "res_nm_z")


def bead_table(config: DataFrame, fits: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """The tidy table of kept beads, a row for each reconstruction: the columns of ``BEAD_TABLE``.

    ``config``: tomogram, thickness, pxl_size, recon_labels; ``fits``: tomogram, recon (label), bead, fwhm_<axis>,
    r2_<axis>, a row for each. A bead goes from all reconstructions if X or Z fails in one, or one lacks it. The
    total counts the beads of the first label. The flag is a window over a bead's rows: one pass over ``fits``.
    """
    head = config.select("tomogram", "thickness", "pxl_size", F.get("recon_labels", F.lit(0)).alias("first"), F.size("recon_labels").alias("wanted"))
    bead = Window.partitionBy("tomogram", "bead")
    flagged = fits.join(head, "tomogram").withColumn("fails", F.bool_or(_fails(cutoff, ("x", "z"))).over(bead) | (F.count(F.lit(1)).over(bead) < F.col("wanted")))
    lead = F.col("recon") == F.col("first")
    counts = flagged.groupBy("tomogram").agg(F.count_if(lead).alias("n_beads_total"), F.count_if(lead & ~F.col("fails")).alias("n_beads_pass"))
    num, angle = parse_recon_label(F.col("recon"))
    kept = flagged.filter(~F.col("fails")).join(counts, "tomogram").withColumns({"recon_label": F.col("recon"), "num_proj": num, "max_angle": angle, "bead_id": F.col("bead")})
    return kept.withColumns({f"res_nm_{a}": finite(F.col(f"fwhm_{a}")) * finite(F.col("pxl_size")) for a in "xyz"}).select(*BEAD_TABLE)


def fit_grid(profiles: DataFrame, skip: DataFrame) -> DataFrame:
    """``bead, i, value, fit`` of the profiles (bead, samples) of beads that are not in ``skip``: samples and fitted curve."""
    kept = profiles.select("bead", "samples").join(skip.select("bead").distinct(), "bead", "left_anti")
    both = kept.join(fit_gaussians(kept, ["bead"]), "bead")
    curve = gaussian(F.col("i").cast("double"), *[F.col(c) for c in ("amplitude", "centre", "sigma", "offset")])
    flat = both.select("bead", "amplitude", "centre", "sigma", "offset", F.posexplode("samples").alias("i", "value"))
    return flat.select("bead", "i", "value", curve.alias("fit"))


def count_mismatch(beads: DataFrame) -> DataFrame:
    """Tomograms whose reconstructions differ in their number of beads."""
    n = beads.groupBy("tomogram", "recon").agg(F.count_distinct("bead").alias("n"))
    return n.groupBy("tomogram").agg(F.min("n").alias("least"), F.max("n").alias("most")).filter("least < most")


# --- views, outliers, summaries -----------------------------------------------------------------------


def mid_planes(roi: DataFrame, size: int) -> DataFrame:
    """``plane, row, col, v`` of the planes through the middle: XY, YZ and ZX."""
    c = size // 2
    plane = lambda name, fixed, row, col: roi.filter(F.col(fixed) == c).select("bead", F.lit(name).alias("plane"), F.col(row).alias("row"), F.col(col).alias("col"), "v")
    return plane("xy", "dz", "dx", "dy").unionByName(plane("yz", "dx", "dy", "dz")).unionByName(plane("zx", "dy", "dz", "dx"))


def rot90(view: DataFrame, size: int) -> DataFrame:
    """A quarter turn against the clock."""
    return view.withColumn("row_", F.col("col")).withColumn("col", F.col("row")).withColumn("row", size - 1 - F.col("row_")).drop("row_")


def views_across_recons(roi: DataFrame, by: Sequence[str], size: int, side: str = "YZ", rotate_xy: bool = True, rotate_side: bool = True) -> DataFrame:
    """``by..., panel, row, col, v``: for each bead and reconstruction the XY plane (rows y, columns x) and one ``SIDE`` plane.

    ``side`` is YZ (rows x, columns z, through the middle y) or XZ (rows y, columns z, through the middle x), as the plots
    name them; either is turned by a quarter against the clock where asked.
    """
    if side not in ("YZ", "XZ"):
        raise ValueError("side is YZ or XZ")
    fixed, row = ("dy", "dx") if side == "YZ" else ("dx", "dy")
    c = size // 2
    out = []
    for name, at, r, col, turn in (("XY", "dz", "dy", "dx", rotate_xy), ("SIDE", fixed, row, "dz", rotate_side)):
        view = roi.filter(F.col(at) == c).select(*by, F.lit(name).alias("panel"), F.col(r).alias("row"), F.col(col).alias("col"), "v")
        out.append(rot90(view, size).select(*view.columns) if turn else view)
    return out[0].unionByName(out[1])


def contrast(view: DataFrame, by: Sequence[str], low: float, high: float) -> DataFrame:
    """Percentiles of the values that are numbers."""
    v = finite(F.col("v"))
    return view.groupBy(*by).agg(F.percentile(v, low / 100).alias("low"), F.percentile(v, high / 100).alias("high"))


def profile_traces(profiles: DataFrame, by: Sequence[str], order: str, step: float = 0.2) -> DataFrame:
    """Samples scaled to 0..1 for each profile, and lifted by ``step`` for each reconstruction."""
    low, high = F.array_min("samples"), F.array_max("samples")
    flat = profiles.withColumn("lift", (F.dense_rank().over(Window.partitionBy(*by).orderBy(order)) - 1) * step)
    scaled = F.transform("samples", lambda v: F.try_divide(v - low, high - low) + F.col("lift"))
    return flat.withColumn("traces", scaled)


def dense_fit(fits: DataFrame, points: int, span: float) -> DataFrame:
    """The fitted curve at ``points`` places from 0 to ``span``."""
    placed = fits.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("k") * (span / (points - 1)))
    return placed.withColumn("value", gaussian(F.col("at"), F.col("amplitude"), F.col("centre"), F.col("sigma"), F.col("offset")))


def sigma_outliers(values: DataFrame, by: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Rows beyond ``k`` population deviations from the mean of their group, NaN aside."""
    c = finite(F.col(value))
    stats = values.groupBy(*by).agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("sd"))
    return values.join(stats, list(by)).filter(F.abs(c - F.col("m")) > k * F.col("sd")).drop("m", "sd")


def joint_outliers(fits: DataFrame, columns: Sequence[str], most: float) -> DataFrame:
    """Rows whose columns are all finite, positive and at most ``most``."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.coalesce((finite(F.col(c)) > 0) & (finite(F.col(c)) <= most), F.lit(False))
    return fits.filter(keep)


def value_range(values: DataFrame, low: float, high: float) -> DataFrame:
    """Rows whose ``value`` lies within; beads keep their ids, so axes stay aligned."""
    return values.filter(F.col("value").between(low, high))


def zx_ratio(fits: DataFrame) -> DataFrame:
    return fits.withColumn("zx", F.when(F.col("fwhm_x") > 0, F.col("fwhm_z") / F.col("fwhm_x")))


def drop_empty(values: DataFrame, by: str, axes: int = 3) -> DataFrame:
    """Rows of the groups that have values on all axes."""
    full = values.filter(F.col("value").isNotNull()).groupBy(by).agg(F.count_distinct("axis").alias("n")).filter(F.col("n") == axes)
    return values.join(full, by, "left_semi")


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    c = finite(F.col(value))
    return df.groupBy(*by).agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count(c).alias("n"))


def group_by_name(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows with each group of ``names`` (grp, part) one of whose parts their name contains, once for each group.

    ``names`` is written by hand; each row is matched with the whole list, held as one array.
    """
    lists = names.groupBy("grp").agg(F.collect_set("part").alias("parts"))
    held = lists.agg(F.collect_list(F.struct("grp", "parts")).alias("groups"))
    return df.crossJoin(F.broadcast(held)).withColumn("g", F.explode("groups")).filter(F.exists("g.parts", lambda p: F.contains(F.col(column), p))).withColumn("grp", F.col("g.grp")).drop("g", "groups")


def ratio_stats(df: DataFrame, by: Sequence[str], top: str, bottom: str, clip: float) -> DataFrame:
    """Mean and deviation of a ratio over rows where both are numbers below ``clip`` and the bottom is above 0.1."""
    t, b = finite(F.col(top)), finite(F.col(bottom))
    kept = df.filter((b > 0.1) & (t < clip) & (b < clip))
    return kept.groupBy(*by).agg(F.avg(t / b).alias("mean"), F.stddev_pop(t / b).alias("std"), F.count(F.lit(1)).alias("n"))


def trend(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Line through the finite pairs; null with two or fewer."""
    a, b = finite(F.col(x)), finite(F.col(y))
    both = a.isNotNull() & b.isNotNull()
    fit = df.filter(both).groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))
    return fit.select(*by, *[F.when(F.col("n") > 2, F.col(c)).alias(c) for c in ("slope", "intercept")], "n")


def histogram(df: DataFrame, by: Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts in equal bins from the group's least to its largest value, the last one closed."""
    c = F.col(value)
    edges = df.groupBy(*by).agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    place = F.least(F.floor(F.try_divide(c - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return df.join(edges, list(by)).groupBy(*by, F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

"""Cross-validation resolution, tilt curves, regions, projections and peaks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settle import settled
from .fourier import fft_arrays, frequencies


def best_shift(pairs: DataFrame, by: str, shape: tuple[int, ...], band: tuple[float, float] | None = None, mask: np.ndarray | None = None, within: float | None = None, refine: bool = False) -> DataFrame:
    """``by, shift, peak``: the shift, wrapped to half the size, at which ``v2`` fits ``v1`` best.

    ``pairs`` has row-major arrays ``v1, v2``; with the same array twice this is the auto-correlation. The product
    of the transforms gives all shifts of a pair in one kernel call. ``band``: least and largest length of the
    frequencies that count, ``mask``: frequencies that count, in centred order; ``within``: the largest shift. ``refine`` fits a quadratic
    (constant, and a slope and a curvature for each axis) to the values within five voxels of the peak and takes
    its top where that lies within two of the peak.
    """
    keep = np.ones(shape, bool) if mask is None else np.asarray(mask, bool).reshape(shape)
    axes = np.meshgrid(*[np.arange(n) - n // 2 for n in shape], indexing="ij")
    if band is not None:
        length = np.sqrt(sum(a.astype(float) ** 2 for a in axes))
        keep = keep & (length >= band[0]) & (length <= band[1])
    near = np.ones(shape, bool) if within is None else sum(a.astype(float) ** 2 for a in axes) <= within**2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, one, two in zip(frame[by], frame["v1"], frame["v2"]):
                f1, f2 = (np.fft.fftn(np.asarray(v, np.float64).reshape(shape)) for v in (one, two))
                map_ = np.fft.fftshift(np.fft.ifftn(np.conj(f1) * f2 * np.fft.ifftshift(keep)).real)
                best = np.unravel_index(np.where(near, map_, -np.inf).argmax(), shape)
                shift = [float(b - n // 2) for b, n in zip(best, shape)]
                out.append((key, refined(map_, best, shift) if refine else shift, float(map_[best])))
            yield pd.DataFrame(out, columns=[by, "shift", "peak"])

    return pairs.select(by, "v1", "v2").mapInPandas(run, f"{by} long, shift array<double>, peak double")


def refined(map_: np.ndarray, best: Sequence[int], shift: list[float], reach: int = 5, most: float = 2.0) -> list[float]:
    """The top of the quadratic through the values about a peak; along an axis where that is too far away, the peak."""
    offsets = np.stack(np.meshgrid(*[np.arange(-min(reach, n // 2), min(reach, (n - 1) // 2) + 1) for n in map_.shape], indexing="ij"), axis=-1).reshape(-1, map_.ndim).astype(float)
    values = map_[tuple(((offsets + np.array(best)) % np.array(map_.shape)).astype(int).T)]
    terms = np.concatenate([np.ones((len(offsets), 1)), offsets, offsets**2], axis=1)
    fit, *_ = np.linalg.lstsq(terms, values, rcond=None)
    slope, bend = fit[1 : 1 + map_.ndim], fit[1 + map_.ndim :]
    move = np.where(bend != 0, -slope / (2 * np.where(bend != 0, bend, 1.0)), 0.0)
    return [a + float(m) if abs(m) <= most else a for a, m in zip(shift, move)]


# --- curves -----------------------------------------------------------------------------------------


def axis_dim(size: Column, unit: Column, resolution: Column) -> tuple[Column, Column]:
    """(resolution within 2 units and half the extent, number of shells ``int(2 + extent / resolution)``)."""
    extent = size * unit
    held = F.least(F.greatest(resolution, 2 * unit), extent / 2)
    return held, (F.lit(2) + extent / held).cast("int")


def physical_shells(radius: Column, bin_size: float, count: Column | int | None = None, alone: bool = True) -> Column:
    """Shells that a frequency at ``radius`` adds to: int(r - d + 1) to int(r + d) with d half the bin; where it is to stand
    ``alone``, the origin only to shell 0, and nothing else to that.

    Of ``count`` shells (``axis_dim``) the last takes no points of its own: those from int(r) = count - 1 on add to none.
    """
    d = bin_size / 2
    low, high = (radius - d + 1).cast("int"), (radius + d).cast("int")
    low = F.greatest(low, F.lit(int(alone)))
    none = F.array().cast("array<int>")
    if count is not None:
        limit = F.lit(count) if isinstance(count, int) else count
        high = F.least(high, (limit - 1).cast("int"))
    found = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(none)
    if alone:
        found = F.when(radius == 0, F.array(F.lit(0))).otherwise(found)
    return found if count is None else F.when(radius.cast("int") + 1 < limit, found).otherwise(none)


def fsc_physical(pairs: DataFrame, by: Sequence[str], radius: Column, bin_size: float = 1.0, even_odd: bool = False, count: Column | int | None = None) -> DataFrame:
    """``idx, value``: correlation by physical frequency in ``count`` shells, clipped to 0..1 and 1 at the origin; ``even_odd``
    turns half-data correlation into that of the whole, 2 c / (c + 1)."""
    exact = pairs.withColumn("shells", physical_shells(radius, bin_size, count)).groupBy(*by, "shells").agg(
        F.sum(F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2")).alias("c"),
        F.sum(F.col("re1") * F.col("re1") + F.col("im1") * F.col("im1")).alias("c1"),
        F.sum(F.col("re2") * F.col("re2") + F.col("im2") * F.col("im2")).alias("c2"),
    )
    return shell_correlation(exact.withColumn("idx", F.explode("shells")), by, even_odd)


def shell_correlation(sums: DataFrame, by: Sequence[str], even_odd: bool = False) -> DataFrame:
    """``idx, value`` of ``fsc_physical`` from sums ``idx, c, c1, c2`` in parts."""
    sums = sums.groupBy(*by, "idx").agg(F.sum("c").alias("c"), F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    value = F.greatest(F.least(F.coalesce(F.try_divide("c", F.sqrt(F.col("c1") * F.col("c2"))), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    if even_odd:
        value = 2 * value / (value + 1)
    return sums.select(*by, "idx", F.when(F.col("idx") == 0, 1.0).otherwise(value).alias("value"))


def last_crossings(curve: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """For each threshold, up to the first that is not positive, the resolution at the last downward crossing
    of ``value`` along ``idx``, interpolated in ``s``; 0 without one."""
    kept = []
    for t in thresholds[:3]:
        if t <= 0:
            break
        kept.append(float(t))
    window = Window.partitionBy(*by).orderBy("idx")
    steps = curve.withColumn("value0", F.lag("value").over(window)).withColumn("s0", F.lag("s").over(window))
    each = steps.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in kept])))
    down = (F.col("value0") >= F.col("threshold")) & (F.col("value") < F.col("threshold"))
    s = F.col("s0") + (F.col("s") - F.col("s0")) * (F.col("value0") - F.col("threshold")) / (F.col("value0") - F.col("value"))
    return each.groupBy(*by, "threshold").agg(F.coalesce(F.try_divide(F.lit(1.0), F.max_by(F.when(down, s), F.when(down, F.col("idx")))), F.lit(0.0)).alias("res"))


def wedge_mask(kx: Column, ky: Column, kz: Column, tmin: float, tmax: float, xtilt: float = 0.0) -> Column:
    """Whether a frequency lies in the missing wedge: its angle, in radians, outside the tilt range. The origin never does.

    Where kx is 0 the angle is a right one, or none where kz is 0 too, whatever the x tilt.
    """
    low, high = min(tmin, tmax), max(tmin, tmax)
    up = kz * F.lit(math.cos(xtilt)) + ky * F.lit(math.sin(xtilt))
    angle = F.when(kx != 0, F.atan(F.try_divide(up, kx))).when(kz == 0, 0.0).otherwise(math.pi / 2)
    outside = (angle < low) | (angle > high)
    return F.when((kx == 0) & (ky == 0) & (kz == 0), False).otherwise(outside)


def nloo2d_sums(triples: DataFrame, by: Sequence[str], radius: Column, bin_size: float = 1.0, count: Column | int | None = None) -> DataFrame:
    """Shell sums of the input image against that without its projection (miss) and with it (full): ``cm, mm, cf, ff``.

    ``triples`` has re0, im0 (input), re1, im1 (miss), re2, im2 (full).
    """
    e = triples.withColumn("idx", F.explode(physical_shells(radius, bin_size, count, alone=False)))
    dot = lambda a, b: F.sum(F.col(f"re{a}") * F.col(f"re{b}") + F.col(f"im{a}") * F.col(f"im{b}"))
    return e.groupBy(*by, "idx").agg(dot(0, 1).alias("cm"), dot(1, 1).alias("mm"), dot(0, 2).alias("cf"), dot(2, 2).alias("ff"))


def nloo_ratio(sums: DataFrame, low: float = 0.0) -> DataFrame:
    """corr(miss, input) / corr(full, input) from the sums: input power cancels; 0 where tiny, clipped to ``low``..1."""
    ratio = F.try_divide(F.col("cm") * F.sqrt("ff"), F.col("cf") * F.sqrt("mm"))
    tiny = (F.abs("cf") < 1e-30) | (F.col("mm") < 1e-30) | (F.col("ff") < 1e-30)
    return sums.withColumn("value", F.when(tiny, 0.0).otherwise(F.greatest(F.least(ratio, F.lit(1.0)), F.lit(low))))


def nloo3d(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same over all projections: the 2-D sums added by shell first."""
    return nloo_ratio(sums.groupBy(*by, "idx").agg(*[F.sum(c).alias(c) for c in ("cm", "mm", "cf", "ff")]))


def frequency_correlation(pairs: DataFrame, least: float = 1e-9) -> DataFrame:
    """``c``: the correlation of each frequency, clipped to 0..1; frequencies without power in one of both go."""
    power = (F.col("re1") * F.col("re1") + F.col("im1") * F.col("im1")) * (F.col("re2") * F.col("re2") + F.col("im2") * F.col("im2"))
    c = (F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2")) / F.sqrt(power)
    return pairs.filter(power > least).withColumn("c", F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def nloo_coefficient(triples: DataFrame, by: Sequence[str], length: Column, low: float, high: float) -> DataFrame:
    """``value``: the leave-one-out ratio of the frequencies between two lengths, in any order, -1..1."""
    band = triples.filter(length.between(min(low, high), max(low, high)))
    return nloo_ratio(nloo2d_sums(band, by, F.lit(1.0)).drop("idx"), -1.0)


def nloo_volume(triples: DataFrame, by: Sequence[str], shape: tuple[int, int, int], z_bin: float = 1.0) -> DataFrame:
    """``hx, hy, hz, value``: frequencies (kx, ky) of projections turned back to the nearest place of a volume of ``shape``
    (x, y, z) whose z is binned by ``z_bin``, summed there, -1..1; those that fall outside are lost.

    ``triples`` has the columns of ``tilt_views`` of its projection: the turn back is the transpose of a view, so
    that a tilt of t takes (kx, 0) to (kx cos t, 0, -kx sin t). Halves are rounded away from zero.
    """
    placed = triples
    for name, j, n, unit in zip(("hx", "hy", "hz"), range(3), shape, (1.0, 1.0, z_bin)):
        place = (F.col("kx") * F.col(f"m0{j}") + F.col("ky") * F.col(f"m1{j}")) / unit
        placed = placed.withColumn(name, F.when(place < 0, F.ceil(place - 0.5)).otherwise(F.floor(place + 0.5)).cast("int"))
        placed = placed.filter(F.col(name).between(-(n // 2), (n - 1) // 2))
    return nloo_ratio(nloo2d_sums(placed, [*by, "hx", "hy", "hz"], F.lit(1.0)), -1.0)


def tilt_weights(projections: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """``centre, near, w`` for projections (proj from 0, tilt) of each series: weights over an odd window, of sum 1.

    The weight is the window's span in tilt less the distance to its centre. Windows are cut at the ends of the
    series, and there the span is scaled by ``2 h`` over the number of projections missing at that end.
    """
    h = max(width, 1) // 2
    tilts = projections.select(*by, "proj", "tilt").distinct()
    length = tilts.groupBy(*by).agg((F.max("proj") + 1).alias("np"))
    near = tilts.select(*by, F.explode(F.sequence(F.col("proj") - h, F.col("proj") + h)).alias("centre"), F.col("proj").alias("near"), F.col("tilt").alias("tilt_near"))
    met = near.join(tilts.select(*by, F.col("proj").alias("centre"), "tilt"), [*by, "centre"]).join(length, list(by))
    window = Window.partitionBy(*by, "centre").orderBy("near").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    missing_left, missing_right = h - F.col("centre"), F.col("centre") + h - (F.col("np") - 1)
    ratio = F.when(missing_right > 0, F.lit(2.0 * h) / missing_right).when(missing_left > 0, F.lit(2.0 * h) / missing_left).otherwise(1.0)
    span = F.abs(F.last("tilt_near").over(window) - F.first("tilt_near").over(window))
    delta = F.when(F.count(F.lit(1)).over(window) > 1, ratio * span).otherwise(1.0)
    raw = met.withColumn("raw", delta - F.abs(F.col("tilt_near") - F.col("tilt")))
    return raw.withColumn("w", F.col("raw") / F.sum("raw").over(Window.partitionBy(*by, "centre"))).select(*by, "centre", "near", "w")


def smooth_over_tilt(curves: DataFrame, by: Sequence[str], width: int, point: str = "idx") -> DataFrame:
    """``value`` averaged over neighbouring projections with ``tilt_weights``, for each ``point`` of the curves."""
    weights = tilt_weights(curves, by, width)
    met = curves.select(*by, F.col("proj").alias("near"), point, "value").join(weights, [*by, "near"])
    return met.groupBy(*by, F.col("centre").alias("proj"), point).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def smooth_estimates(estimates: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Estimates (by..., proj, tilt, value) averaged over neighbouring projections like the curves; as they are for a width of 1."""
    if width <= 1:
        return estimates.select(*by, "proj", "value")
    return smooth_over_tilt(estimates.withColumn("one", F.lit(0)), by, width, "one").drop("one")


# --- regions ----------------------------------------------------------------------------------------


def inside_box(places: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Within start..start + size - 1 on each axis, both ends included."""
    out = F.lit(True)
    for c, start, size in places:
        out = out & (c >= start) & (c <= start + size - 1)
    return out


def inside_sphere(places: Sequence[tuple[Column, Column]], radius: Column) -> Column:
    total = None
    for c, centre in places:
        d = (c - centre) * (c - centre)
        total = d if total is None else total + d
    return total <= radius * radius


def border_distance(places: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Distance to the nearest face of a box."""
    return F.least(*[F.least(F.abs(c - start), F.abs(c - (start + size - 1))) for c, start, size in places])


#: Part of half the shortest side of a region that its edge takes.
TAPER_SHARE = 0.15


def taper_size(sizes: Sequence[float], inner: float = 0.0, radius: bool = False) -> float:
    """Width of the edge of a box of ``sizes``, or of a sphere of radius ``sizes[0]``, about an inner region ``inner`` wide."""
    return 0.5 * (2 * sizes[0] - inner if radius else min(n - inner for n in sizes if n - inner > 1)) * TAPER_SHARE


def taper(v: Column, background: Column, distance: Column, inside: Column, width: float) -> Column:
    """Cosine edge from ``v`` to ``background`` over ``width`` at the border, background outside."""
    w = F.when(distance >= width, 1.0).otherwise(0.5 - 0.5 * F.cos(F.lit(math.pi) * distance / width))
    return F.when(inside, background + (v - background) * w).otherwise(background)


def region_stats(df: DataFrame, by: Sequence[str], inside: Column, background: str = "outside", frame: Column | None = None) -> DataFrame:
    """Mean and deviation inside, and as ``background`` the mean ``outside``, of the ``frame`` (a predicate), or ``inside``."""
    where = {"outside": ~inside, "inside": inside, "frame": frame}[background]
    return df.groupBy(*by).agg(F.avg(F.when(inside, F.col("v"))).alias("avg"), F.stddev_pop(F.when(inside, F.col("v"))).alias("std"), F.avg(F.when(where, F.col("v"))).alias("background"))


#: Ranges of the whole-number voxel types; others are floats.
VOXEL_TYPES = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647)}


def rescale(v: Column, scale: Column | float, shift: Column | float, kind: str = "float", inside: Column | None = None, background: Column | float | None = None) -> Column:
    """``v * scale + shift``, held within the range of the voxel type ``kind`` and cut to a whole number towards zero
    where it is one; outside of a region the ``background``, as it is given."""
    out = v * scale + shift
    if kind in VOXEL_TYPES:
        low, high = VOXEL_TYPES[kind]
        held = F.greatest(F.least(out, F.lit(float(high))), F.lit(float(low)))
        out = F.when(held < 0, F.ceil(held)).otherwise(F.floor(held)).cast("double")
    elif kind not in ("float", "double"):
        raise ValueError(f"no voxel type {kind}")
    if inside is None:
        return out
    ground = F.lit(0.0) if background is None else F.lit(background) if isinstance(background, (int, float)) else background
    return F.when(inside, out).otherwise(ground)


def mask_region(df: DataFrame, by: Sequence[str], inside: Column, background: str = "outside", frame: Column | None = None) -> DataFrame:
    """``v`` as it is inside a region, and the mean that ``region_stats`` takes as ``background`` elsewhere."""
    ground = region_stats(df, by, inside, background, frame).select(*by, "background")
    return df.join(ground, list(by)).withColumn("v", F.when(inside, F.col("v")).otherwise(F.col("background"))).drop("background")


def fill_ratio(df: DataFrame, by: Sequence[str], inside: Column) -> DataFrame:
    """``ratio``: the part of each image or volume that a region takes."""
    return df.groupBy(*by).agg((F.count_if(inside) / F.count(F.lit(1))).alias("ratio"))


def log_intensity(v: Column, offset: float = 0.0) -> Column:
    """Logarithm of ``v + offset``; a value that is not positive is an error."""
    base = v + offset
    return F.when(base > 0, F.ln(base)).otherwise(F.raise_error(F.lit("the logarithm needs positive values")))


def unbin_coordinate(place: Column, factor: Column) -> Column:
    """The place on unbinned data of the middle of a binned one."""
    return place * factor + (factor - 1) / 2


def rescale_ls(pairs: DataFrame, by: Sequence[str], axes: Sequence[str], factor: int, inside: Column | None = None) -> DataFrame:
    """``v2`` brought to ``v1`` by a line fitted on binned data, of a region where one is given: the columns and ``v``."""
    cells = [F.floor(F.col(a) / factor).alias(a) for a in axes]
    region = pairs if inside is None else pairs.filter(inside)
    binned = region.groupBy(*by, *cells).agg(F.avg("v1").alias("v1"), F.avg("v2").alias("v2"))
    fit = binned.groupBy(*by).agg(F.regr_slope("v1", "v2").alias("slope"), F.regr_intercept("v1", "v2").alias("offset"))
    return pairs.join(fit, list(by)).withColumn("v", F.col("offset") + F.col("slope") * F.col("v2")).drop("slope", "offset")


# --- projections and peaks ----------------------------------------------------------------------------


def tilt_views(tilts: DataFrame) -> DataFrame:
    """Rotations to the views of tilts (``tilt`` and ``xtilt``, in degrees) as columns ``m00 .. m22``: rows give new
    x, y and z from old x, y and z. A view is a turn by ``tilt`` about y, then by ``-xtilt`` about x; a projection takes its inverse."""
    c, s, cx, sx = F.cos(F.radians("tilt")), F.sin(F.radians("tilt")), F.cos(F.radians("xtilt")), F.sin(F.radians("xtilt"))
    rows = [[c, -s * sx, -s * cx], [F.lit(0.0), cx, -sx], [s, c * sx, c * cx]]
    return tilts.withColumns({f"m{i}{j}": v for i, row in enumerate(rows) for j, v in enumerate(row)})


def _turned(row: int, centre: Sequence[float]) -> Column:
    """New coordinate ``row`` (0: x, 1: y) of a point x, y, z turned about ``centre`` (x, y, z)."""
    old = [F.col(a) - F.lit(float(o)) for a, o in zip("xyz", centre)]
    return sum((o * F.col(f"m{row}{j}") for j, o in enumerate(old)), F.lit(float(centre[row])))


def project_points(points: DataFrame, views: DataFrame, centre: Sequence[float]) -> DataFrame:
    """``px, py`` of each point (x, y, z) in each view; both belong to a ``series``."""
    return points.join(views, "series").withColumn("px", _turned(0, centre)).withColumn("py", _turned(1, centre))


def reproject(voxels: DataFrame, views: DataFrame, by: Sequence[str], centre: Sequence[float], shape: tuple[int, int], inside: Column | None = None, background: float = 0.0, exponent: tuple[float, float] | None = None) -> DataFrame:
    """Projections ``proj, px, py, v`` of volumes (by..., series, x, y, z, v) in the views of their ``series``.

    Each voxel, of a region where one is given, is split over four pixels by nearness and sums are divided by the
    weights that fell on a pixel; the background is taken off before and added after. ``exponent``: least and
    largest value of a volume of logarithms, whose projections go back to intensities. Voxels that fall outside ``shape`` (x, y) are lost.
    """
    region = voxels if inside is None else voxels.filter(inside)
    met = region.join(views, "series").withColumn("ax", _turned(0, centre)).withColumn("ay", _turned(1, centre))
    near = lambda a: F.array(F.struct(F.floor(a).alias("p"), (1 - (F.col(a) - F.floor(a))).alias("w")), F.struct((F.floor(a) + 1).alias("p"), (F.col(a) - F.floor(a)).alias("w")))
    landed = met.filter((F.floor("ax").between(0, shape[0] - 1)) & (F.floor("ay").between(0, shape[1] - 1)))
    split = landed.withColumn("at_x", F.explode(near("ax"))).withColumn("at_y", F.explode(near("ay"))).withColumn("w", F.col("at_x.w") * F.col("at_y.w"))
    flat = split.select(*by, "proj", F.col("at_x.p").cast("int").alias("px"), F.col("at_y.p").cast("int").alias("py"), (F.col("v") - background).alias("v"), "w")
    flat = flat.filter((F.col("w") > 1e-12) & (F.col("px") < shape[0]) & (F.col("py") < shape[1]))
    v = F.sum(F.col("v") * F.col("w")) / F.sum("w") + background
    if exponent is not None:
        low, high = exponent
        v = F.exp((v - low) / (high - low)) * (high - low)
    return flat.groupBy(*by, "proj", "px", "py").agg(v.alias("v"))


def _pixels(views: DataFrame, shape: tuple[int, int]) -> DataFrame:
    grid = views
    for name, n in zip(("px", "py"), shape):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid


def box_footprint(views: DataFrame, start: Sequence[float], size: Sequence[float], centre: Sequence[float], shape: tuple[int, int]) -> DataFrame:
    """Pixels ``px, py`` of an image of ``shape`` (x, y) within the projection of a box (x, y, z) in each view.

    The projected box is what lies between the three pairs of parallel lines along its projected edges.
    """
    middle = [s + (n - 1) / 2 for s, n in zip(start, size)]
    turned = views.withColumns({a: F.lit(float(m)) for a, m in zip("xyz", middle)}).withColumn("mx", _turned(0, centre)).withColumn("my", _turned(1, centre))
    edges = [(F.col(f"m0{k}") * float(n - 1), F.col(f"m1{k}") * float(n - 1)) for k, n in enumerate(size)]
    inside = F.lit(True)
    for gx, gy in edges:
        across = lambda x, y, gx=gx, gy=gy: F.abs(y * gx - x * gy)
        reach = sum((across(ex, ey) for ex, ey in edges), F.lit(0.0)) / 2
        inside = inside & (across(F.col("px") - F.col("mx"), F.col("py") - F.col("my")) <= reach + 1e-6)
    return _pixels(turned, shape).filter(inside).drop("x", "y", "z", "mx", "my")


def sphere_footprint(views: DataFrame, middle: Sequence[float], radius: float, centre: Sequence[float], shape: tuple[int, int]) -> DataFrame:
    """Pixels within a circle of the sphere's radius about its projected middle."""
    turned = views.withColumns({a: F.lit(float(m)) for a, m in zip("xyz", middle)}).withColumn("mx", _turned(0, centre)).withColumn("my", _turned(1, centre))
    dx, dy = F.col("px") - F.col("mx"), F.col("py") - F.col("my")
    return _pixels(turned, shape).filter(dx * dx + dy * dy <= radius * radius + 1e-6).drop("x", "y", "z", "mx", "my")


def wedge_angles(kz: np.ndarray, kx: np.ndarray, ky: np.ndarray, tmin: float, tmax: float, xtilt: float = 0.0) -> np.ndarray:
    """``wedge_mask`` of arrays of frequencies."""
    kz, kx, ky = np.broadcast_arrays(kz, kx, ky)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.where(kx != 0, np.arctan((kz * math.cos(xtilt) + ky * math.sin(xtilt)) / kx), np.where(kz == 0, 0.0, math.pi / 2))
    outside = (angle < min(tmin, tmax)) | (angle > max(tmin, tmax))
    return outside & ~((kz == 0) & (kx == 0) & (ky == 0))


def wedge_array(shape: tuple[int, int, int], tmin: float, tmax: float, xtilt: float = 0.0) -> np.ndarray:
    """``wedge_mask`` at every frequency (z, x, y) of a transform in FFT order."""
    return wedge_angles(*np.meshgrid(*[np.fft.fftfreq(n) for n in shape], indexing="ij"), tmin, tmax, xtilt)


def bead_score(volumes: DataFrame, by: str, values: str, shape: tuple[int, int, int], diameter: float, wedge: tuple[float, float, float] | None = None) -> DataFrame:
    """``by, score``: correlation with a sphere of -1 of ``diameter`` voxels, round the edges, by transform.

    Rows are whole volumes or boxes of them (``fourier.crop_bricks`` with a margin of half a diameter). ``wedge``:
    tilt range and x tilt in radians; frequencies in its missing wedge do not count.
    """
    reach = int(diameter)
    offsets = np.stack(np.meshgrid(*[np.arange(-reach, reach)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    ball = offsets[(offsets**2).sum(axis=1) <= 0.25 * diameter**2]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = np.zeros(shape)
        np.put(template, np.unique(np.ravel_multi_index((ball % np.array(shape)).T, shape)), -1.0)
        other = np.fft.fftn(template)
        if wedge is not None:
            other = other * ~wedge_array(shape, *wedge)
        for frame in frames:
            found = [np.fft.ifftn(np.fft.fftn(np.asarray(v, np.float64).reshape(shape)) * other).real.ravel() for v in frame[values]]
            yield pd.DataFrame({by: frame[by], "score": found})

    return volumes.select(by, values).mapInPandas(run, f"{by} long, score array<double>")


def above_deviation(score: DataFrame, by: Sequence[str], k: float) -> DataFrame:
    """Rows whose ``v`` exceeds the mean of their volume by more than ``k`` population deviations."""
    cut = score.groupBy(*by).agg((F.avg("v") + k * F.stddev_pop("v")).alias("cut"))
    return score.join(cut, list(by)).filter("v > cut").drop("cut")


def pick_peaks(score: DataFrame, by: Sequence[str], sizes: dict[str, int], radius: int, least: Column, most_rounds: int = 1000) -> DataFrame:
    """Places whose score, above ``least``, is the largest of their tile, thinned out so that none is nearer than ``radius`` to a stronger one that stays.

    ``sizes``: the axes, the slowest first, and how long each is. Tiles of ``radius`` begin at that distance from the
    start of an axis and before that distance from its end; a shorter axis is one tile. Of tile maxima the strongest stays
    (ties: the smaller place) and those near it go, then the strongest of the others, and so on: what has gone beats
    nothing. This is done in rounds: all that are the strongest among their neighbours stay at once, their neighbours go, the
    rest plays again. Neighbours meet on tile numbers, an equi-join over the adjoining tiles, and each round works on
    the maxima still open, a few of a tile's voxels; a chain of k falling peaks takes k / 2 rounds.
    """
    axes = list(sizes)
    tiles, within = [], F.lit(True)
    for a, n in sizes.items():
        first = radius if radius < n else 0
        tile = F.floor((F.col(a) - first) / radius).cast("int")
        tiles.append(tile.alias(f"t{a}"))
        within = within & (F.col(a) >= first) & (first + tile * radius < max(n - radius, 1))
    place = F.struct("v", *[(-F.col(a)).alias(a) for a in axes])
    best = score.filter((F.col("v") > least) & within).groupBy(*by, *tiles).agg(F.max(place).alias("top"))
    left = best.select(*by, *[f"t{a}" for a in axes], F.col("top.v").alias("v"), *[(-F.col(f"top.{a}")).alias(a) for a in axes])
    left, kept = settled(left), None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        winners = left.join(_near(left, left, by, axes, radius, stronger=True), [*by, *axes], "left_anti")
        winners = settled(winners)
        kept = winners if kept is None else kept.unionByName(winners)
        gone = _near(left, winners, by, axes, radius, stronger=False)
        left = settled(left.join(winners.select(*by, *axes), [*by, *axes], "left_anti").join(gone, [*by, *axes], "left_anti"))
    else:
        raise ValueError(f"peaks were not settled in {most_rounds} rounds")
    return (left if kept is None else kept).select(*by, *axes, "v")


def _near(these: DataFrame, others: DataFrame, by: Sequence[str], axes: Sequence[str], radius: int, stronger: bool) -> DataFrame:
    """Places of ``these`` nearer than ``radius`` to one of ``others``, to a ``stronger`` one only where that is asked."""
    around = others.select(*by, *[f"t{a}" for a in axes], F.col("v").alias("nv"), *[F.col(a).alias(f"n{a}") for a in axes])
    for a in axes:
        around = around.withColumn(f"t{a}", F.explode(F.sequence(F.col(f"t{a}") - 1, F.col(f"t{a}") + 1)))
    distance = sum(((F.col(a) - F.col(f"n{a}")) * (F.col(a) - F.col(f"n{a}")) for a in axes), F.lit(0))
    here, there = F.struct("v", *[(-F.col(a)).alias(a) for a in axes]), F.struct(F.col("nv").alias("v"), *[(-F.col(f"n{a}")).alias(a) for a in axes])
    met = these.join(around, [*by, *[f"t{a}" for a in axes]]).filter((distance < radius * radius) & (there > here if stronger else F.lit(True)))
    return met.select(*by, *axes).distinct()


def ring_stats(images: DataFrame, centres: DataFrame, by: Sequence[str], radius: float) -> DataFrame:
    """Mean and deviation of the pixels from ``radius`` to less than twice that from each centre (bead, cx, cy)."""
    d = discs(images, centres, by, 2 * radius)
    return d.filter(F.col("d2") >= radius * radius).groupBy(*by, "bead").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))


def discs(images: DataFrame, centres: DataFrame, by: Sequence[str], reach: float) -> DataFrame:
    """Pixels nearer than ``reach`` to each centre with the squared distance ``d2``; they meet on buckets of that size."""
    edge = math.ceil(reach)
    c = centres.withColumn("bx", F.explode(F.sequence(F.floor((F.col("cx") - reach) / edge), F.floor((F.col("cx") + reach) / edge)))).withColumn("by_", F.explode(F.sequence(F.floor((F.col("cy") - reach) / edge), F.floor((F.col("cy") + reach) / edge))))
    p = images.withColumn("bx", F.floor(F.col("px") / edge)).withColumn("by_", F.floor(F.col("py") / edge))
    d2 = (F.col("px") - F.col("cx")) * (F.col("px") - F.col("cx")) + (F.col("py") - F.col("cy")) * (F.col("py") - F.col("cy"))
    return p.join(c, [*by, "bx", "by_"]).withColumn("d2", d2).filter(F.col("d2") < reach * reach).drop("bx", "by_")


#: A bead is erased over this many times its radius.
ERASE = 1.2


def erase_beads(images: DataFrame, centres: DataFrame, by: Sequence[str], radius: float, noise: int | None = None) -> DataFrame:
    """Pixels nearer than 1.2 ``radius`` to a centre take that bead's ring mean; where discs overlap, the last bead's.

    With ``noise``, a seed, they take normal noise of the ring's mean and deviation. Rings are taken from the images as they are given.
    """
    rings = ring_stats(images, centres, by, radius).select(*by, "bead", "mean", "std")
    hit = discs(images, centres, by, ERASE * radius).select(*by, "px", "py", "bead").join(rings, [*by, "bead"])
    fill = hit.groupBy(*by, "px", "py").agg(F.max_by(F.struct("mean", "std"), "bead").alias("fill"))
    value = F.col("fill.mean") if noise is None else F.col("fill.mean") + F.col("fill.std") * F.randn(noise)
    return images.join(fill, [*by, "px", "py"], "left").withColumn("v", F.coalesce(value, "v")).drop("fill")


# --- whole measurements -------------------------------------------------------------------------------


def _stats(image: np.ndarray, inside: np.ndarray) -> tuple[float, float, float]:
    """Mean and deviation inside, mean outside (0 where there is no outside)."""
    return float(image[inside].mean()), float(image[inside].std()), float(image[~inside].mean()) if (~inside).any() else 0.0


def _rescaled(image: np.ndarray, own: tuple[float, float, float], like: tuple[float, float, float], inside: np.ndarray) -> np.ndarray:
    """``image`` with the mean and deviation of ``like`` inside and its background outside."""
    scale = like[1] / own[1] if own[1] > 0 else 0.0
    return np.where(inside, (image - own[0]) * scale + like[0], like[2])


def prepared(rows: DataFrame, by: str, values: Sequence[str], shape: tuple[int, ...], inside: np.ndarray, like: int, edge: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """The arrays of each row, masked by a region and rescaled to the one at place ``like``: mean, deviation, background.

    ``edge``: distance to the region's border and the width of a cosine edge towards the background there.
    """
    inside = np.asarray(inside, bool).reshape(shape)
    weight = None if edge is None else np.where(edge[0].reshape(shape) < edge[1], 0.5 - 0.5 * np.cos(np.pi * edge[0].reshape(shape) / edge[1]), 1.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {v: [] for v in values}
            for row in zip(*[frame[v] for v in values]):
                images = [np.asarray(v, np.float64).reshape(shape) for v in row]
                stats = [_stats(i, inside) for i in images]
                for k, (name, image) in enumerate(zip(values, images)):
                    made = np.where(inside, image, stats[k][2]) if k == like else _rescaled(image, stats[k], stats[like], inside)
                    if weight is not None:
                        made = np.where(inside, (made - stats[like][2]) * weight + stats[like][2], made)
                    out[name].append(made.ravel())
            yield pd.DataFrame({by: frame[by], **out})

    return rows.select(by, *values).mapInPandas(run, f"{by} long, " + ", ".join(f"{v} array<double>" for v in values))


def cross_validate(projections: DataFrame, shape: tuple[int, int], inside: np.ndarray, bin_size: float = 1.0, count: int | None = None) -> DataFrame:
    """Leave-one-out sums ``proj, idx, cm, mm, cf, ff`` of projections (proj, input, miss, full: arrays, x by y).

    The input and the reprojection without its tilt are masked and rescaled to that of the whole volume; shells by
    physical frequency. ``nloo_ratio`` of the sums gives each projection's curve, ``nloo3d`` that of a series, and
    ``last_crossings`` their tables.
    """
    ready = prepared(projections, "proj", ["input", "miss", "full"], shape, inside, like=2)
    flat = frequencies(fft_arrays(ready, "proj", ["input", "miss", "full"], shape), ["proj"], [("x", shape[0]), ("y", shape[1])])
    triples = flat.withColumnsRenamed({f"{c}{k}": f"{c}{k - 1}" for k in (1, 2, 3) for c in ("re", "im")})
    return nloo2d_sums(triples, ["proj"], F.sqrt((F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky")).cast("double")), bin_size, count)


def view_regions(views: DataFrame, centre: Sequence[float], start: Sequence[float] | None = None, size: Sequence[float] | None = None, middle: Sequence[float] | None = None, radius: float | None = None) -> DataFrame:
    """``views`` with ``region``: what the projection of a box (``start``, ``size``) or a sphere (``middle``, ``radius``; all x, y, z) is in each.

    A projected box lies between three pairs of parallel lines, along its projected edges; ``region`` has the projected
    middle ``mx, my``, the edges ``gx, gy`` and how far the lines lie from the middle (``reach``, times the edge's length).
    """
    box = radius is None
    at = [s + (n - 1) / 2 for s, n in zip(start, size)] if box else list(middle)
    turned = views.withColumns({a: F.lit(float(m)) for a, m in zip("xyz", at)}).withColumn("mx", _turned(0, centre)).withColumn("my", _turned(1, centre))
    gx, gy = ([F.col(f"m{i}{k}") * float(n - 1) for k, n in enumerate(size)] if box else [] for i in (0, 1))
    reach = [sum((F.abs(gy[j] * gx[k] - gx[j] * gy[k]) for j in range(3)), F.lit(0.0)) / 2 for k in range(3)] if box else []
    empty = F.array().cast("array<double>")
    region = F.struct("mx", "my", *[(F.array(*c) if box else empty).alias(n) for n, c in (("gx", gx), ("gy", gy), ("reach", reach))], F.lit(None if box else float(radius)).cast("double").alias("radius"))
    return turned.withColumn("region", region).drop("x", "y", "z", "mx", "my")


def footprint_distance(region, shape: tuple[int, int]) -> tuple[np.ndarray, float]:
    """Distance of each pixel (x, y) to the border of a projected region, below zero outside, and the least width of the region."""
    x, y = np.arange(shape[0])[:, None] - region["mx"], np.arange(shape[1])[None, :] - region["my"]
    if region["radius"] is not None and not np.isnan(region["radius"]):
        return region["radius"] - np.hypot(x, y), 2 * region["radius"]
    distance, width = np.full(shape, np.inf), np.inf
    for gx, gy, reach in zip(region["gx"], region["gy"], region["reach"]):
        length = math.hypot(gx, gy)
        if length > 1e-9:  # an edge along the beam is a point
            distance = np.minimum(distance, (reach - np.abs(y * gx - x * gy)) / length)
            width = min(width, 2 * reach / length)
    return distance, width


def footprint_spans(views: DataFrame, shape: tuple[int, int], by: Sequence[str] = ("series", "proj")) -> DataFrame:
    """``by..., py, first, last``: the pixels of each row of an image that the ``region`` of its view covers, which is convex."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                inside = footprint_distance(row.region, shape)[0] >= -1e-6
                rows = np.flatnonzero(inside.any(axis=0))
                yield pd.DataFrame({**{c: getattr(row, c) for c in by}, "py": rows, "first": inside.argmax(axis=0)[rows], "last": shape[0] - 1 - inside[::-1].argmax(axis=0)[rows]})

    kinds = {f.name: f.dataType.simpleString() for f in views.schema}
    return views.select(*by, "region").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", py int, first int, last int")


def selected(projections: DataFrame, excluded: DataFrame | None = None, every: int = 1, key: str = "proj") -> DataFrame:
    """Projections whose number, from 0, is a multiple of ``every`` and not in ``excluded``."""
    kept = projections if every == 1 else projections.filter(F.col(key) % every == 0)
    return kept if excluded is None else drop_excluded(kept, excluded, key=key)


def cross_validate_views(projections: DataFrame, shape: tuple[int, int], rescale: str = "stats", taper: bool = False, bin_size: float = 1.0, count: int | None = None, by: Sequence[str] = ("proj",)) -> DataFrame:
    """Leave-one-out sums ``by..., idx, cm, mm, cf, ff`` of projections (by..., input, miss, full: arrays, x by y, and ``region``
    of ``view_regions``), each masked by the footprint of its own view.

    Within the footprint the input and the reprojection without its tilt are brought to that of the whole volume by mean and
    deviation (``stats``) or by a fitted line (``line``); outside all have the background of that of the whole volume.
    ``taper`` gives a cosine edge at the footprint's border. A view whose footprint covers no pixel gives no sums.
    """
    if rescale not in ("stats", "line"):
        raise ValueError("rescale is stats or line")
    names = ["input", "miss", "full"]
    k = np.meshgrid(*[np.fft.fftfreq(n, 1 / n) * max(shape) / n for n in shape], indexing="ij")
    radius = np.hypot(*k)
    low, high = np.maximum(np.floor(radius - bin_size / 2 + 1), 0).astype(int), np.floor(radius + bin_size / 2).astype(int)
    use = np.ones(shape, bool)
    if count is not None:
        use, high = np.floor(radius) + 1 < count, np.minimum(high, count - 1)

    def measured(row) -> pd.DataFrame | None:
        distance, width = footprint_distance(row.region, shape)
        inside = distance >= -1e-6
        if not inside.any():
            return None
        images = [np.asarray(getattr(row, n), np.float64).reshape(shape) for n in names]
        like = images[2]
        background = like[~inside].mean() if (~inside).any() else 0.0
        made = []
        for image in images:
            if image is not like and rescale == "stats":
                spread = image[inside].std()
                image = (image - image[inside].mean()) * (like[inside].std() / spread if spread > 0 else 0.0) + like[inside].mean()
            elif image is not like:
                x, y = image[inside] - image[inside].mean(), like[inside] - like[inside].mean()
                slope = (x * y).sum() / (x * x).sum() if (x * x).sum() > 0 else 0.0
                image = (image - image[inside].mean()) * slope + like[inside].mean()
            if taper:
                edge = 0.5 * width * TAPER_SHARE
                weight = np.where(distance < edge, 0.5 - 0.5 * np.cos(np.pi * np.clip(distance, 0, None) / max(edge, 1e-30)), 1.0)
                image = background + (image - background) * weight
            made.append(np.fft.fft2(np.where(inside, image, background)))
        given, miss, full = made
        products = [(given * np.conj(miss)).real, np.abs(miss) ** 2, (given * np.conj(full)).real, np.abs(full) ** 2]
        sums = np.zeros((5, int(high[use].max(initial=0)) + 1))
        for more in range(math.ceil(bin_size) + 1):
            at = use & (low + more <= high)
            for n, v in enumerate([*products, np.ones(shape)]):
                sums[n] += np.bincount((low + more)[at], v[at], sums.shape[1])
        idx = np.flatnonzero(sums[4])
        return pd.DataFrame({**{c: getattr(row, c) for c in by}, "idx": idx, **dict(zip(("cm", "mm", "cf", "ff"), sums[:4, idx]))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                found = measured(row)
                if found is not None:
                    yield found

    kinds = {f.name: f.dataType.simpleString() for f in projections.schema}
    return projections.select(*by, *names, "region").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", idx int, cm double, mm double, cf double, ff double")


def even_odd_resolution(halves: DataFrame, by: str, shape: tuple[int, int, int], inside: np.ndarray, edge: tuple[np.ndarray, float] | None = None, wedge: tuple[float, float, float] | None = None, mask: DataFrame | None = None, bin_size: float = 1.0, whole: bool = True, count: int | None = None) -> DataFrame:
    """``by, idx, value``: correlation of two half-data volumes (v1, v2: arrays, z first), by physical frequency.

    For small volumes; those of bricks have ``volumes.even_odd_curve``.

    The first is rescaled to the second within the region, both get a cosine edge, frequencies of the missing wedge
    and those not in ``mask`` (kz, kx, ky) go; ``whole`` turns it into the correlation of the whole data.
    """
    ready = prepared(halves, by, ["v1", "v2"], shape, inside, like=1, edge=edge)
    flat = frequencies(fft_arrays(ready, by, ["v1", "v2"], shape), [by], list(zip("zxy", shape)))
    if wedge is not None:
        flat = flat.filter(~wedge_mask(F.col("kx"), F.col("ky"), F.col("kz"), *wedge))
    if mask is not None:
        flat = flat.join(mask, ["kz", "kx", "ky"], "left_semi")
    radius = F.sqrt((F.col("kz") * F.col("kz") + F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky")).cast("double"))
    return fsc_physical(flat, [by], radius, bin_size, even_odd=whole, count=count)


def resolution_limit(option: Column, unit: Column, limit: Column) -> Column:
    """The resolution asked for, else what the settings allow: the unit over the limit."""
    return F.coalesce(option, F.try_divide(unit, limit))


def scale_region(shapes: DataFrame, factor: int | Column, columns: Sequence[str]) -> DataFrame:
    """Starts and sizes of regions on data binned by ``factor``."""
    return shapes.withColumns({c: F.col(c) / factor for c in columns})


def drop_excluded(images: DataFrame, excluded: DataFrame, swap: Column | None = None, key: str = "proj") -> DataFrame:
    """Images without the excluded projections; where ``swap`` holds, the tilt axis is the other one: px and py change places."""
    kept = images.join(excluded.select(key).distinct(), key, "left_anti")
    if swap is None:
        return kept
    return kept.withColumns({"px": F.when(swap, F.col("py")).otherwise(F.col("px")), "py": F.when(swap, F.col("px")).otherwise(F.col("py"))})


def assert_counts(projections: DataFrame, angles: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., n_proj, n_tilt`` of series; one whose numbers of projections and of angles differ raises an error."""
    p = projections.groupBy(*by).agg(F.count_distinct("proj").alias("n_proj"))
    a = angles.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tilt"))
    both = p.join(a, list(by), "full").select(*by, F.coalesce("n_proj", F.lit(0)).alias("n_proj"), F.coalesce("n_tilt", F.lit(0)).alias("n_tilt"))
    wrong = F.raise_error(F.format_string("%d projections but %d angles", "n_proj", "n_tilt"))
    return both.withColumn("n_proj", F.when(F.col("n_proj") == F.col("n_tilt"), F.col("n_proj")).otherwise(wrong))

"""Voxel-wise image algebra on tables ``(key..., v)``: names after the operation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settle import settled


def combine(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of two images side by side: ``v1, v2``."""
    return a.select(*keys, F.col("v").alias("v1")).join(b.select(*keys, F.col("v").alias("v2")), list(keys))


def compatible(images: DataFrame, key: str, sizes: Sequence[str], pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b: keys of ``images``) whose images agree in all ``sizes``."""
    size = F.struct(*sizes)
    a, b = images.select(F.col(key).alias("a"), size.alias("size_a")), images.select(F.col(key).alias("b"), size.alias("size_b"))
    return pairs.join(a, "a").join(b, "b").filter("size_a = size_b").drop("size_a", "size_b")


def add_scaled(v1: Column, v2: Column, scale: float = 1.0, shift: float = 0.0) -> Column:
    """``v1 + scale * v2 + shift``."""
    return v1 + v2 * scale + shift


def multiply_scaled(v1: Column, v2: Column, scale: float = 1.0, shift: float = 0.0) -> Column:
    """``v1 * (scale * v2 + shift)``."""
    return v1 * (v2 * scale + shift)


def largest(v1: Column, v2: Column) -> Column:
    return F.greatest(v1, v2)


def smallest(v1: Column, v2: Column) -> Column:
    return F.least(v1, v2)


def correlation_product(v1: Column, v2: Column, mean1: Column | float, mean2: Column | float) -> Column:
    """What a place adds to the covariance of two images."""
    return (v1 - mean1) * (v2 - mean2)


def within_radii(places: Sequence[tuple[Column, float]], low: float, high: float) -> Column:
    """Whether a place lies between two distances from a centre, both included."""
    d2 = sum(((c - centre) * (c - centre) for c, centre in places), F.lit(0.0))
    return (d2 >= low * low) & (d2 <= high * high)


def mask_by_threshold(v: Column, mask: Column, threshold: float, fill: Column | float = 0.0) -> Column:
    """``v`` where the mask image is above the threshold, ``fill`` elsewhere."""
    return F.when(mask > threshold, v).otherwise(fill)


def invert(v: Column, low: Column, high: Column) -> Column:
    """The image with its least and largest value exchanged."""
    return low + high - v


def square(v: Column) -> Column:
    return v * v


def log_of(v: Column, offset: float = 0.0) -> Column:
    """Logarithm of ``v + offset``; null where that is not positive."""
    return F.when(v + offset > 0, F.ln(v + offset))


def truncate(v: Column, low: float, high: float, set_low: Column | float | None = None, set_high: Column | float | None = None) -> Column:
    """Values below and above a range set to its ends, or to other values."""
    low_value, high_value = low if set_low is None else set_low, high if set_high is None else set_high
    return F.when(v < low, low_value).when(v > high, high_value).otherwise(v)


def clamped_cast(v: Column, low: int, high: int) -> Column:
    """A whole number, cut towards zero, within the range of a voxel type."""
    held = F.greatest(F.least(v, F.lit(float(high))), F.lit(float(low)))
    return F.when(held < 0, F.ceil(held)).otherwise(F.floor(held)).cast("long")


def ring_statistics(df: DataFrame, by: Sequence[str], places: Sequence[tuple[str, float]], width: float = 1.0) -> DataFrame:
    """``ring, avg, std, n`` of the values of each ring of ``width`` about a centre (axis, centre)."""
    d2 = sum(((F.col(c) - centre) * (F.col(c) - centre) for c, centre in places), F.lit(0.0))
    ring = F.floor(F.sqrt(d2) / width).cast("int")
    return df.groupBy(*by, ring.alias("ring")).agg(F.avg("v").alias("avg"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))


def image_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("avg"), F.stddev_pop("v").alias("std"))


def with_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each voxel with the statistics of its image."""
    return df.join(image_stats(df, by), list(by))


def rescale_to(df: DataFrame, by: Sequence[str], avg: float, std: float) -> DataFrame:
    """Values with mean ``avg`` and deviation ``std``; null where an image is constant."""
    scaled = (F.col("v") - F.col("avg")) * F.try_divide(F.lit(std), F.col("std")) + avg
    return with_stats(df, by).withColumn("v", scaled).drop("min", "max", "avg", "std")


def to_min_max(df: DataFrame, by: Sequence[str], low: float, high: float) -> DataFrame:
    """Values stretched to a range; null where an image is constant."""
    scaled = low + (F.col("v") - F.col("min")) * F.try_divide(F.lit(high - low), F.col("max") - F.col("min"))
    return with_stats(df, by).withColumn("v", scaled).drop("min", "max", "avg", "std")


def quantise(v: Column, low: Column, high: Column, levels: int) -> Column:
    """One of up to 255 levels: 255 / (n - 1) * floor((v - min) * 0.999 n / (max - min))."""
    return 255.0 / (levels - 1) * F.floor((v - low) * (0.999 * levels) / (high - low))


def weighted_sum(df: DataFrame, keys: Sequence[str], weight: str, image: Sequence[str] | None = None) -> DataFrame:
    """Weighted mean over images by place: the sum over that of the weights, and the weighted deviation; images, by the keys
    ``image``, are brought to mean 0 and deviation 1 first. Weights that add up to 0 give null."""
    if image is not None:
        df = rescale_to(df, image, 0.0, 1.0)
    w, v = F.col(weight), F.col("v")
    sums = df.groupBy(*keys).agg(F.sum(w * v).alias("s"), F.sum(w * v * v).alias("q"), F.sum(w).alias("w"))
    mean = F.try_divide("s", "w")
    return sums.select(*keys, mean.alias("v"), F.sqrt(F.greatest(F.try_divide("q", "w") - mean * mean, F.lit(0.0))).alias("sd"))


def place_small(large: DataFrame, small: DataFrame, keys: Sequence[str], inside: Column, at: dict[str, int] | None = None) -> DataFrame:
    """The smaller of both values where the small image, moved by ``at``, lies ``inside``; the large one elsewhere."""
    other = small.withColumns({a: F.col(a) + d for a, d in (at or {}).items()}).withColumnRenamed("v", "v_small")
    joined = large.join(other, list(keys), "left")
    return joined.withColumn("v", F.when(inside & F.col("v_small").isNotNull(), F.least("v", "v_small")).otherwise(F.col("v"))).drop("v_small")


def linear_fit(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``a + b * v1`` fitted to ``v2``, with R = sqrt(SSres / SStot)."""
    fit = pairs.groupBy(*by).agg(F.regr_slope("v2", "v1").alias("b"), F.regr_intercept("v2", "v1").alias("a"), F.regr_sxx("v2", "v1").alias("sxx"), F.regr_syy("v2", "v1").alias("syy"), F.regr_sxy("v2", "v1").alias("sxy"))
    rest = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0))
    return fit.select(*by, "a", "b", F.sqrt(F.try_divide(rest, "syy")).alias("r"))


def best_fit(v1: np.ndarray, v2: np.ndarray, most: float = 0.5, mask: np.ndarray | None = None, step: float = 0.01) -> tuple[float, float, float, int, np.ndarray]:
    """``a, b, r, n_left_out`` of the best fit ``a + b * v1`` to ``v2`` as more of the worst residuals are left out, and
    the difference image, 0 where masked.

    Shares go from 0 to ``most`` (half at most) by ``step``. After each fit the places whose residual exceeds a cut
    are left out of the next one; the cut is the edge of the highest of 1000 bins at and above which the share lies.
    """
    use = np.ones(len(v1), bool) if mask is None else np.asarray(mask, bool)
    x, y = np.asarray(v1, np.float64)[use], np.asarray(v2, np.float64)[use]
    kept, best = np.ones(len(x), bool), (0.0, 0.0, np.inf, 0)
    for k in range(round(min(most, 0.5) / step) + 1 if len(x) else 0):
        n, sx, sxx = kept.sum(), x[kept].sum(), (x[kept] ** 2).sum()
        sy, sxy = y[kept].sum(), (x[kept] * y[kept]).sum()
        det = n * sxx - sx * sx
        a, b = ((sxx * sy - sx * sxy) / det, (n * sxy - sx * sy) / det) if det else (0.0, 0.0)
        off = np.abs(a + b * x - y)
        rest, total = (off[kept] ** 2).sum(), ((y[kept] - sy / n) ** 2).sum()
        r = 0.0 if rest < 1e-30 else float(np.sqrt(rest / total)) if total else np.inf
        if r < best[2]:
            best = float(a), float(b), r, int(len(x) - n)
        top = off.max() if off.max() >= 1e-30 else 1.0
        upto = np.cumsum(np.bincount(np.minimum((1000 * off / top).astype(int), 999), minlength=1000)[::-1])  # from the highest bin down
        down = int(np.searchsorted(upto, len(x) * k * step - 1e-9))
        kept = off <= max(999 - down, 1) * top / 1000
    difference = np.zeros(len(use))
    difference[use] = best[0] + best[1] * x - y
    return (*best, difference)


def robust_fit(pairs: DataFrame, by: str, most: float = 0.5, mask: str | None = None) -> DataFrame:
    """``by, a, b, r, n_left_out, difference`` of ``best_fit`` for each row of ``pairs`` (v1, v2: arrays, and a mask of 0 and 1)."""
    columns = ["v1", "v2", *([mask] if mask else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [best_fit(np.asarray(r[0]), np.asarray(r[1]), most, np.asarray(r[2]) > 0 if mask else None) for r in zip(*[frame[c] for c in columns])]
            out = pd.DataFrame(found, columns=["a", "b", "r", "n_left_out", "difference"])
            out.insert(0, by, frame[by].to_numpy())
            yield out

    return pairs.select(by, *columns).mapInPandas(run, f"{by} long, a double, b double, r double, n_left_out long, difference array<double>")


#: Bins of residuals, of the largest of an image.
FIT_BINS = 1000


def robust_fit_rows(pairs: DataFrame, by: Sequence[str], most: float = 0.5, step: float = 0.01) -> DataFrame:
    """``by..., a, b, r, n_left_out`` of ``best_fit`` for images whose pixels are rows ``v1, v2`` of ``pairs``, however many.

    Each share is one pass: residuals of the fit at hand are counted in ``FIT_BINS`` bins with their moments (n, x, y, xx, xy,
    yy), so that a thousand rows an image and task are shuffled; the cut of the bins and the next fit come from running
    sums of these rows. What is carried from pass to pass is a row for each image. The difference image is
    ``a + b * v1 - v2``.
    """
    keys, x, y = list(by), F.col("v1").cast("double"), F.col("v2").cast("double")
    moments = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    whole = pairs.groupBy(*keys).agg(*[F.sum(v).alias(c) for c, v in moments.items()])
    state = settled(whole.withColumns({"pixels": F.col("n"), "best": F.lit(None).cast("struct<r:double,k:int,a:double,b:double,left:long>")}))
    steps = round(min(most, 0.5) / step) + 1
    for k in range(steps):
        fitted = _with_fit(state, k)
        if k == steps - 1:
            state = fitted
            break
        ab = fitted.select(*keys, "a", "b")
        off = pairs.select(*keys, x.alias("v1"), y.alias("v2")).join(ab, keys).withColumn("off", F.abs(F.col("a") + F.col("b") * F.col("v1") - F.col("v2")))
        top = off.groupBy(*keys).agg(F.max("off").alias("top")).withColumn("top", F.when(F.col("top") >= 1e-30, F.col("top")).otherwise(1.0))
        u = F.lit(FIT_BINS) * F.col("off") / F.col("top")
        placed = off.join(top, keys).withColumn("bin", F.least(F.floor(u), F.lit(FIT_BINS - 1))).withColumn("edge", (u == F.floor(u)) & (u < FIT_BINS))
        cells = placed.groupBy(*keys, "bin", "edge").agg(*[F.sum(v).alias(c) for c, v in moments.items()])
        # from the highest bin down: bins above which the share does not yet lie
        down = Window.partitionBy(*keys).orderBy(F.desc("bin"))
        asked = F.col("pixels") * (k * step) - 1e-9
        counted = cells.join(fitted.select(*keys, "pixels"), keys).withColumn("upto", F.sum("n").over(down))
        cut = counted.groupBy(*keys).agg(F.max(F.when(F.col("upto") >= asked, F.col("bin"))).alias("reached"))
        cut = cut.select(*keys, F.greatest(F.when(F.lit(k == 0), F.lit(FIT_BINS - 1)).otherwise(F.col("reached")), F.lit(1)).alias("cut"))
        inside = (F.col("bin") < F.col("cut")) | ((F.col("bin") == F.col("cut")) & F.col("edge"))
        sums = cells.join(cut, keys).groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0.0)).alias(c) for c in moments])
        state = settled(sums.join(fitted.select(*keys, "pixels", "best"), keys))
    return state.select(*keys, "best.a", "best.b", "best.r", F.col("best.left").alias("n_left_out"))


def _with_fit(state: DataFrame, k: int) -> DataFrame:
    """The line through the moments of ``state``, and the best of those of all passes so far: the least ``r``, the first of equal ones."""
    n, x, y, xx, xy, yy = (F.col(c) for c in ("n", "x", "y", "xx", "xy", "yy"))
    det = n * xx - x * x
    out = state.withColumn("a", F.coalesce(F.try_divide(xx * y - x * xy, det), F.lit(0.0))).withColumn("b", F.coalesce(F.try_divide(n * xy - x * y, det), F.lit(0.0)))
    a, b = F.col("a"), F.col("b")
    rest = F.greatest(n * a * a + b * b * xx + yy + 2 * a * b * x - 2 * a * y - 2 * b * xy, F.lit(0.0))
    total = F.greatest(yy - F.try_divide(y * y, n), F.lit(0.0))
    r = F.when(rest < 1e-30, 0.0).otherwise(F.sqrt(F.try_divide(rest, total)))
    here = F.struct(F.coalesce(r, F.lit(float("inf"))).alias("r"), F.lit(k).alias("k"), a.alias("a"), b.alias("b"), (F.col("pixels") - n).cast("long").alias("left"))
    return out.withColumn("best", F.when(F.col("best").isNull() | (here["r"] < F.col("best.r")), here).otherwise(F.col("best")))


def r_factor(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of absolute differences over the sum of absolute values of the first image."""
    return pairs.groupBy(*by).agg(F.try_divide(F.sum(F.abs(F.col("v1") - F.col("v2"))), F.sum(F.abs("v1"))).alias("r"))


def pearson(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlation; null where a side is constant."""
    c = F.try_divide(F.covar_pop("v1", "v2"), F.sqrt(F.var_pop("v1") * F.var_pop("v2")))
    return pairs.groupBy(*by).agg(c.alias("corr"))


def histogram_match(pairs: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """``pairs`` (by..., v1, v2, ...) with ``v``: the second image with the densities of the first.

    Counts at and above each bin, over each image's own range, are compared: a bin of the second image takes the
    density of the last bin of the first that has more above it, moved by how far the counts lie between two bins.
    A histogram is an array of ``bins`` numbers; nothing else of an image is gathered.
    """
    def bin_of(v: Column, low: Column, high: Column) -> Column:
        return F.least(F.greatest(F.floor(F.coalesce(F.try_divide((v - low) * bins, high - low), F.lit(0))), F.lit(0)), F.lit(bins - 1)).cast("int")

    ranges = pairs.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("v1", "v2") for n, f in (("lo", F.min), ("hi", F.max))])
    placed = pairs.join(ranges, list(by)).withColumns({f"b{k}": bin_of(F.col(f"v{k}"), F.col(f"lo_v{k}"), F.col(f"hi_v{k}")) for k in (1, 2)})
    side = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("b1").alias("bin")), F.struct(F.lit(2).alias("side"), F.col("b2").alias("bin"))))
    counts = placed.select(*by, side.alias("s")).groupBy(*by, "s.side", "s.bin").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy(*by).agg(*[F.collect_list(F.when(F.col("side") == k, F.struct("bin", "n"))).alias(f"c{k}") for k in (1, 2)])
    places = F.sequence(F.lit(0), F.lit(bins))

    def above(c: str) -> Column:
        """How many lie in each bin and above; 0 beyond the last."""
        return F.transform(places, lambda i: F.aggregate(c, F.lit(0).cast("long"), lambda s, e: s + F.when(e["bin"] >= i, e["n"]).otherwise(0)))

    held = held.select(*by, above("c1").alias("h1"), above("c2").alias("h2"))
    at = lambda h, i: F.get(h, i)
    more = lambda h2: F.greatest(F.size(F.filter(F.slice("h1", 1, bins), lambda c: c > at("h2", h2))) - 1, F.lit(0))
    held = held.withColumn("map", F.transform(F.slice(places, 1, bins), more))

    def density(i: Column) -> Column:
        m = at("map", i)
        inner = at("h1", m + 1) - at("h1", m) - at("h2", i + 1) + at("h2", i)
        last = at("h1", m) - F.coalesce(at("h1", F.greatest(m - 1, F.lit(0))), F.lit(0)) - at("h2", i) + at("h2", F.greatest(i - 1, F.lit(0)))
        return i + F.coalesce(F.try_divide((at("h2", i) - at("h1", m)).cast("double"), F.when(i < bins - 1, inner).otherwise(last)), F.lit(0.5))

    held = held.withColumn("place", F.transform(F.slice(places, 1, bins), density)).select(*by, "map", "place")
    value = at("place", at("map", F.col("b2"))) * (F.col("hi_v1") - F.col("lo_v1")) / bins + F.col("lo_v1")
    return placed.join(held, list(by)).withColumn("v", value).select(*pairs.columns, "v")


def bin_volume(df: DataFrame, by: Sequence[str], axes: Sequence[str], factor: int) -> DataFrame:
    """Sums of blocks over the full block's size, so that partial blocks at the edge are diluted."""
    cells = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in axes]
    return df.groupBy(*by, *cells).agg((F.sum("v") / factor ** len(axes)).alias("v"))


def median_bin(df: DataFrame, by: Sequence[str], axes: Sequence[str], factor: int) -> DataFrame:
    cells = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in axes]
    return df.groupBy(*by, *cells).agg(F.percentile("v", 0.5).alias("v"))


def shift_image(df: DataFrame, shifts: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """Places moved by whole voxels, wrapping round."""
    return df.withColumns({a: F.pmod(F.col(a) + s, F.lit(sizes[a])).cast("int") for a, s in shifts.items()})


def triangle_sample(df: DataFrame, by: Sequence[str], sizes: dict[str, int], factor: int) -> DataFrame:
    """Images on a grid ``factor`` times as wide, each place the mean of those about it with weights that fall off to ``factor``.

    The new sizes are odd, and the middles fall together.
    """
    out = df.withColumn("w", F.lit(1.0))
    for a, n in sizes.items():
        new = (n + 1) // factor
        new -= 1 - new % 2
        d = F.col(a) - n // 2
        low = F.floor(d / factor)
        far = d - low * factor
        near = F.array(F.struct(low.alias("k"), ((factor - far) / factor**2).alias("f")), F.struct((low + 1).alias("k"), (far / factor**2).alias("f")))
        out = out.withColumn("n", F.explode(near)).withColumn(a, (F.col("n.k") + new // 2).cast("int")).withColumn("w", F.col("w") * F.col("n.f"))
        out = out.filter((F.col("w") > 0) & F.col(a).between(0, new - 1)).drop("n")
    return out.groupBy(*by, *sizes).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def rotate(df: DataFrame, by: Sequence[str], sizes: tuple[int, int], degrees: float, scale: float = 1.0, move: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Images (px, py, v) turned about their middle, scaled and moved: each pixel is split over the four places it
    lands between, and sums are divided by the weights there; places that nothing reaches are absent."""
    c, s = float(np.cos(np.radians(degrees))) * scale, float(np.sin(np.radians(degrees))) * scale
    mx, my = (sizes[0] - 1) / 2, (sizes[1] - 1) / 2
    dx, dy = F.col("px") - mx, F.col("py") - my
    out = df.withColumn("ax", F.round(dx * c - dy * s + mx + move[0], 9)).withColumn("ay", F.round(dx * s + dy * c + my + move[1], 9))
    for new, at in (("qx", "ax"), ("qy", "ay")):
        low, far = F.floor(at), F.col(at) - F.floor(at)
        out = out.withColumn(new, F.explode(F.array(F.struct(low.alias("p"), (1 - far).alias("w")), F.struct((low + 1).alias("p"), far.alias("w")))))
    w = F.col("qx.w") * F.col("qy.w")
    flat = out.select(*by, F.col("qx.p").cast("int").alias("px"), F.col("qy.p").cast("int").alias("py"), "v", w.alias("w"))
    kept = flat.filter((F.col("w") > 1e-9) & F.col("px").between(0, sizes[0] - 1) & F.col("py").between(0, sizes[1] - 1))
    return kept.groupBy(*by, "px", "py").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def resize_transform(df: DataFrame, by: Sequence[str], sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """A transform (k<axis>, re, im) cut or padded with zeros to new sizes; ``sizes``: old and new size of each axis.

    As many frequencies stay on either side as the smaller size has.
    """
    kept, grid = df, df.select(*by).distinct()
    for a, (old, new) in sizes.items():
        half, upto = (min(old, new) - 1) // 2, min(old, new) // 2
        kept = kept.filter(F.col(f"k{a}").between(-upto, half))
        grid = grid.withColumn(f"k{a}", F.explode(F.sequence(F.lit(-(new // 2)), F.lit((new - 1) // 2))))
    keys = [*by, *[f"k{a}" for a in sizes]]
    return grid.join(kept.select(*keys, "re", "im"), keys, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("re", "im")})


def whole_spectrum(half: DataFrame, by: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    """All frequencies from those whose last axis is not negative (or at its least, for even sizes): the others are the
    conjugates of their opposites."""
    axes = list(sizes)
    last, n = axes[-1], sizes[axes[-1]]
    opposite = {f"k{a}": (F.pmod(-F.col(f"k{a}") + m // 2, F.lit(m)) - m // 2).cast("int") for a, m in sizes.items()}
    mirrored = half.filter((F.col(f"k{last}") > 0) & (F.col(f"k{last}") * 2 != n)).withColumns({**opposite, "im": -F.col("im")})
    return half.unionByName(mirrored)


def centred(k: Column, n: int) -> Column:
    """A frequency in FFT order, 0 to n - 1, as one about 0; ``standard`` is the way back."""
    return (F.pmod(k + n // 2, F.lit(n)) - n // 2).cast("int")


def standard(k: Column, n: int) -> Column:
    return F.pmod(k, F.lit(n)).cast("int")


def polar(df: DataFrame) -> DataFrame:
    """``amp, phi`` from ``re, im``."""
    return df.withColumn("amp", F.hypot("re", "im")).withColumn("phi", F.atan2("im", "re"))


def cartesian(df: DataFrame) -> DataFrame:
    """``re, im`` from ``amp, phi``."""
    return df.withColumn("re", F.col("amp") * F.cos("phi")).withColumn("im", F.col("amp") * F.sin("phi"))


def complex_product(pairs: DataFrame, mask: Column | None = None) -> DataFrame:
    """``re, im`` of the first transform times the conjugate of the second, 0 where masked out."""
    re, im = F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2"), F.col("im1") * F.col("re2") - F.col("re1") * F.col("im2")
    if mask is not None:
        re, im = F.when(mask, re).otherwise(0.0), F.when(mask, im).otherwise(0.0)
    return pairs.withColumn("re", re).withColumn("im", im)


def phase_difference(pairs: DataFrame, least: float = 1e-9) -> DataFrame:
    """``cosine`` and ``phase`` of the difference in phase at each frequency; those without power in one of both go."""
    n = F.hypot("re1", "im1") * F.hypot("re2", "im2")
    cosine = F.greatest(F.least((F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2")) / F.col("power"), F.lit(1.0)), F.lit(-1.0))
    return pairs.withColumn("power", n).filter(F.col("power") > least).withColumn("cosine", cosine).withColumn("phase", F.acos("cosine")).drop("power")


def extract_region(df: DataFrame, region: dict[str, tuple[int, int]]) -> DataFrame:
    """The places within start and size of each axis, counted from the start."""
    for a, (start, size) in region.items():
        df = df.filter(F.col(a).between(start, start + size - 1)).withColumn(a, F.col(a) - start)
    return df


def slices_as_images(voxels: DataFrame, depth: int) -> DataFrame:
    """Each section of a volume as an image ``vol_id * depth + z``."""
    return voxels.withColumn("img", F.col("vol_id") * depth + F.col("z")).drop("vol_id", "z")


def images_as_slices(images: DataFrame, depth: int) -> DataFrame:
    return images.withColumn("vol_id", F.floor(F.col("img") / depth)).withColumn("z", (F.col("img") % depth).cast("int")).drop("img")


def metadata(volumes: DataFrame) -> DataFrame:
    """``oz, ox, oy``: the middle as origin; ``unit``: one sampling for all axes, the smallest; ``radius``: of the largest sphere inside."""
    middle = {f"o{a}": (F.col(f"n{a}") - 1) / 2 for a in "zxy"}
    return volumes.withColumns({**middle, "unit": F.least("uz", "ux", "uy"), "radius": F.floor(F.least("nz", "nx", "ny") / 2).cast("int")})


def blend(pairs: DataFrame, steps: int) -> DataFrame:
    """``steps`` images from v1 to v2."""
    k = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    return pairs.withColumn("step", k).withColumn("v", F.col("v1") + (F.col("v2") - F.col("v1")) * F.col("step") / (steps - 1))


def merge_amplitude_phase(pairs: DataFrame) -> DataFrame:
    """Amplitudes of ``re1, im1`` with the phases of ``re2, im2``."""
    size = F.hypot("re1", "im1")
    other = F.hypot("re2", "im2")
    return pairs.withColumn("re", F.try_divide(size * F.col("re2"), other)).withColumn("im", F.try_divide(size * F.col("im2"), other))

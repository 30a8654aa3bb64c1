"""Fourier shell correlation of volumes and slices as joins and groupings.

Volumes are voxel tables ``(vol_id, z, x, y, v)``; a pair of tiles is a join of two of them. The
transform is relational and separable, one join with a small frequency table for each axis, or an FFT
on Arrow batches. Shell sums come first by exact index, and only then meet the rings that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import EPSILON, half

# --- tiles ------------------------------------------------------------------------------------------


def crop(voxels: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """Voxels of each tile of ``plan`` (tile, vol_id, z, x, y: its start), with places ``dz, dx, dy`` inside it.

    Tiles and voxels meet on the block of ``size`` voxels that holds them: a tile has up to eight, so this is an
    equi-join, and the exact bounds are its residual condition.
    """
    def blocks(first: Column) -> Column:
        low = F.floor(first / size)
        return F.explode(F.sequence(low, F.floor((first + size - 1) / size)))

    tiles = plan.select("tile", "vol_id", F.col("z").alias("z0"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    for a in "zxy":
        tiles = tiles.withColumn(f"b{a}", blocks(F.col(f"{a}0")))
    placed = voxels.withColumns({f"b{a}": F.floor(F.col(a) / size) for a in "zxy"})
    met = placed.join(tiles, ["vol_id", "bz", "bx", "by"])
    for a in "zxy":
        met = met.filter((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}0") + size))
    return met.select("tile", "vol_id", *[(F.col(a) - F.col(f"{a}0")).cast("int").alias(f"d{a}") for a in "zxy"], "v")


def tile_centre(first: Column, size: int) -> Column:
    """Start plus half the size, rounding down: a size of -1 gives one less than the start."""
    return first + half(F.lit(size))


def pair_stats(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean pixel, maxima, Pearson correlation and status of pairs of values ``v1, v2``.

    The correlation is null where a side is constant. A tile is ``empty`` unless both maxima are positive.
    """
    n, a, b = F.count(F.lit(1)), F.avg("v1"), F.avg("v2")
    sums = pairs.groupBy(*by).agg(
        n.alias("n"), a.alias("m1"), b.alias("m2"), F.max("v1").alias("max1"), F.max("v2").alias("max2"),
        F.covar_pop("v1", "v2").alias("cov"), F.var_pop("v1").alias("var1"), F.var_pop("v2").alias("var2"),
    )
    corr = F.try_divide("cov", F.sqrt(F.col("var1") * F.col("var2")))
    status = F.when((F.col("max1") > 0) & (F.col("max2") > 0), "ok").otherwise("empty")
    return sums.select(*by, "n", ((F.col("m1") + F.col("m2")) / 2).alias("mean_pix"), "max1", "max2", corr.alias("corr"), status.alias("status"))


def same_shape(headers: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of equal shape, others). ``headers``: vol_id, nz, nx, ny; ``pairs``: a, b."""
    shape = F.struct("nz", "nx", "ny")
    a, b = headers.select(F.col("vol_id").alias("a"), shape.alias("shape_a")), headers.select(F.col("vol_id").alias("b"), shape.alias("shape_b"))
    both = pairs.join(a, "a").join(b, "b")
    return both.filter("shape_a = shape_b").select("a", "b"), both.filter("shape_a <> shape_b").select("a", "b")


# --- windows ----------------------------------------------------------------------------------------


def plain_hann(n: int, i: Column) -> Column:
    """Hann window over ``n`` points, zero at both ends."""
    return 0.5 - 0.5 * F.cos(2 * np.pi * i / (n - 1)) if n > 1 else F.lit(1.0)


def fractional_hann(n: int, i: Column, flat: int = 0) -> Column:
    """Cosine window of period ``n`` with its top at place 0, as FFT order has it.

    With ``flat`` points left as they are, the edge has a period of ``n + 1 - flat`` and begins ``(flat - 1) // 2``
    places from the corner; the places before it, and those from ``n + 3 - flat`` after it on, are one.
    """
    if not flat:
        return 0.5 + 0.5 * F.cos(2 * np.pi * i / n)
    first = (flat - 1) // 2
    return F.when((i < first) | (i >= first + n + 3 - flat), 1.0).otherwise(0.5 + 0.5 * F.cos(2 * np.pi * (i - first) / (n + 1 - flat)))


def hann_padded(n: int, size: int, i: Column, flat: int) -> Column:
    """The fractional window of ``size`` points, its top in the middle, among ``n`` places that are zero elsewhere."""
    if size > n or flat > size:
        raise ValueError("the window must fit, and its flat part must fit into it")
    j = i - round(n / 2 - size / 2)
    return F.when((j >= 0) & (j < size), fractional_hann(size, F.pmod(j - size // 2, F.lit(size)), max(flat, 0))).otherwise(0.0)


def circle(nx: int, ny: int, x: Column, y: Column, taper: int) -> Column:
    """One within a radius, a cosine edge of ``taper`` beyond it, zero outside; about the middle rounded half to even.

    The radius comes from the first axis given."""
    free = round(nx / 2) - taper
    r = F.sqrt((x - round(nx / 2)) * (x - round(nx / 2)) + (y - round(ny / 2)) * (y - round(ny / 2)))
    return F.when(r <= free, 1.0).when(r >= free + taper, 0.0).otherwise(0.5 + 0.5 * F.cos(np.pi * (r - free) / taper)) if taper else F.when(r <= free, 1.0).otherwise(0.0)


def window3d(nz: int, nx: int, ny: int, rad: int, ax: int) -> Column:
    """Circle over x and y, of y's radius, times a cosine window along z, on columns ``dz, dx, dy``."""
    return circle(ny, nx, F.col("dy"), F.col("dx"), rad) * hann_padded(nz, nz, F.col("dz"), max(nz - 2 * ax, 0))


def window_array(shape: tuple[int, ...], rad: int, ax: int) -> np.ndarray:
    """``window3d`` as an array, the circle alone for two axes."""
    *rest, nx, ny = shape
    x, y = np.arange(nx)[:, None] - np.round(nx / 2), np.arange(ny)[None, :] - np.round(ny / 2)
    r, free = np.hypot(x, y), np.round(ny / 2) - rad
    disc = np.where(r <= free, 1.0, np.where(r >= free + rad, 0.0, 0.5 + 0.5 * np.cos(np.pi * (r - free) / max(rad, 1))))
    if not rest:
        return disc
    n, flat = rest[0], max(rest[0] - 2 * ax, 0)
    i, first = (np.arange(n) - n // 2) % n, (flat - 1) // 2 if flat else 0
    edge = 0.5 + 0.5 * np.cos(2 * np.pi * (i - first) / (n + 1 - flat if flat else n))
    if flat:
        edge = np.where((i < first) | (i >= first + n + 3 - flat), 1.0, edge)
    return edge[:, None, None] * disc[None]


# --- transform --------------------------------------------------------------------------------------


def frequency_table(spark: SparkSession, n: int) -> DataFrame:
    """``i, k, c, s``: cosine and minus sine of each place and centred frequency; ``n`` squared rows."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(n).select((F.col("id") - n // 2).cast("int").alias("k")))
    angle = 2 * np.pi * F.col("i") * F.col("k") / n
    return rows.select("i", "k", F.cos(angle).alias("c"), (-F.sin(angle)).alias("s"))


def dft(tiles: DataFrame, by: Sequence[str], axes: Sequence[tuple[str, int]]) -> DataFrame:
    """``by..., k<axis>..., re, im`` of values ``v`` at places ``d<axis>``, one axis after the other."""
    spark = tiles.sparkSession
    out, done, left = tiles.withColumn("re", F.col("v").cast("double")).withColumn("im", F.lit(0.0)), [], [a for a, _ in axes]
    for axis, n in axes:
        table = F.broadcast(frequency_table(spark, n)).withColumnRenamed("k", f"k{axis}")
        left = left[1:]
        keys = [*by, *[f"d{a}" for a in left], *done, f"k{axis}"]
        joined = out.join(table, F.col(f"d{axis}") == F.col("i"))
        out = joined.groupBy(*keys).agg(F.sum(F.col("re") * F.col("c") - F.col("im") * F.col("s")).alias("re"), F.sum(F.col("re") * F.col("s") + F.col("im") * F.col("c")).alias("im"))
        done.append(f"k{axis}")
    return out


def fft_kernel(rows: DataFrame, by: str, values: str, shape: tuple[int, ...]) -> DataFrame:
    """``by, re, im`` with arrays in centred frequency order, by FFT on Arrow batches; ``values``: a row-major array."""
    return fft_arrays(rows, by, [values], shape).withColumnsRenamed({"re1": "re", "im1": "im"})


def fft_arrays(rows: DataFrame, by: str, values: Sequence[str], shape: tuple[int, ...]) -> DataFrame:
    """``by, re1, im1, re2, im2, ...``: the transforms of several row-major arrays of a row, together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {by: frame[by]}
            for n, name in enumerate(values, 1):
                cube = np.stack([np.asarray(v, dtype=np.float64).reshape(shape) for v in frame[name]]) if len(frame) else np.zeros((0, *shape))
                axes = tuple(range(1, cube.ndim))
                made = np.fft.fftshift(np.fft.fftn(cube, axes=axes), axes=axes).reshape(len(frame), -1)
                out |= {f"re{n}": list(made.real), f"im{n}": list(made.imag)}
            yield pd.DataFrame(out)

    fields = ", ".join(f"re{n} array<double>, im{n} array<double>" for n in range(1, len(values) + 1))
    return rows.select(by, *values).mapInPandas(run, f"{by} long, {fields}")


def frequencies(spectra: DataFrame, by: Sequence[str], axes: Sequence[tuple[str, int]]) -> DataFrame:
    """A row for each frequency of ``fft_arrays``: ``by..., k<axis>...`` and the values."""
    names = [c for c in spectra.columns if c not in by]
    flat = spectra.select(*by, F.posexplode(F.arrays_zip(*names)).alias("i", "c"))
    place, below = {}, 1
    for axis, n in reversed(axes):
        place[f"k{axis}"] = (F.floor(F.col("i") / below) % n - n // 2).cast("int")
        below *= n
    return flat.select(*by, *[place[f"k{a}"].alias(f"k{a}") for a, _ in axes], *[F.col(f"c.{c}").alias(c) for c in names])


# --- shells -----------------------------------------------------------------------------------------


def shell_index(axes: Sequence[tuple[str, int]], compat: bool = False) -> Column:
    """Radius of a centred frequency, axes scaled to the longest, rounded half to even.

    ``compat`` counts an axis of odd size from one place beside its zero, the last place wrapped round, as results
    made with the inverse shift in place of the forward one do.
    """
    longest = max(n for _, n in axes)
    total = None
    for a, n in axes:
        k = F.col(f"k{a}")
        if compat and n % 2:
            k = F.when(k < n // 2, k + 1).otherwise(-(n // 2))
        k = k * F.lit((longest // 2) / (n // 2) if n > 1 else 0.0)
        total = k * k if total is None else total + k * k
    return F.rint(F.sqrt(total)).cast("int")


def nyquist_axis(*sizes: Column) -> Column:
    """Rings from 0 to half the longest axis."""
    return F.sequence(F.lit(0), F.floor(F.greatest(*sizes) / 2).cast("int"))


def shell_sums(pairs: DataFrame, by: Sequence[str], index: Column, rings: int, nyquist: int) -> DataFrame:
    """Sums of ``re1, im1, re2, im2`` over rings ``f`` of thickness ``rings``: |index - f| <= rings // 2, or equal at 0."""
    exact = pairs.withColumn("index", index).groupBy(*by, "index").agg(
        F.sum(F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2")).alias("cr"),
        F.sum(F.col("im1") * F.col("re2") - F.col("re1") * F.col("im2")).alias("ci"),
        F.sum(F.col("re1") * F.col("re1") + F.col("im1") * F.col("im1")).alias("c1"),
        F.sum(F.col("re2") * F.col("re2") + F.col("im2") * F.col("im2")).alias("c2"),
        F.count(F.lit(1)).alias("npts"),
    )
    return rings_of(exact, by, rings, nyquist)


def rings_of(exact: DataFrame, by: Sequence[str], rings: int | Column, nyquist: int | Column) -> DataFrame:
    """Sums by exact index spread over the rings that hold it."""
    reach = F.floor((F.lit(rings) if isinstance(rings, int) else rings) / 2).cast("int")
    near = F.explode(F.sequence(F.col("index") - reach, F.col("index") + reach))
    spread = exact.withColumn("f", near).filter(F.col("f").between(0, nyquist))
    return spread.groupBy(*by, "f").agg(*[F.sum(c).alias(c) for c in ("cr", "ci", "c1", "c2", "npts")])


def threshold(npts: Column, snr: float | Column) -> Column:
    """The correlation that a signal-to-noise ratio gives over so many points (0.2071: half a bit, 0.5: one bit)."""
    root = F.sqrt(npts + EPSILON)
    side = snr**0.5 if isinstance(snr, (int, float)) else F.sqrt(snr)
    top = snr + 2 * side / root + 1 / F.sqrt(npts)
    return top / (snr + 2 * side / root + 1)


def fsc(sums: DataFrame, snr: float | Column = 0.2071) -> DataFrame:
    """``fsc`` and threshold ``t`` for each ring; null where a side has no power."""
    size = F.sqrt(F.col("cr") * F.col("cr") + F.col("ci") * F.col("ci"))
    return sums.withColumn("fsc", F.try_divide(size, F.sqrt(F.col("c1") * F.col("c2")))).withColumn("t", threshold(F.col("npts"), snr))


def crossing(curve: DataFrame, by: Sequence[str], nyquist: Column, mode: str = "first", compat: bool = False) -> DataFrame:
    """``x`` in units of the Nyquist frequency where ``fsc`` falls below ``t``, interpolated with the ring before.

    ``first`` takes the first ring below, ``last`` the last downward crossing. Without one, or at ring 0, the result is
    null with status ``no_crossing``; ``compat`` gives what wrapping round to the last ring gives instead.
    """
    window = Window.partitionBy(*by).orderBy("f")
    d = F.col("fsc") - F.col("t")
    marked = curve.withColumn("d", d).withColumn("before", F.lag("d").over(window))
    below = F.col("d") < 0 if mode == "first" else (F.col("d") < 0) & (F.col("before") >= 0)
    place = F.col("f") - 1 + F.try_divide("before", F.col("before") - F.col("d"))
    pick = F.min_by if mode == "first" else F.max_by
    found = marked.groupBy(*by).agg(
        pick(F.struct("f", place.alias("place"), "d"), F.when(below, F.col("f"))).alias("hit"),
        F.min_by("d", "f").alias("d0"), F.max_by("d", "f").alias("dn"), nyquist.alias("fn"),
    )
    crossed = F.col("hit.f") >= 1
    x = F.when(crossed, F.col("hit.place") / F.col("fn"))
    if compat:  # the ring before ring 0 is then the last one, a whole axis away
        x = F.coalesce(x, 1 - F.try_divide("dn", F.col("dn") - F.col("d0")))
    return found.select(*by, x.alias("x"), F.when(crossed, "ok").otherwise("no_crossing").alias("status"))


def to_resolution(df: DataFrame, pixel_size: Column) -> DataFrame:
    """``res`` = pixel size over ``x``."""
    return df.withColumn("res", F.try_divide(pixel_size, "x"))


# --- the measurement as a job -------------------------------------------------------------------------


def _as_array(data) -> np.ndarray:
    return np.frombuffer(data, "<f4") if isinstance(data, (bytes, bytearray, memoryview)) else np.asarray(data, np.float32)


def crop_bricks(bricks: DataFrame, plan: DataFrame, edges: tuple[int, int, int], shape: tuple[int, int, int] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """``vol_id, tile, side, places, values``: the parts of each tile of ``plan`` (tile, side, vol_id, z, x, y: its start), and
    the columns ``also`` of the plan.

    Tiles have one ``shape``, or each its own as ``sz, sx, sy``. ``bricks`` (vol_id, bz, bx, by, z0, x0, y0, nz, nx, ny, data:
    binary of floats, or an array) have ``edges`` voxels a side, less at the end of a volume. Tiles and bricks meet on the brick
    number, and a tile's part is cut out of the brick where they meet, so only voxels of tiles are shuffled after that.
    ``places``: start and size of the part in the tile.
    """
    sizes = [F.col(f"s{a}").cast("long") if shape is None else F.lit(n).cast("long") for a, n in zip("zxy", shape or (0, 0, 0))]
    tiles = plan.select("tile", "side", "vol_id", *[F.col(a).alias(f"t{a}") for a in "zxy"], *[s.alias(f"tile_{a}") for a, s in zip("zxy", sizes)], *[F.col(c).alias(f"also_{c}") for c in also])
    for a, edge in zip("zxy", edges):
        tiles = tiles.withColumn(f"b{a}", F.explode(F.sequence(F.floor(F.col(f"t{a}") / edge), F.floor((F.col(f"t{a}") + F.col(f"tile_{a}") - 1) / edge))))
    met = bricks.withColumns({f"b{a}": F.col(f"b{a}").cast("long") for a in "zxy"}).join(tiles, ["vol_id", "bz", "bx", "by"])
    carried = ["vol_id", "tile", "side", *[f"also_{c}" for c in also]]
    columns = [*carried, *[f"t{a}" for a in "zxy"], *[f"tile_{a}" for a in "zxy"], *[f"{a}0" for a in "zxy"], *[f"n{a}" for a in "zxy"], "data"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame[columns].itertuples(index=False):
                own, numbers, data = row[: len(carried)], row[len(carried) : -1], row[-1]
                first, shape, at, size = numbers[:3], numbers[3:6], numbers[6:9], numbers[9:12]
                low = [max(f, z) for f, z in zip(first, at)]
                high = [min(f + n, z + m) for f, n, z, m in zip(first, shape, at, size)]
                if all(a < b for a, b in zip(low, high)):
                    part = _as_array(data).reshape(size)[tuple(slice(a - z, b - z) for a, b, z in zip(low, high, at))]
                    out.append((*own, [*[a - f for a, f in zip(low, first)], *part.shape], part.ravel()))
            yield pd.DataFrame(out, columns=[*carried, "places", "values"])

    kinds = {f.name: f.dataType.simpleString() for f in plan.schema}
    named = ", ".join([f"vol_id {kinds['vol_id']}", f"tile {kinds['tile']}", "side int", *[f"also_{c} {kinds[c]}" for c in also]])
    made = met.select(*columns).mapInPandas(run, f"{named}, places array<int>, values array<float>")
    return made.withColumnsRenamed({f"also_{c}": c for c in also})


def assemble(parts: Sequence, shape: tuple[int, int, int], sides: int) -> tuple[np.ndarray, bool]:
    """``sides`` tiles from their parts, and whether these cover them; NaN where none does."""
    out = np.full((sides, *shape), np.nan, np.float32)
    n = 0
    for p in parts:
        z, x, y, a, b, c = p["places"]
        out[p["side"] - 1, z : z + a, x : x + b, y : y + c] = np.asarray(p["values"], np.float32).reshape(a, b, c)
        n += a * b * c
    return out, n >= out.size


def measure_tile(pair: np.ndarray, window: np.ndarray, index: np.ndarray) -> tuple:
    """Mean, status, correlation, and shell sums by exact index of two arrays of one shape."""
    a, b = pair.astype(np.float64)
    mean = (a.mean() + b.mean()) / 2
    spread = a.std() * b.std()
    corr = float(((a - a.mean()) * (b - b.mean())).mean() / spread) if spread > 0 else None
    if not (a.max() > 0 and b.max() > 0):
        return float(mean), "empty", corr, []
    f1, f2 = (np.fft.fftshift(np.fft.fftn(v * window)).ravel() for v in (a, b))
    cross = f1 * np.conj(f2)
    sums = [np.bincount(index, w) for w in (cross.real, cross.imag, np.abs(f1) ** 2, np.abs(f2) ** 2)]
    counts = np.bincount(index)
    found = [{"index": int(i), "cr": float(sums[0][i]), "ci": float(sums[1][i]), "c1": float(sums[2][i]), "c2": float(sums[3][i]), "npts": int(counts[i])} for i in np.flatnonzero(counts)]
    return float(mean), "ok", corr, found


def index_array(shape: tuple[int, ...], compat: bool = False) -> np.ndarray:
    """``shell_index`` of every place of a centred transform, in row-major order."""
    longest, total = max(shape), 0.0
    for d, n in enumerate(shape):
        k = np.arange(n) - n // 2
        if compat and n % 2:
            k = np.where(k < n // 2, k + 1, -(n // 2))
        scaled = k * ((longest // 2) / (n // 2) if n > 1 else 0.0)
        total = total + (scaled**2).reshape([-1 if i == d else 1 for i in range(len(shape))])
    return np.round(np.sqrt(total)).astype(np.int64).ravel()


def tile_curves(bricks: DataFrame, pairs: DataFrame, edges: tuple[int, int, int], shape: tuple[int, int, int], ring: int = 6, rad: int = 60, ax: int = 60, snr: float = 0.2071, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``tile, mean_pix, status, corr``, ``tile, f, fsc, t, ...``) for tiles of two volumes.

    ``pairs``: tile, a, b (volumes), z, x, y (start). ``shape`` (z, x, y) may have one axis of size 1: a slice, whose
    window is the circle alone. A tile beyond its volumes, or in one only, has the status ``incomplete``; an
    ``empty`` one has no positive voxel in one of them.
    """
    measured = _measured(bricks, _with_parameters(pairs, shape, ring, rad, ax, snr), edges, compat)
    return measured.select("tile", "mean_pix", "status", "corr"), _curves(measured).drop("snr", "nyquist")


#: What a measurement is asked for beside its tile: size, ring thickness, apodisation and signal-to-noise ratio.
PARAMETERS = ["sz", "sx", "sy", "ring", "rad", "ax", "snr"]


def _with_parameters(pairs: DataFrame, shape, ring: int, rad: int, ax: int, snr: float) -> DataFrame:
    sizes = {f"s{a}": F.lit(int(n)) for a, n in zip("zxy", shape)}
    return pairs.withColumns({**sizes, "ring": F.lit(ring), "rad": F.lit(rad), "ax": F.lit(ax), "snr": F.lit(float(snr))})


def _measured(bricks: DataFrame, pairs: DataFrame, edges, compat: bool) -> DataFrame:
    side = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("vol_id")), F.struct(F.lit(2).alias("side"), F.col("b").alias("vol_id"))))
    plan = pairs.select("tile", "z", "x", "y", *PARAMETERS, side.alias("s")).select("tile", "s.side", "s.vol_id", "z", "x", "y", *PARAMETERS)
    parts = crop_bricks(bricks, plan, edges, also=PARAMETERS)
    # a tile's parts: its own voxels, twice
    tiles = parts.groupBy("tile", *PARAMETERS).agg(F.collect_list(F.struct("side", "places", "values")).alias("parts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, window, index = None, None, None
        for frame in frames:
            # the rows of a batch by what they share, so that one window and one index are held
            for key, rows in frame.groupby(["sz", "sx", "sy", "rad", "ax"], sort=False):
                shape, flat = tuple(map(int, key[:3])), tuple(int(n) for n in key[:3] if n > 1)
                if made != key:
                    made, window, index = key, window_array(flat, int(key[3]), int(key[4])), index_array(flat, compat)
                out = []
                for tile, ring, snr, found in rows[["tile", "ring", "snr", "parts"]].itertuples(index=False):
                    pair, whole = assemble(found, shape, 2)
                    out.append((tile, ring, snr, max(shape) // 2, *(measure_tile(pair.reshape(2, *flat), window, index) if whole else (None, "incomplete", None, []))))
                yield pd.DataFrame(out, columns=["tile", "ring", "snr", "nyquist", "mean_pix", "status", "corr", "sums"])

    tile = pairs.schema["tile"].dataType.simpleString()
    return tiles.mapInPandas(run, f"tile {tile}, ring int, snr double, nyquist int, mean_pix double, status string, corr double, sums array<struct<index:int,cr:double,ci:double,c1:double,c2:double,npts:long>>")


def _curves(measured: DataFrame) -> DataFrame:
    sums = measured.select("tile", "ring", "snr", "nyquist", F.inline("sums"))
    return fsc(rings_of(sums, ["tile", "snr", "nyquist"], F.col("ring"), F.col("nyquist")), F.col("snr"))


def resolution_measure(bricks: DataFrame, pairs: DataFrame, edges: tuple[int, int, int], shape: tuple[int, int, int], pixel_size: float, ring: int = 6, rad: int = 60, ax: int = 60, snr: float = 0.2071, compat: bool = False) -> DataFrame:
    """Result rows ``tile, z, x, y, res, mean, corr, status`` of the tiles of ``pairs``; z, x, y are their centres.

    The whole measurement: tiles are cut from bricks, transformed, summed over shells and rings, and the first
    crossing of the threshold gives the resolution. ``res`` is -1 for an empty tile and null where the curve does
    not cross (``compat``: what wrapping round gives there, and the centring of odd sizes that goes with it).
    Options are those of ``tile_curves``.
    """
    return resolution_sweep(bricks, _with_parameters(pairs, shape, ring, rad, ax, snr), edges, pixel_size, compat)


def resolution_sweep(bricks: DataFrame, plan: DataFrame, edges: tuple[int, int, int], pixel_size: float, compat: bool = False) -> DataFrame:
    """``resolution_measure`` of tiles each with its own size, ring thickness, apodisation and threshold, in one job.

    ``plan``: tile, a, b, z, x, y (start) and ``sz, sx, sy, ring, rad, ax, snr``; a row of results for each of its
    rows, by the number ``tile``. ``sweep_tiles`` makes a plan of a parameter sweep.
    """
    measured = _measured(bricks, plan, edges, compat)
    found = crossing(_curves(measured), ["tile", "nyquist"], F.max("nyquist"), compat=compat).select("tile", F.col("x").alias("crossed"), F.col("status").alias("curve"))
    rows = measured.select("tile", "mean_pix", "status", "corr").join(found, "tile", "left")
    rows = rows.join(plan.select("tile", *[(F.col(a) + half(F.col(f"s{a}"))).alias(a) for a in "zxy"]), "tile")
    res = F.when(F.col("status") == "empty", -1.0).otherwise(F.try_divide(F.lit(float(pixel_size)), "crossed"))
    status = F.when(F.col("status") == "ok", F.coalesce("curve", F.lit("no_crossing"))).otherwise(F.col("status"))
    return rows.select("tile", "z", "x", "y", res.alias("res"), F.col("mean_pix").alias("mean"), "corr", status.alias("status"))


def sweep_tiles(pairs: DataFrame, swept: DataFrame, cube: int = 45, ring: int = 6, apod: int = 60, snr: float = 0.2071) -> DataFrame:
    """The plan of a sweep: for each row of ``swept`` (pair, param, value; ``grids.sweep_plan``) a cube in the middle of the
    volumes of its pair (pair, a, b, nz, nx, ny) with one parameter changed: ``cube_size``, ``apod`` (both ways) or ``rt``.

    ``tile`` is ``pair|param|value``.
    """
    def of(name: str, base: int) -> Column:
        return F.when(F.col("param") == name, F.col("value")).otherwise(F.lit(base)).cast("int")

    met = swept.select("pair", "param", "value").join(pairs.select("pair", "a", "b", "nz", "nx", "ny"), "pair")
    met = met.withColumn("tile", F.concat_ws("|", F.col("pair").cast("string"), "param", F.col("value").cast("string"))).withColumn("cube", of("cube_size", cube))
    start = {a: half(F.col(f"n{a}")) - half(F.col("cube")) for a in "zxy"}
    made = met.withColumns({**start, **{f"s{a}": F.col("cube") for a in "zxy"}, "ring": of("rt", ring), "rad": of("apod", apod), "ax": of("apod", apod), "snr": F.lit(float(snr))})
    return made.select("tile", "pair", "param", "value", "a", "b", "z", "x", "y", *PARAMETERS)

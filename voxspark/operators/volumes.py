"""Whole volumes as bricks: regions, transforms by transposition, correlation over halos, projections.

A volume never is one value. Its bricks (vol_id, bz, bx, by, z0, x0, y0, nz, nx, ny, data) meet in sections of
one z, whose 2-D transforms are cut into blocks of frequencies; a block of all sections is transformed along
z. What is shuffled is the volume once as sections and once as blocks, and no row is larger than either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crossval import shell_correlation, taper_size, wedge_angles

Shape = tuple[int, int, int]
BRICK = ["vol_id", "bz", "bx", "by", "z0", "x0", "y0", "nz", "nx", "ny", "data"]

# --- regions ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Region:
    """A box (``start``, ``size``) or a sphere (``centre``, ``radius``) along z, x and y; places of ``inner`` do not belong to it."""

    start: tuple[float, ...] | None = None
    size: tuple[float, ...] | None = None
    centre: tuple[float, ...] | None = None
    radius: float | None = None
    inner: Region | None = None

    @classmethod
    def whole(cls, shape: Sequence[int]) -> Region:
        return cls(start=(0.0,) * len(shape), size=tuple(map(float, shape)))

    @classmethod
    def largest_sphere(cls, shape: Sequence[int]) -> Region:
        """About the middle of a volume, a pixel short of half its shortest side."""
        return cls(centre=tuple((n - 1) / 2 for n in shape), radius=min(shape) / 2 - 1)

    def check(self, shape: Sequence[int]) -> Region:
        """The region, if it lies within a volume of ``shape``; else an error."""
        if self.radius is not None:
            ends = [(c - self.radius, c + self.radius) for c in self.centre]
        else:
            ends = [(s, s + n - 1) for s, n in zip(self.start, self.size)]
        if any(low < 0 or high > n - 1 for (low, high), n in zip(ends, shape)):
            raise ValueError("the region does not fit into the volume")
        if self.inner is not None:
            self.inner.check(shape)
        return self

    def distance(self, *places: np.ndarray) -> np.ndarray:
        """Distance of places inside to the border, and below zero outside; an inner sphere has a border too."""
        if self.radius is not None:
            out = self.radius - np.sqrt(sum((p - c) ** 2.0 for p, c in zip(places, self.centre)))
        else:
            sides = [np.minimum(p - s, s + n - 1 - p) for p, s, n in zip(places, self.start, self.size)]
            out = sides[0]
            for s in sides[1:]:
                out = np.minimum(out, s)
        if self.inner is not None:
            within = self.inner.distance(*places)
            out = np.where(within >= 0, -1.0, np.minimum(out, -within) if self.inner.radius is not None else out)
        return out

    def column_distance(self, *places: Column) -> Column:
        """``distance`` of columns of places."""
        if self.radius is not None:
            out = F.lit(float(self.radius)) - F.sqrt(sum(((p - c) * (p - c) for p, c in zip(places, self.centre)), F.lit(0.0)))
        else:
            out = F.least(*[F.least(p - s, F.lit(s + n - 1) - p) for p, s, n in zip(places, self.start, self.size)]).cast("double")
        if self.inner is None:
            return out
        within = self.inner.column_distance(*places)
        return F.when(within >= 0, -1.0).otherwise(F.least(out, -within) if self.inner.radius is not None else out)

    def inside(self, *places: Column) -> Column:
        """Whether columns of places lie in the region."""
        return self.column_distance(*places) >= 0

    def frame(self, *places: Column, width: float = 0.0) -> Column:
        """Whether columns of places lie in the region and within ``width`` of its border."""
        d = self.column_distance(*places)
        return (d >= 0) & (d <= width)

    def edge_width(self) -> float:
        """Width of its tapered edge."""
        return taper_size((self.radius,), radius=True) if self.radius is not None else taper_size(self.size)


def _places(z0: int, x0: int, y0: int, shape: Sequence[int]) -> list[np.ndarray]:
    return [np.arange(f, f + n).reshape([-1 if i == d else 1 for i in range(3)]) for d, (f, n) in enumerate(zip((z0, x0, y0), shape))]


def _doubles(data) -> np.ndarray:
    """Values of a brick: a binary of 4-byte floats, or an array."""
    return np.frombuffer(data, "<f4").astype(np.float64) if isinstance(data, (bytes, bytearray, memoryview)) else np.asarray(data, np.float64)


def _values(row) -> np.ndarray:
    return _doubles(row.data).reshape(row.nz, row.nx, row.ny)


def volume_stats(bricks: DataFrame, region: Region) -> DataFrame:
    """``vol_id, avg, std, background``: mean and deviation inside of a region, mean outside (0 where nothing is), from sums of bricks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                v = _values(row)
                inside = np.broadcast_to(region.distance(*_places(row.z0, row.x0, row.y0, v.shape)) >= 0, v.shape)
                a, b = v[inside], v[~inside]
                mean = a.mean() if len(a) else 0.0
                out.append((row.vol_id, len(a), a.sum(), ((a - mean) ** 2).sum(), mean * mean * len(a), len(b), b.sum()))
            yield pd.DataFrame(out, columns=["vol_id", "n", "s", "within", "means", "m", "t"])

    kind = bricks.schema["vol_id"].dataType.simpleString()
    sums = bricks.select(*BRICK).mapInPandas(run, f"vol_id {kind}, n long, s double, within double, means double, m long, t double")
    whole = sums.groupBy("vol_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "within", "means", "m", "t")])
    avg = F.try_divide("s", "n")
    # squares of bricks about their own means, and of these about that of all
    std = F.sqrt(F.greatest(F.try_divide(F.col("within") + F.col("means") - F.col("s") * avg, F.col("n")), F.lit(0.0)))
    return whole.select("vol_id", avg.alias("avg"), std.alias("std"), F.coalesce(F.try_divide("t", "m"), F.lit(0.0)).alias("background"))


# --- transforms ---------------------------------------------------------------------------------------

#: Frequencies of a block along x and y, and bytes of results that a task gathers before it hands them on.
BLOCK, HANDED = 64, 32_000_000


def _gathered(df: DataFrame, keys: Sequence[str], values: Sequence[str], kernel: Callable[[tuple, list], pd.DataFrame], schema: str) -> DataFrame:
    """``kernel`` of each group's keys and parts (rows of ``values``), many groups in one call: a frame for each would cost more than a small group."""
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(*values)).alias("parts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                made = kernel(tuple(row[: len(keys)]), row[-1])
                held.append(made)
                size += 16 * made.size + sum(len(v) for c in made if made[c].dtype == object for v in made[c] if isinstance(v, (bytes, np.ndarray)))
                if size > HANDED:
                    yield pd.concat(held)
                    held, size = [], 0
        if held:
            yield pd.concat(held)

    return rows.mapInPandas(run, schema)


Change = Callable[[np.ndarray, list[np.ndarray], object], np.ndarray]


def section_planes(bricks: DataFrame, members: DataFrame, shape: Shape, change: Change | None = None, block: int = BLOCK) -> DataFrame:
    """``run, side, kx0, ky0, z, re, im``: the half transforms of all sections in blocks.

    ``members`` (run, side, vol_id, ...) names the volumes; ``change`` makes new values of a brick from the old
    ones, its places and its row, which has the other columns of ``members``. A section that lacks a brick is an error.
    """
    others = [c for c in members.columns if c not in ("run", "side", "vol_id")]
    met = bricks.select(*BRICK).join(members, "vol_id")
    run_kind = members.schema["run"].dataType.simpleString()
    _, nx, ny = shape

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                v = _values(row)
                if change is not None:
                    v = change(v, _places(row.z0, row.x0, row.y0, v.shape), row)
                yield pd.DataFrame({"run": row.run, "side": row.side, "z": row.z0 + np.arange(row.nz), "x0": row.x0, "y0": row.y0, "nx": row.nx, "ny": row.ny, "data": [np.ascontiguousarray(s).tobytes() for s in v]})

    parts = met.select(*BRICK, "run", "side", *others).mapInPandas(slices, f"run {run_kind}, side int, z long, x0 long, y0 long, nx long, ny long, data binary")

    corners = [(x, y) for x in range(0, nx, block) for y in range(0, ny // 2 + 1, block)]

    def transform(key: tuple, rows: list) -> pd.DataFrame:
        section, filled = np.zeros((nx, ny)), 0
        for r in rows:
            section[r["x0"] : r["x0"] + r["nx"], r["y0"] : r["y0"] + r["ny"]] = np.frombuffer(r["data"]).reshape(r["nx"], r["ny"])
            filled += r["nx"] * r["ny"]
        if filled != nx * ny:
            raise ValueError(f"section {key[2]} holds {filled} of {nx * ny} voxels")
        made = np.fft.rfft2(section)
        cut = [made[x : x + block, y : y + block] for x, y in corners]
        return pd.DataFrame({"run": key[0], "side": key[1], "kx0": [x for x, _ in corners], "ky0": [y for _, y in corners], "z": key[2], "re": [c.real.tobytes() for c in cut], "im": [c.imag.tobytes() for c in cut]})

    return _gathered(parts, ["run", "side", "z"], ["x0", "y0", "nx", "ny", "data"], transform, f"run {run_kind}, side int, kx0 int, ky0 int, z long, re binary, im binary")


def signed(n: int) -> np.ndarray:
    """The frequency at each place of a transform, -n // 2 for the middle of an even size."""
    k = np.arange(n)
    return np.where(k > (n - 1) // 2, k - n, k)


Kernel = Callable[[dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def by_blocks(planes: DataFrame, shape: Shape, kernel: Kernel, schema: str, block: int = BLOCK) -> DataFrame:
    """``run`` and the columns of ``schema`` that ``kernel`` makes of each block of frequencies of a run.

    It gets the transform of each side (z first) and the frequencies along z, x and y of the block; of the last axis
    only those from 0 to half the size are there, see ``halves_of``.
    """
    nz, nx, ny = shape

    def run(key: tuple, rows: list) -> pd.DataFrame:
        _, kx0, ky0 = key
        kx, ky = signed(nx)[kx0 : kx0 + block], signed(ny)[ky0 : min(ky0 + block, ny // 2 + 1)]
        sides: dict[int, np.ndarray] = {}
        found: dict[int, int] = {}
        for r in rows:
            side = int(r["side"])
            if side not in sides:
                sides[side] = np.zeros((nz, len(kx), len(ky)), np.complex128)
            sides[side][r["z"]] = (np.frombuffer(r["re"]) + 1j * np.frombuffer(r["im"])).reshape(len(kx), len(ky))
            found[side] = found.get(side, 0) + 1
        if any(n != nz for n in found.values()):
            raise ValueError(f"a volume has {min(found.values())} of {nz} sections")
        out = kernel({side: np.fft.fft(cube, axis=0) for side, cube in sides.items()}, signed(nz), kx, ky)
        out.insert(0, "run", key[0])
        return out

    kind = planes.schema["run"].dataType.simpleString()
    return _gathered(planes, ["run", "kx0", "ky0"], ["side", "z", "re", "im"], run, f"run {kind}, {schema}")


def halves_of(ky: np.ndarray, ny: int) -> np.ndarray:
    """Whether a frequency of the half spectrum stands for its opposite too."""
    return ~((ky == 0) | ((ny % 2 == 0) & (np.abs(ky) == ny // 2)))


def _opposite(k: np.ndarray, n: int) -> np.ndarray:
    return np.where(2 * k == -n, k, -k)


Keep = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def shell_kernel(shape: Shape, scale: tuple[float, float, float], bin_size: float, count: int | None, keep: Keep | None) -> Kernel:
    """Sums ``idx, c, c1, c2, n`` of a block over the shells of ``crossval.physical_shells``, of the sides 1 and 2.

    ``keep``: which frequencies, given as kz, kx, ky, count; both of an opposite pair are asked.
    """

    def run(sides: dict[int, np.ndarray], kz: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> pd.DataFrame:
        grid = [kz[:, None, None], kx[None, :, None], ky[None, None, :]]
        radius = np.sqrt(sum((k * s) ** 2.0 for k, s in zip(grid, scale)))
        double = np.broadcast_to(halves_of(ky, shape[2])[None, None, :], radius.shape)
        if keep is None:
            weight = 1.0 + double
        else:
            weight = 1.0 * np.broadcast_to(keep(*grid), radius.shape) + 1.0 * double * keep(*[_opposite(k, n) for k, n in zip(grid, shape)])
        a, b = sides[1], sides[2]
        cross, one, two = (a * np.conj(b)).real, np.abs(a) ** 2, np.abs(b) ** 2
        low, high = np.floor(radius - bin_size / 2 + 1).astype(int), np.floor(radius + bin_size / 2).astype(int)
        some = weight > 0
        if count is not None:
            some &= np.floor(radius) + 1 < count
            high = np.minimum(high, count - 1)
        low, high = np.where(radius == 0, 0, np.maximum(low, 1)), np.where(radius == 0, 0, high)
        sums = np.zeros((4, max(int(high.max()) + 1, 1)))
        for more in range(math.ceil(bin_size) + 1):
            at = some & (low + more <= high)
            for k, v in enumerate((cross, one, two, np.ones_like(cross))):
                sums[k] += np.bincount((low + more)[at], (weight * v)[at], sums.shape[1])
        idx = np.flatnonzero(sums[3])
        return pd.DataFrame({"idx": idx, "c": sums[0, idx], "c1": sums[1, idx], "c2": sums[2, idx], "n": sums[3, idx].astype(np.int64)})

    return run


def correlation_kernel(shape: Shape, least: float = 1e-9) -> Kernel:
    """``kz, kx, ky, c``: the correlation of each frequency of the half spectrum, clipped to 0..1; without power in one side there is none."""

    def run(sides: dict[int, np.ndarray], kz: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> pd.DataFrame:
        a, b = sides[1], sides[2]
        power = np.abs(a) ** 2 * np.abs(b) ** 2
        z, x, y = np.nonzero(power > least)
        c = np.clip((a * np.conj(b)).real[z, x, y] / np.sqrt(power[z, x, y]), 0, 1)
        return pd.DataFrame({"kz": kz[z].astype(np.int32), "kx": kx[x].astype(np.int32), "ky": ky[y].astype(np.int32), "c": c})

    return run


def crop_kernel(shape: Shape, to: Shape) -> Kernel:
    """``kz, kx, ky, re, im``: the frequencies of the half spectrum that a volume of the smaller shape ``to`` has."""

    def run(sides: dict[int, np.ndarray], kz: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> pd.DataFrame:
        z, x, y = (np.flatnonzero((k >= -(n // 2)) & (k <= (n - 1) // 2) | (k == -(n // 2))) for k, n in zip((kz, kx, ky), to))
        part = sides[1][np.ix_(z, x, y)]
        grid = np.meshgrid(kz[z], kx[x], ky[y], indexing="ij")
        return pd.DataFrame({**{c: g.ravel().astype(np.int32) for c, g in zip(("kz", "kx", "ky"), grid)}, "re": part.real.ravel(), "im": part.imag.ravel()})

    return run


def _sides(pairs: DataFrame) -> DataFrame:
    side = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("vol_id")) for k, c in ((1, "a"), (2, "b"))]))
    return pairs.select("run", side.alias("s")).select("run", "s.side", "s.vol_id")


def _brought_to(region: Region, width: float | None) -> Change:
    """Side 1 with the mean and deviation of side 2 inside of a region, both with the background of side 2 outside and a cosine edge of ``width``."""

    def change(v: np.ndarray, places: list[np.ndarray], row) -> np.ndarray:
        distance = np.broadcast_to(region.distance(*places), v.shape)
        inside = distance >= 0
        if row.side == 1 and not row.fitted:
            v = (v - row.avg) * (row.like_std / row.std if row.std > 0 else 0.0) + row.like_avg
        elif row.side == 1:
            v = row.offset + row.slope * v
        if width is not None:
            edge = np.where(distance < width, 0.5 - 0.5 * np.cos(np.pi * np.clip(distance, 0, None) / width), 1.0)
            v = (v - row.like_background) * edge + row.like_background
        return np.where(inside, v, row.like_background)

    return change


def line_fits(bricks: DataFrame, pairs: DataFrame, region: Region) -> DataFrame:
    """``run, slope, offset`` of the line that brings volume ``a`` of a pair to ``b`` within a region, from sums of bricks."""
    place = ["bz", "bx", "by"]
    a = pairs.select("run", "a", "b").join(bricks.select(*BRICK), F.col("a") == F.col("vol_id"))
    b = bricks.select(F.col("vol_id").alias("b"), *place, F.col("data").alias("other"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                x, y = _values(row), _doubles(row.other).reshape(row.nz, row.nx, row.ny)
                inside = np.broadcast_to(region.distance(*_places(row.z0, row.x0, row.y0, x.shape)) >= 0, x.shape)
                x, y = x[inside], y[inside]
                out.append((row.run, len(x), x.sum(), y.sum(), (x * x).sum(), (x * y).sum()))
            yield pd.DataFrame(out, columns=["run", "n", "x", "y", "xx", "xy"])

    kind = pairs.schema["run"].dataType.simpleString()
    sums = a.join(b, ["b", *place]).select("run", *BRICK, "other").mapInPandas(run, f"run {kind}, n long, x double, y double, xx double, xy double")
    whole = sums.groupBy("run").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    slope = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    return whole.withColumn("slope", F.coalesce(slope, F.lit(0.0))).select("run", "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("offset"))


def even_odd_curve(bricks: DataFrame, pairs: DataFrame, shape: Shape, region: Region, wedge: tuple[float, float, float] | None = None, keep: Keep | None = None, bin_size: float = 1.0, count: int | None = None, taper: bool = True, whole: bool = True, rescale: str = "stats", block: int = BLOCK) -> DataFrame:
    """``run, idx, value``: correlation of two half-data volumes of bricks by physical frequency.

    ``pairs``: run, a, b (volumes). Volume a is rescaled to b within the region, by mean and deviation (``stats``) or by a
    fitted line (``line``); both get a cosine edge. Frequencies of the missing ``wedge`` and those that ``keep`` does not
    keep go. Shells are one frequency of the longest axis wide, ``count`` of them. ``whole`` turns the correlation of the
    halves into that of the whole data. A volume that lacks bricks is an error.
    """
    if rescale not in ("stats", "line"):
        raise ValueError("rescale is stats or line")
    region.check(shape)
    stats = volume_stats(bricks, region)
    like = stats.select(F.col("vol_id").alias("b"), F.col("avg").alias("like_avg"), F.col("std").alias("like_std"), F.col("background").alias("like_background"))
    fits = line_fits(bricks, pairs, region) if rescale == "line" else pairs.select("run", F.lit(1.0).alias("slope"), F.lit(0.0).alias("offset"))
    members = _sides(pairs).join(pairs.select("run", "b"), "run").join(like, "b").join(stats.select("vol_id", "avg", "std"), "vol_id").join(fits, "run")
    members = members.select("run", "side", "vol_id", "avg", "std", "like_avg", "like_std", "like_background", "slope", "offset", F.lit(rescale == "line").alias("fitted"))
    planes = section_planes(bricks, members, shape, _brought_to(region, region.edge_width() if taper else None), block)
    scale = tuple(max(shape) / n for n in shape)

    def kept(kz: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
        out = np.ones(np.broadcast_shapes(kz.shape, kx.shape, ky.shape), bool)
        if wedge is not None:
            out &= ~wedge_angles(*[k * s for k, s in zip((kz, kx, ky), scale)], *wedge)
        return out if keep is None else out & keep(kz, kx, ky)

    kernel = shell_kernel(shape, scale, bin_size, count, None if wedge is None and keep is None else kept)
    sums = by_blocks(planes, shape, kernel, "idx int, c double, c1 double, c2 double, n long", block)
    return shell_correlation(sums, ["run"], whole)


def frequency_correlations(bricks: DataFrame, pairs: DataFrame, shape: Shape, block: int = BLOCK) -> DataFrame:
    """``run, kz, kx, ky, c`` of ``crossval.frequency_correlation`` for pairs (run, a, b) of volumes of bricks; of opposite frequencies one."""
    planes = section_planes(bricks, _sides(pairs), shape, block=block)
    return by_blocks(planes, shape, correlation_kernel(shape), "kz int, kx int, ky int, c double", block)


def cropped_transforms(bricks: DataFrame, shape: Shape, to: Shape, block: int = BLOCK) -> DataFrame:
    """``vol_id, kz, kx, ky, re, im``: the transforms of volumes of bricks, cropped to the frequencies of a smaller shape; of
    opposite frequencies one. ``imageops.whole_spectrum`` gives both."""
    members = bricks.select("vol_id").distinct().select(F.col("vol_id").alias("run"), F.lit(1).alias("side"), "vol_id")
    planes = section_planes(bricks, members, shape, block=block)
    found = by_blocks(planes, shape, crop_kernel(shape, to), "kz int, kx int, ky int, re double, im double", block)
    return found.withColumnRenamed("run", "vol_id")


Filter = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def filtered_volumes(bricks: DataFrame, shape: Shape, weights: Filter, block: int = BLOCK) -> DataFrame:
    """Volumes of bricks multiplied in reciprocal space by ``weights`` (of kz, kx, ky), as bricks of one section each.

    A block is transformed along z, weighed and transformed back where it lies; one more shuffle brings sections together again.
    What is not symmetric in ``weights`` counts as the mean of opposite frequencies, as the real part of the result has it.
    """
    nz, nx, ny = shape
    members = bricks.select("vol_id").distinct().select(F.col("vol_id").alias("run"), F.lit(1).alias("side"), "vol_id")

    def weigh(sides: dict[int, np.ndarray], kz: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> pd.DataFrame:
        grid = [kz[:, None, None], kx[None, :, None], ky[None, None, :]]
        there = weights(*[_opposite(k, n) for k, n in zip(grid, shape)])
        made = np.fft.ifft(sides[1] * 0.5 * (weights(*grid) + np.conj(there)), axis=0)
        first = int(np.flatnonzero(signed(nx) == kx[0])[0]), int(np.flatnonzero(signed(ny)[: ny // 2 + 1] == ky[0])[0])
        return pd.DataFrame({"z": np.arange(nz), "kx0": first[0], "ky0": first[1], "nkx": len(kx), "nky": len(ky), "re": [np.ascontiguousarray(c.real).tobytes() for c in made], "im": [np.ascontiguousarray(c.imag).tobytes() for c in made]})

    back = by_blocks(section_planes(bricks, members, shape, block=block), shape, weigh, "z long, kx0 int, ky0 int, nkx int, nky int, re binary, im binary", block)

    def section(key: tuple, rows: list) -> pd.DataFrame:
        half = np.zeros((nx, ny // 2 + 1), np.complex128)
        for r in rows:
            x, y, a, b = r["kx0"], r["ky0"], r["nkx"], r["nky"]
            half[x : x + a, y : y + b] = (np.frombuffer(r["re"]) + 1j * np.frombuffer(r["im"])).reshape(a, b)
        made = np.fft.irfft2(half, (nx, ny))
        return pd.DataFrame({"vol_id": [key[0]], "bz": [key[1]], "bx": [0], "by": [0], "z0": [key[1]], "x0": [0], "y0": [0], "nz": [1], "nx": [nx], "ny": [ny], "data": [made.ravel()]})

    kind = bricks.schema["vol_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in BRICK[1:-1])
    return _gathered(back, ["run", "z"], ["kx0", "ky0", "nkx", "nky", "re", "im"], section, f"vol_id {kind}, {numbers}, data array<double>")


# --- correlation with a ball ----------------------------------------------------------------------------


def ball_offsets(diameter: float) -> np.ndarray:
    """Offsets (z, x, y) of a ball: from -int(diameter) up to int(diameter) - 1, as far as half the diameter."""
    reach = int(diameter)
    offsets = np.stack(np.meshgrid(*[np.arange(-reach, reach)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    return offsets[(offsets**2).sum(axis=1) <= 0.25 * diameter**2]


def _overlaps(first: int, n: int, edge: int, whole: int, reach: int) -> list[tuple[int, int, int, int]]:
    """Bricks of an axis whose halo of ``reach`` holds places of a brick at ``first``, round the ends: number, start and end in
    the brick, place in the halo's box."""
    out = []
    for t in range(-(-whole // edge)):
        low, high = t * edge - reach, min((t + 1) * edge, whole) + reach
        for turn in range(-(reach // whole + 1), reach // whole + 2):
            at = first + turn * whole
            a, b = max(low, at), min(high, at + n)
            if a < b:
                out.append((t, a - at, b - at, a - low))
    return out


def with_halo(bricks: DataFrame, shape: Shape, edges: Shape, reach: int) -> DataFrame:
    """``vol_id, bz, bx, by, parts``: the pieces that make up each brick and ``reach`` places about it, round the edges of the volume.

    Each brick sends its faces to its neighbours by their number; a piece is ``places`` (start and size) and ``values``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                v, out = _values(row), []
                zs, xs, ys = (_overlaps(f, n, e, w, reach) for f, n, e, w in zip((row.z0, row.x0, row.y0), v.shape, edges, shape))
                for bz, za, zb, zp in zs:
                    for bx, xa, xb, xp in xs:
                        for by, ya, yb, yp in ys:
                            out.append((row.vol_id, bz, bx, by, [zp, xp, yp, zb - za, xb - xa, yb - ya], v[za:zb, xa:xb, ya:yb].tobytes()))
                yield pd.DataFrame(out, columns=["vol_id", "bz", "bx", "by", "places", "values"])

    kind = bricks.schema["vol_id"].dataType.simpleString()
    pieces = bricks.select(*BRICK).mapInPandas(run, f"vol_id {kind}, bz long, bx long, by long, places array<int>, values binary")
    return pieces.groupBy("vol_id", "bz", "bx", "by").agg(F.collect_list(F.struct("places", "values")).alias("parts"))


def bead_score_bricks(bricks: DataFrame, shape: Shape, edges: Shape, diameter: float) -> DataFrame:
    """Bricks of the correlation with a sphere of -1 of ``diameter`` voxels, round the edges, as ``crossval.bead_score`` gives it.

    A brick and its halo are correlated with the ball by one transform; places whose ball would leave the halo are
    dropped (overlap-save), so the result does not depend on where volumes are cut. Bricks have ``edges`` voxels a side,
    less at the end of a volume. A frequency filter such as the missing wedge has no bounded reach: see ``bead_score_wedge``.
    """
    ball = ball_offsets(diameter)
    reach = int(np.abs(ball).max(initial=0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                first = [b * e for b, e in zip((row.bz, row.bx, row.by), edges)]
                own = [min(e, w - f) for e, w, f in zip(edges, shape, first)]
                box, filled = np.zeros([n + 2 * reach for n in own]), 0
                for part in row.parts:
                    z, x, y, a, b, c = part["places"]
                    box[z : z + a, x : x + b, y : y + c] = np.frombuffer(part["values"]).reshape(a, b, c)
                    filled += a * b * c
                if filled != box.size:
                    raise ValueError(f"brick {row.bz}, {row.bx}, {row.by} lacks neighbours")
                template = np.zeros(box.shape)
                np.add.at(template, tuple((ball % np.array(box.shape)).T), -1.0)
                score = np.fft.irfftn(np.fft.rfftn(box) * np.fft.rfftn(template), box.shape)
                score = score[tuple(slice(reach, reach + n) for n in own)]
                yield pd.DataFrame({"vol_id": row.vol_id, **dict(zip(("bz", "bx", "by"), (row.bz, row.bx, row.by))), **dict(zip(("z0", "x0", "y0"), first)), **dict(zip(("nz", "nx", "ny"), own)), "data": [score.ravel()]})

    kind = bricks.schema["vol_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in BRICK[1:-1])
    return with_halo(bricks, shape, edges, reach).mapInPandas(run, f"vol_id {kind}, {numbers}, data array<double>")


def ball_transform(diameter: float, shape: Shape) -> Filter:
    """The transform of a sphere of -1 of ``diameter`` voxels at any frequencies, axis after axis."""
    ball = ball_offsets(diameter)
    reach = int(diameter)
    held = np.zeros((2 * reach,) * 3)
    held[tuple((ball + reach).T)] = -1.0
    offsets = np.arange(-reach, reach)

    def run(kz: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
        waves = [np.exp(-2j * np.pi * np.outer(np.ravel(k), offsets) / n) for k, n in zip((kz, kx, ky), shape)]
        return np.einsum("zo,xp,opy->zxy", waves[0], waves[1], np.tensordot(held, waves[2], axes=(2, 1)), optimize=True)

    return run


def bead_score_wedge(bricks: DataFrame, shape: Shape, diameter: float, wedge: tuple[float, float, float], block: int = BLOCK) -> DataFrame:
    """``bead_score_bricks`` without the frequencies of the missing ``wedge`` (tilt range and x tilt in radians), as bricks of one section each."""
    ball = ball_transform(diameter, shape)

    def weights(kz: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
        return ball(kz, kx, ky) * ~wedge_angles(*[k / n for k, n in zip((kz, kx, ky), shape)], *wedge)

    return filtered_volumes(bricks, shape, weights, block)


def strong_voxels(score: DataFrame, k: float) -> DataFrame:
    """``vol_id, z, x, y, v`` of the voxels that exceed the mean of their volume by more than ``k`` population deviations.

    Mean and deviation come from sums of bricks; only voxels beyond the cut become rows. ``score`` is read twice: write it first
    where it is costly.
    """
    sums = score.select("vol_id", F.size("data").alias("n"), F.aggregate("data", F.lit(0.0), lambda s, v: s + v).alias("s"), F.aggregate("data", F.lit(0.0), lambda s, v: s + v * v).alias("q"))
    whole = sums.groupBy("vol_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.col("s") / F.col("n")
    cut = whole.select("vol_id", (mean + k * F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))).alias("cut"))
    flat = score.join(cut, "vol_id").select("*", F.posexplode("data").alias("i", "v")).filter("v > cut")
    place = [("z", F.floor(F.col("i") / (F.col("nx") * F.col("ny")))), ("x", F.floor(F.col("i") / F.col("ny")) % F.col("nx")), ("y", F.col("i") % F.col("ny"))]
    return flat.select("vol_id", *[(F.col(f"{a}0") + p).cast("int").alias(a) for a, p in place], "v")


# --- projections ----------------------------------------------------------------------------------------

#: Pixels of an image tile along x and y.
TILE = 256


def project_bricks(bricks: DataFrame, views: DataFrame, centre: Sequence[float], shape: tuple[int, int], region: Region | None = None, background: float = 0.0, exponent: tuple[float, float] | None = None, tile: int = TILE) -> DataFrame:
    """``vol_id, proj, px, py, v`` of ``crossval.reproject`` for volumes of bricks (with a column ``series``).

    A brick becomes, for each view of its series, a small image of sums and one of weights, cut at the edges of image tiles;
    only these are shuffled, and added tile by tile. ``region`` has places z, x, y; ``centre`` x, y, z.
    """
    turns = [f"m{i}{j}" for i in range(2) for j in range(3)]
    seen = views.groupBy("series").agg(F.collect_list(F.struct("proj", *turns)).alias("views"))  # a number of tilts
    met = bricks.select(*BRICK, "series").join(seen, "series")
    kind = bricks.schema["vol_id"].dataType.simpleString()

    def splat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                v = _values(row)
                z, x, y = _places(row.z0, row.x0, row.y0, v.shape)
                inside = np.ones(v.shape, bool) if region is None else np.broadcast_to(region.distance(z, x, y) >= 0, v.shape)
                values = (v - background)[inside]
                old = [np.broadcast_to(p, v.shape)[inside] - c for p, c in zip((x, y, z), centre)]
                out = []
                for view in row.views:
                    ax, ay = (sum(view[f"m{i}{j}"] * o for j, o in enumerate(old)) + centre[i] for i in range(2))
                    fx, fy = np.floor(ax).astype(int), np.floor(ay).astype(int)
                    on = (fx >= 0) & (fx < shape[0]) & (fy >= 0) & (fy < shape[1])
                    if on.any():
                        out += pieces(row.vol_id, view["proj"], fx[on], fy[on], ax[on] - fx[on], ay[on] - fy[on], values[on])
                yield pd.DataFrame(out, columns=["vol_id", "proj", "tx", "ty", "places", "sums", "weights"])

    def pieces(vol_id, proj, fx, fy, wx, wy, values) -> list[tuple]:
        x0, y0 = fx.min(), fy.min()
        size = (fx.max() + 2 - x0, fy.max() + 2 - y0)
        sums, weights = np.zeros(size[0] * size[1]), np.zeros(size[0] * size[1])
        for dx in (0, 1):
            for dy in (0, 1):
                w = (wx if dx else 1 - wx) * (wy if dy else 1 - wy)
                w = np.where(w > 1e-12, w, 0.0)
                at = (fx + dx - x0) * size[1] + fy + dy - y0
                sums += np.bincount(at, w * values, len(sums))
                weights += np.bincount(at, w, len(sums))
        sums, weights, out = sums.reshape(size), weights.reshape(size), []
        for tx in range(x0 // tile, (min(x0 + size[0], shape[0]) - 1) // tile + 1):
            for ty in range(y0 // tile, (min(y0 + size[1], shape[1]) - 1) // tile + 1):
                a, b = max(tx * tile, x0), min((tx + 1) * tile, x0 + size[0], shape[0])
                c, d = max(ty * tile, y0), min((ty + 1) * tile, y0 + size[1], shape[1])
                if a < b and c < d:
                    part = (slice(a - x0, b - x0), slice(c - y0, d - y0))
                    out.append((vol_id, proj, tx, ty, [a - tx * tile, c - ty * tile, b - a, d - c], np.ascontiguousarray(sums[part]).tobytes(), np.ascontiguousarray(weights[part]).tobytes()))
        return out

    parts = met.select(*BRICK, "views").mapInPandas(splat, f"vol_id {kind}, proj int, tx int, ty int, places array<int>, sums binary, weights binary")

    whole = tuple(min(tile, n) for n in shape)

    def add(key: tuple, rows: list) -> pd.DataFrame:
        sums, weights = np.zeros(whole), np.zeros(whole)
        for r in rows:
            x, y, nx, ny = r["places"]
            sums[x : x + nx, y : y + ny] += np.frombuffer(r["sums"]).reshape(nx, ny)
            weights[x : x + nx, y : y + ny] += np.frombuffer(r["weights"]).reshape(nx, ny)
        x, y = np.nonzero(weights)
        v = sums[x, y] / weights[x, y] + background
        if exponent is not None:
            low, high = exponent
            v = np.exp((v - low) / (high - low)) * (high - low)
        return pd.DataFrame({"vol_id": key[0], "proj": key[1], "px": x + key[2] * tile, "py": y + key[3] * tile, "v": v})

    return _gathered(parts, ["vol_id", "proj", "tx", "ty"], ["places", "sums", "weights"], add, f"vol_id {kind}, proj int, px int, py int, v double")

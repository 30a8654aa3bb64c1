"""Plans: tile grids, parameter grids, run matrices and splits, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def starts(first: Column, last: Column, step: Column | int) -> Column:
    """``first, first + step, ...`` up to ``last``; empty where ``last`` lies before ``first``."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.when(last >= first, F.sequence(first.cast("int"), F.greatest(last, first).cast("int"), step.cast("int"))).otherwise(F.array().cast("array<int>"))


def centre_region(size: Column, part: Column, first: Column | None = None) -> tuple[Column, Column]:
    """Start and size of the middle ``part`` of an axis; the whole axis where ``part`` is not positive."""
    first = F.lit(0) if first is None else first
    return F.when(part > 0, F.floor((size - part) / 2)).otherwise(first).cast("int"), F.when(part > 0, part).otherwise(size).cast("int")


def plan_tiles(volumes: DataFrame, size: int, sub: tuple[int, int, int] = (1, 1, 1), plane: str = "3d", slice_step: int = 1) -> DataFrame:
    """Tile starts ``z, x, y`` for each row of ``volumes`` (..., z0, x0, y0, nz, nx, ny: region to tile).

    ``3d`` cubes take every ``sub``-th place of each axis, to the end of the region. ``beam`` slices step by
    ``sub[0]`` in z, and in x and y end before a tile that would fit exactly. ``tilt`` slices fix x and ``edge``
    slices fix y; both step by ``slice_step`` there and tile the other axes. A size of 0 or less takes whole slices.
    """
    z0, x0, y0, nz, nx, ny = (F.col(c) for c in ("z0", "x0", "y0", "nz", "nx", "ny"))
    if size <= 0:
        axis = {"beam": (z0, nz), "tilt": (x0, nx), "edge": (y0, ny)}[plane]
        slices = F.explode(starts(axis[0], axis[0] + axis[1] - 1, sub[0] if plane == "beam" else slice_step))
        fixed = {"z": F.lit(0), "x": F.lit(0), "y": F.lit(0)} | {{"beam": "z", "tilt": "x", "edge": "y"}[plane]: F.col("at")}
        return volumes.withColumn("at", slices).withColumns({c: v.cast("int") for c, v in fixed.items()}).drop("at")
    exact = plane == "3d"

    def axis_of(first: Column, n: Column, step: int) -> Column:
        return starts(first, first + n - size - (0 if exact else 1), size * step)

    z = axis_of(z0, nz, sub[0]) if exact else starts(z0, z0 + nz - 1, sub[0]) if plane == "beam" else axis_of(z0, nz, 1)
    x = starts(x0, x0 + nx - 1, slice_step) if plane == "tilt" else axis_of(x0, nx, sub[1] if plane in ("3d", "beam") else 1)
    y = starts(y0, y0 + ny - 1, slice_step) if plane == "edge" else axis_of(y0, ny, sub[2] if plane in ("3d", "beam") else 1)
    return volumes.withColumn("x", F.explode(x)).withColumn("y", F.explode(y)).withColumn("z", F.explode(z))


def z_clip_from_catalog(catalog: DataFrame, factors: DataFrame, cube: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``z_first, z_last``, rejected rows). ``factors``: magnification, thickness, factor."""
    joined = catalog.join(F.broadcast(factors), ["magnification", "thickness"], "left")
    centre, clip = F.floor((F.col("z_max") + F.col("z_min")) / 2), F.col("factor") * cube
    placed = joined.filter(F.col("factor").isNotNull()).withColumn("z_first", (F.floor(centre - clip / 2) + 1).cast("int")).withColumn("z_last", F.floor(centre + clip / 2).cast("int"))
    return placed, joined.filter(F.col("factor").isNull())


def param_grid(spark: SparkSession, num_angs: Sequence[int], max_angs: Sequence[float], exclude: Sequence[tuple[int, float]] = ()) -> DataFrame:
    """All pairs but the excluded ones."""
    grid = spark.createDataFrame([(n,) for n in num_angs], "num_ang int").crossJoin(spark.createDataFrame([(float(m),) for m in max_angs], "max_ang double"))
    for n, m in exclude:
        grid = grid.filter(~((F.col("num_ang") == n) & (F.col("max_ang") == m)))
    return grid


def const_increment_grid(spark: SparkSession, num_angs: Sequence[int], max_angs: Sequence[float]) -> DataFrame:
    """Pairs by position."""
    return spark.createDataFrame([(n, float(m)) for n, m in zip(num_angs, max_angs, strict=True)], "num_ang int, max_ang double")


def sweep_plan(base: DataFrame) -> DataFrame:
    """One row for each value of each swept parameter."""
    sizes, apods, rings = F.sequence(F.lit(50), F.lit(750), F.lit(100)), F.sequence(F.lit(10), F.lit(910), F.lit(100)), F.sequence(F.lit(2), F.lit(12), F.lit(2))
    swept = {"cube_size": sizes, "apod": apods, "rt": rings}
    parts = [base.withColumn("param", F.lit(name)).withColumn("value", F.explode(values)) for name, values in swept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pair_runs(files: DataFrame, keys: Sequence[str], mode: str = "ab") -> DataFrame:
    """``path1, path2`` by run from ``files`` (keys..., role, path). ``ab``: roles a and b of a run; ``refa``: b
    against the reference of role full_a; ``refb``: a against full_b."""
    first, second = {"ab": ("a", "b"), "refa": ("b", "full_a"), "refb": ("a", "full_b")}[mode]
    left = files.filter(F.col("role") == first).select(*keys, F.col("path").alias("path1"))
    return left.join(files.filter(F.col("role") == second).select(*keys, F.col("path").alias("path2")), list(keys))


def exactly_one(files: DataFrame, keys: Sequence[str], expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys and path where there is one file, keys with another number ``n`` and the ``reason``).

    ``expected`` has the keys that there should be; of those without any file nothing else knows.
    """
    counted = files.groupBy(*keys).agg(F.count("path").alias("n"), F.min("path").alias("path"))
    if expected is not None:
        counted = expected.select(*keys).distinct().join(counted, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    reason = F.when(F.col("n") == 0, "no file").otherwise("several files")
    return counted.filter("n = 1").drop("n"), counted.filter("n <> 1").select(*keys, "n", reason.alias("reason"))


def box_counts(volumes: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """``key, n_boxes`` for each volume; a volume without a box raises an error."""
    n = volumes.select(key).join(boxes.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left")
    return n.select(key, F.when(F.col("n").isNull(), F.raise_error(F.format_string("volume %s has no box", F.col(key).cast("string")))).otherwise(F.col("n")).alias("n_boxes"))


def path_of(ccdb: Column, microscopy: Column, num_ang: Column, max_ang: Column, root: str = "/data/ccdb") -> Column:
    """Folder of a reconstruction from its catalog numbers and its parameters."""
    return F.format_string(root + "%d/microscopy_%d/%d-limited[%.1f_-%.1f]", ccdb, microscopy, num_ang, max_ang, max_ang)


def run_paths(catalog: DataFrame, grid: Sequence[tuple[int, float]], root: str = "/data/ccdb") -> DataFrame:
    """``catalog`` (ccdbprod, mpid, ...) with ``num_ang, max_ang, path`` of each of its reconstructions, one for each pair of ``grid``."""
    pairs = F.array(*[F.struct(F.lit(int(n)).alias("num_ang"), F.lit(float(m)).alias("max_ang")) for n, m in grid])
    each = catalog.withColumn("run_", F.explode(pairs)).select("*", "run_.num_ang", "run_.max_ang").drop("run_")
    return each.withColumn("path", path_of(F.col("ccdbprod"), F.col("mpid"), F.col("num_ang"), F.col("max_ang"), root))


def normalise_points(df: DataFrame, position: str = "position", xyz: str = "xyz") -> DataFrame:
    """Whole ``x, y, z``, cut towards zero, of points given as a struct ``position`` (x, y, z) or as an array ``xyz``."""
    made = {a: F.coalesce(F.col(f"{position}.{a}"), F.get(F.col(xyz), F.lit(i))).cast("int") for i, a in enumerate("xyz")}
    return df.withColumns(made).drop(position, xyz)


def pending(plan: DataFrame, existing: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """The runs of ``plan`` that have no output yet."""
    return plan if overwrite else plan.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def box_grid(volumes: DataFrame, box: int, skip: int, window: int) -> DataFrame:
    """Cross-validation boxes within a centred window of x and y, every ``skip``-th, with an id ``x_y_z``."""
    out = volumes
    for axis, n, part in (("x", "nx", window), ("y", "ny", window), ("z", "nz", 0)):
        first, size = centre_region(F.col(n), F.least(F.lit(part), F.col(n)))
        out = out.withColumn(axis, F.explode(starts(first, first + size - box, box * skip)))
    return out.withColumn("box_id", F.concat_ws("_", "x", "y", "z"))


def split_even_odd(projections: DataFrame, exclude: DataFrame, key: str = "proj") -> DataFrame:
    """Projections without the excluded ones, with ``half`` 0 or 1 by the parity of their number."""
    return projections.join(exclude.select(key).distinct(), key, "left_anti").withColumn("half", F.pmod(F.col(key), F.lit(2)))


def loo_groups(projections: DataFrame, step: int, exclude: DataFrame, undersample: int = 1) -> DataFrame:
    """For each left-out projection, every ``undersample``-th, the others that share its remainder by ``step`` stay out too."""
    usable = projections.join(exclude.select("proj").distinct(), "proj", "left_anti")
    lead = usable.filter(F.pmod("proj", F.lit(undersample)) == 0).select("series", F.col("proj").alias("left_out"), F.pmod("proj", F.lit(step)).alias("rest"))
    members = usable.groupBy("series", F.pmod("proj", F.lit(step)).alias("rest")).agg(F.sort_array(F.collect_list("proj")).alias("group"))
    return lead.join(members, ["series", "rest"])


def task_split(items: DataFrame, key: str, total: Column, parts: int) -> DataFrame:
    """Numbers rows 0..total-1 by ``key`` into ``parts``: the first ones get ``total // parts``, the last ones one more."""
    q, r = F.floor(total / parts), total % parts
    small = (parts - r) * q
    part = F.when(F.col(key) < small, F.floor(F.try_divide(F.col(key), q))).otherwise((parts - r) + F.floor((F.col(key) - small) / (q + 1)))
    return items.withColumn("part", part.cast("int"))


def tilt_series(runs: DataFrame) -> DataFrame:
    """``proj, tilt`` from ``amin, amax, step`` of each run, rounded to 0.1 degree with halves away from zero."""
    count = F.floor((F.col("amax") - F.col("amin")) / F.col("step") + 0.5).cast("int")
    raw = (F.col("amin") + F.col("proj") * F.col("step")) * 10
    tilt = F.when(raw >= 0, F.floor(raw + 0.5)).otherwise(F.ceil(raw - 0.5)) / 10
    return runs.withColumn("proj", F.explode(F.sequence(F.lit(0), count))).withColumn("tilt", tilt)


def roi_plan(points: DataFrame, size: int, mode: str = "pad") -> DataFrame:
    """Boxes of ``size`` about points (x, y, z) in volumes of ``nx, ny, nz``.

    ``plain`` starts at point - size // 2. ``pad`` clips to the volume and says where to paste. ``shift`` moves the
    box inside, never shrinks it, and marks volumes that are too small.
    """
    half = size // 2
    out = points
    for a in "xyz":
        p, n = F.col(a), F.col(f"n{a}")
        if mode == "plain":
            out = out.withColumn(f"{a}0", p - half)
        elif mode == "pad":
            first, last = F.greatest(p - half, F.lit(0)), F.least(p - half + size, n)
            out = out.withColumn(f"{a}0", first).withColumn(f"{a}_size", F.greatest(last - first, F.lit(0))).withColumn(f"{a}_paste", first - (p - half))
        else:
            # the far corner is point + half, and the largest index is n - 1
            out = out.withColumn(f"{a}0", F.greatest(F.least(p + half, n - 1) - size, F.lit(0)))
    if mode == "shift":
        out = out.withColumn("fits", (F.col("nx") >= size) & (F.col("ny") >= size) & (F.col("nz") >= size))
    return out


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``i`` from 0 in each group."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)

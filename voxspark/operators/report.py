"""Reports over result rows: averaging of references, filters, group estimates, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import elongation, measured, status_of


def clean(df: DataFrame, columns: Sequence[str] = ("res", "mean", "corr")) -> DataFrame:
    """``status`` from the resolution, and null for NaN and for the sentinel of empty cubes."""
    out = df.withColumn("status", status_of(F.col("res")))
    return out.withColumns({c: measured(F.col(c)) if c == "res" else F.when(~F.isnan(c), F.col(c)) for c in columns})


def average_refs(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str] = ("res", "mean", "corr"), compat: bool = False) -> DataFrame:
    """The mean of two references by key. ``compat`` averages sentinels with measurements, as positions in
    two frames would; otherwise a row counts only where both are measured.

    A key that only one of both has is an error; ``unmatched_refs`` lists such keys.
    """
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in values], F.lit(1).alias("in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in values], F.lit(1).alias("in_b"))
    fit = (lambda c: F.col(c)) if compat else (lambda c: measured(F.col(c)))
    both = left.join(right, list(keys), "full")
    wrong = F.raise_error(F.concat(F.lit("only one reference has "), F.to_json(F.struct(*keys))))
    matched = F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), wrong.cast("boolean")).otherwise(F.lit(True))
    return both.filter(matched).select(*keys, *[((fit(f"{c}_a") + fit(f"{c}_b")) / 2).alias(c) for c in values])


def unmatched_refs(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., side``: the keys that only the first (``a``) or only the second (``b``) of two references has."""
    here, there = a.select(*keys).distinct(), b.select(*keys).distinct()
    return here.join(there, list(keys), "left_anti").withColumn("side", F.lit("a")).unionByName(there.join(here, list(keys), "left_anti").withColumn("side", F.lit("b")))


def load_results(rows: DataFrame, catalog: DataFrame, grid: DataFrame | None = None, on: Sequence[str] = ("name",)) -> DataFrame:
    """Cleaned result rows with the thickness and pixel size of ``catalog`` by ``on``, of the runs of ``grid`` (num_ang, max_ang)
    where one is given. Rows whose key the catalog lacks are left out, as it says what belongs to a report."""
    kept = clean(rows)
    if grid is not None:
        kept = kept.join(grid, ["num_ang", "max_ang"], "left_semi")
    return kept.join(catalog, list(on))


def in_range(df: DataFrame, thickness: Sequence[str] | None = None, edge: tuple[float, float] | None = None, positive: bool = True, complete: Sequence[str] = ()) -> DataFrame:
    """Rows of the thicknesses, away from the edges, with a positive resolution and the ``complete`` columns present."""
    keep: Column = F.lit(True)
    if thickness is not None:
        keep = keep & F.col("thickness").isin(list(thickness))
    if edge is not None:
        keep = keep & F.col("x").between(*edge) & F.col("y").between(*edge)
    if positive:
        keep = keep & ~F.isnan("res") & (F.col("res") > 0)
    for c in complete:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c)
    return df.filter(keep)


def refined_percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], bins: int = 4096, levels: int = 2) -> DataFrame:
    """``by..., n, p0, p1, ...``: exact percentiles of ``value`` for groups too large to gather, by histograms.

    Values are counted by bin between a group's least and largest, the bins that hold the ranks asked for are found, and
    only their values are counted again in finer bins, at last value by value. A shuffle carries a row for each
    group, bin and task; values that repeat are one row. Nulls and NaN do not count; percentiles interpolate.
    """
    keys = [f"k{i}" for i in range(len(by))]
    number = F.when(~F.isnan(value), F.col(value).cast("double"))
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], number.alias("v")).filter("v is not null")
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)]))
    asked = whole.withColumn("s", at).withColumn("at", F.col("s.p") * (F.col("n") - 1))
    asked = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).withColumn("before", F.lit(0).cast("long"))

    def same(left: str, right: str, names: Sequence[str]) -> Column:
        out = F.lit(True)
        for c in names:
            out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        return out

    for level in range(levels + 1):
        last = level == levels
        cells = asked.select(*keys, "lo", "hi").distinct()
        inside = rows.alias("r").join(cells.alias("c"), same("r", "c", keys) & F.col("r.v").between(F.col("c.lo"), F.col("c.hi")))
        place = F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0)))
        met = inside.select(*[f"r.{k}" for k in keys], "v", "lo", "hi").withColumn("bin", F.col("v") if last else F.least(place, F.lit(bins - 1)).cast("double"))
        counts = met.groupBy(*keys, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin")))
        found = asked.alias("a").join(counts.alias("b"), same("a", "b", [*keys, "lo", "hi"]) & (F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("c")))
        asked = found.select(*[F.col(f"a.{k}").alias(k) for k in keys], "n", "s", "at", "rank", (F.col("before") + F.col("upto") - F.col("c")).alias("before"), F.col("least").alias("lo"), F.col("most").alias("hi"))
    weight = F.when(F.col("at") == F.col("rank"), 1.0).otherwise(1 - F.abs(F.col("at") - F.col("rank")))
    each = asked.groupBy(*keys, "n").agg(*[F.sum(F.when(F.col("s.i") == i, F.col("lo") * weight)).alias(f"p{i}") for i in range(len(shares))])
    return each.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "n", *[f"p{i}" for i in range(len(shares))])


def point_stats(df: DataFrame, by: Sequence[str], value: str, estimator: str = "mean", interval: int = 50, exact: bool | str = True) -> DataFrame:
    """Mean or median with a percentile interval for each group.

    For groups too large to gather their values, ``exact="refined"`` finds the same percentiles by histograms in a few
    more scans, and ``exact=False`` takes approximate ones, whose state is bounded, in one.
    """
    low, high = (100 - interval) / 200, (100 + interval) / 200
    c = F.when(~F.isnan(value), F.col(value))
    if exact == "refined":
        p = refined_percentiles(df, by, value, [low, 0.5, high])
        mean = df.groupBy(*by).agg(F.avg(c).alias("mean"), F.count(c).alias("n"))
        joined = mean.alias("m").join(p.alias("p"), [F.col(f"m.{k}").eqNullSafe(F.col(f"p.{k}")) for k in by], "left")
        return joined.select(*[F.col(f"m.{k}").alias(k) for k in by], F.col("mean" if estimator == "mean" else "p1").alias("estimate"), F.col("p0").alias("low"), F.col("p2").alias("high"), F.col("m.n").alias("n"))
    quantile = (lambda p: F.percentile(c, p)) if exact else (lambda p: F.percentile_approx(c, p, 10_000))
    centre = F.avg(c) if estimator == "mean" else quantile(0.5)
    return df.groupBy(*by).agg(centre.alias("estimate"), quantile(low).alias("low"), quantile(high).alias("high"), F.count(c).alias("n"))


def iqr_half(df: DataFrame, by: Sequence[str], value: str, estimator: str = "mean", exact: bool | str = True) -> DataFrame:
    """Estimate and half the interquartile range; ``exact`` as in ``point_stats``."""
    stats = point_stats(df, by, value, estimator, exact=exact)
    return stats.withColumn("iqr_half", (F.col("high") - F.col("low")) / 2).select(*by, "estimate", "iqr_half", "n")


def heatmap(df: DataFrame, row: str, column: str, value: str, values: Sequence) -> DataFrame:
    """``value`` by row and column; cells that hold several values raise an error."""
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a cell has several values"))).otherwise(F.first(value))
    return df.groupBy(row).pivot(column, list(values)).agg(single)


def constant(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """The one value of ``column`` in each group, and whether it is the only one."""
    return df.groupBy(*by).agg(F.min(column).alias(column), (F.min(column).eqNullSafe(F.max(column))).alias("single"))


def in_pixels(df: DataFrame, value: str = "res") -> DataFrame:
    return df.withColumn(f"{value}_px", F.try_divide(F.col(value), F.col("pixel_size")))


def z_resolution(df: DataFrame) -> DataFrame:
    """Resolution along the beam, from that in the plane and the largest tilt."""
    return df.withColumn("res_z", F.col("res") * elongation(F.col("max_ang")))


def theory_curve(ranges: DataFrame, n: int) -> DataFrame:
    """Elongation at ``n`` evenly spaced angles from ``low`` to ``high`` of each row of ``ranges``: ``i, alpha, elongation``."""
    angle = F.col("low") + F.col("i") * ((F.col("high") - F.col("low")) / (n - 1))
    grid = ranges.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("alpha", angle)
    return grid.withColumn("elongation", elongation(F.col("alpha"))).drop("low", "high")

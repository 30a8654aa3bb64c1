"""Column expressions: parsing of names, sentinels, rounding and small formulas."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FWHM of a Gaussian of unit sigma, to the three digits that the measurements use.
FWHM_PER_SIGMA = 2.355
EPSILON = 2.220446049250313e-16


def measured(c: Column) -> Column:
    """``c``, or null where it is NaN or the sentinel -1 for an empty cube."""
    return F.when(F.isnan(c) | (c == -1), None).otherwise(c)


def status_of(c: Column) -> Column:
    """``ok``, ``empty`` for the sentinel, ``nan`` for an undefined or missing value."""
    return F.when(c.isNull() | F.isnan(c), "nan").when(c == -1, "empty").otherwise("ok")


def finite(c: Column) -> Column:
    """``c``, or null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def half(n: Column) -> Column:
    """``n // 2`` rounding down, so that -1 gives -1."""
    return F.floor(n / 2).cast("int")


def safe_name(c: Column) -> Column:
    """Letters, digits, ``_``, ``-`` and ``.`` stay; all else becomes ``_``."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_.-]", "_")


def parse_recon_label(c: Column) -> tuple[Column, Column]:
    """(number of projections, largest angle) of a reconstruction label, null where it has none.

    The last path segment counts, without ``#...`` and ``?...``; of several matches the last.
    """
    segment = F.regexp_extract(F.regexp_replace(c, r"[#?].*$", ""), r"([^/]*)/*$", 1)
    pattern = r"(?i)(\d+)\s*[_-]*\s*lim\s*(\d+)"
    last = lambda group: F.try_element_at(F.regexp_extract_all(segment, F.lit(pattern), F.lit(group)), F.lit(-1)).cast("double")
    return last(1), last(2)


def parse_recon_label_legacy(c: Column) -> tuple[Column, Column]:
    """The older form: ``<n>_lim<m>`` first, else a number, then anything but digits, then ``lim<m>``."""
    def first(group: int) -> Column:
        found = [F.regexp_extract(c, p, group) for p in (r"(\d+)_lim(\d+)", r"(\d+)[^\d]+lim(\d+)")]
        return F.coalesce(*[F.when(f != "", f) for f in found]).cast("double")

    return first(1), first(2)


def angle_of(c: Column) -> Column:
    """The angle after ``lim``."""
    found = F.regexp_extract(c, r"lim(\d+)", 1)
    return F.when(found != "", found).cast("double")


def common_prefix(a: Column, b: Column) -> Column:
    """The longest string that both begin with."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (i <= n) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k))
    return F.substring(a, F.lit(1), same)


def expand_int_list(c: Column) -> Column:
    """``1-2,45,59`` as an array of integers."""
    parts = F.transform(F.split(c, ","), lambda p: F.split(F.trim(p), "-"))
    return F.flatten(F.transform(parts, lambda p: F.sequence(F.element_at(p, 1).cast("int"), F.element_at(p, -1).cast("int"))))


def elongation(degrees: Column) -> Column:
    """Elongation of the point spread along the beam for a tilt range of ``+-degrees``; null at 0."""
    a = F.radians(degrees)
    mixed = F.sin(a) * F.cos(a)
    return F.sqrt(F.try_divide(a + mixed, a - mixed))


def gaussian(x: Column, amplitude: Column, centre: Column, sigma: Column, offset: Column) -> Column:
    return amplitude * F.exp(-((x - centre) * (x - centre)) / (2 * sigma * sigma)) + offset


def _r_squared(samples: pa.Array, model: pa.Array) -> pa.Array:
    n = pc.fill_null(pc.list_value_length(samples), 0).to_numpy()
    good = (n > 0) & (n == pc.fill_null(pc.list_value_length(model), 0).to_numpy())
    flat = [a.filter(pa.array(good)).flatten() for a in (samples, model)]
    v, m = (np.asarray(a.to_numpy(zero_copy_only=False), float) for a in flat)
    out = np.full(len(n), np.nan)
    undefined = ~good
    if good.any():
        n = n[good]
        at = np.cumsum(n) - n
        d = v - np.repeat(v[at], n)  # exactly 0 where the samples are constant
        rest = np.add.reduceat((v - m) ** 2, at)
        whole = np.add.reduceat((d - np.repeat(np.add.reduceat(d, at) / n, n)) ** 2, at)
        out[good] = 1 - np.divide(rest, whole, out=np.zeros(len(n)), where=whole != 0)
        missing = reduce(np.logical_or, [a.is_null().to_numpy(zero_copy_only=False) for a in flat])
        undefined[good] = (whole == 0) | np.logical_or.reduceat(missing, at)
    return pa.array(out, mask=undefined)


def r_squared(samples: Column, model: Column) -> Column:
    """1 - SSres / SStot of two arrays of one length; null where the samples are constant, empty or not all there.

    A kernel on Arrow batches: its work is in proportion to the number of samples.
    """
    return F.arrow_udf(_r_squared, "double")(samples, model)


def deconvolve(fwhm_px: Column, diameter_nm: Column, pixel_nm: Column) -> Column:
    """FWHM in nm without a top hat of the bead's diameter; null where nothing is left."""
    sigma = fwhm_px / FWHM_PER_SIGMA * pixel_nm
    rest = sigma * sigma - diameter_nm * diameter_nm / 12
    return F.when(rest > 0, FWHM_PER_SIGMA * F.sqrt(F.greatest(rest, F.lit(0.0))))


def trim_nan(samples: Column, least: int = 7) -> Column:
    """Samples from the first to the last that is a number; none if fewer than ``least`` are left."""
    good = F.transform(samples, lambda v: v.isNotNull() & ~F.isnan(v))
    first = F.array_position(good, True)
    last = F.size(samples) - F.array_position(F.reverse(good), True) + 1
    kept = F.when(first > 0, F.slice(samples, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")))
    return F.when(F.size(kept) >= least, kept).otherwise(F.slice(samples, 1, 0))


def moving_average(samples: Column, width: int) -> Column:
    """Centred mean with the edge values repeated outside; even widths reach further to the left."""
    left = width // 2
    n = F.size(samples)

    def at(i: Column) -> Column:
        return F.get(samples, F.greatest(F.least(i, n - 1), F.lit(0)))

    def mean(_: Column, i: Column) -> Column:
        return reduce(lambda a, b: a + b, [at(i + (k - left)) for k in range(width)]) / width

    return F.transform(samples, mean)


def run_keys(path: Column) -> dict[str, Column]:
    """What the name of a result file says: dimension, reference, thickness, tomogram, projections and angle."""
    name = F.regexp_extract(F.url_decode(path), r"([^/]*)$", 1)
    pattern = r"^(?:dt)?FSC([23])D_(?:ref([ab])_)?([^_]+)_(.+)_(\d+)-limited(?:\[([\d.]+)_-[\d.]+\])?(?:\.csv)?$"

    def part(group: int) -> Column:
        found = F.regexp_extract(name, pattern, group)
        return F.when(found != "", found)

    return {"dim": part(1).cast("int"), "ref": part(2), "thickness": part(3), "tomogram": part(4), "num_ang": part(5).cast("int"), "max_ang": part(6).cast("double")}

"""Fixed schemas of the tables that this package reads and makes. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"double": T.DoubleType(), "float": T.FloatType(), "int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    """Columns from ``name type, ...``; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (column.split() for column in text.split(", "))])


FSC_RESULT = _schema("z double, x double, y double, res double, mean double, corr double")
CATALOG = _schema("tomogram string, label string, pid bigint, expid bigint, mpid bigint, ccdbprod string, thickness string, z_min int, z_max int, magnification string, pixel_size_a double, pixel_size_nm double")
BEAD_CONFIG = _schema("tomogram string, annotation_id string, thickness double, pxl_size double, box_size int, recon_labels array<string>")
POINTS = _schema("tomogram string, bead_id int, x int, y int, z int")
VOLUMES = _schema("vol_id string, nz int, nx int, ny int, ux double, uy double, uz double, resolution double, background double")
BRICKS = _schema("vol_id string, bz int, bx int, by int, z0 int, x0 int, y0 int, nz int, nx int, ny int, data binary")
VOXELS = _schema("vol_id string, z int, x int, y int, v float")
CURVE = _schema("run_id string, idx int, s double, res double, value double")

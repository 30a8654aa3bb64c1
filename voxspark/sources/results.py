"""Readers and writers of result files, catalogs, tilt lists, settings and curves."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import expand_int_list, run_keys
from ..schemas import BEAD_CONFIG, CATALOG, FSC_RESULT


def parse_result_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Result rows from text lines of 4 (last field "res mean"), 5 or 6 fields; the kind comes from their number.

    A blank line has no row; fields that are no numbers become null.
    """
    parts = F.split(F.trim(F.col(column)), r"[,\s]+")
    n = F.size(parts)
    number = lambda i: F.when(n > i, F.get(parts, F.lit(i))).try_cast("double")
    named = {name: number(i) for i, name in enumerate(FSC_RESULT.names)}
    commas = F.size(F.split(F.col(column), ",")) - 1
    kind = F.when(n >= 6, "3d").when(commas == 3, "cli").otherwise("2d")
    return lines.filter(F.length(F.trim(column)) > 0).withColumns(named).withColumn("kind", kind)


def read_fsc_results(spark: SparkSession, path: str, pattern: str = "*FSC?D_*") -> DataFrame:
    """All result files below a folder, with the keys from their names; one scan."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    named = lines.select("value", F.col("_metadata.file_name").alias("file"))
    return parse_result_lines(named).withColumns(run_keys(F.col("file"))).drop("value")


#: Header names of the catalogs, and ours.
CATALOG_COLUMNS = {"Tomogram": "tomogram", "Label": "label", "PID": "pid", "EXPID": "expid", "MPID": "mpid", "ccdbprod": "ccdbprod", "Thickness": "thickness", "z_min": "z_min", "z_max": "z_max", "Magnification": "magnification", "PIxel Size (A)": "pixel_size_a", "Pixel Size bin 4 (nm)": "pixel_size_nm"}


def read_catalog(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Catalogs of differing columns as one table; nameless and unknown columns are left out, missing ones null."""
    out = None
    for path in paths:
        raw = spark.read.option("header", True).csv(path)
        known = {f.name: CATALOG_COLUMNS[f.name.strip()] for f in raw.schema if f.name.strip() in CATALOG_COLUMNS}
        typed = raw.select(*[F.trim(F.col(f"`{old}`")).try_cast(CATALOG[new].dataType).alias(new) for old, new in known.items()]).filter("tomogram is not null")
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in CATALOG if f.name not in out.columns]
    return out.select("*", *missing).select(*CATALOG.names)


def read_tilt_angles(spark: SparkSession, path: str) -> DataFrame:
    """``proj, tilt``: one angle in degrees for each line of a small file; ``rad`` in radians."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s*\n\s*")).alias("proj", "line"))
    return lines.filter("line <> ''").select("proj", F.col("line").cast("double").alias("tilt"), F.radians(F.col("line").cast("double")).alias("rad"))


#: The keys of a reconstruction's settings.
SETTINGS = ("InputProjections", "OutputFile", "FULLIMAGE", "RADIAL", "SCALE", "SHIFT", "MODE", "THICKNESS", "TILTFILE", "FBPINTERP", "PARALLEL", "PERPENDICULAR", "LOG", "XAXISTILT", "EXCLUDELIST", "UseGPU")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: the lines of small text files, each with its number from 0; files are read whole."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def read_tilt_configs(spark: SparkSession, path: str) -> DataFrame:
    """One row of settings for each configuration file of a folder: ``file`` and the ``SETTINGS``, null where absent.

    ``log_base``, ``x_tilt`` and ``excluded`` (numbers of projections) are those that later steps use.
    """
    rows = settings_of(_numbered_lines(spark, path), ["file"], SETTINGS)
    return rows.withColumns({"log_base": F.col("LOG").try_cast("double"), "x_tilt": F.col("XAXISTILT").try_cast("double"), "excluded": expand_int_list(F.regexp_replace("EXCLUDELIST", r"\s", ""))})


def read_nloo2d(spark: SparkSession, path: str) -> DataFrame:
    """Curves of the text files of a folder: ``file, proj, tilt, idx, s, res, value``."""
    rows = parse_curves(_numbered_lines(spark, path), ["file"])
    return rows.select("file", "proj", "tilt", F.col("radius").cast("int").alias("idx"), "s", "res", F.col("value_").alias("value"))


def bead_config(spark: SparkSession, entries: dict) -> DataFrame:
    """The table of a parsed bead configuration, which has to have ``tomograms``; one row for each."""
    if not isinstance(entries, dict) or "tomograms" not in entries:
        raise ValueError("a bead configuration has a list of tomograms")
    number = lambda v: None if v is None else float(v)
    rows = [(e["tomogram"], e.get("annotation_id"), number(e.get("thickness")), number(e.get("pxl_size")), e.get("box_size"), list(e["recon_labels"])) for e in entries["tomograms"]]
    return spark.createDataFrame(rows, BEAD_CONFIG)


def read_bead_config(spark: SparkSession, path: str) -> DataFrame:
    """The bead configuration in a YAML file, a few kB that the driver parses; needs the yaml module."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return bead_config(spark, yaml.safe_load(text["value"]))


def config_labels(config: DataFrame, default_box: int = 36) -> DataFrame:
    """A row for each label of a bead configuration, with its place ``pos`` and the box size or the default one."""
    return config.select("*", F.posexplode("recon_labels").alias("pos", "label")).withColumn("box_size", F.coalesce("box_size", F.lit(default_box))).drop("recon_labels")


def write_roi(boxes: DataFrame, path: str) -> None:
    """Boxes (tomogram, recon_label, bead, values, ...) as Parquet by tomogram and label."""
    boxes.write.mode("append").partitionBy("tomogram", "recon_label").parquet(path)


def read_roi(spark: SparkSession, path: str, tomogram: str | None = None, recon_label: str | None = None) -> DataFrame:
    """Boxes that ``write_roi`` wrote, of all or of one tomogram and label: only its folder is read."""
    out = spark.read.option("inferSchema", False).parquet(path).withColumns({c: F.col(c).cast("string") for c in ("tomogram", "recon_label")})
    for c, v in (("tomogram", tomogram), ("recon_label", recon_label)):
        out = out if v is None else out.filter(F.col(c) == v)
    return out


def import_roi(spark: SparkSession, path: str) -> DataFrame:
    """``tomogram, recon_label, bead, size, x, y, z, values`` from NPZ stacks ``<tomogram>/<label>.npz`` (subvolumes, points).

    A row for each bead; a file is one task's, as it has to be unpacked whole.
    """
    schema = "tomogram string, recon_label string, bead int, size int, x int, y int, z int, values array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                stack = np.load(io.BytesIO(content))
                volumes, points = stack["subvolumes"], stack["points"]
                tomogram, name = unquote(path).rsplit("/", 2)[-2:]
                for bead, (volume, point) in enumerate(zip(volumes, points)):
                    yield pd.DataFrame({"tomogram": [tomogram], "recon_label": [name.removesuffix(".npz")], "bead": [bead], "size": [volume.shape[0]], "x": [int(point[0])], "y": [int(point[1])], "z": [int(point[2])], "values": [volume.astype(np.float32).ravel()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, schema)


def settings_of(lines: DataFrame, by: Sequence[str], keys: Sequence[str], column: str = "value") -> DataFrame:
    """One row of settings for each file from lines ``KEY value``; of repeated keys the last line counts (``line``: its number)."""
    key, value = F.regexp_extract(column, r"^\s*(\w+)", 1), F.trim(F.regexp_extract(column, r"^\s*\w+\s*(.*)$", 1))
    return lines.select(*by, "line", key.alias("key"), value.alias("val")).groupBy(*by).pivot("key", list(keys)).agg(F.max_by("val", "line"))


def parse_curves(lines: DataFrame, by: Sequence[str], column: str = "value") -> DataFrame:
    """Curve rows from text: a header line with projection and tilt, a comment line, then rows.

    Each row takes the last header before it; ``line`` orders the lines of a file.
    """
    header = r"Projection # (\d+) - Tilt angle: (-?[\d.]+)"
    order = Window.partitionBy(*by).orderBy("line")
    proj = F.when(F.regexp_like(column, F.lit(header)), F.regexp_extract(column, header, 1).try_cast("int"))
    tilt = F.when(F.regexp_like(column, F.lit(header)), F.regexp_extract(column, header, 2).try_cast("double"))
    filled = lines.withColumn("proj", F.last(proj, ignorenulls=True).over(order)).withColumn("tilt", F.last(tilt, ignorenulls=True).over(order))
    parts = F.split(F.trim(F.col(column)), r"\s+")
    rows = filled.filter(F.regexp_like(column, F.lit(r"^\s*\d")))
    return rows.select(*by, "proj", "tilt", "line", *[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("radius", "s", "res", "value_"))])


def equal_lengths(curves: DataFrame, by: Sequence[str]) -> DataFrame:
    """Files whose curves differ in length."""
    n = curves.groupBy(*by, "proj").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.min("n").alias("least"), F.max("n").alias("most")).filter("least < most")


def points_of(trees: Column) -> Column:
    """Positions of all nodes of all trees."""
    return F.flatten(F.transform(trees, lambda t: F.transform(t["nodes"], lambda n: n["position"])))


def result_line(corr: bool = True) -> Column:
    """A result row as text, with blanks after the commas."""
    names = ["z", "x", "y", "res", "mean", *(["corr"] if corr else [])]
    return F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in names])


def write_results(df: DataFrame, path: str, text: bool = False) -> None:
    """Parquet by magnification and number of projections, or text lines."""
    if text:
        df.select(result_line()).write.text(path)
    else:
        df.write.partitionBy("magnification", "num_ang").parquet(path)


def overwrite_runs(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replaces the partitions of the runs in ``df`` and leaves others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def wide_estimates(df: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """A column for each threshold."""
    wide = df.groupBy(*by).pivot("threshold", [float(t) for t in thresholds]).agg(F.first("res"))
    return wide.select(*by, *[F.col(f"`{float(t)}`").alias(f"t{round(t * 100):02d}") for t in thresholds])


# --- texts of curves and estimates ---------------------------------------------------------------------


def _number(c: Column, width: int, digits: int) -> Column:
    """``%<width>.<digits>f`` as C prints it: the value itself is rounded, where ``format_string`` rounds halves of its shortest decimal up."""
    rounded = F.call_function("format_number", c, F.lit("0." + "0" * digits))
    return F.when(F.abs(c) < 1e9, F.format_string(f"%{width}s", rounded)).otherwise(F.format_string(f"%{width}.{digits}f", c))


def curve_lines(curves: DataFrame, by: Sequence[str], label: str = "NLOO2D", titled: bool = False) -> DataFrame:
    """``by..., line, value``: the text of curves (idx, s, res, value), a header each and a line for each point.

    ``titled`` puts projection and tilt (``proj`` from 0, ``tilt`` in degrees) before the header.
    """
    text = F.concat_ws("\t", F.col("idx").cast("string"), _number(F.col("s"), 7, 5), _number(F.col("res"), 9, 3), _number(F.col("value"), 8, 4))
    points = curves.select(*by, (F.col("idx") + 2).alias("line"), text.alias("text"))
    head = F.lit(f"Radius\ts(1/A)\tRes(A)\t{label}")
    first = curves.filter("idx = 0").select(*by, F.lit(1).alias("line"), head.alias("text"))
    out = points.unionByName(first)
    if titled:
        title = F.format_string("Projection # %d - Tilt angle: %5.2f", (F.col("proj") + 1).cast("int"), F.col("tilt"))
        out = out.unionByName(curves.filter("idx = 0").select(*by, F.lit(0).alias("line"), title.alias("text")))
    return out


def write_curves(curves: DataFrame, by: Sequence[str], path: str, label: str = "NLOO2D", titled: bool = False) -> None:
    """The text of curves, a folder for each value of the first key of ``by`` with its lines in order."""
    lines = curve_lines(curves, by, label, titled)
    lines.repartition(by[0]).sortWithinPartitions(*by, "line").select(by[0], "text").write.partitionBy(by[0]).text(path)


def estimate_lines(estimates: DataFrame, by: Sequence[str], label: str = "NLOO3D") -> DataFrame:
    """``by..., header, text``: the estimates (threshold, res) of a curve as the two lines of an estimate file."""
    ordered = F.array_sort(F.collect_list(F.struct("threshold", "res")))
    held = estimates.groupBy(*by).agg(ordered.alias("e"))  # three thresholds at most
    header = F.array_join(F.transform("e", lambda e: F.format_string(label + "(%3.1f)", e["threshold"])), "\t")
    return held.select(*by, header.alias("header"), F.array_join(F.transform("e", lambda e: _number(e["res"], 8, 2)), "\t").alias("text"))


def tilt_lines(projections: DataFrame) -> DataFrame:
    """``text``: each angle (``tilt``, degrees) to a tenth, halves away from zero, by ``proj``."""
    t = F.col("tilt") * 10
    tenth = F.when(t > -5, F.floor(t + 0.5)).otherwise(F.ceil(t - 0.5))
    tenth = F.when((t > -5) & (t + 0.5 < 0), F.ceil(t + 0.5)).otherwise(tenth)  # the cast goes towards zero
    return projections.select("*", _number(tenth / 10, 5, 1).alias("text"))


def write_tilt_angles(projections: DataFrame, path: str, exact: bool = False) -> None:
    """The tilt list of one series as text, a line for each projection in order: a small table, written as one file.

    ``exact`` writes all digits of an angle, so that it is read as it was, instead of tenths.
    """
    lines = projections.withColumn("text", F.col("tilt").cast("string")) if exact else tilt_lines(projections)
    lines.select("proj", "text").coalesce(1).sortWithinPartitions("proj").select("text").write.text(path)


def pack_params(*columns: Column) -> Column:
    """The parameters of a run, columns by their names, as JSON; null ones are left out."""
    return F.to_json(F.struct(*columns))


def unpack_params(packed: Column, schema: str) -> Column:
    """The parameters of ``schema`` from JSON, a struct; missing ones are null."""
    return F.from_json(packed, schema)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """The parameters of a run as one JSON row beside its results."""
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def use_params(spark: SparkSession, path: str, params: dict) -> dict:
    """Parameters recorded at ``path`` over those given; keys that only one of both has are kept."""
    return params | json.loads(spark.read.text(path).first()["value"])

"""Volumes in MRC files as bricks: a Python data source, one or several slabs of sections for each partition.

``spark.dataSource.register(MrcSource)`` and ``spark.read.format("mrc").load(path)``. Options: ``brick``, the edge of a
brick, ``slab``, the sections that a partition reads, ``stack``: each section is one image, a row with its number as
``bz``, and ``paths``: several files as a JSON list. Of a slab a task holds the rows of one row of bricks at a time. Both byte
orders are read. Where there are more slabs than ``tasks``, neighbours share a partition: small files are many, and a partition of
its own costs each of them more than its reading.

``read_bricks`` and ``read_projections`` switch on ``pushdown``: conditions on vol_id and on brick numbers reach the
reader, which then makes no partition of slabs, and reads no rows, that they leave out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..schemas import BRICKS

#: Pixel types by the mode in the header.
MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2"}
HEADER = 1024


@dataclass
class Slab(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Slabs(InputPartition):
    parts: list[Slab]


#: Bytes of a partition of several slabs at most, files that are opened at once for their headers, voxels of a batch.
PARTITION_BYTES, OPENED, BATCH = 2**28, 16, 2**18


def header_of(source) -> tuple[int, int, int, str, int]:
    """(sections, rows, columns, pixel type, offset of the data)."""
    raw = source.read(HEADER)
    order = ">" if raw[212:213] == b"\x11" else "<"  # the machine stamp
    columns, rows, sections, mode = np.frombuffer(raw[:16], order + "i4").tolist()
    if mode not in MODES or min(columns, rows, sections) < 1:
        raise ValueError(f"not a volume that can be read: mode {mode}, size {sections} x {rows} x {columns}")
    return sections, rows, columns, order + MODES[mode], HEADER + int(np.frombuffer(raw[92:96], order + "i4")[0])


class MrcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self):
        return BRICKS

    def reader(self, schema) -> DataSourceReader:
        return (PruningReader if str(self.options.get("pushdown", "false")).lower() == "true" else MrcReader)(self.options)


def _open(path: str):
    system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(base)


def _header_at(path: str) -> tuple[int, int, int, str, int]:
    with _open(path) as source:
        return header_of(source)


def _packed(slabs: list[Slab], sizes: list[int], tasks: int) -> list[Slabs]:
    """The slabs in their order as about ``tasks`` partitions of alike bytes, more where these would be too large; slabs
    of a file that follow on each other become one."""
    ends = np.cumsum(sizes)
    share = min(-(-int(ends[-1]) // tasks), PARTITION_BYTES)
    out, last = [], -1
    for slab, number in zip(slabs, ((ends - 1) // share).tolist()):
        if number > last:
            out.append(Slabs([]))
        parts, last = out[-1].parts, number
        if parts and parts[-1].path == slab.path and parts[-1].stop == slab.start:
            parts[-1] = Slab(slab.path, parts[-1].start, slab.stop)
        else:
            parts.append(slab)
    return out


class MrcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.brick, self.slab = int(options.get("brick", 64)), int(options.get("slab", 64))
        self.tasks = int(options["tasks"]) if "tasks" in options else None
        self.filters: list[Filter] = []
        self.stack = str(options.get("stack", "false")).lower() == "true"
        if self.slab % self.brick:
            raise ValueError("slabs must hold whole bricks")

    def _kept(self, column: str, value) -> bool:
        """Whether the conditions that were pushed down leave a value of a column."""
        return all(_holds(f, value) for f in self.filters if f.attribute == (column,))

    def partitions(self) -> list[InputPartition]:
        """Slabs of all files; of each file the driver reads the header, of some at a time."""
        out, sizes, step = [], [], 1 if self.stack else self.brick
        paths = [p for p in self.paths if self._kept("vol_id", p)]
        with ThreadPoolExecutor(OPENED) as pool:
            for path, (sections, nx, ny, kind, _) in zip(paths, pool.map(_header_at, paths)):
                slabs = [Slab(path, a, min(a + self.slab, sections)) for a in range(0, sections, self.slab)]
                slabs = [s for s in slabs if any(self._kept("bz", z // step) and self._kept("z0", z) for z in range(s.start, s.stop, step))]
                out += slabs
                sizes += [(s.stop - s.start) * nx * ny * np.dtype(kind).itemsize for s in slabs]
        return out if self.tasks is None or len(out) <= self.tasks else _packed(out, sizes, self.tasks)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for slab in partition.parts if isinstance(partition, Slabs) else [partition]:
            yield from self._read(slab)

    def _read(self, partition: Slab) -> Iterator[tuple]:
        b = self.brick
        with _open(partition.path) as source:
            _, nx, ny, kind, offset = header_of(source)
            size = np.dtype(kind).itemsize

            def rows(z: int, x0: int, n: int) -> np.ndarray:
                source.seek(offset + (z * nx + x0) * ny * size)
                return np.frombuffer(source.read(n * ny * size), kind).reshape(n, ny).astype("<f4")

            if self.stack:
                for z in (z for z in range(partition.start, partition.stop) if self._kept("bz", z) and self._kept("z0", z)):
                    yield (partition.path, z, 0, 0, z, 0, 0, 1, nx, ny, rows(z, 0, nx).tobytes())
                return
            for z0 in range(partition.start, partition.stop, b):
                if not (self._kept("bz", z0 // b) and self._kept("z0", z0)):
                    continue
                sections = range(z0, min(z0 + b, partition.stop))
                for x0 in range(0, nx, b):
                    if not (self._kept("bx", x0 // b) and self._kept("x0", x0)):
                        continue
                    part = np.stack([rows(z, x0, min(b, nx - x0)) for z in sections])
                    for y0 in (y0 for y0 in range(0, ny, b) if self._kept("by", y0 // b) and self._kept("y0", y0)):
                        cut = part[:, :, y0 : y0 + b]
                        yield (partition.path, z0 // b, x0 // b, y0 // b, z0, x0, y0, *cut.shape, cut.tobytes())


#: Columns whose conditions the reader can use.
PUSHED = {"vol_id", "bz", "bx", "by", "z0", "x0", "y0"}


def _holds(condition: Filter, value) -> bool:
    if isinstance(condition, In):
        return value in condition.value
    if isinstance(condition, EqualTo):
        return value == condition.value
    if isinstance(condition, GreaterThan):
        return value > condition.value
    if isinstance(condition, GreaterThanOrEqual):
        return value >= condition.value
    if isinstance(condition, LessThan):
        return value < condition.value
    return value <= condition.value


class PruningReader(MrcReader):
    """A reader that is told conditions on its columns; they are checked by Spark as well where they are not kept."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (In, EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.filters.append(f)
            else:
                yield f


def _reader(spark: SparkSession, paths: str | Sequence[str]):
    spark.dataSource.register(MrcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("mrc").option("pushdown", "true").option("paths", json.dumps(files)).option("tasks", 4 * spark.sparkContext.defaultParallelism)


def read_bricks(spark: SparkSession, paths: str | Sequence[str], brick: int = 64, slab: int = 64, plan: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Bricks of one or several volumes, and only those that the tiles of ``plan`` (vol_id, z, x, y: starts; ``size`` voxels a
    side) need where one is given: whole slabs beyond them are not opened.

    The driver gets the brick numbers that tiles touch along each axis, as many as the axes have bricks at most.
    """
    bricks = _reader(spark, paths).option("brick", brick).option("slab", slab).load()
    if plan is None:
        return bricks
    touched = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.floor(F.col(a) / brick), F.floor((F.col(a) + size - 1) / brick)))))).alias(a) for a in "zxy"]
    found = plan.agg(F.collect_set("vol_id").alias("vols"), *touched).first()
    for column, values in (("vol_id", found["vols"]), ("bz", found["z"]), ("bx", found["x"]), ("by", found["y"])):
        bricks = bricks.filter(F.col(column).isin([v if column == "vol_id" else int(v) for v in values]))
    return bricks


def read_projections(spark: SparkSession, paths: str | Sequence[str], slab: int = 64) -> DataFrame:
    """``series, proj, nx, ny, data``: the images of projection stacks, one for each tilt."""
    rows = _reader(spark, paths).option("stack", "true").option("slab", slab).option("brick", slab).load()
    return rows.selectExpr("vol_id as series", "bz as proj", "nx", "ny", "data")


def write_volumes(sections: DataFrame, folder: str) -> DataFrame:
    """``path, sections``: volume files of 4-byte floats ``<folder>/<file>.mrc``, one for each ``file`` of ``sections`` (file, z, nx, ny, values: arrays).

    A file is one task's, section after section; one that is written again is replaced.
    """

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("z")
        first = frame.iloc[0]
        header = np.zeros(HEADER // 4, "<i4")
        header[:4] = (first["ny"], first["nx"], len(frame), 2)
        raw = bytearray(header.tobytes())
        raw[208:216] = b"MAP \x44\x44\x00\x00"
        path = f"{folder}/{first['file']}.mrc"
        system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(base.rpartition("/")[0], recursive=True)
        with system.open_output_stream(base) as out:
            out.write(bytes(raw))
            for v in frame["values"]:
                out.write(np.asarray(v, "<f4").tobytes())
        return pd.DataFrame({"path": [path], "sections": [len(frame)]})

    return sections.groupBy("file").applyInPandas(write, "path string, sections int")


def explode_bricks(bricks):
    """``vol_id, z, x, y, v`` of bricks, on Arrow batches: of small bricks many at once, of large ones one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = [np.asarray(batch[c]).astype(np.int64) for c in ("nz", "nx", "ny")]
            start = {c: np.asarray(batch[f"{c}0"]) for c in "zxy"}
            count = shape[0] * shape[1] * shape[2]
            parts = (np.cumsum(count) - 1) // BATCH
            for rows in np.split(np.arange(len(count)), np.flatnonzero(np.diff(parts)) + 1):
                row = np.repeat(rows, count[rows])
                place = np.arange(len(row)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
                nx, ny = shape[1][row], shape[2][row]
                at = {"z": place // (nx * ny), "x": place // ny % nx, "y": place % ny}
                ids = batch["vol_id"].take(pa.array(row))
                places = [pa.array((at[c] + start[c][row]).astype(np.int32)) for c in "zxy"]
                values = np.frombuffer(b"".join(batch["data"].take(pa.array(rows)).to_pylist()), "<f4")
                yield pa.RecordBatch.from_arrays([ids, *places, pa.array(values)], names=["vol_id", "z", "x", "y", "v"])

    needed = bricks.select("vol_id", "nz", "nx", "ny", "z0", "x0", "y0", "data")
    return needed.mapInArrow(run, "vol_id string, z int, x int, y int, v float")

"""Queries against their SQL on rows that the smallest tables do not hold."""

import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.functions import columns
from voxspark.queries import QUERIES, SQL
from voxspark.sources import mrc, results

from .test_queries import rows_of
from .test_units import volume_file


def both(spark, folder, name, table, rows, schema):
    """The rows of a query and of its SQL on one table."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall()
    return rows_of(tuple(r) for r in df.select(*columns).collect()), rows_of(want)


def test_tilts_keep_all_digits(spark, tmp_path):
    """Keys up to 1,200: of the angles above 0 the differences are no whole tenths, some are just below 0."""
    got, want = both(spark, tmp_path, "s07_tilt_list", "supplier", [(k,) for k in np.random.default_rng(1).permutation(1200).tolist()], "s_suppkey long")
    assert got == want and len(got) == 1200


def test_printed_numbers_round_as_in_sql(spark):
    """Decimals that end in 5 lie above or below the half in binary; what is a half goes to the even digit."""
    rng = np.random.default_rng(2)
    values = [*(np.round(rng.uniform(0, 4000, 2000), 2) + 0.005).round(6), *(rng.integers(-8000, 8000, 500) / 8), 0.0, -0.001, 1.005, 2.675, 5e8 + 0.125]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    con = duckdb.connect()
    for width, digits in ((8, 2), (9, 3), (8, 4), (7, 5)):
        got = [r["text"] for r in df.select(results._number(F.col("v"), width, digits).alias("text")).collect()]
        assert got == [con.execute(f"select printf('%{width}.{digits}f', ?::DOUBLE)", [float(v)]).fetchall()[0][0] for v in values]


def test_estimates_round_as_in_sql(spark, tmp_path):
    """Curves of one crossing of 0.5 each, whose resolutions are half hundredths after the rounding to six digits."""
    rows = []
    for vec in range(300):
        s = 1 / (1.605 + vec * 0.01)  # the frequency of the crossing; 100 s lies between the points i and i + 1
        i = int(100 * s)
        values = [0.5] * (i - 1) + [100 * s - i] + [100 * s - i - 1] * (65 - i)  # of 2 v + 0.5, 0 lies at 0.5
        rows.append((vec, [float(v) for v in values[:64]], vec % 3))
    got, want = both(spark, tmp_path, "k06_estimate_text", "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert got == want and len(got) == 300


def test_r_squared_of_arrays(spark):
    nan = float("nan")
    rows = [([0.1] * 24, [0.0] * 24), ([1.0, 2.0, 4.0], [1.0, 2.5, 3.0]), ([], []), (None, [1.0]), ([1.0, 2.0], [1.0]), ([1.0, None], [1.0, 2.0]), ([5.0, 7.0], [5.0, 7.0]), ([1.0, 2.0], [None, 2.0]), ([nan, 2.0], [1.0, 2.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v array<double>, m array<double>").coalesce(1)
    got = [r["r2"] for r in df.select("i", columns.r_squared(F.col("v"), F.col("m")).alias("r2")).orderBy("i").collect()]
    assert got[1] == pytest.approx(1 - 1.25 / (14 / 3)) and got[6] == 1.0 and got[8] != got[8]
    assert [got[i] for i in (0, 2, 3, 4, 5, 7)] == [None] * 6


def test_r_squared_takes_time_in_proportion(spark):
    """As many samples in fewer rows take as long; with the mean taken anew for each sample they took 16 times as long."""
    rows = lambda n: spark.range(64000 // n).select(*[F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.rand(k) * i).alias(c) for k, c in enumerate("vm")])

    def seconds(n):
        df = rows(n).select(columns.r_squared(F.col("v"), F.col("m")).alias("r2"))
        began = time.monotonic()
        df.write.format("noop").mode("overwrite").save()
        return time.monotonic() - began

    seconds(100)
    assert seconds(1600) < 4 * seconds(100) + 2


def test_many_small_files_share_partitions(spark, tmp_path):
    """Each slab of each file was a task of its own; now partitions are about as many as tasks can run, with all images in them."""
    rng = np.random.default_rng(4)
    cubes = {f"{tmp_path}/v{n}.mrc": rng.normal(size=(32 + n % 3, 3, 4)).astype("<f4") for n in range(50)}
    for path, cube in cubes.items():
        volume_file(Path(path), cube)
    images = mrc.read_projections(spark, list(cubes), slab=4)
    most = 4 * spark.sparkContext.defaultParallelism
    assert most // 2 <= images.rdd.getNumPartitions() <= most + 1
    got = {(r["series"], r["proj"]): np.frombuffer(r["data"], "<f4").reshape(3, 4) for r in images.collect()}
    assert set(got) == {(p, z) for p, c in cubes.items() for z in range(len(c))} and all(np.array_equal(v, cubes[p][z]) for (p, z), v in got.items())
    # bricks of conditions that leave slabs out within shared partitions
    some = mrc.read_bricks(spark, list(cubes), brick=4, slab=4).filter("bz in (1, 2, 5, 8)")
    voxels = some.select("vol_id", "bz", "nz").collect()
    assert sorted((r["vol_id"], r["bz"], r["nz"]) for r in voxels) == sorted((p, z, min(4, len(c) - 4 * z)) for p, c in cubes.items() for z in (1, 2, 5, 8) if 4 * z < len(c))


def test_partitions_hold_alike_bytes():
    slabs = [mrc.Slab("a", z, z + 4) for z in range(0, 40, 4)] + [mrc.Slab("b", z, z + 4) for z in (0, 4, 12)]
    packed = mrc._packed(slabs, [100] * 13, 4)
    assert [[(s.path, s.start, s.stop) for s in p.parts] for p in packed] == [[("a", 0, 12)], [("a", 12, 24)], [("a", 24, 36)], [("a", 36, 40), ("b", 0, 8), ("b", 12, 16)]]
    assert len(mrc._packed(slabs, [mrc.PARTITION_BYTES] * 13, 4)) == 13


def test_bricks_of_all_sizes_to_voxels(spark):
    from voxspark.schemas import BRICKS

    rng = np.random.default_rng(5)
    shapes = [(1, 2, 3), (4, 3, 2), (70, 65, 60), (1, 1, 1), (66, 65, 64), (2, 2, 2)]  # two of more than a batch
    cubes = [rng.normal(size=s).astype("<f4") for s in shapes]
    rows = [(f"v{i}", 0, 0, 0, 10 * i, i, 2, *c.shape, c.tobytes()) for i, c in enumerate(cubes)]
    df = mrc.explode_bricks(spark.createDataFrame(rows, BRICKS).coalesce(1)).toPandas()
    assert len(df) == sum(c.size for c in cubes)
    for i, c in enumerate(cubes):
        mine = df[df["vol_id"] == f"v{i}"]
        assert np.array_equal(c[mine["z"] - 10 * i, mine["x"] - i, mine["y"] - 2], mine["v"]) and len(mine) == c.size


def test_projection_files_as_in_sql(spark, tmp_path):
    """Two files, one of them not full."""
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=64).astype("f4").tolist(), 0) for k in rng.permutation(100).tolist()]
    got, want = both(spark, tmp_path, "s13_projection_files", "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert got == want and len(got) == 400

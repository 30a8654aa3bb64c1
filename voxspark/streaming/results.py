"""Result rows as a stream: late and repeated runs, and reports that follow them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_results(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 64) -> DataFrame:
    """Parquet files of results as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_of_runs(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """One row for each run; the state of runs older than ``delay`` is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def running_stats(stream: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean and deviation by group, whose state is a few numbers for each group."""
    return stream.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def value_counts(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by..., v, n``: how often each group has each value; nulls and NaN do not count. Counts of parts add up."""
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    return rows.select(*by, v.alias("v")).filter("v is not null").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))


def stats_of_counts(counts: DataFrame, by: Sequence[str], estimator: str = "mean", interval: int = 50) -> DataFrame:
    """``by..., estimate, low, high, n`` of ``report.point_stats`` from counts of values, exactly.

    Percentiles interpolate between the values at two ranks, which running sums of the counts find: what a window
    sorts is a group's distinct values, not its rows.
    """
    shares = {"low": (100 - interval) / 200, "mid": 0.5, "high": (100 + interval) / 200}
    order = Window.partitionBy(*by).orderBy("v")
    every = Window.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(every))
    out = [F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean")]
    for name, share in shares.items():
        at = F.lit(share) * (F.col("all") - 1)
        for side, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            holds = (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))
            out.append(F.max(F.when(holds, F.col("v"))).alias(f"{name}_{side}"))
        out.append(F.max(at - F.floor(at)).alias(f"{name}_w"))
    found = placed.groupBy(*by).agg(*out)
    value = {name: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * F.col(f"{name}_w") for name in shares}
    return found.select(*by, (F.col("mean") if estimator == "mean" else value["mid"]).alias("estimate"), value["low"].alias("low"), value["high"].alias("high"), "n")


def append_and_report(stream: DataFrame, table: str, report: str, by: Sequence[str], value: str, checkpoint: str, estimator: str = "mean"):
    """Appends each batch of ``stream`` to ``table`` once, by its number, and refreshes the group estimates in ``report``.

    Returns the running query, which ends when all files that are there have been read. Beside the rows, ``table`` has a
    state: counts of values by group, ``<table>_state/after=<batch>``. A batch reads its own rows and the state of the batch
    before, adds both, and writes the next state and the report from it, so that it costs what is new and the number of distinct
    values, not the table. A batch that is repeated after a failure starts from the state before it again, and replaces
    its own folders; states before the last two are deleted.
    """
    state = f"{table}_state"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        rows = spark.read.schema(batch.schema).parquet(f"{table}/batch={number}")
        counts = value_counts(rows, by, value)
        done = _states(spark, state)
        before = [n for n in done if n < number]
        if before:
            old = spark.read.schema(counts.schema).parquet(f"{state}/after={max(before)}")
            counts = counts.unionByName(old).groupBy(*by, "v").agg(F.sum("n").alias("n"))
        counts.write.mode("overwrite").parquet(f"{state}/after={number}")
        stats_of_counts(spark.read.schema(counts.schema).parquet(f"{state}/after={number}"), by, estimator).write.mode("overwrite").parquet(report)
        for n in sorted(before)[:-1]:
            _folder(spark, f"{state}/after={n}", delete=True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str, delete: bool = False) -> list[str]:
    """Names of what a folder holds that was written whole; or the folder deleted."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if delete:
        system.delete(target, True)
        return []
    if not system.exists(target):
        return []
    return [f.getPath().getName() for f in system.listStatus(target) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]


def _states(spark: SparkSession, state: str) -> list[int]:
    return [int(name.split("=")[1]) for name in _folder(spark, state) if name.startswith("after=")]

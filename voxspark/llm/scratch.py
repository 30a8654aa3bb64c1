"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

Operators that read an intermediate result more than once write it as Parquet. The table cuts the
lineage, survives the loss of executors, and keeps random choices such as range bounds fixed. A
folder of one's own is made only where the session names none and runs on this machine alone, as in tests.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a new local one, set for the session, where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(root, exist_ok=True)
        folder = "file://" + tempfile.mkdtemp(dir=root)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch. Texts are long: with Spark's default of 10,000 a batch takes tens of MB on either side.
BATCH_ROWS = 1_000


class Scratch:
    """A folder of intermediate tables, removed when the driver's Python ends.

    Makes the session's Arrow batches smaller unless someone has set their size.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        self.path = f"{shared_dir(spark)}/voxspark-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[tuple[DataFrame, str]] = []
        atexit.register(_delete, spark, self.path)

    def folder(self, label: str) -> str:
        """A new path below this folder."""
        self._n += 1
        return f"{self.path}/{self._n:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``df``, written once and read from its table from then on."""
        path = self.folder(label)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((kept, path))
        return kept

    def free(self, *needed: DataFrame) -> None:
        """Deletes the tables that ``keep`` has made, but for those ``needed``: what was derived from the others is to be written."""
        gone = [path for df, path in self._tables if all(df is not x for x in needed)]
        self._tables = [(df, path) for df, path in self._tables if path not in gone]
        for path in gone:
            _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: its cluster cleans the folder
        pass

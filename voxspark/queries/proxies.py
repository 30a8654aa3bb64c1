"""Stand-ins for measurements, derived from the given tables, and the same as SQL.

No volumes come with the tables: 64-float vectors serve as 4 x 4 x 4 volumes, 8 x 8 images and
64-sample profiles, order lines as result rows, orders as annotated points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

_RESULTS = """
  CASE l_returnflag WHEN 'A' THEN '250nm' WHEN 'N' THEN '500nm' ELSE '1000nm' END AS thickness,
  CASE l_linestatus WHEN 'F' THEN 'a' ELSE 'b' END AS ref,
  concat('tomo', cast(l_suppkey % 8 AS {string})) AS name,
  l_linenumber * 10 + 1 AS num_ang,
  cast(floor(l_quantity / 10) * 10 + 10 AS double) AS max_ang,
  cast(l_partkey % 4 * 45 AS double) AS z, cast(l_orderkey % 40 * 50 AS double) AS x, cast(l_suppkey % 40 * 50 AS double) AS y,
  CASE WHEN l_tax = 0 AND l_discount <= 0.01 THEN cast(-1 AS double) WHEN l_tax >= 0.08 AND l_discount >= 0.1 THEN cast('NaN' AS double) ELSE l_extendedprice / 1000 END AS res,
  l_quantity AS mean, l_discount AS corr,
  cast(CASE WHEN l_returnflag = 'A' THEN 1.4 ELSE 4.9 END AS double) AS pixel_size
"""

#: Common table expressions for the SQL of queries.
RESULTS_SQL = f"""results AS (SELECT l_orderkey, l_partkey, l_suppkey, {_RESULTS.format(string='varchar')} FROM lineitem),
clean AS (SELECT * REPLACE (CASE WHEN isnan(res) OR res = -1 THEN NULL ELSE res END AS res),
  CASE WHEN isnan(res) THEN 'nan' WHEN res = -1 THEN 'empty' ELSE 'ok' END AS status FROM results)"""

VOXELS_SQL = "voxels AS (SELECT vec_id AS vol_id, label, (i // 16)::INT AS z, (i // 4 % 4)::INT AS x, (i % 4)::INT AS y, v::DOUBLE AS v FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings))"
IMAGES_SQL = "images AS (SELECT vec_id AS img, label, (i // 8)::INT AS px, (i % 8)::INT AS py, v::DOUBLE AS v FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings))"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", *_split(_RESULTS.format(string="string")))


def _split(select: str) -> list[str]:
    """The items of a select list."""
    out, depth, item = [], 0, ""
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]


def _exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vol_id, label, z, x, y, v`` of 4 x 4 x 4 volumes."""
    i = F.col("i")
    return _exploded(spark, sf_dir).select(F.col("vec_id").alias("vol_id"), "label", F.floor(i / 16).cast("int").alias("z"), (F.floor(i / 4) % 4).cast("int").alias("x"), (i % 4).cast("int").alias("y"), "v")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img, label, px, py, v`` of 8 x 8 images."""
    i = F.col("i")
    return _exploded(spark, sf_dir).select(F.col("vec_id").alias("img"), "label", F.floor(i / 8).cast("int").alias("px"), (i % 8).cast("int").alias("py"), "v")

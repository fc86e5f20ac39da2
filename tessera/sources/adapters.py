"""Pixel tables from the star-schema tables, by fixed integer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.grid import dense

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_lineitem(spark: SparkSession, sf_dir: str, *scenes: int) -> DataFrame:
    """``scene_id``, ``r``, ``c``, ``dn``: line numbers as scenes of 32 by 32 cells, 8 bits."""
    rows = table(spark, sf_dir, "lineitem")
    if scenes:
        rows = rows.where(F.col("l_linenumber").isin(*scenes))
    return rows.groupBy(
        F.col("l_linenumber").alias("scene_id"), F.pmod("l_orderkey", F.lit(SIDE)).cast("int").alias("r"), F.pmod("l_partkey", F.lit(SIDE)).cast("int").alias("c")
    ).agg(F.max(F.floor("l_quantity") * 5).cast("long").alias("dn"))


def scene_ids(spark: SparkSession, sf_dir: str) -> list[int]:
    """The scenes of ``lineitem``, in ascending order; a mosaic takes them one after the other."""
    return sorted(r[0] for r in table(spark, sf_dir, "lineitem").where("l_linenumber IS NOT NULL").select("l_linenumber").distinct().collect())


def scenes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id`` of every scene."""
    return table(spark, sf_dir, "lineitem").where("l_linenumber IS NOT NULL").select(F.col("l_linenumber").alias("scene_id")).distinct()


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id``, ``r``, ``c`` of every cell of every scene, with two cloud codes (0 or 10) that its
    rows give: ``cell``, scattered over about a sixth of the cells, and ``block``, in 8 by 8 blocks."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("scene_id"), F.pmod("l_orderkey", F.lit(SIDE)).cast("int").alias("r"), F.pmod("l_partkey", F.lit(SIDE)).cast("int").alias("c")).agg(F.sum("l_suppkey").alias("s"))
    cells = dense(spark, scenes_of(spark, sf_dir), SIDE, SIDE).join(rows, ["scene_id", "r", "c"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    br, bc = F.floor(F.col("r") / 8), F.floor(F.col("c") / 8)
    block = F.sum("s").over(Window.partitionBy("scene_id", br, bc)) + br * 3 + bc * 5 + F.col("scene_id")
    cell = F.col("s") + F.col("r") * 7 + F.col("c") * 3 + F.col("scene_id") * 11
    return cells.select("scene_id", "r", "c", F.when(cell % 17 < 3, 10).otherwise(0).alias("cell"), F.when(block % 6 == 0, 10).otherwise(0).alias("block"))


def px_bands(spark: SparkSession, sf_dir: str, *scenes: int) -> DataFrame:
    """``scene_id``, ``band`` 1..4, ``r``, ``c``, ``dn``; one aggregation, then the bands stacked."""
    rows = table(spark, sf_dir, "lineitem")
    if scenes:
        rows = rows.where(F.col("l_linenumber").isin(*scenes))
    wide = rows.groupBy(F.col("l_linenumber").alias("scene_id"), F.pmod("l_orderkey", F.lit(SIDE)).cast("int").alias("r"), F.pmod("l_partkey", F.lit(SIDE)).cast("int").alias("c")).agg(
        F.max(F.floor("l_quantity")).cast("long").alias("b1"), F.max(F.floor("l_extendedprice") % 4095 + 1).cast("long").alias("b2"),
        F.max(F.floor(F.col("l_discount") * 100 + 0.5)).cast("long").alias("b3"), F.max(F.floor(F.col("l_tax") * 100 + 0.5)).cast("long").alias("b4"),
    )
    return wide.select("scene_id", "r", "c", F.expr("stack(4, 1, b1, 2, b2, 3, b3, 4, b4) AS (band, dn)")).select("scene_id", "band", "r", "c", "dn")


def px_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id``, ``label``, ``r``, ``c``, ``dn``: vectors of 64 as 8 by 8 patches."""
    value = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 1) * 127.5))).cast("long")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "label", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), value.alias("dn"))


def patch_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id``, ``label``, ``cells``: the patches of :func:`px_embedding`, row by row, one array each."""
    value = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5))).cast("long")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", value).alias("cells"))


def scene_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene catalogue with footprint boxes: ``scene_id``, ``name``, ``x0``, ``y0``, ``x1``, ``y1``."""
    k = F.col("s_suppkey")
    x0, y0 = (k * 37) % 1000, 1000 + (k * 53) % 1000
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.select(k.alias("scene_id"), F.concat(F.lit("a"), F.lpad(k.cast("string"), 7, "0"), F.lit("_"), F.col("n_name")).alias("name"), x0.alias("x0"), y0.alias("y0"), (x0 + 60 + k % 40).alias("x1"), (y0 - 60 - k % 30).alias("y1"))

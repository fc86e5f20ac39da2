"""Grid arithmetic: geotransforms, windows, pixel ids, search orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pixel_id(r: Column, c: Column, width: int) -> Column:
    return r * width + c + 1


def to_col(x: Column, x0: Column, res: Column, half_even: bool = False) -> Column:
    v = (x - x0) / res
    return (F.bround(v) if half_even else F.floor(v)).cast("long")


def to_row(y: Column, y0: Column, res: Column, half_even: bool = False) -> Column:
    v = (y0 - y) / res
    return (F.bround(v) if half_even else F.floor(v)).cast("long")


def corner_col(size: Column | int, origin: Column) -> Column:
    return origin + size


def padded(lo: Column, size: Column, limit: Column, pad: int = 10) -> tuple[Column, Column]:
    """Margins before and after a box side: ``pad``, or what the edge leaves."""
    return F.least(F.lit(pad), lo), F.least(F.lit(pad), limit - (lo + size))


def spiral(nx: int = 50, ny: int = 50) -> list[tuple[int, int, int]]:
    """Offsets (step, dx, dy) of a square spiral around 0 that stay within nx by ny.

    Its sides are 1, 1, 2, 2, 3, 3, … steps long and turn from +x to +y, -x, -y and on; it is walked
    until it has covered the larger side's square.
    """
    side = max(nx, ny)
    turns = np.arange(2 * side)
    heading = np.array([(1, 0), (0, 1), (-1, 0), (0, -1)])[turns % 4]
    walked = np.concatenate([[(0, 0)], np.cumsum(np.repeat(heading, turns // 2 + 1, axis=0), axis=0)])[: side * side]
    x, y = walked.T
    inside = walked[(2 * x > -nx) & (2 * x <= nx) & (2 * y > -ny) & (2 * y <= ny)]
    return [(k, dx, dy) for k, (dx, dy) in enumerate(inside.tolist())]


def dense(spark: SparkSession, keys: DataFrame | None, height: int, width: int) -> DataFrame:
    """Every cell (r, c) of a grid, for each row of ``keys`` (a scene list) if given."""
    cells = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("r"), F.pmod("id", F.lit(width)).cast("int").alias("c"))
    if keys is None:
        return cells
    rows = F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    return keys.select("*", rows.alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c"))


def completed(px: DataFrame, keys: list[str], height: int, width: int, value: str = "dn") -> DataFrame:
    """``px`` with a row for every cell of each key; absent cells are no-data, 0."""
    full = dense(px.sparkSession, px.select(*keys).distinct(), height, width)
    return full.join(px.select(*keys, "r", "c", value), [*keys, "r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def wkt_point(wkt: Column) -> tuple[Column, Column]:
    """x and y of a POINT or of a LINESTRING's first vertex; null for anything else or empty."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    pattern = rf"^\s*(?:POINT|LINESTRING)\s*\(\s*{number}\s+{number}"
    pick = lambda k: F.when(wkt.rlike(pattern), F.regexp_extract(wkt, pattern, k)).cast("double")
    return pick(1), pick(2)

"""Cloud masks: patches, fractions, borders, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import pixel
from tessera.functions.grid import dense
from tessera.operators import graph
from tessera.operators.focal import dilated
from tessera.operators.state import checkpointed


def target_cells(mask: DataFrame) -> DataFrame:
    """Cells with mask value exactly 1."""
    return mask.where("code = 1")


def patches(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Components (8-connected) of at least ``least`` cells, as ``patch_id`` per cell."""
    return graph.without_scraps(graph.components(cells, keys), keys, least).withColumnRenamed("label", "patch_id")


def clear_fraction(patch: DataFrame, mask: DataFrame, keys: list[str], clear_below: int = 10, shared: tuple[str, ...] = ()) -> DataFrame:
    """Clear cells of each candidate's mask inside each patch; a patch without cells has none. ``shared``:
    keys that patch and mask have in common besides the cell."""
    met = patch.join(mask.select(*shared, "scene_id", "r", "c", "code"), [*shared, "r", "c"])
    return met.groupBy(*keys, "scene_id").agg(F.sum(F.when(F.col("code") < clear_below, 1).otherwise(0)).alias("clear"), F.count("*").alias("cells")).withColumn("fraction", F.coalesce(F.col("clear") / F.col("cells"), F.lit(0.0)))


def on_border(patch: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    edge = F.col("r").isin(0, height - 1) | F.col("c").isin(0, width - 1)
    return patch.groupBy(*keys).agg(F.bool_or(edge).alias("on_border"), F.count("*").alias("cells"))


def updated(mask: DataFrame, patch: DataFrame, flagged: DataFrame, land: DataFrame, index: Column | int, keys: tuple[str, ...] = ()) -> DataFrame:
    """After a fill: filled land cells become 0, land cells the candidate's clouds cover (i + 1) * 10."""
    at = [*keys, "r", "c"]
    out = mask.join(patch.select(*at, F.lit(1).alias("p")), at, "left").join(flagged.select(*at, F.lit(1).alias("f")), at, "left").join(land, ["r", "c"], "left")
    on_land = F.coalesce("land", F.lit(0)) == 1
    code = F.when(F.col("p").isNotNull() & F.col("f").isNull() & on_land, 0).when(F.col("p").isNotNull() & F.col("f").isNotNull() & on_land, (index + 1) * 10).otherwise(F.col("code"))
    return out.select(*at, code.alias("code"))


def isolated(patch: DataFrame, mask: DataFrame, height: int, width: int, grow: int = 10, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``keys``, ``r``, ``c``, ``flag`` of every patch cell: 1 where the candidate is cloudy (codes above 2,
    widened by ``grow`` cells) or where such clouds cut the cell off from the grid's upper left part."""
    at, own = [*keys, "r", "c"], keys or ["one"]
    code = patch.select(*at).join(mask.select(*at, "code"), at).select(*at, F.when(F.col("code") <= 2, 1).otherwise(F.least("code", F.lit(10))).alias("v"))
    grid = dense(mask.sparkSession, patch.select(*keys).distinct() if keys else None, height, width)
    grid = (grid if keys else grid.withColumn("one", F.lit(1))).join(code, at, "left").withColumn("v", F.coalesce("v", F.lit(1)))
    open_ = graph.flooded(checkpointed(dilated(grid, grow, own)), own, (1, 1), 0)
    return patch.join(open_.select(*at, pixel.binary(F.col("v")).alias("flag")), at)


def counters(scores: DataFrame) -> DataFrame:
    return scores.groupBy("reason").agg(F.count("*").alias("n"))

"""Radiometric normalization: change masks, histograms, matching tables, lookup.

Values and counts are integers throughout. The matching rule is ours: a value goes to the least
reference value whose cumulative share is at least its own. It is found with one running window over
the merged distinct values, so 16-bit data need no quadratic join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.pixel import masked

HI_PERCENT, LO_PERCENT = 10, 10


def no_data(px: DataFrame, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """1 where all bands of a cell are 0."""
    return px.groupBy(*keys).agg(F.when(F.max("dn") == 0, 1).otherwise(0).alias("no_data"))


def differences(raw: DataFrame, ref: DataFrame, bands: tuple[int, ...] = (1, 2, 3), keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``band``, ``r``, ``c``, ``diff``: raw minus reference where the raw cell has data, else 0."""
    at = [*keys, "r", "c"]
    kept = raw.where(F.col("band").isin(*bands)).join(no_data(raw, tuple(at)), at)
    other = ref.where(F.col("band").isin(*bands)).select(*keys, "band", "r", "c", F.col("dn").alias("ref"))
    return kept.join(other, [*keys, "band", "r", "c"]).select(*keys, "band", "r", "c", F.when(F.col("no_data") == 0, F.col("dn") - F.col("ref")).otherwise(0).alias("diff"), "no_data")


def thresholds(diff: DataFrame, hi_percent: int = HI_PERCENT, lo_percent: int = LO_PERCENT, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per band: shares of the largest gain and of the largest loss. One row for each key and band."""
    clamp = lambda p: max(0, min(100, p))
    return diff.groupBy(*keys, "band").agg(
        (F.greatest(F.lit(0), F.max("diff")) * clamp(hi_percent) / F.lit(100.0)).alias("hi"), (F.least(F.lit(0), F.min("diff")) * clamp(lo_percent) / F.lit(100.0)).alias("lo")
    )


def change_codes(diff: DataFrame, limits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Codes 1 (loss beyond the limit), 2, 3 (no change), 4, 5 (gain beyond the limit)."""
    d = F.col("diff")
    code = F.when(d < F.col("lo"), 1).when(d < 0, 2).when(d == 0, 3).when(d <= F.col("hi"), 4).otherwise(5)
    return diff.join(F.broadcast(limits), [*keys, "band"]).withColumn("code", code)  # limits: a row for each scene and band


def changed(codes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return codes.groupBy(*keys, "r", "c").agg(F.max(F.when(F.col("code").isin(1, 5), 1).otherwise(0)).alias("changed"), F.max("no_data").alias("no_data"))


def exclusion(change: DataFrame, river: DataFrame, border: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """1 where changed, water, outside the border or without data. Absent cells: no water, outside."""
    at = [*keys, "r", "c"]
    out = change.join(river, at, "left").join(border, at, "left")
    hit = (F.col("changed") == 1) | (F.coalesce("river", F.lit(0)) == 1) | (F.coalesce("border", F.lit(0)) == 0) | (F.col("no_data") == 1)
    return out.select(*at, F.when(hit, 1).otherwise(0).alias("excluded"))


def without_masked(px: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``px`` with masked cells (``mask`` 1) set to no data, so that histograms leave them out."""
    met = px.join(mask.select(*keys, "r", "c", "mask"), [*keys, "r", "c"], "left")
    return met.withColumn("dn", masked(F.col("dn"), F.coalesce("mask", F.lit(0)))).select(*px.columns)


def histogram(px: DataFrame, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """Counts of every value but 0."""
    return px.where("dn <> 0").groupBy(*keys, "dn").agg(F.count("*").alias("n"))


def matching_table(raw: DataFrame, ref: DataFrame, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """``keys``, ``dn``, ``out`` from two histograms. Shares are compared as cross products, exactly;
    the reference's values are merged into the raw ones' order and the next one at or above is taken."""

    def shares(h: DataFrame, side: int) -> DataFrame:
        run = Window.partitionBy(*keys).orderBy("dn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return h.withColumn("k", F.sum("n").over(run)).withColumn("t", F.sum("n").over(Window.partitionBy(*keys))).select(*keys, "dn", "k", "t", F.lit(side).alias("side"))

    a, b = shares(raw, 1), shares(ref, 0)
    totals = a.select(*keys, F.col("t").alias("ta")).distinct().join(b.select(*keys, F.col("t").alias("tb")).distinct(), list(keys))
    both = a.union(b).join(totals, list(keys))
    # k / t on a common scale: k_raw * t_ref against k_ref * t_raw
    place = F.col("k").cast("decimal(38,0)") * F.when(F.col("side") == 1, F.col("tb")).otherwise(F.col("ta")).cast("decimal(19,0)")
    ahead = Window.partitionBy(*keys).orderBy(F.col("place").desc(), F.col("side").asc(), F.col("dn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("place", place).withColumn("out", F.min(F.when(F.col("side") == 0, F.col("dn"))).over(ahead))
    return found.where("side = 1").select(*keys, "dn", "out")


def reshaped(table: DataFrame, knee: int) -> DataFrame:
    """Our stretch of dark values: below the knee a square-root curve that meets it, monotone."""
    low = F.floor(F.sqrt(F.col("out") * F.lit(float(knee)))).cast("long")
    return table.withColumn("out", F.when((F.col("out") > 0) & (F.col("out") < knee), low).otherwise(F.col("out")))


def complete_groups(tables: DataFrame, bands: int = 4) -> DataFrame:
    """Tables of scenes that have one for every band."""
    whole = tables.groupBy("scene_id").agg(F.countDistinct("band").alias("n")).where(F.col("n") == bands).select("scene_id")
    return tables.join(whole, "scene_id", "left_semi")


def apply_table(px: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """Looks every value up; a cell whose bands sum to 0 stays 0, a value without an entry becomes 0."""
    cells = [c for c in px.columns if c not in ("band", "dn")]
    total = F.sum("dn").over(Window.partitionBy(*cells))
    return px.withColumn("total", total).join(table, [*keys, "dn"], "left").select(*cells, "band", "dn", F.when(F.col("total") > 0, F.coalesce("out", F.lit(0))).otherwise(0).alias("out"))

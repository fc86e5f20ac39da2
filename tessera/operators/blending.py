"""Blending scenes and masks into mosaics, filling patches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.pixel import blend
from tessera.operators import kernels
from tessera.operators.state import checkpointed

FULL = 58


def coverage(parts: DataFrame, weight: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``scene_id``, ``region`` 0 or 1 (weights exactly 0 or full), covered and all cells, for
    the scenes of ``parts`` (``keys``, ``scene_id``, ``r``, ``c``, ``dn``); ``weight`` holds for all keys."""
    region = F.when(F.col("k") == 0, 0).when(F.col("k") == FULL, 1)
    cells = weight.withColumn("region", region).where("region IS NOT NULL")
    sizes = cells.groupBy("region").agg(F.count("*").alias("cells"))  # two rows
    hits = parts.where("dn > 0").select(*keys, "scene_id", "r", "c").distinct().join(cells.select("r", "c", "region"), ["r", "c"]).groupBy(*keys, "scene_id", "region").agg(F.count("*").alias("covered"))
    every = parts.select(*keys, "scene_id").distinct().withColumn("region", F.explode(F.array(F.lit(0), F.lit(1)))).join(F.broadcast(sizes), "region")
    return every.join(hits, [*keys, "scene_id", "region"], "left").select(*keys, "scene_id", "region", F.coalesce("covered", F.lit(0)).alias("covered"), "cells")


def weighted_scene(cover: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The scene that gets the weight itself: it covers region 1 more; a tie keeps the first."""
    share = F.floor(F.col("covered") * F.lit(1e9) / F.col("cells"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(share), "scene_id"))
    return cover.where("region = 1").withColumn("place", place).where("place = 1").select(*keys, "scene_id", "covered", "cells")


def feather_blend(a: DataFrame, b: DataFrame, weight: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``trunc(a (1 - w) + b w)`` over all cells that either has; an absent one reads 0, as does an
    absent weight."""
    both = a.select(*keys, "r", "c", F.col("dn").alias("a")).join(b.select(*keys, "r", "c", F.col("dn").alias("b")), [*keys, "r", "c"], "full")
    value = blend(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)), F.coalesce("k", F.lit(0)), FULL)
    return both.join(weight.select("r", "c", "k"), ["r", "c"], "left").select(*keys, "r", "c", value.alias("dn"))


def over(old: DataFrame, new: DataFrame, weight: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``new`` blended over ``old`` by the weights; where only one of them has data (``dn`` above 0), that one."""
    both = old.select(*keys, "r", "c", F.col("dn").alias("a")).join(new.select(*keys, "r", "c", F.col("dn").alias("b")), [*keys, "r", "c"], "full").join(weight.select("r", "c", "k"), ["r", "c"], "left")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    value = F.when(b == 0, a).when(a == 0, b).otherwise(blend(a, b, F.coalesce("k", F.lit(0)), FULL))
    return both.select(*keys, "r", "c", value.cast("long").alias("dn"))


def folded(layers: list[tuple[DataFrame, DataFrame]], keys: tuple[str, ...] = ()) -> DataFrame:
    """Scenes (pixels, weights) blended one after the other; a step's result is stored before the next."""
    out = layers[0][0].select(*keys, "r", "c", "dn")
    for px, weight in layers[1:]:
        out = checkpointed(over(out, px, weight, keys))
    return out


def mask_blend(a: DataFrame, b: DataFrame, weight: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """1 where either mask contributes with positive weight."""
    both = a.select(*keys, "r", "c", F.col("v").alias("a")).join(b.select(*keys, "r", "c", F.col("v").alias("b")), [*keys, "r", "c"], "full").join(weight.select("r", "c", "k"), ["r", "c"], "left")
    k = F.coalesce("k", F.lit(0))
    total = F.coalesce("a", F.lit(0)) * (FULL - k) + F.coalesce("b", F.lit(0)) * k
    return both.select(*keys, "r", "c", F.when(total > 0, 1).otherwise(0).alias("v"))


def pan_blend(a: DataFrame, b: DataFrame, weight: DataFrame, factor: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The blend at ``factor`` times the weights' resolution; each pan cell takes its cell's weight."""
    both = a.select(*keys, "r", "c", F.col("dn").alias("a")).join(b.select(*keys, "r", "c", F.col("dn").alias("b")), [*keys, "r", "c"], "full")
    coarse = weight.select(F.col("r").alias("wr"), F.col("c").alias("wc"), "k")
    at = both.withColumn("wr", F.floor(F.col("r") / F.lit(float(factor))).cast("int")).withColumn("wc", F.floor(F.col("c") / F.lit(float(factor))).cast("int")).join(coarse, ["wr", "wc"], "left")
    return at.select(*keys, "r", "c", blend(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)), F.coalesce("k", F.lit(0)), FULL).alias("dn"))


def rewritten(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """An update in place: new cells replace old ones, the others stay."""
    both = old.join(new.select(*keys, "r", "c", F.col("dn").alias("new")), [*keys, "r", "c"], "full")
    return both.select(*keys, "r", "c", F.coalesce("new", "dn").alias("dn"))


def over_no_data(mosaic: DataFrame, candidate: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells whose bands are all 0 in the mosaic take the candidate (``band``, ``r``, ``c``, ``dn``)."""
    empty = F.max("dn").over(Window.partitionBy(*keys, "r", "c")) == 0
    met = mosaic.withColumn("empty", empty).join(candidate.select(*keys, "band", "r", "c", F.col("dn").alias("other")), [*keys, "band", "r", "c"], "left")
    return met.select(*keys, "band", "r", "c", F.when(F.col("empty"), F.coalesce("other", F.lit(0))).otherwise(F.col("dn")).alias("dn"))


def poisson_fill(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """Filled patches. ``rows``: dense boxes (``keys``, ``band``, ``r``, ``c``, ``mosaic``, ``candidate``,
    ``member``, ``flag``); a group is one band of one patch, so its size is a patch's box.

    The candidate's gradients are fitted to the mosaic's values around the patch; inside, fill and
    candidate are joined by the flag's feather, and the result by the patch's adaptive feather.
    """
    types = dict(rows.dtypes)

    def run(t: pa.Table) -> pa.Table:
        r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
        r0, c0 = int(r.min()), int(c.min())
        shape = (int(r.max()) - r0 + 1, int(c.max()) - c0 + 1)
        grids = {}
        for name in ("mosaic", "candidate", "member", "flag"):
            g = np.zeros(shape, np.int64)
            g[r - r0, c - c0] = t.column(name).to_numpy()
            grids[name] = g
        mosaic, candidate, member, flag = (grids[n] for n in ("mosaic", "candidate", "member", "flag"))
        base = np.where(mosaic == 0, candidate, mosaic)
        fill = kernels.poisson(candidate, base, member)
        if flag.any():
            w = np.where(flag > 0, 0, kernels.feather(1 - flag, 25))
            fill = fill * w + candidate * (1 - w)
        w = kernels.adaptive_feather(member)
        out = np.clip(np.floor(fill * w + mosaic * (1 - w)), 0, top).astype(np.int64)
        head = {k: pa.array([t.column(k)[0].as_py()] * t.num_rows, t.schema.field(k).type) for k in [*keys, "band"]}
        return pa.table(head | {"r": t.column("r"), "c": t.column("c"), "dn": pa.array(out[r - r0, c - c0])})

    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "band"]) + f", r {types['r']}, c {types['c']}, dn long"
    return rows.groupBy(*keys, "band").applyInArrow(run, schema)

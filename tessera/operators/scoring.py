"""Scoring replacement scenes for cloud patches: structural similarity, rules, ranking, acceptance.

Similarity uses five integer sums per window and one formula; a pair's score adds windows as integers
of 1e-9, so any order of addition gives the same value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.focal import window_sums

ERROR, EXCLUDED, EMPTY = -1.0, -2.0, -3.0
THRESHOLD, TOLERANCE, PENALTY = 0.75, 0.25, 0.05
#: Patches, and candidates, that are scored against each other in one task.
TILE = 512


def ssim_formula(n: int, sa, sb, saa, sbb, sab, full: float = 255.0):
    """For columns and for arrays of doubles, with the same operations in the same order."""
    m, k = float(n), float(n) / float(n - 1)
    c1, c2 = (0.01 * full) ** 2, (0.03 * full) ** 2
    ma, mb = sa / m, sb / m
    va, vb, vab = k * (saa / m - ma * ma), k * (sbb / m - mb * mb), k * (sab / m - ma * mb)
    return ((2.0 * ma * mb + c1) * (2.0 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def ssim_scores(pairs: DataFrame, keys: list[str], height: int, width: int, size: int = 7) -> DataFrame:
    """``keys``, ``score9`` (sum of floor(1e9 s) over windows), ``windows``, ``ssim`` of dense pairs
    (``r``, ``c``, ``a``, ``b``)."""
    a, b = F.col("a"), F.col("b")
    sums = window_sums(pairs, keys, {"sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b}, size, height, width)
    one = F.floor(ssim_formula(size * size, *(F.col(k).cast("double") for k in ("sa", "sb", "saa", "sbb", "sab"))) * F.lit(1e9)).cast("long")
    return sums.groupBy(*keys).agg(F.sum(one).alias("score9"), F.count("*").alias("windows")).withColumn("ssim", F.col("score9") / (F.col("windows") * F.lit(1e9)))


def pool_scores(patches: DataFrame, height: int, width: int, size: int = 7, tile: int | None = None, asked: Column | None = None) -> DataFrame:
    """``patch``, ``scene_id``, ``score9``, ``windows``, ``ssim`` of every asked patch (``vec_id``, ``label``,
    ``cells``; a condition, all by default) with every other one of its label, scored in blocks of
    ``tile`` by ``tile``."""
    tile = TILE if tile is None else tile
    windows = (height - size + 1) * (width - size + 1)
    kind = dict(patches.dtypes)["vec_id"]

    def run(t: pa.Table) -> pa.Table:
        side, ids = t.column("side").to_numpy(), t.column("vec_id").combine_chunks()
        cells = t.column("cells").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), height, width)
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        score = np.zeros((len(p), len(q)), np.int64)
        for i in range(height - size + 1 if score.size else 0):
            for j in range(width - size + 1):
                a, b = (cells[at, i : i + size, j : j + size].reshape(len(at), -1) for at in (p, q))
                sums = a.sum(1)[:, None], b.sum(1)[None], (a * a).sum(1)[:, None], (b * b).sum(1)[None], a @ b.T
                score += np.floor(ssim_formula(size * size, *sums) * 1e9).astype(np.int64)
        number = ids.to_numpy(zero_copy_only=False)
        x, y = np.nonzero(number[p][:, None] != number[q])
        return pa.table({"patch": ids.take(pa.array(p[x])), "scene_id": ids.take(pa.array(q[y])), "score9": pa.array(score[x, y]), "windows": pa.array(np.full(len(x), windows, np.int64))})

    tiles = patches.where("label IS NOT NULL").groupBy("label").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = patches.join(tiles, "label").withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = own.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    if asked is not None:
        dealt = dealt.where((F.col("side") == 1) | asked)
    mine = F.col("side") == 0
    dealt = dealt.select("label", "vec_id", "cells", "side", F.when(mine, F.col("tile")).otherwise(F.col("other")).alias("x"), F.when(mine, F.col("other")).otherwise(F.col("tile")).alias("y"))
    found = dealt.groupBy("label", "x", "y").applyInArrow(run, f"patch {kind}, scene_id {kind}, score9 long, windows long")
    return found.withColumn("ssim", F.col("score9") / (F.col("windows") * F.lit(1e9)))


def ruled(scores: DataFrame, penalty: str = "reference") -> DataFrame:
    """``ssim`` under the rules, strongest first: excluded, empty, disjoint or failed, penalty.

    Columns: ``ssim``, ``excluded``, ``empty``, ``disjoint``, ``partial`` (booleans), ``at_origin``.
    ``penalty``: ``reference`` takes 0.05 from every patch that is not at the mosaic's origin,
    ``overlap`` from those that the candidate only partly covers.
    """
    off = ~F.col("at_origin") if penalty == "reference" else F.col("partial")
    score = F.when(F.col("excluded"), F.lit(EXCLUDED)).when(F.col("empty"), F.lit(EMPTY)).when(F.col("disjoint") | F.col("ssim").isNull(), F.lit(ERROR))
    reason = F.when(F.col("excluded"), "excluded").when(F.col("empty"), "empty").when(F.col("disjoint"), "disjoint").when(F.col("ssim").isNull(), "error").otherwise("scored")
    return scores.withColumn("reason", reason).withColumn("score", score.when(off, F.col("ssim") - F.lit(PENALTY)).otherwise(F.col("ssim")))


def ranked(scores: DataFrame, patch: list[str], score: str = "score", scene: str = "scene_id") -> DataFrame:
    """Best first within a patch; ties go to the later scene."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*patch).orderBy(F.desc(score), F.desc(scene))))


def acceptable(rows: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Score at least the threshold, patch off the border, no zero in band 1, and strictly more than
    ``1 - tolerance`` clear cells (``clear``, ``cells``)."""
    enough = F.col("clear") > (F.lit(1.0) - F.lit(tolerance)) * F.col("cells")
    return rows.withColumn("accepted", (F.col("score") >= threshold) & ~F.col("on_border") & (F.col("least") > 0) & enough)


def first_accepted(rows: DataFrame, patch: list[str]) -> DataFrame:
    """The best ranked accepted scene of each patch."""
    return rows.where("accepted").groupBy(*patch).agg(F.min("rank").alias("rank"), F.min_by("scene_id", "rank").alias("scene_id"))

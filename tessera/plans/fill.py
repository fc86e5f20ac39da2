"""Cloud filling as one plan over tables: patches, scoring of every candidate, acceptance, fill, update.

For each window of the mosaic, in order (a window's fill changes what later ones see):

1. Targets: mask cells of code 1 in the window, without scraps, widened; the outer contours' boxes, padded;
   in each box the dominant component with its holes filled is the patch.
2. Scores: every patch with every candidate that has cells in its box, one group per pair: similarity of the
   masked 8-bit images on the common box, and what acceptance needs (border, least value, clear cells).
   Pairs without common cells are ``disjoint``, scenes already used here ``excluded``, candidates
   without data outside the patch ``empty``, those without a cloud mask ``no mask``; none of these is lost.
3. Choice: the best ranked acceptable candidate of a patch; failures fall through to the next rank.
4. Fill: one group per patch: the candidate's gradients fitted to the mosaic, joined to the candidate under
   its own clouds and to the mosaic by feathers. Where padded patches overlap, a cell takes the value of the
   patch with the greatest weight there, then of the least number.
5. Update: filled land cells of the mask become 0, those under the candidate's clouds (i + 1) * 10; the
   panchromatic mosaic is blended with the same weights.

A group holds one padded box; nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import clouds, focal, graph, kernels, scoring
from tessera.operators.state import checkpointed
from tessera.plans.mosaic import Box
from tessera.plans.params import Params

BANDS = (1, 2, 3, 4)


@dataclass
class Filled:
    """``rows`` (band, r, c, dn) and ``mask`` (r, c, code) after all windows; ``scores``: every pair with
    its reason, score, rank and ``accepted``; ``fills``: the candidate that each filled patch took;
    ``pan`` (r, c, dn) where a panchromatic mosaic was given."""

    rows: DataFrame
    mask: DataFrame
    scores: DataFrame
    fills: DataFrame
    pan: DataFrame | None = None

    def counters(self) -> DataFrame:
        return clouds.counters(self.scores)


def patches(mask: DataFrame, box: Box, res: float, pad: int = 10) -> DataFrame:
    """``patch_id``, ``r``, ``c``, ``member`` of every cell of the padded boxes of a window's targets."""
    local = mask.where(box.inside()).select(F.lit(1).alias("one"), (F.col("r") - box.r0).alias("r"), (F.col("c") - box.c0).alias("c"), "code")
    cells = clouds.target_cells(local).select("one", "r", "c")
    kept = graph.without_scraps(graph.components(cells, ["one"]), ["one"], max(1, graph.scrap_limit(res)))
    grid = graph.completed_mask(kept, ["one"], box.height, box.width)
    grown = checkpointed(focal.dilated(grid, max(1, round(300 / res)), ["one"]).where("v = 1").select("one", "r", "c"))
    filled = checkpointed(graph.holes_filled(graph.completed_mask(grown, ["one"], box.height, box.width), ["one"], box.height, box.width).where("v = 1"))
    labelled = checkpointed(graph.components(filled, ["one"]))
    boxes = checkpointed(graph.component_sizes(labelled, ["one"]))
    main = checkpointed(graph.dominant_in_box(labelled, boxes, ["one"], box.height, box.width, pad).select(F.col("box").alias("patch_id"), F.col("label").alias("own")))
    side = lambda lo, hi, n: F.explode(F.sequence(F.greatest(F.lit(0), F.col(lo) - pad), F.least(F.lit(n - 1), F.col(hi) + pad)))
    whole = checkpointed(boxes.select(F.col("label").alias("patch_id"), "c0", "c1", side("r0", "r1", box.height).alias("r")).select("patch_id", "r", side("c0", "c1", box.width).alias("c")))
    met = whole.join(main, "patch_id").join(labelled.select("r", "c", "label"), ["r", "c"], "left")
    out = met.select("patch_id", (F.col("r") + box.r0).cast("int").alias("r"), (F.col("c") + box.c0).cast("int").alias("c"), F.coalesce((F.col("label") == F.col("own")).cast("int"), F.lit(0)).alias("member"))
    return checkpointed(out)


def _wide(px: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A column for each band, 0 where a band has no row."""
    return px.groupBy(*keys, "r", "c").agg(*[F.coalesce(F.max(F.when(F.col("band") == b, F.col("dn"))), F.lit(0)).cast("long").alias(f"{name}{b}") for b in BANDS])


def _grid(t: pa.Table, name: str, r: np.ndarray, c: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.int64)
    out[r, c] = t.column(name).to_numpy()
    return out


def _places(t: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
    return r - r.min(), c - c.min(), (int(r.max() - r.min()) + 1, int(c.max() - c.min()) + 1)


def scored(cells: DataFrame, box: Box, params: Params) -> DataFrame:
    """One row per pair from its cells (``patch_id``, ``scene_id``, ``r``, ``c``, ``member``, ``land``, ``code``,
    ``m1``.. of the mosaic and ``p1``.. of the candidate, dense on the common box)."""
    unit = 2**params.true_bits / 256

    def run(t: pa.Table) -> pa.Table:
        r, c, shape = _places(t)
        at = lambda name: _grid(t, name, r, c, shape)
        member, land, code = at("member"), at("land"), at("code")
        eight = lambda name: np.floor(at(name) / unit).astype(np.int64) & 255
        ours = np.stack([np.where(member == 1, 0, eight(f"m{b}")) for b in (3, 2, 1)], axis=-1)
        theirs = np.stack([np.where((member == 1) | (land == 0), 0, eight(f"p{b}")) for b in (3, 2, 1)], axis=-1)
        value, failed = None, None
        try:
            value = kernels.ssim(ours, theirs)
        except ValueError as e:  # a side is shorter than the window
            failed = str(e)
        inside = member == 1
        edge = bool(member[0].any() or member[-1].any() or member[:, 0].any() or member[:, -1].any())
        one = {"patch_id": t.column("patch_id")[0].as_py(), "scene_id": t.column("scene_id")[0].as_py(), "ssim": value, "failed": failed, "empty": not theirs[member == 0].any(), "on_border": edge}
        one |= {"least": int(at("p1")[inside].min()) if inside.any() else 0, "clear": int((code[inside] < 10).sum()), "cells": int(inside.sum()), "has_mask": bool((code >= 0).all()), "n": t.num_rows, "r0": int(t.column("r").to_numpy().min()), "c0": int(t.column("c").to_numpy().min())}
        return pa.Table.from_pylist([one], schema=kinds)

    kinds = pa.schema([("patch_id", pa.int64()), ("scene_id", pa.int64()), ("ssim", pa.float64()), ("failed", pa.string()), ("empty", pa.bool_()), ("on_border", pa.bool_()), ("least", pa.int64()), ("clear", pa.int64()), ("cells", pa.int64()), ("has_mask", pa.bool_()), ("n", pa.int64()), ("r0", pa.int64()), ("c0", pa.int64())])
    schema = "patch_id long, scene_id long, ssim double, failed string, empty boolean, on_border boolean, least long, clear long, cells long, has_mask boolean, n long, r0 long, c0 long"
    return cells.groupBy("patch_id", "scene_id").applyInArrow(run, schema)


def _filled(cells: DataFrame, params: Params) -> DataFrame:
    """``patch_id``, ``r``, ``c``, ``flag``, ``member``, ``land``, ``w``, ``p0`` and the bands' values of filled boxes."""
    unit = 2**params.true_bits / 256
    names = [f"b{b}" for b in BANDS]

    def run(t: pa.Table) -> pa.Table:
        r, c, shape = _places(t)
        at = lambda name: _grid(t, name, r, c, shape)
        member, land, code = at("member"), at("land"), at("code")
        ours, theirs = ([at(f"{side}{b}") for b in BANDS] for side in ("m", "p"))
        # clouds of the candidate inside the patch, widened; what is not open from the upper left is flagged
        cloud = kernels.dilated(np.where((member == 0) | (code <= 2), 1, np.minimum(code, 10)), 10)
        seed = (min(1, shape[0] - 1), min(1, shape[1] - 1))
        flag = (kernels.flood(cloud, seed, 0) != 0).astype(np.int64)
        soft = np.where(flag == 1, 0, kernels.feather(1 - flag, 25)) if flag.any() else np.ones(shape)
        w = kernels.adaptive_feather(member)
        out = []
        nothing = np.all([m == 0 for m in ours], axis=0)
        for m, p in zip(ours, theirs, strict=True):
            target = np.where(nothing, p, m) / unit  # cells without data would darken the fill
            fill = kernels.poisson(np.where(land == 0, 0, p) / unit, target, member) * unit
            fill = np.where(flag == 1, p, fill)
            value = (fill * soft + p * (1 - soft)) * w + m * (1 - w)
            out.append(np.clip(np.floor(value), 0, 2**params.true_bits - 1).astype(np.int64))
        same = {k: t.column(k) for k in ("patch_id", "r", "c", "member", "land")}
        return pa.table(same | {"flag": pa.array(flag[r, c]), "w": pa.array(w[r, c].astype(np.float64))} | {n: pa.array(v[r, c]) for n, v in zip(names, out, strict=True)} | {"scene_id": t.column("scene_id")})

    types = dict(cells.dtypes)
    schema = f"patch_id long, r int, c int, member {types['member']}, land {types['land']}, flag long, w double, " + ", ".join(f"{n} long" for n in names) + ", scene_id long"
    return cells.groupBy("patch_id").applyInArrow(run, schema)


def fill(rows: DataFrame, mask: DataFrame, windows: list[tuple[int, int, Box]], candidates: DataFrame, masks: DataFrame, land: DataFrame, params: Params, pan: DataFrame | None = None, candidate_pan: DataFrame | None = None, penalty: str = "reference") -> Filled:
    """Fills the clouds of a mosaic.

    ``rows``: band, r, c, dn; ``mask``: r, c, code (1 is cloud); ``windows``: sequence, scene and box of the
    mosaic's steps; ``candidates``: scene_id, band, r, c, dn; ``masks``: scene_id, r, c, code; ``land``: r, c of
    land; ``pan``, ``candidate_pan``: r, c, dn and scene_id, r, c, dn at ``params.pan_factor`` times the resolution.
    """
    spark = rows.sparkSession
    pool = candidates.groupBy("scene_id").agg(*[f(v).alias(f"{v}{k}") for v in ("r", "c") for k, f in ((0, F.min), (1, F.max))])  # a row for each scene
    every, fills, first = None, None, windows[0][0] if windows else 0
    for i, (seq, scene, box) in enumerate(w for w in windows if w[0] != first):
        used = [scene]
        if i == 0:  # the first window is that of the first two scenes
            used, box = [s for q, s, _ in windows if q in (first, seq)], box.joined(next(b for q, _, b in windows if q == first))
        patch = patches(mask, box, params.res)
        if patch.isEmpty():
            continue
        mosaic = _wide(rows.where(box.inside()), [], "m")
        near = patch.groupBy("patch_id").agg(F.min("r").alias("p0"), F.max("r").alias("p1"), F.min("c").alias("q0"), F.max("c").alias("q1")).withColumn("window", F.lit(i))
        pairs = near.join(pool.withColumn("window", F.lit(i)), "window")  # every candidate is scored for every patch of the window
        pairs = checkpointed(pairs).withColumn("disjoint", ~((F.col("r0") <= F.col("p1")) & (F.col("r1") >= F.col("p0")) & (F.col("c0") <= F.col("q1")) & (F.col("c1") >= F.col("q0"))))
        met = patch.join(pairs.where("not disjoint").select("patch_id", "scene_id", "r0", "r1", "c0", "c1"), "patch_id").where(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1"))).drop("r0", "r1", "c0", "c1")
        known = masks.select("scene_id").distinct().withColumn("masked", F.lit(1))
        cells = met.join(mosaic, ["r", "c"], "left").join(_wide(candidates, ["scene_id"], "p"), ["scene_id", "r", "c"], "left")
        cells = cells.join(land.select("r", "c", F.lit(1).alias("land")), ["r", "c"], "left").join(masks.select("scene_id", "r", "c", "code"), ["scene_id", "r", "c"], "left").join(known, "scene_id", "left")
        cells = cells.withColumn("code", F.when(F.col("masked").isNull(), -1).otherwise(F.coalesce("code", F.lit(0)))).drop("masked").fillna(0)
        cells = checkpointed(cells.withColumn("scene_id", F.col("scene_id").cast("long")))
        whole = patch.groupBy("patch_id").agg(F.count("*").alias("size"))
        found = pairs.select("patch_id", F.col("scene_id").cast("long").alias("scene_id"), "disjoint", "p0", "q0").join(scored(cells, box, params), ["patch_id", "scene_id"], "left").join(whole, "patch_id")
        found = found.withColumns({"excluded": F.col("scene_id").isin(used), "partial": F.coalesce(F.col("n") < F.col("size"), F.lit(True)), "at_origin": (F.col("p0") == 0) & (F.col("q0") == 0), "empty": F.coalesce("empty", F.lit(False))})
        ranked = scoring.ranked(scoring.ruled(found, penalty), ["patch_id"])
        judged = scoring.acceptable(ranked.fillna({"least": 0, "clear": 0, "cells": 0}).fillna(False, ["on_border", "has_mask"]), params.ssim_threshold, params.cloud_tolerance)
        judged = judged.withColumn("accepted", F.col("accepted") & F.col("has_mask") & (F.col("cells") > 0))
        reason = F.when((F.col("reason") == "scored") & ~F.col("has_mask"), "no mask").otherwise(F.col("reason"))
        judged = checkpointed(judged.select(F.lit(seq).alias("seq"), "patch_id", "scene_id", reason.alias("reason"), "score", "rank", "on_border", "least", "clear", "cells", "failed", "accepted"))
        every = judged if every is None else every.union(judged)
        best = scoring.first_accepted(judged, ["patch_id"]).withColumn("seq", F.lit(seq))
        fills = best if fills is None else fills.union(best)
        done = checkpointed(_filled(cells.join(best.select("patch_id", "scene_id"), ["patch_id", "scene_id"], "left_semi"), params))
        if done.isEmpty():
            continue
        # of overlapping patches the one with the greatest weight at a cell
        one = done.where("w > 0").groupBy("r", "c").agg(F.max_by(F.struct(*[f"b{b}" for b in BANDS], "w", "scene_id"), F.struct("w", -F.col("patch_id"))).alias("x")).select("r", "c", "x.*")
        new = one.select("r", "c", F.expr("stack(4, 1, b1, 2, b2, 3, b3, 4, b4) AS (band, dn)"))
        given = rows.select("band").distinct()
        changed = new.join(given, "band", "left_semi").select("band", "r", "c", F.col("dn").alias("new"))
        rows = checkpointed(rows.join(changed, ["band", "r", "c"], "full").select("band", "r", "c", F.coalesce("new", "dn").alias("dn")))
        inside = done.where("member = 1")
        mask = checkpointed(clouds.updated(mask, inside.where("flag = 0").select("r", "c").distinct(), spark.createDataFrame([], "r int, c int"), land.select("r", "c").distinct().withColumn("land", F.lit(1)), i))
        cut = inside.where("flag = 1 AND land = 1").select("r", "c", F.lit((i + 1) * 10).alias("now")).distinct()
        mask = checkpointed(mask.join(cut, ["r", "c"], "left").select("r", "c", F.coalesce("now", "code").alias("code")))
        if pan is not None:
            pan = checkpointed(pan_filled(pan, candidate_pan, one, params.pan_factor))
    if every is None:
        every = spark.createDataFrame([], "seq int, patch_id long, scene_id long, reason string, score double, rank int, on_border boolean, least long, clear long, cells long, failed string, accepted boolean")
        fills = spark.createDataFrame([], "patch_id long, rank int, scene_id long, seq int")
    return Filled(rows, mask, every, fills, pan)


def pan_filled(pan: DataFrame, candidate: DataFrame, weights: DataFrame, factor: int) -> DataFrame:
    """The panchromatic mosaic blended with the candidates' partners: ``weights`` (``r``, ``c``, ``w``,
    ``scene_id``) at the coarse resolution."""
    at = [F.floor(F.col(v) / factor).cast("int").alias(f"w{v}") for v in ("r", "c")]
    w = weights.select(F.col("r").alias("wr"), F.col("c").alias("wc"), "w", "scene_id")
    fine = pan.select("r", "c", "dn", *at).join(w, ["wr", "wc"], "left")
    other = candidate.select(F.col("scene_id").cast("long").alias("scene_id"), "r", "c", F.col("dn").alias("theirs"))
    met = fine.join(other, ["scene_id", "r", "c"], "left")
    value = F.floor(F.coalesce("theirs", F.lit(0)) * F.col("w") + F.col("dn") * (1 - F.col("w"))).cast("long")
    return met.select("r", "c", F.when(F.col("w").isNull(), F.col("dn")).otherwise(value).alias("dn"))

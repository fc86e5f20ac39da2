"""The mosaic of many scenes as one plan over tables: a fold over the processing order.

Every seam depends on the mosaic so far, so scenes follow each other; within a step all cells work in
parallel. A step reads and writes only the box of its scene: the mosaic is kept as layers, one stored
table per step, and a cell's value is that of the last layer that has it. So a step costs what its scene
holds, not what the mosaic has grown to, and the whole canvas is never in one task: only the search runs
in one group, on the box at search resolution.

A step: gray of both sides in 8 bits; both brought to the search grid; costs of the edges
(:mod:`tessera.functions.cost`); ends where the footprints' boundaries cross; erosion, the cheapest
path, drawn on to the border; the region on one side; its feather at full resolution; the side that each
image takes, by what it covers; the blend. A cell that only one image has takes that one. Band 0, where
given, is the cloud mask: set where either image contributes a cloud.

Windows, roles, weights and seams are tables (:meth:`Mosaic.save`), which later steps read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixel
from tessera.functions.grid import dense
from tessera.operators import align, blending, focal, graph, seams
from tessera.operators.state import checkpointed
from tessera.plans.params import Params

#: A seam's search falls back to these erosions where the wide one parts its ends.
RETRY = (11, 1)
#: Regions up to so many cells are scraps.
REGION_LEAST = 1000

WINDOWS = "seq int, scene_id long, r0 int, c0 int, height int, width int, kernel int, new_weighted boolean"


@dataclass
class Box:
    r0: int
    c0: int
    height: int
    width: int

    def meets(self, other: Box) -> bool:
        return self.r0 < other.r0 + other.height and other.r0 < self.r0 + self.height and self.c0 < other.c0 + other.width and other.c0 < self.c0 + self.width

    def joined(self, other: Box) -> Box:
        r0, c0 = min(self.r0, other.r0), min(self.c0, other.c0)
        return Box(r0, c0, max(self.r0 + self.height, other.r0 + other.height) - r0, max(self.c0 + self.width, other.c0 + other.width) - c0)

    def inside(self, factor: int = 1):
        return F.col("r").between(self.r0 * factor, (self.r0 + self.height) * factor - 1) & F.col("c").between(self.c0 * factor, (self.c0 + self.width) * factor - 1)


@dataclass
class Layers:
    """Stored tables (``band``, ``r``, ``c``, ``dn``) with the boxes they lie in, oldest first."""

    held: list[tuple[Box, DataFrame]] = field(default_factory=list)

    def add(self, box: Box, rows: DataFrame) -> None:
        self.held.append((box, rows))

    def rows(self, box: Box | None = None, factor: int = 1) -> DataFrame:
        """The newest value of every cell, of those in a box if given."""
        found = None
        for n, (own, rows) in enumerate(self.held):
            if box is None or own.meets(box):
                part = rows.select("band", "r", "c", "dn", F.lit(n).alias("layer"))
                found = part if found is None else found.union(part)
        if found is None:
            return self.held[0][1].where("false").select("band", "r", "c", "dn")
        found = found if box is None else found.where(box.inside(factor))
        return found.groupBy("band", "r", "c").agg(F.max_by("dn", "layer").alias("dn"))


@dataclass
class Mosaic:
    layers: Layers
    windows: DataFrame
    weights: dict[int, DataFrame]
    seams: dict[int, DataFrame]
    boxes: list[Box]
    new_weighted: list[bool]

    def rows(self) -> DataFrame:
        return self.layers.rows()

    def save(self, path: str) -> None:
        """Windows and roles, weights and seams of every step, and the mosaic, as Parquet below ``path``."""
        self.windows.write.parquet(f"{path}/windows")
        for name, tables in (("weights", self.weights), ("seams", self.seams)):
            for seq, rows in tables.items():
                rows.write.parquet(f"{path}/{name}/seq={seq}")
        self.rows().write.parquet(f"{path}/mosaic")


def load_steps(spark: SparkSession, path: str) -> list[tuple[int, int, Box, bool, DataFrame | None]]:
    """What :meth:`Mosaic.save` left: sequence, scene, box, role and weights of every step."""
    out = []
    for w in spark.read.parquet(f"{path}/windows").orderBy("seq").collect():  # a row for each scene
        weight = spark.read.parquet(f"{path}/weights/seq={w['seq']}") if w["seq"] else None
        out.append((w["seq"], w["scene_id"], Box(w["r0"], w["c0"], w["height"], w["width"]), w["new_weighted"], weight))
    return out


def ordered_scenes(scenes: DataFrame) -> list[int]:
    """Scenes (``scene_id``, ``name``, box) by their distance to the first by name; the second is the first
    of the others that meets it."""
    anchor = scenes.agg(F.min_by(F.struct("x0", "y0"), "name").alias("p")).select(F.col("p.x0").alias("ax"), F.col("p.y0").alias("ay"))
    order = align.processing_order(scenes, anchor)
    ids = [r[0] for r in order.orderBy("seq").select("scene_id").collect()]  # a catalogue
    second = align.second_scene(order).first()[0]
    return ids if second is None else [ids[0], second, *(x for x in ids[1:] if x != second)]


def on_canvas(px: DataFrame, scenes: DataFrame, params: Params) -> DataFrame:
    """Scene cells moved to the canvas that spans all scenes, and cut at its bounds."""
    frame = align.canvas(scenes, params.canvas_x_max, params.canvas_y_min, params.res).first()
    at = scenes.select("scene_id", F.floor((F.lit(frame["y0"]) - F.col("y0")) / params.res).cast("int").alias("dr"), F.floor((F.col("x0") - F.lit(frame["x0"])) / params.res).cast("int").alias("dc"))
    moved = px.join(at, "scene_id").withColumn("r", F.col("r") + F.col("dr")).withColumn("c", F.col("c") + F.col("dc")).select("scene_id", "band", "r", "c", "dn")
    return moved.where(F.col("r").between(0, frame["height"] - 1) & F.col("c").between(0, frame["width"] - 1))


def _gray(px: DataFrame, bits: int, name: str) -> DataFrame:
    """``r``, ``c``, the 8-bit gray of bands 3, 2, 1, and whether any band has data."""
    band = lambda b: F.coalesce(F.max(F.when(F.col("band") == b, pixel.to_8bit(F.col("dn"), bits))), F.lit(0))
    kept = px.where("band > 0").groupBy("r", "c").agg(band(3).alias("x"), band(2).alias("y"), band(1).alias("z"), F.max("dn").alias("most"))
    return kept.select("r", "c", pixel.gray(F.col("x"), F.col("y"), F.col("z")).cast("long").alias(name), pixel.binary(F.col("most")).alias(f"{name}_v"))


def search(old: DataFrame, new: DataFrame, box: Box, params: Params) -> DataFrame:
    """``i``, ``j``, ``side``, ``line``, ``kernel`` on the search grid of a box; cells of both images in
    canvas coordinates."""
    spark, shape = old.sparkSession, (box.height, box.width)
    small = tuple(max(2, round(n / params.resample_to)) for n in shape)
    whole = dense(spark, None, *shape)
    local = lambda d: d.select((F.col("r") - box.r0).alias("r"), (F.col("c") - box.c0).alias("c"), *d.columns[2:])
    cells = whole.join(local(_gray(old, params.true_bits, "a")), ["r", "c"], "left").join(local(_gray(new, params.true_bits, "b")), ["r", "c"], "left").fillna(0)
    cells = checkpointed(cells)
    grid = dense(spark, None, *small)
    for name in ("a", "b"):
        gray = focal.bilinear(cells.select("r", "c", F.col(name).alias("dn")), shape, small).select("r", "c", F.col("dn").cast("long").alias("dn" if name == "a" else "dn_b"))
        held = focal.nearest(cells.select("r", "c", F.col(f"{name}_v").alias("dn")), shape, small).select("r", "c", F.col("dn").alias(f"{name}_v"))
        grid = grid.join(gray, ["r", "c"], "left").join(held, ["r", "c"], "left")
    costed = graph.cell_costs(grid.fillna(0), params.path_method).withColumn("one", F.lit(1))
    least = REGION_LEAST / params.resample_to**2
    sizes = (params.kernel, *(k for k in RETRY if k < params.kernel))

    def run(t: pa.Table) -> pa.Table:
        def of(name: str, kind) -> np.ndarray:
            out = np.zeros(small, kind)
            out[t.column("r").to_numpy(), t.column("c").to_numpy()] = t.column(name).fill_null(0).to_numpy()
            return out

        costs = {k: of(k, np.float64) for k in ("right", "down", "right0", "down0")}
        side, line, kernel = seams.region(of("a_v", np.int64) > 0, of("b_v", np.int64) > 0, (of("dn", np.int64), of("dn_b", np.int64)), costs, sizes, least=int(least))
        i, j = np.indices(small, dtype=np.int32)
        return pa.table({"i": pa.array(i.reshape(-1)), "j": pa.array(j.reshape(-1)), "side": pa.array(side.reshape(-1).astype(np.int32)), "line": pa.array(line.reshape(-1).astype(np.int32)), "kernel": pa.array(np.full(side.size, kernel, np.int32))})

    return checkpointed(costed.groupBy("one").applyInArrow(run, "i int, j int, side int, line int, kernel int"))


def step_weights(found: DataFrame, box: Box, params: Params) -> DataFrame:
    """``r``, ``c``, ``k``: the feather of the side at full resolution, in canvas coordinates."""
    size = found.agg(F.max("i"), F.max("j")).first()
    up = [F.floor(F.col(v) * (m + 1) / F.lit(float(n))).cast("int") for v, m, n in (("r", size[0], box.height), ("c", size[1], box.width))]
    cells = dense(found.sparkSession, None, box.height, box.width).select("r", "c", up[0].alias("i"), up[1].alias("j"))
    mask = cells.join(found.select("i", "j", F.col("side").alias("v")), ["i", "j"]).select("r", "c", "v")
    k = focal.feathered(mask, box.height, box.width, params.feather)
    return checkpointed(k.select((F.col("r") + box.r0).alias("r"), (F.col("c") + box.c0).alias("c"), "k"))


def _blended(old: DataFrame, new: DataFrame, weight: DataFrame) -> DataFrame:
    """The blend of all bands; band 0 is a mask, set where either image contributes."""
    at = ["band", "r", "c"]
    clouds = [d.where("band = 0").select("r", "c", F.col("dn").alias("v")) for d in (old, new)]
    mask = blending.mask_blend(*clouds, weight).select(F.lit(0).alias("band"), "r", "c", F.col("v").cast("long").alias("dn"))
    return blending.over(old.where("band > 0").select(*at, "dn"), new.where("band > 0").select(*at, "dn"), weight, ("band",)).union(mask)


def _box(px: DataFrame) -> Box | None:
    b = px.where("band > 0 AND dn > 0").agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    return None if b[0] is None else Box(b[0], b[2], b[1] - b[0] + 1, b[3] - b[2] + 1)


def mosaic(px: DataFrame, order: list[int], params: Params | None = None) -> Mosaic:
    """Scenes (``scene_id``, ``band``, ``r``, ``c``, ``dn`` on one canvas) in the given order. Scenes without
    data are left out."""
    params = params or Params()
    spark, layers, rows = px.sparkSession, Layers(), []
    weights: dict[int, DataFrame] = {}
    lines: dict[int, DataFrame] = {}
    boxes: list[Box] = []
    for scene in order:
        new = px.where(F.col("scene_id") == scene).select("band", "r", "c", F.col("dn").cast("long").alias("dn"))
        box = _box(new)
        if box is None:
            continue
        seq, kernel, first = len(rows), 0, True
        if not layers.held:
            layers.add(box, checkpointed(new))
        else:
            old = checkpointed(layers.rows(box))
            found = search(old, new, box, params)
            weight = step_weights(found, box, params)
            held = lambda d, n: d.where("band > 0").select(F.lit(n).alias("scene_id"), "r", "c", "dn")
            cover = blending.weighted_scene(blending.coverage(held(old, 0).union(held(new, 1)), weight)).first()
            first = cover is None or cover["scene_id"] == 1
            if not first:  # the side is the mosaic's: the new scene takes the rest
                weight = weight.withColumn("k", F.lit(blending.FULL) - F.col("k"))
            weights[seq] = weight
            lines[seq] = found.where("line = 1").select("i", "j")
            kernel = found.agg(F.max("kernel")).first()[0]
            layers.add(box, checkpointed(_blended(old, new, weight)))
        boxes.append(box)
        rows.append((seq, scene, box.r0, box.c0, box.height, box.width, kernel, first))
    return Mosaic(layers, spark.createDataFrame(rows, WINDOWS), weights, lines, boxes, [r[-1] for r in rows])


def pan_mosaic(pan: DataFrame, steps: list[tuple[int, int, Box, bool, DataFrame | None]], factor: int) -> DataFrame:
    """The panchromatic mosaic (``r``, ``c``, ``dn``): the same steps at ``factor`` times the resolution, with the
    weights of each step's window. ``pan``: ``scene_id``, ``r``, ``c``, ``dn`` on the fine canvas; cells outside a
    window are cut."""
    layers = Layers()
    for _, scene, box, _, weight in steps:
        new = pan.where(F.col("scene_id") == scene).where(box.inside(factor)).select(F.lit(1).alias("band"), "r", "c", F.col("dn").cast("long").alias("dn"))
        if weight is not None:
            old = layers.rows(box, factor)
            fine = new.select("r", "c").union(old.select("r", "c")).distinct()
            coarse = weight.select(F.col("r").alias("wr"), F.col("c").alias("wc"), "k")
            at = [F.floor(F.col(v) / factor).cast("int").alias(f"w{v}") for v in ("r", "c")]
            new = blending.over(old, new, fine.select("r", "c", *at).join(coarse, ["wr", "wc"]).select("r", "c", "k"), ("band",))
        layers.add(box, checkpointed(new))
    return layers.rows().select("r", "c", "dn")

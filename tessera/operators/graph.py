"""Seam graphs, paths and components: edges as tables, searches as grouped kernels.

A group is one overlap of two scenes, the unit the search is bounded by. Component labelling of cells
that span groups works on the whole table, by label propagation with pointer jumping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cost import cost
from tessera.functions.grid import completed
from tessera.operators import kernels
from tessera.operators.align import difference_cells
from tessera.operators.focal import eroded, neighbour_pairs, reopened
from tessera.operators.state import checkpointed


def seam_edges(pair: DataFrame, method: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Weighted edges of a dense pair table (``keys``, ``r``, ``c``, ``dn``, ``dn_b``).

    A cell with data in both scenes links to its right and its lower neighbour, whatever that holds.
    """
    both = neighbour_pairs(pair, keys, ("dn", "dn_b")).where("dn <> 0 AND dn_b <> 0")
    return both.select(*keys, "r", "c", "dir", cost(method, F.col("dn") - F.col("dn_next"), F.col("dn_b") - F.col("dn_b_next")).alias("w"))


def cell_costs(pair: DataFrame, method: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """A dense pair table with the costs of each cell's edges: ``right``, ``down``, and ``right0``, ``down0``
    as if the neighbour had no data. Null beyond the grid."""
    right = Window.partitionBy(*keys, "r").orderBy("c")
    down = Window.partitionBy(*keys, "c").orderBy("r")
    columns, zero = {}, F.lit(0).cast("long")
    for side, over in (("right", right), ("down", down)):
        a, b = F.lead("dn").over(over), F.lead("dn_b").over(over)
        columns[side] = F.when(a.isNotNull(), cost(method, F.col("dn") - a, F.col("dn_b") - b))
        columns[f"{side}0"] = F.when(a.isNotNull(), cost(method, F.col("dn") - zero, F.col("dn_b") - zero))
    return pair.withColumns(columns)


def _ends(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = t.column("r").to_numpy().astype(np.int64) * width + t.column("c").to_numpy()
    right = np.array([d == "r" for d in t.column("dir").to_pylist()])
    return at, at + np.where(right, 1, width), t.column("w").to_numpy().astype(np.float64)


def seam_distances(edges: DataFrame, key: str, start: tuple[int, int], height: int, width: int) -> DataFrame:
    """``key``, ``r``, ``c``, ``dist`` from the start cell of each group's graph."""

    def run(t: pa.Table) -> pa.Table:
        dist, _ = kernels.dijkstra(start[0] * width + start[1], _ends(t, width), height * width)
        at = np.flatnonzero(np.isfinite(dist))
        return pa.table({key: pa.array([t.column(key)[0].as_py()] * len(at), t.schema.field(key).type), "r": pa.array((at // width).astype(np.int32)), "c": pa.array((at % width).astype(np.int32)), "dist": pa.array(dist[at])})

    return edges.groupBy(key).applyInArrow(run, f"{key} {dict(edges.dtypes)[key]}, r int, c int, dist double")


def seam_paths(edges: DataFrame, key: str, start: tuple[int, int], goal: tuple[int, int], height: int, width: int) -> DataFrame:
    """``key``, ``step``, ``r``, ``c``: the cheapest path of each group; no rows where there is none."""

    def run(t: pa.Table) -> pa.Table:
        a, b = start[0] * width + start[1], goal[0] * width + goal[1]
        dist, back = kernels.dijkstra(a, _ends(t, width), height * width, b)
        at = np.array(kernels.path(back, b) if np.isfinite(dist[b]) else [], np.int64)
        return pa.table({key: pa.array([t.column(key)[0].as_py()] * len(at), t.schema.field(key).type), "step": pa.array(np.arange(len(at), dtype=np.int32)), "r": pa.array((at // width).astype(np.int32)), "c": pa.array((at % width).astype(np.int32))})

    return edges.groupBy(key).applyInArrow(run, f"{key} {dict(edges.dtypes)[key]}, step int, r int, c int")


def components(cells: DataFrame, keys: list[str], eight: bool = True, max_rounds: int = 60) -> DataFrame:
    """``keys``, ``r``, ``c``, ``label``: the least cell number of each cell's component.

    Rows of set cells become runs first (one row each), and runs of neighbouring rows are linked, so
    the propagation works on runs. Any grid size; nothing is gathered.
    """
    wide = 1 << 31
    by_row = Window.partitionBy(*keys, "r").orderBy("c")
    runs = cells.select(*keys, "r", "c").distinct().withColumn("g", F.col("c") - F.row_number().over(by_row))
    runs = runs.groupBy(*keys, "r", "g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).withColumn("id", F.col("r").cast("long") * wide + F.col("lo")).persist()
    reach = 1 if eight else 0
    up = runs.select(*keys, (F.col("r") + 1).alias("r"), F.col("lo").alias("ulo"), F.col("hi").alias("uhi"), F.col("id").alias("uid"))
    links = runs.join(up, [*keys, "r"]).where((F.col("ulo") <= F.col("hi") + reach) & (F.col("uhi") >= F.col("lo") - reach)).select(*keys, F.col("id").alias("a"), F.col("uid").alias("b"))
    links = links.union(links.select(*keys, F.col("b"), F.col("a"))).persist()
    labels = runs.select(*keys, "id", F.col("id").alias("label"))
    for _ in range(max_rounds):
        near = links.join(labels.withColumnRenamed("id", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, [*keys, "id"], "left").select(*keys, "id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(*keys, F.col("id").alias("low"), F.col("label").alias("up"))
        new = checkpointed(low.join(jump, [*keys, "low"]).select(*keys, "id", "old", F.least("low", "up").alias("label")))
        labels = new.select(*keys, "id", "label")
        if new.where("old <> label").isEmpty():
            break
    else:
        raise RuntimeError("labels still change")
    named = labels.join(checkpointed(runs), [*keys, "id"])
    links.unpersist()
    runs.unpersist()
    return named.select(*keys, "r", F.explode(F.sequence("lo", "hi")).alias("c"), "label").withColumn("c", F.col("c").cast("int"))


def flooded(px: DataFrame, keys: list[str], seed: tuple[int, int] = (1, 1), fill: int = 0, value: str = "v") -> DataFrame:
    """``px`` with the area (4-connected, equal values) around the seed (row, col) set to ``fill``; a
    grid without a row at the seed stays as it is."""
    at_seed = (F.col("r") == seed[0]) & (F.col("c") == seed[1])
    same = px.join(px.where(at_seed).select(*keys, F.col(value).alias("__seed")), keys).where(F.col(value) == F.col("__seed"))
    areas = components(same, keys, eight=False)
    hit = areas.join(areas.where(at_seed).select(*keys, "label"), [*keys, "label"], "left_semi").select(*keys, "r", "c", F.lit(1).alias("__hit"))
    return px.join(hit, [*keys, "r", "c"], "left").withColumn(value, F.when(F.col("__hit") == 1, fill).otherwise(F.col(value))).drop("__hit")


def holes_filled(px: DataFrame, keys: list[str], height: int, width: int, value: str = "v") -> DataFrame:
    """A dense mask with those unset areas (4-connected) set that do not touch the grid's border."""
    areas = components(px.where(F.col(value) == 0), keys, eight=False)
    border = F.col("r").isin(0, height - 1) | F.col("c").isin(0, width - 1)
    enclosed = areas.join(areas.where(border).select(*keys, "label").distinct(), [*keys, "label"], "left_anti").select(*keys, "r", "c", F.lit(1).alias("__in"))
    return px.join(enclosed, [*keys, "r", "c"], "left").withColumn(value, F.when(F.col("__in") == 1, 1).otherwise(F.col(value))).drop("__in")


def connecting_size(valid: DataFrame, keys: list[str], start: tuple[int, int], goal: tuple[int, int], sizes: tuple[int, ...], height: int, width: int, margin: int = 30) -> DataFrame:
    """``keys``, ``size``: the first erosion after which the two ends are connected (4 neighbours);
    no row where none of ``sizes`` connects them. ``valid`` is a dense mask."""
    found = None
    for place, size in enumerate(sizes):
        open_ = reopened(eroded(valid, size, height, width, keys), valid, [start, goal], size, margin, keys=keys)
        areas = checkpointed(components(open_.where("v > 0"), keys, eight=False))
        a, b = (areas.where((F.col("r") == r) & (F.col("c") == c)).select(*keys, "label") for r, c in (start, goal))
        hit = a.join(b, [*keys, "label"]).select(*keys, F.lit(place).alias("place"), F.lit(size).alias("size"))
        found = hit if found is None else found.union(hit)
    return found.groupBy(*keys).agg(F.min_by("size", "place").alias("size"))


def component_sizes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Size and box of every component."""
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def without_scraps(labelled: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Only cells of components with at least ``least`` cells."""
    kept = component_sizes(labelled, keys).where(F.col("n") >= least).select(*keys, "label")
    return labelled.join(kept, [*keys, "label"], "left_semi")


def scrap_limit(res: float) -> int:
    return round(500 * (6 / res) ** 2)


def main_regions(labelled: DataFrame, keys: list[str], least: int = 1000) -> DataFrame:
    """Components above ``least`` cells, largest first: ``place`` and how many there are."""
    big = component_sizes(labelled, keys).where(F.col("n") > least)
    return big.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "label"))).withColumn("regions", F.count("*").over(Window.partitionBy(*keys)))


def chosen_regions(labelled: DataFrame, keys: list[str], least: int = 1000) -> DataFrame:
    """The regions that go to one side of a seam: the smallest one above ``least`` cells; where there are
    exactly three, it and the largest one."""
    big = main_regions(labelled, keys, least)
    return big.where((F.col("place") == F.col("regions")) | ((F.col("regions") == 3) & (F.col("place") == 1)))


def without_minor_pieces(union: DataFrame, new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """A running union of footprints without those disconnected pieces of new minus old that are not
    the largest one."""
    pieces = components(difference_cells(new, old, tuple(keys)), keys, eight=False)
    minor = pieces.join(main_regions(pieces, keys, 0).where("place > 1").select(*keys, "label"), [*keys, "label"], "left_semi")
    return union.join(minor.select(*keys, "r", "c"), [*keys, "r", "c"], "left_anti")


def dominant_in_box(labelled: DataFrame, boxes: DataFrame, keys: list[str], height: int, width: int, pad: int = 10, tile: int = 64) -> DataFrame:
    """The component with most cells in each box widened by up to ``pad`` cells. Boxes and cells are dealt
    into tiles, so they meet in an equi-join."""
    wide = boxes.select(*keys, F.col("label").alias("box"), F.greatest(F.lit(0), F.col("r0") - pad).alias("p0"), F.least(F.lit(height - 1), F.col("r1") + pad).alias("p1"), F.greatest(F.lit(0), F.col("c0") - pad).alias("q0"), F.least(F.lit(width - 1), F.col("c1") + pad).alias("q1"))
    at = lambda v: F.floor(F.col(v) / tile)
    wide = wide.withColumn("ty", F.explode(F.sequence(at("p0"), at("p1")))).withColumn("tx", F.explode(F.sequence(at("q0"), at("q1"))))
    dealt = labelled.withColumn("ty", at("r")).withColumn("tx", at("c"))
    inside = wide.join(dealt, [*keys, "ty", "tx"]).where(F.col("r").between(F.col("p0"), F.col("p1")) & F.col("c").between(F.col("q0"), F.col("q1")))
    counted = inside.groupBy(*keys, "box", "label").agg(F.count("*").alias("n"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "box").orderBy(F.desc("n"), "label"))).where("k = 1").drop("k")


def outer_boxes(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Boxes of the outer contours of set cells: of components that do not lie in a hole of another one.
    They are those of the mask with its holes filled."""
    grid = completed_mask(cells, keys, height, width)
    filled = holes_filled(grid, keys, height, width).where("v = 1")
    return component_sizes(components(filled, keys), keys)


def completed_mask(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """A dense mask ``v`` of set cells."""
    return completed(cells.select(*keys, "r", "c", F.lit(1).alias("v")), keys, height, width, "v")


def seams_to_border(canvases: DataFrame, key: str, ends: tuple[tuple[int, int], tuple[int, int]], height: int, width: int, reach: int = 100) -> DataFrame:
    """``key``, ``r``, ``c`` of the seam cells of each canvas (``v``: 0 free, 1 seam, 9 blocked) after
    its two ends (row, col) have been drawn on to the border; a canvas is one group."""

    def run(t: pa.Table) -> pa.Table:
        grid = np.zeros((height, width), np.int64)
        grid[t.column("r").to_numpy(), t.column("c").to_numpy()] = t.column("v").to_numpy()
        r, c = np.nonzero(border_connected(grid, ends, reach) == 1)
        return pa.table({key: pa.array([t.column(key)[0].as_py()] * len(r), t.schema.field(key).type), "r": pa.array(r.astype(np.int32)), "c": pa.array(c.astype(np.int32))})

    return canvases.select(key, "r", "c", "v").groupBy(key).applyInArrow(run, f"{key} {dict(canvases.dtypes)[key]}, r int, c int")


def border_connected(seam: np.ndarray, ends: tuple[tuple[int, int], tuple[int, int]], reach: int = 100) -> np.ndarray:
    """A seam on a union canvas (1 on the seam, 9 where it may not pass) drawn on to the border: from
    each end through free cells to the nearest border cell within ``reach``, else straight lines."""
    out = seam.copy()
    height, width = seam.shape
    for r, c in ends:
        grid = np.where(seam == 0, 0, 9)
        edge = np.zeros_like(grid, bool)
        edge[[0, -1]] = edge[:, [0, -1]] = True
        rr, cc = np.indices(grid.shape)
        edge &= (abs(rr - r) <= reach) & (abs(cc - c) <= reach) & (grid == 0)
        grid[edge] = 2
        grid[r, c] = 0
        found = kernels.shortest_steps(grid, (c, r), 9, 2)
        if found is not None:
            for x, y in found:
                out[y, x] = 1
            continue
        side = min(((r, "up"), (height - 1 - r, "down"), (c, "left"), (width - 1 - c, "right")))[1]
        if side in ("up", "down"):
            out[(slice(0, r + 1) if side == "up" else slice(r, height)), c] = 1
        else:
            out[r, (slice(0, c + 1) if side == "left" else slice(c, width))] = 1
    return out

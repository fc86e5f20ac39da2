"""Alignment of scenes: box overlap, pixel joins, canvases, footprints, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import pan_paths


def overlaps(scenes: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs ``a`` < ``b`` of scenes whose boxes meet (touching counts), with the common box.

    ``cell``: side of the grid's cells in map units; by default that of the mean scene, so that a box
    lies in about four cells at any scale.

    Boxes are dealt into a grid of cells, so the range join is an equi-join on the cell; a pair is
    taken only in the cell of its common box's upper left corner, so no distinct is needed.
    """
    if cell is None:
        cell = scenes.agg(F.greatest(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y0") - F.col("y1")))).first()[0] or 1.0
    key = lambda v: F.floor(v / F.lit(float(cell)))
    cells = scenes.select("scene_id", "x0", "y0", "x1", "y1", F.explode(F.sequence(key(F.col("x0")), key(F.col("x1")))).alias("tx")).select("*", F.explode(F.sequence(key(F.col("y1")), key(F.col("y0")))).alias("ty"))
    a = cells.select(F.col("scene_id").alias("a"), *[F.col(k).alias(f"a_{k}") for k in ("x0", "y0", "x1", "y1")], "tx", "ty")
    b = cells.select(F.col("scene_id").alias("b"), *[F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")], "tx", "ty")
    pairs = a.join(b, ["tx", "ty"]).where("a < b").withColumn("x0", F.greatest("a_x0", "b_x0")).withColumn("y0", F.least("a_y0", "b_y0")).withColumn("x1", F.least("a_x1", "b_x1")).withColumn("y1", F.greatest("a_y1", "b_y1"))
    return pairs.where((F.col("x1") >= F.col("x0")) & (F.col("y0") >= F.col("y1")) & (key(F.col("x0")) == F.col("tx")) & (key(F.col("y0")) == F.col("ty"))).select("a", "b", "x0", "y0", "x1", "y1")


def processing_order(scenes: DataFrame, anchor: DataFrame) -> DataFrame:
    """Scenes by squared distance to the anchor (one row ``ax``, ``ay``), then name."""
    d = (F.col("x0") - F.col("ax")) * (F.col("x0") - F.col("ax")) + (F.col("y0") - F.col("ay")) * (F.col("y0") - F.col("ay"))
    return scenes.join(F.broadcast(anchor)).withColumn("d2", d).withColumn("seq", F.row_number().over(Window.orderBy("d2", "name"))).drop("ax", "ay")  # a catalogue, not pixels


def second_scene(ordered: DataFrame) -> DataFrame:
    """The first scene in order, after the first, whose box meets the first one's."""
    one = ordered.where("seq = 1").select(*[F.col(k).alias(f"f_{k}") for k in ("x0", "y0", "x1", "y1")])
    meets = (F.least("x1", "f_x1") >= F.greatest("x0", "f_x0")) & (F.least("y0", "f_y0") >= F.greatest("y1", "f_y1"))
    return ordered.where("seq > 1").join(F.broadcast(one), meets).agg(F.min_by("scene_id", "seq").alias("scene_id"), F.min("seq").alias("seq"))


def canvas(scenes: DataFrame, x_max: float, y_min: float, res: float) -> DataFrame:
    """Origin and size of the mosaic's canvas."""
    return scenes.agg(F.min("x0").alias("x0"), F.max("y0").alias("y0")).select("x0", "y0", F.floor((F.col("y0") - y_min) / res).cast("long").alias("height"), F.floor((F.lit(x_max) - F.col("x0")) / res).cast("long").alias("width"))


def aligned(a: DataFrame, b: DataFrame, dr: int = 0, dc: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells that both have: ``dn`` of a and ``dn_b`` of b, b shifted by (dr, dc)."""
    moved = b.select(*keys, (F.col("r") + dr).cast("int").alias("r"), (F.col("c") + dc).cast("int").alias("c"), F.col("dn").alias("dn_b"))
    return a.join(moved, [*keys, "r", "c"])


def placed(parts: list[tuple[DataFrame, int, int]], height: int, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pixel tables shifted into one canvas; cells outside are cut, cells that meet are added."""
    out = None
    for px, dr, dc in parts:
        moved = px.select(*keys, (F.col("r") + dr).cast("int").alias("r"), (F.col("c") + dc).cast("int").alias("c"), "dn").where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
        out = moved if out is None else out.unionByName(moved)
    return out.groupBy(*keys, "r", "c").agg(F.sum("dn").alias("dn"))


def occupancy(parts: list[tuple[DataFrame, int, int]], height: int, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """1 where any part has data."""
    return placed(parts, height, width, keys).select(*keys, "r", "c", F.when(F.col("dn") > 0, 1).otherwise(0).alias("dn"))


def footprint(px: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells with data in any band."""
    return px.where("dn <> 0").select(*keys, "r", "c").distinct()


def area(cells: DataFrame, res: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` and ``area`` (in square map units) of a footprint; repeated cells count once."""
    return cells.select(*keys, "r", "c").distinct().groupBy(*keys).agg(F.count("*").alias("cells"), (F.count("*") * F.lit(float(res) * float(res))).alias("area"))


def boundary(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of a footprint with a neighbour (4) outside it."""
    near = cells.select(*keys, "r", "c", F.explode(F.expr("array(struct(1 AS dr, 0 AS dc), struct(-1 AS dr, 0 AS dc), struct(0 AS dr, 1 AS dc), struct(0 AS dr, -1 AS dc))")).alias("d"))
    missing = near.select(*keys, "r", "c", (F.col("r") + F.col("d.dr")).alias("nr"), (F.col("c") + F.col("d.dc")).alias("nc")).join(cells.select(*keys, F.col("r").alias("nr"), F.col("c").alias("nc")), [*keys, "nr", "nc"], "left_anti")
    return missing.select(*keys, "r", "c").distinct()


def crossings(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Boundary cells of a within one cell of b's boundary."""
    near = boundary(b, keys).select(*keys, F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(r + i AS r, c + j AS c))))")).alias("x")).select(*keys, "x.r", "x.c").distinct()
    return boundary(a, keys).join(near, [*keys, "r", "c"])


def nearest_points(points: DataFrame, target: DataFrame, keep: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` points nearest to a target's centre of gravity (one row ``tr``, ``tc`` per key)."""
    d = (F.col("r") - F.col("tr")) * (F.col("r") - F.col("tr")) + (F.col("c") - F.col("tc")) * (F.col("c") - F.col("tc"))
    met = points.join(target, list(keys)) if keys else points.join(F.broadcast(target))  # one row
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("d2", "r", "c"))
    return met.withColumn("d2", d).withColumn("place", place).where(F.col("place") <= keep).select(*keys, "r", "c", "d2")


def union_cells(*parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    out = parts[0].select(*keys, "r", "c")
    for p in parts[1:]:
        out = out.union(p.select(*keys, "r", "c"))
    return out.distinct()


def difference_cells(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return new.select(*keys, "r", "c").join(old.select(*keys, "r", "c"), [*keys, "r", "c"], "left_anti").distinct()


def by_name(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """Left join on names without regard to case; where several match, as written, upper, lower."""
    r = right.select(*[F.col(c).alias(f"found_{c}") for c in right.columns])
    rank = F.when(F.col(f"found_{key}") == F.col(key), 0).when(F.col(f"found_{key}") == F.upper(key), 1).otherwise(2)
    hit = left.join(r, F.lower(F.col(key)) == F.lower(F.col(f"found_{key}")), "left").withColumn("__rank", rank)
    return hit.withColumn("__n", F.row_number().over(Window.partitionBy(*left.columns).orderBy("__rank", f"found_{key}"))).where("__n = 1").drop("__rank", "__n")


def without_scenes(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates whose scene is not already used here (exact names)."""
    return candidates.join(used.select("name"), "name", "left_anti")


def pan_scenes(scenes: DataFrame, files: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """``scenes`` with ``path``: the first of a scene's possible paths that ``files`` (``path``) has, else
    the sensor's layout as written; and ``found``, false for such a scene, which cannot be read."""
    paths = pan_paths(folder, F.col(name))
    keyed = scenes.withColumn("__paths", paths)
    tried = keyed.select(name, F.posexplode("__paths").alias("__at", "path")).join(files.select("path").distinct(), "path")
    first = tried.groupBy(name).agg(F.min_by("path", "__at").alias("__first"))
    out = keyed.join(first, name, "left").select(*scenes.columns, F.coalesce("__first", F.element_at("__paths", 1)).alias("path"), F.col("__first").isNotNull().alias("found"))
    return out


def with_masks(scenes: DataFrame, masks: DataFrame, stem: str = "name") -> DataFrame:
    """``scenes`` with the first mask file (``file``, in order) whose name holds the scene's; a scene
    without one keeps its row, with ``reason``. Mask files are a catalogue, joined by the stem they hold."""
    held = masks.select("file", F.regexp_extract("file", r"([^/]*?)(?:_[a-z]+)?[.]tif$", 1).alias("__stem"))
    least = held.groupBy("__stem").agg(F.min("file").alias("mask"))
    out = scenes.join(least, F.col(stem) == F.col("__stem"), "left").drop("__stem")
    return out.withColumn("reason", F.when(F.col("mask").isNull(), F.concat(F.lit("no cloud mask for "), F.col(stem))))

"""More registered queries: regions, searches, footprints, tables and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import grid, names
from tessera.operators import align, blending, clouds, focal, graph, radiometry
from tessera.plans import fill, mosaic
from tessera.plans.params import Params
from tessera.plans.queries import (
    _SCENE, BANDS, BLOCKS, CELLS, COST_SQL, EDGES, ERODED, FULL, HIST, LABELS, MASKS, N, NEXT, PAIR, PAIR_KEY, PX, QUERIES, SCENES, SQL, VALID, _blocks, _cells, _lut, _next, _pairs, _sides, _valid, query,
)
from tessera.sources import adapters as src

__all__ = ["QUERIES", "SQL"]

BRIGHT = 225  # cells above it form scattered regions
_FRAME = f"(r IN (0, {N - 1}) OR c IN (0, {N - 1}))"
SPOTS = f"{FULL}, spots AS (SELECT scene_id, r, c, CASE WHEN dn > {BRIGHT} THEN 1 ELSE 0 END AS v FROM full_)"


def _spots(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).select("scene_id", "r", "c", F.when(F.col("dn") > BRIGHT, 1).otherwise(0).alias("v"))


# --- areas ---------------------------------------------------------------------------------------
@query(f"WITH RECURSIVE {PX}, {CELLS}, {SPOTS}, fl AS (SELECT scene_id, r, c, v FROM spots WHERE r = 1 AND c = 1 UNION SELECT s.scene_id, s.r, s.c, s.v FROM fl JOIN spots s ON s.scene_id = fl.scene_id AND s.v = fl.v AND abs(s.r - fl.r) + abs(s.c - fl.c) = 1) SELECT s.scene_id, s.r, s.c, CASE WHEN fl.r IS NOT NULL THEN 7 ELSE s.v END AS v FROM spots s LEFT JOIN fl ON fl.scene_id = s.scene_id AND fl.r = s.r AND fl.c = s.c")
def flood_fill(spark: SparkSession, sf: str) -> DataFrame:
    return graph.flooded(_spots(spark, sf), _SCENE, (1, 1), 7)


@query(f"WITH RECURSIVE {PX}, {CELLS}, {SPOTS}, o AS (SELECT scene_id, r, c FROM spots WHERE v = 0 AND {_FRAME} UNION SELECT s.scene_id, s.r, s.c FROM o JOIN spots s ON s.scene_id = o.scene_id AND s.v = 0 AND abs(s.r - o.r) + abs(s.c - o.c) = 1) SELECT s.scene_id, s.r, s.c, CASE WHEN s.v = 1 OR o.r IS NULL THEN 1 ELSE 0 END AS v FROM spots s LEFT JOIN o ON o.scene_id = s.scene_id AND o.r = s.r AND o.c = s.c")
def fill_holes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.holes_filled(_spots(spark, sf), _SCENE, N, N)


_ST = "st AS (SELECT scene_id, r, c FROM spots WHERE v = 1)"
_SIZES = "sz AS (SELECT scene_id, label, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lab GROUP BY 1, 2)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(_spots(spark, sf).where("v = 1"), _SCENE)


@query(f"WITH {PX}, {CELLS}, {SPOTS}, {_ST}, {LABELS}, {_SIZES} SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, label) AS place, count(*) OVER (PARTITION BY scene_id) AS regions FROM sz WHERE n > 3")
def main_regions(spark: SparkSession, sf: str) -> DataFrame:
    return graph.main_regions(_labelled(spark, sf), _SCENE, 3).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {PX}, {CELLS}, {SPOTS}, {_ST}, {LABELS}, {_SIZES}, big AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, label) AS place, count(*) OVER (PARTITION BY scene_id) AS regions FROM sz WHERE n > 3) SELECT scene_id, label, n FROM big WHERE place = regions OR (regions = 3 AND place = 1)")
def chosen_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The regions a seam leaves to one side: the smallest main one; of exactly three, the largest too."""
    return graph.chosen_regions(_labelled(spark, sf), _SCENE, 3).select("scene_id", "label", "n")


@query(f"WITH {PX}, {CELLS}, {SPOTS}, {_ST}, {LABELS}, {_SIZES}, h AS (SELECT sz.scene_id, sz.label AS box, lab.label, count(*) AS n FROM sz JOIN lab ON lab.scene_id = sz.scene_id AND lab.r BETWEEN greatest(0, r0 - 2) AND least({N - 1}, r1 + 2) AND lab.c BETWEEN greatest(0, c0 - 2) AND least({N - 1}, c1 + 2) GROUP BY 1, 2, 3) SELECT scene_id, box, label, n FROM h QUALIFY row_number() OVER (PARTITION BY scene_id, box ORDER BY n DESC, label) = 1")
def dominant_label(spark: SparkSession, sf: str) -> DataFrame:
    found = _labelled(spark, sf)
    return graph.dominant_in_box(found, graph.component_sizes(found, _SCENE), _SCENE, N, N, 2)


@query(f"WITH {CELLS}, {BLOCKS}, {LABELS}, {_SIZES} SELECT scene_id, label AS patch_id, CAST(least(10, r0) AS INT) AS top, CAST(least(10, {N} - 1 - r1) AS INT) AS bottom, CAST(least(10, c0) AS INT) AS before, CAST(least(10, {N} - 1 - c1) AS INT) AS behind FROM sz")
def patch_padding(spark: SparkSession, sf: str) -> DataFrame:
    boxes = graph.component_sizes(graph.components(_blocks(spark, sf), _SCENE), _SCENE)
    sides = []
    for lo, hi in (("r0", "r1"), ("c0", "c1")):
        sides += grid.padded(F.col(lo), F.col(hi) - F.col(lo) + 1, F.lit(N))
    return boxes.select("scene_id", F.col("label").alias("patch_id"), *[s.cast("int").alias(n) for s, n in zip(sides, ("top", "bottom", "before", "behind"), strict=True)])


_GROWN = f"{NEXT}, code AS (SELECT pair_id, a.r, a.c, a.block, CASE WHEN a.block <> 10 OR b.cell <= 2 THEN 1 ELSE least(b.cell, 10) END AS v FROM nx JOIN mk a ON a.scene_id = pair_id JOIN mk b ON b.scene_id = next_id AND b.r = a.r AND b.c = a.c WHERE pair_id IN (SELECT scene_id FROM mk WHERE block = 10)), grown AS (SELECT a.pair_id, a.r, a.c, max(b.v) AS v FROM code a JOIN code b ON a.pair_id = b.pair_id AND b.r BETWEEN a.r - 2 AND a.r + 1 AND b.c BETWEEN a.c - 2 AND a.c + 1 GROUP BY 1, 2, 3)"


@query(f"WITH RECURSIVE {CELLS}, {MASKS}, {_GROWN}, fl AS (SELECT pair_id, r, c, v FROM grown WHERE r = 1 AND c = 1 UNION SELECT g.pair_id, g.r, g.c, g.v FROM fl JOIN grown g ON g.pair_id = fl.pair_id AND g.v = fl.v AND abs(g.r - fl.r) + abs(g.c - fl.c) = 1) SELECT code.pair_id, code.r, code.c, CASE WHEN fl.r IS NULL THEN 1 ELSE 0 END AS flag FROM code LEFT JOIN fl ON fl.pair_id = code.pair_id AND fl.r = code.r AND fl.c = code.c WHERE code.block = 10")
def cloud_isolation(spark: SparkSession, sf: str) -> DataFrame:
    own, other = _sides(spark, sf, src.masks(spark, sf))
    patch = own.where("block = 10").select("pair_id", "r", "c")
    return clouds.isolated(patch, other.withColumn("code", F.col("cell")), N, N, 4, ["pair_id"]).select("pair_id", "r", "c", "flag")


# --- searches ------------------------------------------------------------------------------------
_INSIDE = " OR ".join(f"(r >= {r - 4} AND r < {r + 4} AND c >= {c - 4} AND c < {c + 4})" for r, c in ((4, 5), (20, 25)))


@query(f"WITH {PX}, {CELLS}, {VALID}, {ERODED} SELECT scene_id, r, c, CASE WHEN {_INSIDE} THEN valid.v WHEN n < 9 THEN 0 ELSE m END AS v FROM k JOIN valid USING (scene_id, r, c)")
def endpoint_reopen(spark: SparkSession, sf: str) -> DataFrame:
    valid = _valid(spark, sf)
    return focal.reopened(focal.eroded(valid, 3, N, N, _SCENE), valid, [(4, 5), (20, 25)], 3, 3, keys=_SCENE)


_SPIRAL = ", ".join(map(str, grid.spiral(35, 35)))


@query(f"WITH {PX}, {CELLS}, {PAIR}, s(n, dx, dy) AS (VALUES {_SPIRAL}), ok AS (SELECT pair_id, r, c FROM pair WHERE dn > 235 AND dn_b > 235), h AS (SELECT p.pair_id, CAST(p.r * {N} + p.c AS INT) AS p, ok.r, ok.c, s.n FROM pair p CROSS JOIN s JOIN ok ON ok.pair_id = p.pair_id AND ok.r = p.r + s.dy AND ok.c = p.c + s.dx) SELECT pair_id, p, r, c FROM h QUALIFY row_number() OVER (PARTITION BY pair_id, p ORDER BY n) = 1")
def spiral_search(spark: SparkSession, sf: str) -> DataFrame:
    """From every cell of every pair, within 35 by 35, the first cell that is bright in both."""
    pairs = _pairs(spark, sf)
    points = pairs.select("pair_id", (F.col("r") * N + F.col("c")).alias("p"), "r", "c")
    return focal.nearest_valid(points, pairs.where("dn > 235 AND dn_b > 235"), keys=["pair_id"])


@query(f"WITH {SCENES}, p AS (SELECT scene_id, CASE WHEN scene_id % 5 <> 4 THEN x0::DOUBLE END AS x, CASE WHEN scene_id % 5 <> 4 THEN y0::DOUBLE END AS y FROM scenes) SELECT scene_id, x, y, CAST(floor(x / 6.0::DOUBLE) AS BIGINT) AS c, CAST(floor((2100.0::DOUBLE - y) / 6.0::DOUBLE) AS BIGINT) AS r, CAST(round_even(x / 6.0::DOUBLE, 0) AS BIGINT) AS c_even, CAST(round_even((2100.0::DOUBLE - y) / 6.0::DOUBLE, 0) AS BIGINT) AS r_even, CAST(floor((2100.0::DOUBLE - y) / 6.0::DOUBLE) AS BIGINT) * 200 + CAST(floor(x / 6.0::DOUBLE) AS BIGINT) + 1 AS id FROM p")
def endpoint_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Scene corners as text of points, of lines or of nothing, to cells and cell numbers."""
    at = F.concat_ws(" ", F.col("x0").cast("string"), F.col("y0").cast("string"))
    k = F.col("scene_id") % 5
    wkt = F.when(k == 4, F.lit("POINT EMPTY")).when(k == 3, F.concat(F.lit("LINESTRING ("), at, F.lit(", 0 0)"))).otherwise(F.concat(F.lit("POINT ("), at, F.lit(")")))
    x, y = grid.wkt_point(wkt)
    rows = src.scene_supplier(spark, sf).select("scene_id", x.alias("x"), y.alias("y"))
    zero, top, res = F.lit(0.0), F.lit(2100.0), F.lit(6.0)
    rows = rows.withColumns({"c": grid.to_col(F.col("x"), zero, res), "r": grid.to_row(F.col("y"), top, res), "c_even": grid.to_col(F.col("x"), zero, res, True), "r_even": grid.to_row(F.col("y"), top, res, True)})
    return rows.withColumn("id", grid.pixel_id(F.col("r"), F.col("c"), 200))


@query()
def connecting_kernel(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connecting_size(_valid(spark, sf), _SCENE, (3, 3), (N - 4, N - 4), (9, 5, 3, 1), N, N, 1)


@query()
def seam_to_border(spark: SparkSession, sf: str) -> DataFrame:
    """The seam of each pair between two inner cells, drawn on to the border."""
    edges = graph.seam_edges(_pairs(spark, sf), "a6c_int", ["pair_id"])
    seam = graph.seam_paths(edges, "pair_id", (3, 3), (N - 4, N - 4), N, N).select("pair_id", "r", "c", F.lit(1).alias("v"))
    return graph.seams_to_border(seam, "pair_id", ((3, 3), (N - 4, N - 4)), N, N)


@query(f"WITH {PX}, {CELLS}, {PAIR}, {EDGES}, e AS (SELECT pair_id, r, dir, {COST_SQL['a7c_int']} AS w FROM edges WHERE dn <> 0 AND dn_b <> 0 AND dn_next IS NOT NULL) SELECT pair_id, dir, count(*) AS edges, min(w) AS least, max(w) AS most FROM e GROUP BY 1, 2")
def lattice_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.seam_edges(_pairs(spark, sf), "a7c_int", ["pair_id"]).groupBy("pair_id", "dir").agg(F.count("*").alias("edges"), F.min("w").alias("least"), F.max("w").alias("most"))


# --- footprints ----------------------------------------------------------------------------------
def _border_sql(name: str, side: str) -> str:
    near = f"SELECT pair_id, r, c, unnest([1, -1, 0, 0]) AS dr, unnest([0, 0, 1, -1]) AS dc FROM f{name}"
    return f"f{name} AS (SELECT DISTINCT pair_id, r, c FROM nx JOIN px ON scene_id = {side} WHERE dn > {BRIGHT}), {name} AS (SELECT DISTINCT n.pair_id, n.r, n.c FROM ({near}) n LEFT JOIN f{name} x ON x.pair_id = n.pair_id AND x.r = n.r + dr AND x.c = n.c + dc WHERE x.r IS NULL)"


_CROSS = f"{NEXT}, {_border_sql('ba', 'pair_id')}, {_border_sql('bb', 'next_id')}, cr AS (SELECT DISTINCT ba.pair_id, ba.r, ba.c FROM ba JOIN bb ON ba.pair_id = bb.pair_id AND abs(ba.r - bb.r) <= 1 AND abs(ba.c - bb.c) <= 1)"


def _footprints(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return tuple(d.where(F.col("dn") > BRIGHT).select("pair_id", "r", "c") for d in _sides(spark, sf))


@query(f"WITH {PX}, {_CROSS} SELECT pair_id, r, c FROM cr")
def boundary_crossings(spark: SparkSession, sf: str) -> DataFrame:
    return align.crossings(*_footprints(spark, sf), PAIR_KEY)


# pieces of the first footprint without the second; the pair stands for the scene in the labels
_REST = "st AS (SELECT pair_id AS scene_id, r, c FROM fba EXCEPT SELECT pair_id, r, c FROM fbb)"
_FOUR = LABELS.replace("abs(s.r - n.r) <= 1 AND abs(s.c - n.c) <= 1", "abs(s.r - n.r) + abs(s.c - n.c) <= 1")
_LARGEST = "lg AS (SELECT scene_id AS pair_id, label FROM lab GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY count(*) DESC, label) = 1)"


@query(f"WITH {PX}, {_CROSS}, {_REST}, {_FOUR}, {_LARGEST}, g AS (SELECT pair_id, sum(r)::DOUBLE / count(*) AS tr, sum(c)::DOUBLE / count(*) AS tc FROM lg JOIN lab ON lab.scene_id = lg.pair_id AND lab.label = lg.label GROUP BY 1) SELECT pair_id, cr.r, cr.c, (cr.r - tr) * (cr.r - tr) + (cr.c - tc) * (cr.c - tc) AS d2 FROM cr JOIN g USING (pair_id) QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY d2, cr.r, cr.c) <= 2")
def crossing_points(spark: SparkSession, sf: str) -> DataFrame:
    """The two crossings nearest to the largest piece that only the new footprint has."""
    new, old = _footprints(spark, sf)
    pieces = graph.components(align.difference_cells(new, old, PAIR_KEY), ["pair_id"], eight=False)
    largest = pieces.join(graph.main_regions(pieces, ["pair_id"], 0).where("place = 1").select("pair_id", "label"), ["pair_id", "label"], "left_semi")
    centre = largest.groupBy("pair_id").agg((F.sum("r").cast("double") / F.count("*")).alias("tr"), (F.sum("c").cast("double") / F.count("*")).alias("tc"))
    return align.nearest_points(align.crossings(new, old, PAIR_KEY), centre, keys=PAIR_KEY)


@query(f"WITH {PX}, {_CROSS}, {_REST}, {_FOUR}, {_LARGEST}, minor AS (SELECT lab.scene_id AS pair_id, r, c FROM lab LEFT JOIN lg ON lg.pair_id = lab.scene_id AND lg.label = lab.label WHERE lg.label IS NULL) SELECT pair_id, r, c FROM (SELECT * FROM fba UNION SELECT * FROM fbb) EXCEPT SELECT * FROM minor")
def main_union(spark: SparkSession, sf: str) -> DataFrame:
    new, old = _footprints(spark, sf)
    return graph.without_minor_pieces(align.union_cells(new, old, keys=PAIR_KEY), new, old, ["pair_id"])


# --- tables and names ----------------------------------------------------------------------------
@query(f"WITH {BANDS}, {HIST} SELECT pair_id, band, dn, CASE WHEN out > 0 AND out < 30 THEN CAST(floor(sqrt(out * 30.0::DOUBLE)) AS BIGINT) ELSE out END AS out FROM lut")
def dark_stretch(spark: SparkSession, sf: str) -> DataFrame:
    return radiometry.reshaped(_lut(spark, sf), 30)


@query(f"WITH {BANDS}, t AS (SELECT scene_id, band, count(*) AS n FROM bands WHERE dn > 0 AND NOT (scene_id % 3 = 0 AND band = 4) GROUP BY 1, 2) SELECT scene_id, band, n FROM t WHERE scene_id IN (SELECT scene_id FROM t GROUP BY 1 HAVING count(DISTINCT band) = 4)")
def complete_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes with a table for each band; every third scene's last table is missing."""
    tables = src.px_bands(spark, sf).where("dn > 0 AND NOT (scene_id % 3 = 0 AND band = 4)").groupBy("scene_id", "band").agg(F.count("*").alias("n"))
    return radiometry.complete_groups(tables).select("scene_id", "band", "n")


@query(f"WITH {BANDS}, {NEXT}, a AS (SELECT pair_id, band, r, c, CASE WHEN (r + c) % 5 = 0 THEN 0 ELSE dn END AS dn FROM nx JOIN bands ON scene_id = pair_id), b AS (SELECT pair_id, band, r, c, dn FROM nx JOIN bands ON scene_id = next_id), m AS (SELECT *, max(dn) OVER (PARTITION BY pair_id, r, c) = 0 AS hole FROM a) SELECT m.pair_id, m.band, m.r, m.c, CASE WHEN hole THEN coalesce(b.dn, 0) ELSE m.dn END AS dn FROM m LEFT JOIN b USING (pair_id, band, r, c)")
def no_data_source(spark: SparkSession, sf: str) -> DataFrame:
    """Every scene, with every fifth diagonal without data, filled from the next one."""
    a, b = _sides(spark, sf, src.px_bands(spark, sf))
    return blending.over_no_data(a.withColumn("dn", F.when((F.col("r") + F.col("c")) % 5 == 0, 0).otherwise(F.col("dn"))), b, PAIR_KEY)


_FILES = "files AS (SELECT upper(name) AS name, scene_id * 10 AS file FROM scenes WHERE scene_id % 3 <> 0 UNION ALL SELECT lower(name), scene_id * 10 + 1 FROM scenes WHERE scene_id % 2 = 0)"


@query(f"WITH {SCENES}, {_FILES}, h AS (SELECT s.scene_id, s.name, f.name AS found_name, f.file AS found_file FROM scenes s LEFT JOIN files f ON lower(s.name) = lower(f.name)) SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY CASE WHEN found_name = name THEN 0 WHEN found_name = upper(name) THEN 1 ELSE 2 END, found_name) = 1")
def pan_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Files by scene name without regard to case: as written, then upper, then lower."""
    scenes = src.scene_supplier(spark, sf).select("scene_id", "name")
    upper = scenes.where("scene_id % 3 <> 0").select(F.upper("name").alias("name"), (F.col("scene_id") * 10).alias("file"))
    lower = scenes.where("scene_id % 2 = 0").select(F.lower("name").alias("name"), (F.col("scene_id") * 10 + 1).alias("file"))
    return align.by_name(scenes, upper.union(lower))


@query(f"WITH {SCENES} SELECT name, scene_id FROM scenes WHERE name NOT IN (SELECT name FROM scenes WHERE scene_id % 4 = 1)")
def scene_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    scenes = src.scene_supplier(spark, sf).select("scene_id", "name")
    return align.without_scenes(scenes, scenes.where("scene_id % 4 = 1"))


_PATHS = ", ".join(f"'/pan/' || {n} || '/' || {n} || '_B1.DAT.raw' AS p{2 * k + 1}, '/pan/' || {n} || '.tif' AS p{2 * k + 2}" for k, n in enumerate(("name", "upper(name)", "lower(name)")))


@query(f"WITH {SCENES} SELECT scene_id, name || '.img' AS file, name AS stem, {_PATHS} FROM scenes")
def scene_files(spark: SparkSession, sf: str) -> DataFrame:
    """Where a scene's panchromatic partner may lie, best first."""
    file = F.concat("name", F.lit(".img"))
    paths = names.pan_paths("/pan", names.stem(file))
    return src.scene_supplier(spark, sf).select("scene_id", file.alias("file"), names.stem(file).alias("stem"), *[F.element_at(paths, k).alias(f"p{k}") for k in range(1, 7)])


_ON_DISK = "disk AS (SELECT '/pan/' || upper(name) || '/' || upper(name) || '_B1.DAT.raw' AS path FROM scenes WHERE scene_id % 3 = 0 UNION SELECT '/pan/' || name || '.tif' FROM scenes WHERE scene_id % 2 = 0 UNION SELECT '/pan/' || lower(name) || '.tif' FROM scenes WHERE scene_id % 5 = 0)"


@query(f"WITH {SCENES}, {_ON_DISK}, t AS (SELECT scene_id, name, {_PATHS} FROM scenes), u AS (SELECT scene_id, name, p1, unnest([1, 2, 3, 4, 5, 6]) AS spot, unnest([p1, p2, p3, p4, p5, p6]) AS path FROM t) SELECT scene_id, name, coalesce(arg_min(disk.path, CASE WHEN disk.path IS NOT NULL THEN spot END), any_value(p1)) AS path, count(disk.path) > 0 AS found FROM u LEFT JOIN disk USING (path) GROUP BY 1, 2")
def pan_scene_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The first possible path that is there; without any, the first possible one and no find."""
    scenes = src.scene_supplier(spark, sf).select("scene_id", "name")
    upper, written, lower = (scenes.where(f"scene_id % {m} = 0") for m in (3, 2, 5))
    raw = upper.select(F.concat(F.lit("/pan/"), F.upper("name"), F.lit("/"), F.upper("name"), F.lit("_B1.DAT.raw")).alias("path"))
    disk = raw.union(written.select(F.concat(F.lit("/pan/"), "name", F.lit(".tif")))).union(lower.select(F.concat(F.lit("/pan/"), F.lower("name"), F.lit(".tif"))))
    return align.pan_scenes(scenes, disk, "/pan")


@query(f"WITH {SCENES} SELECT scene_id, name, CASE WHEN scene_id % 4 <> 0 THEN 'm/' || name || '_cloud.tif' END AS mask, CASE WHEN scene_id % 4 = 0 THEN 'no cloud mask for ' || name END AS reason FROM scenes")
def mask_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Cloud mask files by scene name; a scene without one keeps its row, with the reason."""
    scenes = src.scene_supplier(spark, sf).select("scene_id", "name")
    files = scenes.where("scene_id % 4 <> 0").select(F.explode(F.array(F.concat(F.lit("m/"), "name", F.lit("_cloud.tif")), F.concat(F.lit("n/"), "name", F.lit("_cloud.tif")))).alias("file"))
    return align.with_masks(scenes, files)


def _canvas_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All scenes at their places on one canvas: scene n is moved by (3 n mod 10, 5 n mod 12) cells."""
    px = src.px_bands(spark, sf)
    n = F.col("scene_id")
    return px.select("scene_id", "band", (F.col("r") + n * 3 % 10).cast("int").alias("r"), (F.col("c") + n * 5 % 12).cast("int").alias("c"), "dn")


def _mosaic(spark: SparkSession, sf: str) -> "mosaic.Mosaic":
    return mosaic.mosaic(_canvas_rows(spark, sf), src.scene_ids(spark, sf), Params(resample_to=2, kernel=3, true_bits=12))


@query()
def running_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    """All scenes one after the other, each against the mosaic so far."""
    return _mosaic(spark, sf).rows()


@query()
def mosaic_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The windows and roles of the mosaic's steps."""
    return _mosaic(spark, sf).windows


@query()
def patch_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Every scene's blocks of cloud filled from all other scenes, one window for each pair of neighbours; the
    mosaic that is filled is the blend of all scenes."""
    px = src.px_bands(spark, sf)
    rows = blending.folded([(px.where(F.col("scene_id") == n).drop("scene_id"), grid.dense(spark, None, N, N).withColumn("k", F.lit(29))) for n in src.scene_ids(spark, sf)], ("band",))
    masks = src.masks(spark, sf)
    mask = masks.groupBy("r", "c").agg(F.max(F.when((F.col("block") == 10) & (F.col("r") > 3) & (F.col("r") < N - 4) & (F.col("c") > 3) & (F.col("c") < N - 4), 1).otherwise(0)).alias("code"))
    every = mosaic.Box(0, 0, N, N)
    windows = [(seq, n, every) for seq, n in enumerate(src.scene_ids(spark, sf)[:2])]
    land = grid.dense(spark, None, N, N).where((F.col("r") + 2 * F.col("c")) % 9 != 0)
    params = Params(res=300.0, true_bits=12, ssim_threshold=0.0, cloud_tolerance=0.9)
    done = fill.fill(rows, mask, windows, px, masks.select("scene_id", "r", "c", F.col("cell").alias("code")), land, params)
    return done.rows

"""The registered queries: adapters joined to operators, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cost, grid, names, pixel
from tessera.operators import align, blending, clouds, focal, graph, radiometry, scoring
from tessera.sources import adapters as src

N = src.SIDE
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- SQL of the adapters -------------------------------------------------------------------------
PX = f"px AS (SELECT l_linenumber AS scene_id, CAST(l_orderkey % {N} AS INT) AS r, CAST(l_partkey % {N} AS INT) AS c, CAST(max(floor(l_quantity) * 5) AS BIGINT) AS dn FROM lineitem GROUP BY 1, 2, 3)"
CELLS = f"cells AS (SELECT CAST(i // {N} AS INT) AS r, CAST(i % {N} AS INT) AS c FROM range({N * N}) t(i)), sc AS (SELECT DISTINCT l_linenumber AS scene_id FROM lineitem WHERE l_linenumber IS NOT NULL)"
#: Every scene with the next one; pair_id is the first one's number.
NEXT = "nx AS (SELECT * FROM (SELECT scene_id AS pair_id, lead(scene_id) OVER (ORDER BY scene_id) AS next_id FROM (SELECT DISTINCT l_linenumber AS scene_id FROM lineitem WHERE l_linenumber IS NOT NULL)) WHERE next_id IS NOT NULL)"
BANDS = (
    f"wide AS (SELECT l_linenumber AS scene_id, CAST(l_orderkey % {N} AS INT) AS r, CAST(l_partkey % {N} AS INT) AS c, CAST(max(floor(l_quantity)) AS BIGINT) AS b1, CAST(max(floor(l_extendedprice) % 4095 + 1) AS BIGINT) AS b2, CAST(max(floor(l_discount * 100 + 0.5)) AS BIGINT) AS b3, CAST(max(floor(l_tax * 100 + 0.5)) AS BIGINT) AS b4 FROM lineitem GROUP BY 1, 2, 3), "
    "bands AS (SELECT scene_id, 1 AS band, r, c, b1 AS dn FROM wide UNION ALL SELECT scene_id, 2, r, c, b2 FROM wide UNION ALL SELECT scene_id, 3, r, c, b3 FROM wide UNION ALL SELECT scene_id, 4, r, c, b4 FROM wide)"
)
SCENES = "scenes AS (SELECT s_suppkey AS scene_id, 'a' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') || '_' || n_name AS name, (s_suppkey * 37) % 1000 AS x0, 1000 + (s_suppkey * 53) % 1000 AS y0, (s_suppkey * 37) % 1000 + 60 + s_suppkey % 40 AS x1, 1000 + (s_suppkey * 53) % 1000 - 60 - s_suppkey % 30 AS y1 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
PAIR = f"{NEXT}, pair AS (SELECT nx.pair_id, cells.r, cells.c, coalesce(a.dn, 0) AS dn, coalesce(b.dn, 0) AS dn_b FROM nx CROSS JOIN cells LEFT JOIN px a ON a.scene_id = nx.pair_id AND a.r = cells.r AND a.c = cells.c LEFT JOIN px b ON b.scene_id = nx.next_id AND b.r = cells.r AND b.c = cells.c)"
MASKS = (
    f"ks AS (SELECT l_linenumber AS scene_id, CAST(l_orderkey % {N} AS INT) AS r, CAST(l_partkey % {N} AS INT) AS c, CAST(sum(l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2, 3), "
    "km AS (SELECT scene_id, cells.r, cells.c, coalesce(s, 0) AS s, CAST(sum(coalesce(s, 0)) OVER (PARTITION BY scene_id, cells.r // 8, cells.c // 8) AS BIGINT) AS t FROM sc CROSS JOIN cells LEFT JOIN ks USING (scene_id, r, c)), "
    "mk AS (SELECT scene_id, r, c, CASE WHEN (s + r * 7 + c * 3 + scene_id * 11) % 17 < 3 THEN 10 ELSE 0 END AS cell, CASE WHEN (t + (r // 8) * 3 + (c // 8) * 5 + scene_id) % 6 = 0 THEN 10 ELSE 0 END AS block FROM km)"
)
WEIGHT = "CAST(least(58, greatest(0, (c - 8) * 4)) AS INT)"
EMB = "emb AS (SELECT vec_id, label, CAST((pos - 1) // 8 AS INT) AS r, CAST((pos - 1) % 8 AS INT) AS c, CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS dn FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _next(spark: SparkSession, sf: str) -> DataFrame:
    """Every scene with the next one; ``pair_id`` is the first one's number. A row for each scene."""
    from pyspark.sql import Window

    ids = src.scenes_of(spark, sf).select(F.col("scene_id").alias("pair_id"))
    return ids.withColumn("next_id", F.lead("pair_id").over(Window.orderBy("pair_id"))).where("next_id IS NOT NULL")


def _sides(spark: SparkSession, sf: str, px: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of the first and of the next scene of every pair, with ``pair_id`` for ``scene_id``."""
    keys, px = F.broadcast(_next(spark, sf)), src.px_lineitem(spark, sf) if px is None else px  # a row for each scene
    rest = [c for c in px.columns if c != "scene_id"]
    return tuple(px.join(keys, px["scene_id"] == keys[side]).select("pair_id", *rest) for side in ("pair_id", "next_id"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Dense cells of every pair of neighbouring scenes: ``pair_id``, ``r``, ``c``, ``dn``, ``dn_b``."""
    a, b = _sides(spark, sf)
    cells = grid.dense(spark, _next(spark, sf).select("pair_id"), N, N)
    return cells.join(a, ["pair_id", "r", "c"], "left").join(b.withColumnRenamed("dn", "dn_b"), ["pair_id", "r", "c"], "left").fillna(0, ["dn", "dn_b"])


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Dense cells of every scene."""
    return grid.dense(spark, src.scenes_of(spark, sf), N, N).join(src.px_lineitem(spark, sf), ["scene_id", "r", "c"], "left").fillna(0, ["dn"])


def _weight(spark: SparkSession, height: int = N, width: int = N) -> DataFrame:
    return grid.dense(spark, None, height, width).withColumn("k", F.least(F.lit(58), F.greatest(F.lit(0), (F.col("c") - 8) * 4)).cast("int"))


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).select("scene_id", "r", "c", F.when(F.col("dn") > 25, 1).otherwise(0).alias("v"))


FULL = "full_ AS (SELECT scene_id, cells.r, cells.c, coalesce(px.dn, 0) AS dn FROM sc CROSS JOIN cells LEFT JOIN px USING (scene_id, r, c))"
VALID = f"{FULL}, valid AS (SELECT scene_id, r, c, CASE WHEN dn > 25 THEN 1 ELSE 0 END AS v FROM full_)"

# --- seam costs ----------------------------------------------------------------------------------
_D = lambda a: f"({a} - {a}_next)"
_W = lambda x: f"(({x}) % 256 + 256) % 256"
_OVER = lambda d: f"CASE WHEN {d} = 0 THEN 1e10::DOUBLE ELSE 1.0::DOUBLE / ({d})::DOUBLE END"
_SUM = lambda a, b, t: f"CASE WHEN {a} = 0 AND {b} = 0 THEN 1e10::DOUBLE WHEN {t} = 0 THEN 'Infinity'::DOUBLE ELSE 1.0::DOUBLE / ({t})::DOUBLE END"
_A, _B = f"abs{_D('dn')}", f"abs{_D('dn_b')}"
_WA, _WB = _W(_D("dn")), _W(_D("dn_b"))
COST_SQL = {
    "a6": f"1.0::DOUBLE / ({_A} + 1e-18::DOUBLE) + 1.0::DOUBLE / ({_B} + 1e-18::DOUBLE)",
    "a7": f"1.0::DOUBLE / (({_A} + 1e-18::DOUBLE) + ({_B} + 1e-18::DOUBLE))",
    "a6c": f"{_OVER(_WA)} + {_OVER(_WB)}", "a7c": _SUM(_WA, _WB, _W(f"{_WA} + {_WB}")),
    "a6c_int": f"{_OVER(_A)} + {_OVER(_B)}", "a7c_int": _SUM(_A, _B, f"({_A} + {_B})"),
}
EDGES = "edges AS (SELECT pair_id, r, c, 'r' AS dir, dn, dn_b, lead(dn) OVER (PARTITION BY pair_id, r ORDER BY c) AS dn_next, lead(dn_b) OVER (PARTITION BY pair_id, r ORDER BY c) AS dn_b_next FROM pair UNION ALL SELECT pair_id, r, c, 'd', dn, dn_b, lead(dn) OVER (PARTITION BY pair_id, c ORDER BY r), lead(dn_b) OVER (PARTITION BY pair_id, c ORDER BY r) FROM pair)"
for _name in cost.COSTS:

    def _edge(spark: SparkSession, sf: str, method: str = _name) -> DataFrame:
        return graph.seam_edges(_pairs(spark, sf), method, ["pair_id"])

    _edge.__name__ = f"edge_cost_{_name}"
    query(f"WITH {PX}, {CELLS}, {PAIR}, {EDGES} SELECT pair_id, r, c, dir, {COST_SQL[_name]} AS w FROM edges WHERE dn <> 0 AND dn_b <> 0 AND dn_next IS NOT NULL")(_edge)


@query(f"WITH {PX}, {CELLS}, {PAIR}, {EDGES}, e AS (SELECT pair_id, r, c, dir, {COST_SQL['a6c_int']} AS w FROM edges WHERE dn <> 0 AND dn_b <> 0 AND dn_next IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, r ORDER BY w, c, dir) AS rank FROM e) SELECT pair_id, r, rank, c, dir, w FROM k WHERE rank <= 3")
def cheapest_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The three cheapest edges of each row of each pair (a top-k report)."""
    from pyspark.sql import Window

    e = graph.seam_edges(_pairs(spark, sf), "a6c_int", ["pair_id"])
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id", "r").orderBy("w", "c", "dir")).cast("long")).where("rank <= 3").select("pair_id", "r", "rank", "c", "dir", "w")


# --- pixels --------------------------------------------------------------------------------------
@query(f"WITH {BANDS} SELECT scene_id, band, r, c, dn, CAST(floor(dn / 16.0::DOUBLE) % 256 AS INT) AS dn8 FROM bands")
def bit_depth_scale(spark: SparkSession, sf: str) -> DataFrame:
    return src.px_bands(spark, sf).withColumn("dn8", pixel.to_8bit(F.col("dn"), 12))


@query(f"WITH {BANDS} SELECT scene_id, r, c, CAST(floor((b3 * 4899 + b2 * 9617 + b1 * 1868 + 8192) / 16384.0::DOUBLE) AS INT) AS gray, CASE WHEN greatest(b1, b2, b3, b4) > 0 THEN 1 ELSE 0 END AS valid, CASE WHEN least(b1, b2, b3) = 0 THEN 0 ELSE CAST(floor((b1 + b2 + b3) / 3.0::DOUBLE) AS BIGINT) END AS pan, CASE WHEN b2 = 0 THEN 0 ELSE least(greatest(b2 - 1000, 1), 4095) END AS dn12 FROM wide")
def pixel_algebra(spark: SparkSession, sf: str) -> DataFrame:
    wide = src.px_bands(spark, sf).groupBy("scene_id", "r", "c").pivot("band", [1, 2, 3, 4]).agg(F.first("dn")).withColumnsRenamed({str(b): f"b{b}" for b in (1, 2, 3, 4)})
    b1, b2, b3, b4 = (F.col(f"b{b}") for b in (1, 2, 3, 4))
    return wide.select("scene_id", "r", "c", pixel.gray(b3, b2, b1).alias("gray"), F.when(F.greatest(b1, b2, b3, b4) > 0, 1).otherwise(0).alias("valid"), pixel.pseudo_pan(b1, b2, b3).cast("long").alias("pan"), pixel.to_12bit(b2, 1000).alias("dn12"))


@query(f"WITH {PX} SELECT scene_id, r, c, dn FROM px WHERE r BETWEEN 4 AND 19 AND c BETWEEN 8 AND 23")
def window_read(spark: SparkSession, sf: str) -> DataFrame:
    """A window of every scene."""
    return src.px_lineitem(spark, sf).where(F.col("r").between(4, 19) & F.col("c").between(8, 23))


# --- radiometry ----------------------------------------------------------------------------------
DIFF = f"{NEXT}, nd AS (SELECT scene_id, r, c, CASE WHEN max(dn) = 0 THEN 1 ELSE 0 END AS no_data FROM bands GROUP BY 1, 2, 3), diff AS (SELECT nx.pair_id, a.band, a.r, a.c, CASE WHEN no_data = 0 THEN a.dn - b.dn ELSE 0 END AS diff, no_data FROM nx JOIN bands a ON a.scene_id = nx.pair_id JOIN bands b ON b.scene_id = nx.next_id AND a.band = b.band AND a.r = b.r AND a.c = b.c JOIN nd ON nd.scene_id = a.scene_id AND nd.r = a.r AND nd.c = a.c WHERE a.band IN (1, 2, 3)), lim AS (SELECT pair_id, band, greatest(0, max(diff)) * 10 / 100.0::DOUBLE AS hi, least(0, min(diff)) * 10 / 100.0::DOUBLE AS lo FROM diff GROUP BY 1, 2), code AS (SELECT d.*, CASE WHEN diff < lo THEN 1 WHEN diff < 0 THEN 2 WHEN diff = 0 THEN 3 WHEN diff <= hi THEN 4 ELSE 5 END AS code FROM diff d JOIN lim USING (pair_id, band))"
PAIR_KEY = ("pair_id",)


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    d = radiometry.differences(*_sides(spark, sf, src.px_bands(spark, sf)), keys=PAIR_KEY)
    return radiometry.change_codes(d, radiometry.thresholds(d, keys=PAIR_KEY), PAIR_KEY)


@query(f"WITH {BANDS}, {DIFF} SELECT pair_id, band, r, c, diff, code FROM code")
def change_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(spark, sf).select("pair_id", "band", "r", "c", "diff", "code")


# the river: cells whose rows' supplier numbers add up to a multiple of 13; the border leaves out the first row and column
EXCLUDED = f"ch AS (SELECT pair_id, r, c, max(CASE WHEN code IN (1, 5) THEN 1 ELSE 0 END) AS changed, max(no_data) AS no_data FROM code GROUP BY 1, 2, 3), rv AS (SELECT DISTINCT l_linenumber AS pair_id, CAST(l_orderkey % {N} AS INT) AS r, CAST(l_partkey % {N} AS INT) AS c FROM lineitem GROUP BY 1, 2, 3 HAVING sum(l_suppkey) % 13 = 0), ex AS (SELECT ch.pair_id, ch.r, ch.c, CASE WHEN changed = 1 OR rv.r IS NOT NULL OR NOT (ch.r >= 1 AND ch.c >= 1) OR no_data = 1 THEN 1 ELSE 0 END AS excluded FROM ch LEFT JOIN rv USING (pair_id, r, c))"


def _excluded(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("pair_id"), F.pmod("l_orderkey", F.lit(N)).cast("int").alias("r"), F.pmod("l_partkey", F.lit(N)).cast("int").alias("c"))
    river = rows.agg(F.sum("l_suppkey").alias("s")).where("s % 13 = 0").select("pair_id", "r", "c", F.lit(1).alias("river"))
    border = _cells(spark, sf).where("r >= 1 AND c >= 1").select(F.col("scene_id").alias("pair_id"), "r", "c", F.lit(1).alias("border"))
    return radiometry.exclusion(radiometry.changed(_codes(spark, sf), PAIR_KEY), river, border, PAIR_KEY)


@query(f"WITH {BANDS}, {DIFF}, {EXCLUDED} SELECT * FROM ex")
def exclusion_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _excluded(spark, sf)


HIST = f"{DIFF}, {EXCLUDED}, kept AS (SELECT nx.pair_id, side, b.band, b.r, b.c, b.dn FROM nx CROSS JOIN (VALUES (0), (1)) s(side) JOIN bands b ON b.scene_id = CASE side WHEN 0 THEN nx.pair_id ELSE nx.next_id END LEFT JOIN ex ON ex.pair_id = nx.pair_id AND ex.r = b.r AND ex.c = b.c WHERE coalesce(excluded, 0) = 0), h AS (SELECT pair_id, side, band, dn, count(*) AS n FROM kept WHERE dn <> 0 GROUP BY 1, 2, 3, 4), cum AS (SELECT *, sum(n) OVER (PARTITION BY pair_id, side, band ORDER BY dn) AS k, sum(n) OVER (PARTITION BY pair_id, side, band) AS t FROM h), lut AS (SELECT a.pair_id, a.band, a.dn, min(b.dn) AS out FROM cum a JOIN cum b ON a.pair_id = b.pair_id AND a.band = b.band AND a.side = 0 AND b.side = 1 AND b.k * a.t >= a.k * b.t GROUP BY 1, 2, 3)"


def _lut(spark: SparkSession, sf: str) -> DataFrame:
    """Matching tables of every pair, from the cells that the exclusion mask leaves."""
    mask = _excluded(spark, sf).withColumnRenamed("excluded", "mask")
    raw, ref = (radiometry.histogram(radiometry.without_masked(px, mask, PAIR_KEY), ("pair_id", "band")) for px in _sides(spark, sf, src.px_bands(spark, sf)))
    return radiometry.matching_table(raw, ref, ("pair_id", "band"))


@query(f"WITH {BANDS}, {HIST} SELECT * FROM lut")
def histmatch_lut(spark: SparkSession, sf: str) -> DataFrame:
    return _lut(spark, sf)


@query(f"WITH {BANDS}, {HIST}, p AS (SELECT pair_id, r, c, band, dn, sum(dn) OVER (PARTITION BY pair_id, r, c) AS total FROM nx JOIN bands ON scene_id = pair_id) SELECT p.pair_id, r, c, p.band, p.dn, CASE WHEN total > 0 THEN coalesce(out, 0) ELSE 0 END AS out FROM p LEFT JOIN lut ON p.pair_id = lut.pair_id AND p.band = lut.band AND p.dn = lut.dn")
def apply_lut(spark: SparkSession, sf: str) -> DataFrame:
    return radiometry.apply_table(_sides(spark, sf, src.px_bands(spark, sf))[0], _lut(spark, sf), ("pair_id", "band"))


# --- alignment -----------------------------------------------------------------------------------
@query(f"WITH {SCENES} SELECT a.scene_id AS a, b.scene_id AS b, greatest(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1 FROM scenes a JOIN scenes b ON a.scene_id < b.scene_id AND least(a.x1, b.x1) >= greatest(a.x0, b.x0) AND least(a.y0, b.y0) >= greatest(a.y1, b.y1)")
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return align.overlaps(src.scene_supplier(spark, sf))


ORDER = "o AS (SELECT *, (x0 - ax) * (x0 - ax) + (y0 - ay) * (y0 - ay) AS d2 FROM scenes, (SELECT x0 AS ax, y0 AS ay FROM scenes ORDER BY name LIMIT 1)), q AS (SELECT *, row_number() OVER (ORDER BY d2, name) AS seq FROM o)"


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    scenes = src.scene_supplier(spark, sf)
    anchor = scenes.agg(F.min_by(F.struct("x0", "y0"), "name").alias("p")).select(F.col("p.x0").alias("ax"), F.col("p.y0").alias("ay"))
    return align.processing_order(scenes, anchor).withColumn("seq", F.col("seq").cast("long"))


@query(f"WITH {SCENES}, {ORDER} SELECT scene_id, name, x0, y0, d2, seq FROM q")
def processing_order(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, sf).select("scene_id", "name", "x0", "y0", "d2", "seq")


@query(f"WITH {SCENES}, {ORDER} SELECT s.scene_id, s.seq FROM q s JOIN q f ON f.seq = 1 AND s.seq > 1 AND least(s.x1, f.x1) >= greatest(s.x0, f.x0) AND least(s.y0, f.y0) >= greatest(s.y1, f.y1) ORDER BY s.seq LIMIT 1")
def overlap_repair(spark: SparkSession, sf: str) -> DataFrame:
    return align.second_scene(_ordered(spark, sf))


@query(f"WITH {SCENES} SELECT min(x0) AS x0, max(y0) AS y0, CAST(floor((max(y0) - 500.0::DOUBLE) / 6.0::DOUBLE) AS BIGINT) AS height, CAST(floor((1200.0::DOUBLE - min(x0)) / 6.0::DOUBLE) AS BIGINT) AS width FROM scenes")
def canvas_extent(spark: SparkSession, sf: str) -> DataFrame:
    return align.canvas(src.scene_supplier(spark, sf), 1200.0, 500.0, 6.0)


@query(f"WITH {PX}, {NEXT} SELECT pair_id, a.r, a.c, a.dn, b.dn AS dn_b FROM nx JOIN px a ON a.scene_id = pair_id JOIN px b ON b.scene_id = next_id AND a.r = b.r + 3 AND a.c = b.c - 5")
def pixel_alignment(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return align.aligned(a, b, 3, -5, PAIR_KEY)


PLACED = f"{NEXT}, p AS (SELECT pair_id, r, c, dn FROM nx JOIN px ON scene_id = pair_id UNION ALL SELECT pair_id, r + 10, c + 20, dn FROM nx JOIN px ON scene_id = next_id), pl AS (SELECT pair_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(sum(dn) AS BIGINT) AS dn FROM p WHERE r BETWEEN 0 AND 39 AND c BETWEEN 0 AND 47 GROUP BY 1, 2, 3)"


def _parts(spark: SparkSession, sf: str) -> list[tuple[DataFrame, int, int]]:
    a, b = _sides(spark, sf)
    return [(a, 0, 0), (b, 10, 20)]


@query(f"WITH {PX}, {PLACED} SELECT * FROM pl")
def place_and_add(spark: SparkSession, sf: str) -> DataFrame:
    return align.placed(_parts(spark, sf), 40, 48, PAIR_KEY)


@query(f"WITH {PX}, {PLACED} SELECT pair_id, r, c, CASE WHEN dn > 0 THEN 1 ELSE 0 END AS dn FROM pl")
def union_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return align.occupancy(_parts(spark, sf), 40, 48, PAIR_KEY)


@query(f"WITH {PX}, f AS (SELECT DISTINCT scene_id, r, c FROM px WHERE dn > 25), n AS (SELECT scene_id, r, c, unnest([1, -1, 0, 0]) AS dr, unnest([0, 0, 1, -1]) AS dc FROM f) SELECT DISTINCT n.scene_id, n.r, n.c FROM n LEFT JOIN f ON f.scene_id = n.scene_id AND f.r = n.r + dr AND f.c = n.c + dc WHERE f.r IS NULL")
def footprint_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return align.boundary(src.px_lineitem(spark, sf).where("dn > 25").select("scene_id", "r", "c").distinct(), ("scene_id",))


@query(f"WITH {PX}, {NEXT}, a AS (SELECT pair_id, r, c FROM nx JOIN px ON scene_id = pair_id WHERE dn > 200), b AS (SELECT pair_id, r, c FROM nx JOIN px ON scene_id = next_id WHERE dn > 200) SELECT 'union' AS op, pair_id, r, c FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'difference', pair_id, r, c FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersection', pair_id, r, c FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def footprint_sets(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (d.where("dn > 200").select("pair_id", "r", "c") for d in _sides(spark, sf))
    named = lambda op, d: d.select(F.lit(op).alias("op"), "pair_id", "r", "c")
    return named("union", align.union_cells(a, b, keys=PAIR_KEY)).union(named("difference", align.difference_cells(a, b, PAIR_KEY))).union(named("intersection", a.intersect(b)))


@query(f"WITH {PX} SELECT scene_id, count(*) AS cells, count(*) * 36.0::DOUBLE AS area FROM px WHERE dn > 25 GROUP BY 1")
def footprint_area(spark: SparkSession, sf: str) -> DataFrame:
    """Area of each scene's footprint, in square map units at 6 units a cell."""
    return align.area(src.px_lineitem(spark, sf).where("dn > 25").select("scene_id", "r", "c"), 6.0, ("scene_id",))


# --- focal ---------------------------------------------------------------------------------------
_SCENE = ["scene_id"]
ERODED = f"f AS (SELECT scene_id, r, c, CASE WHEN r IN (0, {N - 1}) OR c IN (0, {N - 1}) THEN 0 ELSE v END AS v FROM valid), k AS (SELECT a.scene_id, a.r, a.c, min(b.v) AS m, count(*) AS n FROM f a JOIN f b ON a.scene_id = b.scene_id AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2, 3)"


@query(f"WITH {PX}, {CELLS}, {VALID}, {ERODED} SELECT scene_id, r, c, CASE WHEN n < 9 THEN 0 ELSE m END AS v FROM k")
def erode(spark: SparkSession, sf: str) -> DataFrame:
    return focal.eroded(_valid(spark, sf), 3, N, N, _SCENE)


@query(f"WITH {PX}, {CELLS}, {VALID} SELECT a.scene_id, a.r, a.c, max(1 - b.v) AS v FROM valid a JOIN valid b ON a.scene_id = b.scene_id AND b.r BETWEEN a.r - 5 AND a.r + 4 AND b.c BETWEEN a.c - 5 AND a.c + 4 GROUP BY 1, 2, 3")
def dilate(spark: SparkSession, sf: str) -> DataFrame:
    return focal.dilated(_valid(spark, sf).withColumn("v", 1 - F.col("v")), 10, _SCENE)


@query(f"WITH {PX}, {CELLS}, {VALID} SELECT a.scene_id, a.r, a.c, max(CASE WHEN abs(a.r - b.r) + abs(a.c - b.c) <= 3 THEN 1 - b.v ELSE 0 END) AS v FROM valid a JOIN valid b ON a.scene_id = b.scene_id AND b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 GROUP BY 1, 2, 3")
def dilate_cross(spark: SparkSession, sf: str) -> DataFrame:
    return focal.dilated_cross(_valid(spark, sf).withColumn("v", 1 - F.col("v")), 3, _SCENE)


_TAPS = focal.gaussian_taps(57)
_REFLECT = lambda v: f"abs({N - 1} - abs({N - 1} - abs({v})))"
_TAP_ROWS = ", ".join(f"({i - 28}, {t})" for i, t in enumerate(_TAPS))


@query(f"WITH {PX}, {CELLS}, {VALID}, tap(o, t) AS (VALUES {_TAP_ROWS}), m AS (SELECT scene_id, r, c, v * 58 AS v FROM valid), h AS (SELECT a.scene_id, a.r, a.c, sum(b.v * t) AS v FROM m a CROSS JOIN tap JOIN m b ON b.scene_id = a.scene_id AND b.r = a.r AND b.c = {_REFLECT('a.c + o')} GROUP BY 1, 2, 3), g AS (SELECT a.scene_id, a.r, a.c, sum(b.v * t) AS v FROM h a CROSS JOIN tap JOIN h b ON b.scene_id = a.scene_id AND b.c = a.c AND b.r = {_REFLECT('a.r + o')} GROUP BY 1, 2, 3) SELECT scene_id, r, c, CAST(floor((v + 2147483648) / 4294967296.0::DOUBLE) AS INT) AS k FROM g")
def feather_int(spark: SparkSession, sf: str) -> DataFrame:
    return focal.feathered(_valid(spark, sf), N, N, keys=_SCENE)


@query(f"WITH {PX}, o AS (SELECT CAST(i // 20 AS INT) AS i, CAST(i % 20 AS INT) AS j FROM range(400) t(i)) SELECT scene_id, i AS r, j AS c, dn FROM o JOIN px ON r = floor(i * 32 / 20.0::DOUBLE) AND c = floor(j * 32 / 20.0::DOUBLE)")
def resize_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return focal.nearest(src.px_lineitem(spark, sf), (N, N), (20, 20), _SCENE)


@query(f"WITH {PX}, o AS (SELECT CAST(i // 7 AS INT) AS i, CAST(i % 7 AS INT) AS j FROM range(49) t(i)), d AS (SELECT i, j, a, b, (i * 31) // 6 + a AS r, (j * 31) // 6 + b AS c, CASE WHEN a = 1 THEN (i * 31) % 6 ELSE 6 - (i * 31) % 6 END * CASE WHEN b = 1 THEN (j * 31) % 6 ELSE 6 - (j * 31) % 6 END AS w FROM o, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b)) SELECT scene_id, i AS r, j AS c, CAST(floor(sum(w * dn) / 36.0::DOUBLE) AS BIGINT) AS dn FROM d JOIN px ON px.r = d.r AND px.c = d.c WHERE w > 0 GROUP BY 1, 2, 3")
def downsample_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    return focal.bilinear(src.px_lineitem(spark, sf), (N, N), (7, 7), _SCENE).select("scene_id", "r", "c", F.col("dn").cast("long").alias("dn"))


# --- scoring -------------------------------------------------------------------------------------
# Patches are the vectors whose number is divisible by 20; all others of the label are candidates.
ASKED = 20


_C1, _C2 = (0.01 * 255.0) ** 2, (0.03 * 255.0) ** 2
_K = 49.0 / 48.0
_MA, _MB = "(sa / 49.0::DOUBLE)", "(sb / 49.0::DOUBLE)"
_V = lambda s, x, y: f"({_K!r}::DOUBLE * ({s} / 49.0::DOUBLE - {x} * {y}))"
_SSIM = f"((2.0::DOUBLE * {_MA} * {_MB} + {_C1!r}::DOUBLE) * (2.0::DOUBLE * {_V('sab', _MA, _MB)} + {_C2!r}::DOUBLE)) / (({_MA} * {_MA} + {_MB} * {_MB} + {_C1!r}::DOUBLE) * ({_V('saa', _MA, _MA)} + {_V('sbb', _MB, _MB)} + {_C2!r}::DOUBLE))"
SSIM = f"{EMB}, near AS (SELECT p.vec_id AS patch, q.vec_id AS scene_id FROM embeddings p JOIN embeddings q ON p.label = q.label AND p.vec_id % {ASKED} = 0 AND q.vec_id <> p.vec_id), pr AS (SELECT patch, scene_id, a.r, a.c, a.dn AS a, b.dn AS b FROM near JOIN emb a ON a.vec_id = patch JOIN emb b ON b.vec_id = scene_id AND a.r = b.r AND a.c = b.c), w AS (SELECT patch, scene_id, i, j, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, sum(a * a)::DOUBLE AS saa, sum(b * b)::DOUBLE AS sbb, sum(a * b)::DOUBLE AS sab FROM pr, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j) WHERE r BETWEEN i AND i + 6 AND c BETWEEN j AND j + 6 GROUP BY 1, 2, 3, 4), s AS (SELECT patch, scene_id, CAST(sum(CAST(floor({_SSIM} * 1e9::DOUBLE) AS BIGINT)) AS BIGINT) AS score9, count(*) AS windows FROM w GROUP BY 1, 2)"


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.pool_scores(src.patch_embedding(spark, sf), 8, 8, asked=F.col("vec_id") % ASKED == 0)


@query(f"WITH {SSIM} SELECT patch, scene_id, score9, windows FROM s")
def ssim_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).select("patch", "scene_id", "score9", "windows")


# what the pixels say: least and greatest, clear cells (below 160), whether the brightest lies on the frame
_FRAME_CELL = "(r IN (0, 7) OR c IN (0, 7))"
RULED = f"{SSIM}, st AS (SELECT vec_id, max(dn) AS most, min(dn) AS least, count(*) FILTER (dn < 160) AS clear, count(*) AS cells, max(dn) FILTER ({_FRAME_CELL}) > max(dn) FILTER (NOT {_FRAME_CELL}) AS edge FROM emb GROUP BY 1), u AS (SELECT patch, scene_id, score9 / (windows * 1e9::DOUBLE) AS ssim, scene_id % 11 = 0 AS excluded, q.most = 0 AS empty, p.edge AS on_border, q.least, q.clear, q.cells FROM s JOIN st p ON p.vec_id = patch JOIN st q ON q.vec_id = scene_id), t AS (SELECT *, CASE WHEN excluded THEN 'excluded' WHEN empty THEN 'empty' ELSE 'scored' END AS reason, CASE WHEN excluded THEN -2.0::DOUBLE WHEN empty THEN -3.0::DOUBLE WHEN patch <> 0 THEN ssim - 0.05::DOUBLE ELSE ssim END AS score FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY score DESC, scene_id DESC) AS rank FROM t)"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    cells = src.patch_embedding(spark, sf)
    frame = lambda inside: F.array_max(F.filter("cells", lambda x, i: (((i % 8).isin(0, 7)) | (F.floor(i / 8).isin(0, 7))) != F.lit(inside)))
    seen = cells.select("vec_id", F.array_max("cells").alias("most"), F.array_min("cells").alias("least"), F.size(F.filter("cells", lambda x: x < 160)).alias("clear"), F.size("cells").alias("cells"), (frame(False) > frame(True)).alias("edge"))
    s = _pool(spark, sf).join(seen.select(F.col("vec_id").alias("patch"), F.col("edge").alias("on_border")), "patch").join(seen.drop("edge").withColumnRenamed("vec_id", "scene_id"), "scene_id")
    s = s.withColumns({"excluded": F.col("scene_id") % 11 == 0, "empty": F.col("most") == 0, "disjoint": F.lit(False), "partial": F.lit(False), "at_origin": F.col("patch") == 0})
    return scoring.ranked(scoring.ruled(s), ["patch"]).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {RULED} SELECT patch, scene_id, reason, score, rank FROM k")
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("patch", "scene_id", "reason", "score", "rank")


@query(f"WITH {RULED}, a AS (SELECT * FROM k WHERE score >= 0.05::DOUBLE AND NOT on_border AND least > 0 AND clear > (1.0::DOUBLE - 0.25::DOUBLE) * cells) SELECT patch, min(rank) AS rank, arg_min(scene_id, rank) AS scene_id FROM a GROUP BY 1")
def accept_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.first_accepted(scoring.acceptable(_ranked(spark, sf), threshold=0.05), ["patch"])


@query(f"WITH {RULED} SELECT reason, count(*) AS n FROM k GROUP BY 1")
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.counters(_ranked(spark, sf))


# --- blending ------------------------------------------------------------------------------------
W_CELLS = f"w AS (SELECT r, c, {WEIGHT} AS k FROM cells)"
COVER = f"{NEXT}, cov AS (SELECT pair_id, scene_id, CASE k WHEN 0 THEN 0 ELSE 1 END AS region, count(p.dn) AS covered, count(*) AS cells FROM (SELECT pair_id, pair_id AS scene_id FROM nx UNION ALL SELECT pair_id, next_id FROM nx) s CROSS JOIN w LEFT JOIN px p USING (scene_id, r, c) WHERE k IN (0, 58) GROUP BY 1, 2, 3)"


def _cover(spark: SparkSession, sf: str) -> DataFrame:
    keys, px = F.broadcast(_next(spark, sf)), src.px_lineitem(spark, sf)  # a row for each scene
    parts = px.join(keys, (px["scene_id"] == keys["pair_id"]) | (px["scene_id"] == keys["next_id"])).select("pair_id", "scene_id", "r", "c", "dn")
    return blending.coverage(parts, _weight(spark), PAIR_KEY)


@query(f"WITH {PX}, {CELLS}, {W_CELLS}, {COVER} SELECT * FROM cov")
def coverage_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _cover(spark, sf)


@query(f"WITH {PX}, {CELLS}, {W_CELLS}, {COVER} SELECT pair_id, scene_id, covered, cells FROM cov WHERE region = 1 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY floor(covered * 1e9::DOUBLE / cells) DESC, scene_id) = 1")
def mask_side(spark: SparkSession, sf: str) -> DataFrame:
    return blending.weighted_scene(_cover(spark, sf), PAIR_KEY)


_AB = f"{NEXT}, a AS (SELECT pair_id, r, c, dn FROM nx JOIN px ON scene_id = pair_id), b AS (SELECT pair_id, r, c, dn FROM nx JOIN px ON scene_id = next_id)"
_BLEND = "CAST(floor((coalesce(a.dn, 0) * (58 - coalesce(k, 0)) + coalesce(b.dn, 0) * coalesce(k, 0)) / 58.0::DOUBLE) AS BIGINT)"


@query(f"WITH {PX}, {CELLS}, {W_CELLS}, {_AB} SELECT pair_id, r, c, {_BLEND} AS dn FROM a FULL JOIN b USING (pair_id, r, c) LEFT JOIN w USING (r, c)")
def feather_blend(spark: SparkSession, sf: str) -> DataFrame:
    return blending.feather_blend(*_sides(spark, sf), _weight(spark), PAIR_KEY)


@query(f"WITH {PX}, {CELLS}, {W_CELLS}, {_AB}, p AS (SELECT pair_id, r, c, r // 4 AS wr, c // 4 AS wc, a.dn AS x, b.dn AS y FROM a FULL JOIN b USING (pair_id, r, c)) SELECT pair_id, p.r, p.c, CAST(floor((coalesce(x, 0) * (58 - coalesce(k, 0)) + coalesce(y, 0) * coalesce(k, 0)) / 58.0::DOUBLE) AS BIGINT) AS dn FROM p LEFT JOIN w ON w.r = wr AND w.c = wc")
def pan_blend(spark: SparkSession, sf: str) -> DataFrame:
    return blending.pan_blend(*_sides(spark, sf), _weight(spark), 4, PAIR_KEY)


_MASK_AB = f"{NEXT}, a AS (SELECT pair_id, r, c, CASE WHEN cell > 2 THEN 1 ELSE 0 END AS v FROM nx JOIN mk ON scene_id = pair_id), b AS (SELECT pair_id, r, c, CASE WHEN cell > 2 THEN 1 ELSE 0 END AS v FROM nx JOIN mk ON scene_id = next_id)"


@query(f"WITH {CELLS}, {W_CELLS}, {MASKS}, {_MASK_AB} SELECT pair_id, r, c, CASE WHEN a.v * (58 - k) + b.v * k > 0 THEN 1 ELSE 0 END AS v FROM a JOIN b USING (pair_id, r, c) JOIN w USING (r, c)")
def cloudmask_blend(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf, src.masks(spark, sf).select("scene_id", "r", "c", pixel.clouded(F.col("cell")).alias("v")))
    return blending.mask_blend(a, b, _weight(spark), PAIR_KEY)


@query(f"WITH {PX}, {_AB}, n AS (SELECT * FROM b WHERE r BETWEEN 4 AND 11) SELECT pair_id, r, c, coalesce(n.dn, a.dn) AS dn FROM a FULL JOIN n USING (pair_id, r, c)")
def mosaic_update(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return blending.rewritten(a, b.where("r BETWEEN 4 AND 11"), PAIR_KEY)


# a fold over all scenes with given weights: each scene's cells against the result so far
def _folded() -> str:
    return (
        f"WITH RECURSIVE {PX}, {CELLS}, o AS (SELECT scene_id, row_number() OVER (ORDER BY scene_id) AS n FROM sc), "
        "step(n, r, c, dn) AS (SELECT CAST(0 AS BIGINT), r, c, CAST(0 AS BIGINT) FROM cells UNION ALL SELECT s.n + 1, s.r, s.c, "
        "CASE WHEN p.dn IS NULL THEN s.dn WHEN s.dn = 0 THEN p.dn ELSE CAST(floor((s.dn * (58 - k) + p.dn * k) / 58.0::DOUBLE) AS BIGINT) END "
        "FROM (SELECT *, CAST(least(58, greatest(0, (c - 8) * 4 + (n + 1) * 3 - 12)) AS INT) AS k FROM step) s JOIN o ON o.n = s.n + 1 LEFT JOIN px p ON p.scene_id = o.scene_id AND p.r = s.r AND p.c = s.c) "
        "SELECT r, c, dn FROM step WHERE n = (SELECT max(n) FROM o) AND dn > 0"
    )


@query(_folded())
def running_blend(spark: SparkSession, sf: str) -> DataFrame:
    """All scenes one after the other, each blended into the mosaic so far."""
    px = src.px_lineitem(spark, sf)
    layers = []
    for n, scene in enumerate(src.scene_ids(spark, sf), 1):
        k = F.least(F.lit(58), F.greatest(F.lit(0), (F.col("c") - 8) * 4 + n * 3 - 12)).cast("int")
        weight = grid.dense(spark, None, N, N).withColumn("k", k)
        layers.append((px.where(F.col("scene_id") == scene).select("r", "c", "dn"), weight))
    return blending.folded(layers).where("dn > 0")


# --- clouds --------------------------------------------------------------------------------------
BLOCKS = f"{MASKS}, st AS (SELECT scene_id, r, c FROM mk WHERE block = 10)"
LABELS = "lab AS (WITH RECURSIVE reach(scene_id, r, c, l) USING KEY (scene_id, r, c) AS (SELECT scene_id, r, c, CAST(r AS BIGINT) * 2147483648 + c FROM st UNION SELECT s.scene_id, s.r, s.c, min(n.l) FROM reach n JOIN recurring.reach s ON s.scene_id = n.scene_id AND abs(s.r - n.r) <= 1 AND abs(s.c - n.c) <= 1 AND n.l < s.l GROUP BY s.scene_id, s.r, s.c) SELECT scene_id, r, c, l AS label FROM reach)"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return src.masks(spark, sf).where("block = 10").select("scene_id", "r", "c")


@query(f"WITH {CELLS}, {BLOCKS}, {LABELS} SELECT scene_id, r, c, label FROM lab")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(_blocks(spark, sf), _SCENE).select("scene_id", "r", "c", "label")


@query(f"WITH {CELLS}, {BLOCKS}, {LABELS} SELECT scene_id, label, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lab GROUP BY 1, 2")
def patch_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.component_sizes(graph.components(_blocks(spark, sf), _SCENE), _SCENE)


# the outside of a scene's blocks, 4-connected from beyond the frame; what it does not reach is filled
_FILLED = f"ot AS (WITH RECURSIVE o AS (SELECT scene_id, r, c FROM mk WHERE block = 0 AND (r IN (0, {N - 1}) OR c IN (0, {N - 1})) UNION SELECT m.scene_id, m.r, m.c FROM o JOIN mk m ON m.scene_id = o.scene_id AND m.block = 0 AND abs(m.r - o.r) + abs(m.c - o.c) = 1) SELECT * FROM o)"


@query(f"WITH {CELLS}, {MASKS}, {_FILLED}, st AS (SELECT scene_id, r, c FROM mk EXCEPT SELECT * FROM ot), {LABELS} SELECT scene_id, label, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lab GROUP BY 1, 2")
def outer_contours(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the blocks' outer contours; what lies in a hole has none of its own."""
    return graph.outer_boxes(_blocks(spark, sf), _SCENE, N, N)


@query(f"WITH {PX}, st AS (SELECT scene_id, r, c FROM px WHERE dn > 215), {LABELS} SELECT scene_id, r, c, label FROM lab WHERE (scene_id, label) IN (SELECT (scene_id, label) FROM lab GROUP BY scene_id, label HAVING count(*) >= 4)")
def scrap_removal(spark: SparkSession, sf: str) -> DataFrame:
    cells = src.px_lineitem(spark, sf).where("dn > 215").select("scene_id", "r", "c")
    return graph.without_scraps(graph.components(cells, _SCENE), _SCENE, 4).select("scene_id", "r", "c", "label")


@query(f"WITH {CELLS}, {BLOCKS}, {LABELS}, {NEXT} SELECT pair_id, label AS patch_id, next_id AS scene_id, CAST(sum(CASE WHEN cell < 10 THEN 1 ELSE 0 END) AS BIGINT) AS clear, count(*) AS cells, sum(CASE WHEN cell < 10 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS fraction FROM nx JOIN lab ON lab.scene_id = pair_id JOIN mk ON mk.scene_id = next_id AND mk.r = lab.r AND mk.c = lab.c GROUP BY 1, 2, 3")
def clear_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Every scene's patches against the next scene's mask."""
    keys, masks = F.broadcast(_next(spark, sf)), src.masks(spark, sf)  # a row for each scene
    patch = clouds.patches(_blocks(spark, sf), _SCENE, 1).withColumnRenamed("scene_id", "pair_id")
    other = masks.join(keys, masks["scene_id"] == keys["next_id"]).select("pair_id", "scene_id", "r", "c", F.col("cell").alias("code"))
    return clouds.clear_fraction(patch, other, ["pair_id", "patch_id"], shared=PAIR_KEY)


@query(f"WITH {CELLS}, {BLOCKS}, {LABELS} SELECT scene_id, label AS patch_id, bool_or(r IN (0, {N - 1}) OR c IN (0, {N - 1})) AS on_border, count(*) AS cells FROM lab GROUP BY 1, 2")
def border_touch(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.on_border(clouds.patches(_blocks(spark, sf), _SCENE, 1), ["scene_id", "patch_id"], N, N)


@query(f"WITH {CELLS}, {MASKS}, {NEXT}, land AS (SELECT r, c FROM cells WHERE (r + 2 * c) % 9 <> 0) SELECT pair_id, m.r, m.c, CASE WHEN m.block = 10 AND f.cell <> 10 AND land.r IS NOT NULL THEN 0 WHEN m.block = 10 AND f.cell = 10 AND land.r IS NOT NULL THEN 20 ELSE m.block END AS code FROM nx JOIN mk m ON m.scene_id = pair_id JOIN mk f ON f.scene_id = next_id AND f.r = m.r AND f.c = m.c LEFT JOIN land ON land.r = m.r AND land.c = m.c")
def mask_update(spark: SparkSession, sf: str) -> DataFrame:
    own, other = _sides(spark, sf, src.masks(spark, sf))
    mask = own.select("pair_id", "r", "c", F.col("block").alias("code"))
    patch = mask.where("code = 10").select("pair_id", "r", "c")
    flagged = other.where("cell = 10").select("pair_id", "r", "c")
    land = grid.dense(spark, None, N, N).where((F.col("r") + 2 * F.col("c")) % 9 != 0).withColumn("land", F.lit(1))
    return clouds.updated(mask, patch, flagged, land, 1, PAIR_KEY)


# --- names ---------------------------------------------------------------------------------------
@query(f"WITH {SCENES}, k AS (SELECT scene_id, name, substr(name, instr(name, 'a'), 8) AS key FROM scenes) SELECT scene_id, key, upper(substr(key, 1, 1)) || lpad(CAST(CAST(regexp_extract(key, '0\\d*', 0) AS BIGINT) + 1 AS VARCHAR), 7, '0') AS pan FROM k")
def scene_name_pan_key(spark: SparkSession, sf: str) -> DataFrame:
    key = names.scene_key(F.col("name"))
    return src.scene_supplier(spark, sf).select("scene_id", key.alias("key"), names.pan_key(key).alias("pan"))


# --- seams ---------------------------------------------------------------------------------------
@query(f"WITH {PX}, {CELLS}, {PAIR}, {EDGES}, g AS (SELECT (pair_id * {N} + r) * {N} + c AS a, CASE dir WHEN 'r' THEN (pair_id * {N} + r) * {N} + c + 1 ELSE (pair_id * {N} + r + 1) * {N} + c END AS b, {COST_SQL['a6c_int']} AS w FROM edges WHERE dn <> 0 AND dn_b <> 0 AND dn_next IS NOT NULL), e AS (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g), s AS (SELECT DISTINCT pair_id FROM edges WHERE dn <> 0 AND dn_b <> 0 AND dn_next IS NOT NULL), d AS (WITH RECURSIVE dist(v, x) USING KEY (v) AS (SELECT pair_id * {N * N}, 0.0::DOUBLE FROM s UNION SELECT e.b, min(n.x + e.w) FROM dist n JOIN e ON e.a = n.v LEFT JOIN recurring.dist o ON o.v = e.b WHERE o.x IS NULL OR n.x + e.w < o.x GROUP BY e.b) SELECT * FROM dist) SELECT CAST(v // {N * N} AS INT) AS pair_id, CAST(v // {N} % {N} AS INT) AS r, CAST(v % {N} AS INT) AS c, x AS dist FROM d")
def seam_distance(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.seam_edges(_pairs(spark, sf), "a6c_int", ["pair_id"])
    return graph.seam_distances(edges, "pair_id", (0, 0), N, N).withColumn("pair_id", F.col("pair_id").cast("int"))


@query()
def seam_path(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.seam_edges(_pairs(spark, sf), "a6c_int", ["pair_id"])
    return graph.seam_paths(edges, "pair_id", (0, 0), (N - 1, N - 1), N, N)

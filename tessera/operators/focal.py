"""Neighbourhood operators on dense grids, as separable windows and bounded offset joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.grid import dense


def _two_passes(px: DataFrame, keys: list[str], fold, before: int, after: int, value: str) -> DataFrame:
    along = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-before, after)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-before, after)
    return px.withColumn(value, fold(value).over(along)).withColumn(value, fold(value).over(down))


def eroded(px: DataFrame, size: int, height: int, width: int, keys: list[str] = [], value: str = "v") -> DataFrame:  # noqa: B006
    """Minimum over size by size; what lies outside the grid, and its one-cell frame, is 0."""
    frame = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == height - 1) | (F.col("c") == width - 1)
    inner = px.withColumn(value, F.when(frame, 0).otherwise(F.col(value)))
    half = size // 2
    out = _two_passes(inner, keys, F.min, half, size - 1 - half, value)
    edge = (F.col("r") < half) | (F.col("c") < half) | (F.col("r") > height - size + half) | (F.col("c") > width - size + half)
    return out.withColumn(value, F.when(edge, 0).otherwise(F.col(value)))


def dilated(px: DataFrame, size: int, keys: list[str] = [], value: str = "v") -> DataFrame:  # noqa: B006
    """Maximum over size by size, anchored at size // 2."""
    return _two_passes(px, keys, F.max, size // 2, size - 1 - size // 2, value)


def dilated_cross(px: DataFrame, steps: int, keys: list[str] = [], value: str = "v") -> DataFrame:  # noqa: B006
    """``steps`` dilations by a cross: every set cell reaches the cells within that many steps.

    In the coordinates r + c and r - c that is a square, so one direction spreads each set cell over
    ``2 steps + 1`` places and the other is a window."""
    u, w = (F.col("r") + F.col("c")).alias("__u"), (F.col("r") - F.col("c")).alias("__w")
    spread = px.where(F.col(value) > 0).select(*keys, u, w, F.explode(F.sequence(F.lit(-steps), F.lit(steps))).alias("__d")).select(*keys, (F.col("__u") + F.col("__d")).alias("__u"), "__w").distinct()
    both = px.select(*px.columns, u, w, F.lit(0).alias("__hit")).unionByName(spread.withColumn("__hit", F.lit(1)), allowMissingColumns=True)
    across = Window.partitionBy(*keys, "__u").orderBy("__w").rangeBetween(-steps, steps)
    return both.withColumn("__near", F.max("__hit").over(across)).where("__hit = 0").withColumn(value, F.col("__near")).select(*px.columns)


def reopened(eroded_: DataFrame, original: DataFrame, points: list[tuple[int, int]], size: int, margin: int = 30, value: str = "v", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Squares around the seam's end points get their original values back (upper sides excluded)."""
    h = size // 2 + margin
    inside = F.lit(False)
    for r, c in points:
        inside = inside | ((F.col("r") >= r - h) & (F.col("r") < r + h) & (F.col("c") >= c - h) & (F.col("c") < c + h))
    back = original.select(*keys, "r", "c", F.col(value).alias("__was"))
    return eroded_.join(back, [*keys, "r", "c"]).withColumn(value, F.when(inside, F.col("__was")).otherwise(F.col(value))).drop("__was")


def gaussian_taps(size: int = 57, scale: int = 1 << 16) -> list[int]:
    """Integer taps of a Gaussian whose width follows its size; they sum to about ``scale``."""
    import math

    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [math.floor(x / sum(raw) * scale + 0.5) for x in raw]


def _mirrored(v: Column, n: int, half: int) -> Column:
    """The places within ``half`` of a line of n that show place v when its ends mirror (not repeated)."""
    if n == 1:
        return F.sequence(F.lit(-half), F.lit(half))
    turn = 2 * (n - 1)
    every = F.flatten(F.array(*[F.array(v + k * turn, -v + k * turn) for k in range(-(half // turn) - 1, half // turn + 2)]))
    return F.array_distinct(F.filter(every, lambda x: (x >= -half) & (x < n + half)))


def feathered(mask: DataFrame, height: int, width: int, size: int = 57, keys: list[str] = [], value: str = "v", tile: int = 512) -> DataFrame:  # noqa: B006
    """Weights of a binary mask as ``k`` of ``size + 1``: blurred both ways and rounded to integers. The
    border is mirrored. Set cells are dealt to square tiles with a halo; a tile is one group."""
    taps, half = gaussian_taps(size), size // 2
    at = mask.where(F.col(value) > 0).select(*keys, F.explode(_mirrored(F.col("r"), height, half)).alias("r"), "c").select(*keys, "r", F.explode(_mirrored(F.col("c"), width, half)).alias("c"))
    places = lambda v, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((v - half) / tile).cast("int")), F.least(F.lit((n - 1) // tile), F.floor((v + half) / tile).cast("int"))))
    dealt = at.select(*keys, "r", "c", places(F.col("r"), height).alias("ty")).select(*keys, "r", "c", "ty", places(F.col("c"), width).alias("tx"))
    types = dict(dealt.dtypes)

    def run(t: pa.Table) -> pa.Table:
        ty, tx = t.column("ty")[0].as_py(), t.column("tx")[0].as_py()
        h, w = min(tile, height - ty * tile), min(tile, width - tx * tile)
        grid = np.zeros((h + 2 * half, w + 2 * half), np.int64)
        r, c = t.column("r").to_numpy() - ty * tile + half, t.column("c").to_numpy() - tx * tile + half
        inside = (r < grid.shape[0]) & (c < grid.shape[1])
        grid[r[inside], c[inside]] = size + 1
        down = sum(x * grid[k : k + h] for k, x in enumerate(taps))
        total = sum(x * down[:, k : k + w] for k, x in enumerate(taps))
        k = (total + (1 << 31)) >> 32
        y, x = np.nonzero(k)
        head = {name: pa.array([t.column(name)[0].as_py()] * len(y), t.schema.field(name).type) for name in keys}
        return pa.table(head | {"r": pa.array((y + ty * tile).astype(np.int32)), "c": pa.array((x + tx * tile).astype(np.int32)), "k": pa.array(k[y, x].astype(np.int32))})

    found = dealt.groupBy(*keys, "ty", "tx").applyInArrow(run, ", ".join([f"{k} {types[k]}" for k in keys] + ["r int", "c int", "k int"]))
    return mask.join(found, [*keys, "r", "c"], "left").withColumn("k", F.coalesce("k", F.lit(0))).drop(value)


def nearest(px: DataFrame, n: tuple[int, int], m: tuple[int, int], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """From n rows and columns to m: cell i takes ``floor(i n / m)``."""
    cells = dense(px.sparkSession, None, *m).withColumnsRenamed({"r": "i", "c": "j"})
    pick = cells.withColumn("r", F.floor(F.col("i") * n[0] / F.lit(float(m[0]))).cast("int")).withColumn("c", F.floor(F.col("j") * n[1] / F.lit(float(m[1]))).cast("int"))
    return pick.join(px, ["r", "c"]).drop("r", "c").withColumnsRenamed({"i": "r", "j": "c"}).select(*keys, "r", "c", "dn")


def bilinear(px: DataFrame, n: tuple[int, int], m: tuple[int, int], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """From n to m with end points aligned; weights are exact fractions, the result is truncated."""
    (nr, nc), (mr, mc) = n, m
    cells = dense(px.sparkSession, None, mr, mc).withColumnsRenamed({"r": "i", "c": "j"})

    def split(v: Column, a: int, b: int) -> tuple[Column, Column]:
        whole = F.floor(v * (a - 1) / F.lit(float(max(b - 1, 1))))
        return whole.cast("int"), (v * (a - 1) - whole * max(b - 1, 1)).cast("long")

    r0, fr = split(F.col("i"), nr, mr)
    c0, fc = split(F.col("j"), nc, mc)
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    spread = cells.withColumn("r0", r0).withColumn("fr", fr).withColumn("c0", c0).withColumn("fc", fc).withColumn("d", F.explode(corners))
    dr, dc = max(mr - 1, 1), max(mc - 1, 1)
    weight = F.when(F.col("d.a") == 1, F.col("fr")).otherwise(dr - F.col("fr")) * F.when(F.col("d.b") == 1, F.col("fc")).otherwise(dc - F.col("fc"))
    near = spread.select("i", "j", (F.col("r0") + F.col("d.a")).alias("r"), (F.col("c0") + F.col("d.b")).alias("c"), weight.alias("w")).where("w > 0")
    return near.join(px, ["r", "c"]).groupBy(*keys, "i", "j").agg(F.floor(F.sum(F.col("w") * F.col("dn")) / F.lit(float(dr * dc))).alias("dn")).withColumnsRenamed({"i": "r", "j": "c"})


def neighbour_pairs(px: DataFrame, keys: list[str] = [], values: tuple[str, ...] = ("dn",)) -> DataFrame:  # noqa: B006
    """Each cell of a dense grid with its right and its lower neighbour: ``dir`` and ``<value>_next``."""
    right = Window.partitionBy(*keys, "r").orderBy("c")
    down = Window.partitionBy(*keys, "c").orderBy("r")
    wide = px.select("*", *[F.lead(v).over(right).alias(f"{v}_r") for v in values], *[F.lead(v).over(down).alias(f"{v}_d") for v in values])
    sides = [F.struct(F.lit(side).alias("dir"), *[F.col(f"{v}_{side}").alias(f"{v}_next") for v in values]) for side in ("r", "d")]
    return wide.withColumn("x", F.explode(F.array(*sides))).select(*px.columns, "x.*").where(F.col(f"{values[0]}_next").isNotNull())


def nearest_valid(points: DataFrame, valid: DataFrame, nx: int = 35, ny: int = 35, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """For each point (``p``, ``r``, ``c``) the first valid cell in spiral order."""
    from tessera.functions.grid import spiral

    order = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in spiral(nx, ny)])
    around = points.withColumn("s", F.explode(order)).select(*keys, "p", (F.col("r") + F.col("s.dy")).alias("r"), (F.col("c") + F.col("s.dx")).alias("c"), F.col("s.n").alias("n"))
    return around.join(valid.select(*keys, "r", "c"), [*keys, "r", "c"]).groupBy(*keys, "p").agg(F.min_by(F.struct("r", "c"), "n").alias("x")).select(*keys, "p", "x.r", "x.c")


def window_sums(px: DataFrame, keys: list[str], values: dict[str, Column], size: int, height: int, width: int) -> DataFrame:
    """Sums of columns over every size by size window inside the grid, by its upper left cell."""
    out = px.select(*keys, "r", "c", *[v.alias(k) for k, v in values.items()])
    along = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(0, size - 1)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(0, size - 1)
    for w in (along, down):
        out = out.select(*keys, "r", "c", *[F.sum(k).over(w).alias(k) for k in values])
    return out.where((F.col("r") <= height - size) & (F.col("c") <= width - size))

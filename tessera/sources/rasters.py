"""Rasters as tables: scene directories, band-sequential raw files, tiles and pixels.

A raw raster is a file of unsigned samples, band by band, row by row, with a JSON file of its
geotransform beside it. Files are read by Spark's own binary reader, so any store Spark reads works.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE = "name string, res double, x0 double, y0 double, height int, width int, bands int, true_bits int, crs string, role string"


def scene_directory(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """One row for each scene description in a directory, with :data:`SCENE`'s columns."""
    return spark.read.schema(SCENE).option("multiLine", True).option("pathGlobFilter", f"*{suffix}").json(path)


def describe(name: str, array: np.ndarray, res: float, x0: float, y0: float, true_bits: int, crs: str, role: str) -> str:
    bands, height, width = array.shape
    return json.dumps({"name": name, "res": res, "x0": x0, "y0": y0, "height": height, "width": width, "bands": bands, "true_bits": true_bits, "crs": crs, "role": role})


def read_pixels(spark: SparkSession, path: str, suffix: str = ".raw", window: tuple[int, int, int, int] | None = None, bands: tuple[int, ...] = ()) -> DataFrame:
    """``name``, ``band``, ``r``, ``c``, ``dn`` of every raw file whose description lies beside it.

    ``window``: row offset, column offset, height, width; only its pixels leave the reader.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    named = files.select(F.regexp_extract("path", rf"([^/]+){suffix.replace('.', '[.]')}$", 1).alias("name"), "content")
    rows = named.join(scene_directory(spark, path).select("name", "height", "width", "bands", "true_bits"), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, height, width, count, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = next(k for n, k in ((8, "<u1"), (16, "<u2"), (32, "<u4"), (64, "<u8")) if bits <= n)
                cube = np.frombuffer(content, kind).reshape(count, height, width)
                r0, c0, h, w = window or (0, 0, height, width)
                for b in bands or range(1, count + 1):
                    part = cube[b - 1, r0 : r0 + h, c0 : c0 + w]
                    r, c = np.indices(part.shape, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array(np.full(part.size, b, np.int32)), pa.array((r + r0).reshape(-1)), pa.array((c + c0).reshape(-1)), pa.array(part.reshape(-1).astype(np.int64))], names=["name", "band", "r", "c", "dn"])

    return rows.mapInArrow(run, "name string, band int, r int, c int, dn long")


def to_tiles(px: DataFrame, keys: list[str], side: int = 256) -> DataFrame:
    """Pixels as dense tiles: ``keys``, ``ty``, ``tx``, ``h``, ``w``, ``data`` (little-endian int64)."""
    names = [*keys, "ty", "tx"]
    kept = px.select(*keys, F.floor(F.col("r") / side).cast("int").alias("ty"), F.floor(F.col("c") / side).cast("int").alias("tx"), F.pmod("r", F.lit(side)).alias("r"), F.pmod("c", F.lit(side)).alias("c"), "dn")

    def build(t: pa.Table) -> pa.Table:
        r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
        tile = np.zeros((int(r.max()) + 1, int(c.max()) + 1), np.int64)
        tile[r, c] = t.column("dn").to_numpy()
        return pa.table({k: t.column(k).slice(0, 1) for k in names} | {"h": pa.array([tile.shape[0]], pa.int32()), "w": pa.array([tile.shape[1]], pa.int32()), "data": pa.array([tile.tobytes()], pa.binary())})

    types = dict(kept.dtypes)
    return kept.groupBy(*names).applyInArrow(build, ", ".join(f"{k} {types[k]}" for k in names) + ", h int, w int, data binary")


def from_tiles(tiles: DataFrame, keys: list[str], side: int = 256) -> DataFrame:
    """The inverse of :func:`to_tiles`; no-data cells come back as 0."""
    types = dict(tiles.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            for i, data in enumerate(rows["data"]):
                tile = np.frombuffer(data, np.int64).reshape(rows["h"][i], rows["w"][i])
                r, c = np.indices(tile.shape, dtype=np.int32)
                head = [batch.column(k).take(pa.array(np.full(tile.size, i))) for k in keys]
                yield pa.RecordBatch.from_arrays([*head, pa.array((r + rows["ty"][i] * side).reshape(-1)), pa.array((c + rows["tx"][i] * side).reshape(-1)), pa.array(tile.reshape(-1))], names=[*keys, "r", "c", "dn"])

    return tiles.select(*keys, "ty", "tx", "h", "w", "data").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", r int, c int, dn long")

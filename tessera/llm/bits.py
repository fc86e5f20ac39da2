"""Fixed-size tables of counters or bits over all rows, summed across tasks in pieces.

Each task counts into an array of its own and emits only the pieces that are not all zero,
compressed; pieces are summed by number. What reaches the driver has a size fixed by ``bits``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_CODEC = "zstd"
PIECE_BITS = 16


def pieces(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Numbers and compressed contents of the pieces of a counter array (uint16) that hold counts."""
    size = min(1 << PIECE_BITS, len(counts))
    grid = counts.reshape(-1, size)
    full = np.flatnonzero(grid.any(axis=1))
    return full.tolist(), [pa.compress(np.ascontiguousarray(grid[k]).tobytes(), codec=_CODEC, asbytes=True) for k in full]


def _unpack(payload: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(payload, decompressed_size=2 * size, codec=_CODEC, asbytes=True), np.uint16)


def reached(parts: DataFrame, bits: int, *least: int) -> list[np.ndarray]:
    """For each of ``least`` a bool array of 2**bits: which counters sum to that or more over the rows
    (``piece`` int, ``payload`` binary) of ``parts``."""
    size = 1 << min(PIECE_BITS, bits)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for p in table.column("payload"):
            total += _unpack(p.as_py(), size)
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "payload": pa.array([b"".join(np.packbits(total >= k).tobytes() for k in least)], pa.binary())})

    out = np.zeros(((1 << bits) // size, len(least), size // 8), np.uint8)
    for row in parts.groupBy("piece").applyInArrow(add, "piece int, payload binary").toLocalIterator():
        out[row["piece"]] = np.frombuffer(row["payload"], np.uint8).reshape(len(least), -1)
    return [np.unpackbits(np.ascontiguousarray(out[:, k]).reshape(-1)).astype(bool) for k in range(len(least))]

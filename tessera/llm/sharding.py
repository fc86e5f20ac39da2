"""Sharding by a minimax contiguous partition, with DataFrame operations only.

The law is ``bytes``: shard sizes near equal. Groups of equal texts are atomic and ordered by a
digest of the text. The smallest capacity is found by binary search: a capacity is feasible if cutting
greedily, each time at the last group end that fits, needs no more than the wanted shards. The search
runs on an index of group ends with a fixed number of blocks (least and greatest end, count); bounds
on the cuts inside a block give bounds on the capacity, and only blocks that the bounds still meet are
refined, so what reaches the driver stays below a fixed number of rows and the result is exact.

A null text has no bytes and size 1; nulls form a group of their own. Repeated rows are rows of their
own in their text's group. With fewer groups than shards, or a group larger than the even share, some
shards are small or empty, as small as the largest group allows. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.ordering import numbered
from tessera.llm.storage import store

SHARDS = 16
#: Blocks of the index, and group ends that are fetched at once: the most rows on the driver.
BLOCKS = 1 << 15


class _Ends:
    """What is known of the sorted group ends: disjoint blocks (least, greatest, count)."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends = ends
        self.low = self.high = self.count = np.zeros(0, np.int64)
        self._add(ends, max(1, -(-total // BLOCKS)))

    def _add(self, part: DataFrame, width: int) -> None:
        rows = part.groupBy(F.floor((F.col("end") - 1) / F.lit(width)).alias("block")).agg(F.min("end"), F.max("end"), F.count("*")).collect()  # at most BLOCKS and a few
        fresh = np.array([(r[1], r[2], r[3]) for r in rows], np.int64).reshape(-1, 3)
        both = np.concatenate([np.stack([self.low, self.high, self.count], 1), fresh])
        self.low, self.high, self.count = both[np.argsort(both[:, 0], kind="stable")].T.copy()

    def refine(self, blocks: set[int]) -> None:
        at = np.array(sorted(blocks))
        spans = [(int(self.low[i]), int(self.high[i])) for i in at]
        found = F.lit(False)
        for a, b in spans:
            found = found | F.col("end").between(a, b)
        keep = np.ones(len(self.low), bool)
        keep[at] = False
        size = int(self.count[at].sum())
        self.low, self.high, self.count = self.low[keep], self.high[keep], self.count[keep]
        width = 1 if size <= BLOCKS else max(1, sum(b - a + 1 for a, b in spans) // (BLOCKS - 2 * len(spans)))
        self._add(self.ends.where(found), width)

    def last(self, v: int, upper: bool, unknown: set[int]) -> int:
        """The greatest end up to v, or a bound on it; blocks that leave it open go to ``unknown``."""
        i = int(np.searchsorted(self.low, v, side="right")) - 1
        if i < 0:
            return 0
        if self.high[i] <= v:
            return int(self.high[i])
        if self.count[i] == 2:
            return int(self.low[i])
        unknown.add(i)
        return min(v, int(self.high[i]) - 1) if upper else int(self.low[i])

    def cuts(self, capacity: int, total: int, shards: int, upper: bool, unknown: set[int]) -> list[int]:
        at, cuts = 0, []
        for _ in range(shards):
            at = self.last(at + capacity, upper, unknown)
            cuts.append(at)
            if at >= total:
                break
        return cuts

    def least(self, total: int, shards: int, upper: bool) -> tuple[int, set[int]]:
        """The smallest capacity that the bounds call feasible, and the open blocks it rests on."""
        low, high = -(-total // shards), total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, total, shards, upper, set())[-1] >= total:
                high = mid
            else:
                low = mid + 1
        unknown: set[int] = set()
        self.cuts(low, total, shards, upper, unknown)
        return low, unknown


def minimax_cuts(ends: DataFrame, total: int, shards: int = SHARDS) -> list[int]:
    """Where the shards end, for sorted group ends (``end`` long, stored) up to ``total``."""
    if not total:
        return []
    index = _Ends(ends, total)
    while True:
        high, a = index.least(total, shards, upper=False)
        low, b = index.least(total, shards, upper=True)
        unknown: set[int] = set()
        cuts = index.cuts(high, total, shards, False, unknown)
        if low == high and not unknown:
            return cuts
        index.refine(a | b | unknown)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("__doc"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("__size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("__crc"), F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("__digest"),
    )
    rows = numbered(rows, ["__digest", "__doc"], "sharding")
    parts = rows.groupBy("__part").agg(F.count("*").alias("n"), F.sum("__size").alias("bytes"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = parts.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__rows_before"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("__bytes_before"))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("__end", F.sum("__size").over(within)).join(parts, "__part")
    placed = placed.select("__doc", "__size", "__crc", "__digest", (F.col("__at") + F.col("__rows_before")).alias("__row"), (F.col("__end") + F.col("__bytes_before")).alias("__end"))
    placed = store(placed, "placed")
    ends = store(placed.groupBy("__digest").agg(F.max("__end").alias("end")).select("end"), "ends")
    total = placed.agg(F.max("__end")).first()[0] or 0
    cuts = minimax_cuts(ends, total, shards)
    number = F.lit(0)
    for cut in cuts[:-1]:
        number = number + (F.col("__end") > F.lit(cut)).cast("int")
    dealt = placed.withColumn("__shard", number)
    first = dealt.groupBy("__shard").agg(F.min("__row").alias("__first"))  # one row for each shard
    return dealt.join(F.broadcast(first), "__shard").select(
        F.col("__doc").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").alias("shard"),
        (F.col("__row") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

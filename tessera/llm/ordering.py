"""Global row numbers with DataFrame operations only.

Rows are range-partitioned and sorted, numbered within their partition, and written; what is written
never changes, so a lost executor or another run of a task cannot renumber rows. A key of any size is
split over partitions as long as the order columns tell its rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import store

def unused(columns: list[str], name: str) -> str:
    """``name``, or with underscores before it where ``columns`` have one of that name already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_SHIFT = 33  # monotonically_increasing_id: partition number above, row number below


def numbered(df: DataFrame, order: list[Column | str], tag: str) -> DataFrame:
    """``df`` as a stored table with ``__part`` and ``__at``: the row's partition, in order, and its
    place there from 0. Rows equal in ``order`` may stand either way round."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return store(out, tag).withColumn("__part", F.shiftright("__id", _SHIFT)).withColumn("__at", F.col("__id").bitwiseAND((1 << _SHIFT) - 1)).drop("__id")

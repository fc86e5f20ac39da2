"""Connected components of a link table, without gathering links or components anywhere.

First each of a number of partitions that follows the number of links (``PART_LINKS`` each) reduces its
links to a forest, by union-find over the links of that partition alone: links of one partition are
done then. Otherwise rounds follow. Each round gives every vertex the smallest label among its own and its neighbours', then the label
of that label (pointer jumping), so long chains shrink exponentially. A round's result is written
to the shared folder. Hot vertices only meet partial aggregations and joins that AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import store


#: Links that one task takes up.
PART_LINKS = 250_000


def _forest(links: DataFrame, parts: int) -> DataFrame:
    """``v``, ``root`` with the smallest vertex that the links of the same partition lead to."""
    kind = dict(links.dtypes)["u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
                up[max(a, b)] = min(a, b)
        if up:
            v = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(v, arrow), pa.array([root(x) for x in v], arrow)], names=["v", "root"])

    return links.repartition(parts).mapInArrow(run, f"v {kind}, root {kind}")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """``v``, ``root``: the smallest vertex reachable from each vertex that has a link.

    ``links`` may hold repeated rows, both directions and loops; rows with a null end are ignored.
    Without links the result is empty.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    one = store(one.distinct(), "links")
    parts = -(-one.count() // PART_LINKS)
    forest = store(_forest(one, max(1, parts)), "forest")
    if parts <= 1:
        return forest
    one = forest.select(F.col("v").alias("u"), F.col("root").alias("v"))
    edges = store(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = store(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        near = edges.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("root").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        up = labels.select(F.col("v").alias("low"), F.col("root").alias("higher"))
        jumped = store(lower.join(up, "low").select("v", "old", F.least("low", "higher").alias("root")), "labels")
        labels = jumped.select("v", "root")
        if jumped.where("old <> root").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")

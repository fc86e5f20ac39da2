"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

A source's target is its weight's share of all words, at most ``MOST`` times its own size; the excess
goes to the other sources by weight until none is above. Within a source every document has the same
expected number of copies, target / size. Documents are ordered by size, their expected copies are
summed up from one random offset per source, and a document is emitted once for each whole number its
sum crosses. Ordering by size makes the words taken differ from the target by about the size of a few
documents. Copies never exceed ``MOST``. The offset depends on the seed and the source only, so
reruns agree.

Null text has size 0; null source is a source of its own, last in order. A source without words has
target 0 and is not taken. Repeated rows are documents of their own; rows equal in id, size and text
may stand either way round and get results that are the same as a set. Empty tables give empty
results. Columns that are carried keep their names and values, whatever the names. The table of sources
(one row each) is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.ordering import numbered

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _offset(source):
    """A number in [0, 1) from the first 32 bits of a digest of seed and source."""
    name = F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("source:"), source))
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), name)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``__source``, ``__source_size``, ``__target`` from one row per source (``__source``,
    ``__source_size``, ``__documents``).

    The common level is where the capped shares add up to all words: going up the sources by
    cap / weight, the first level that does not reach its own cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last())
    whole = Window.partitionBy()
    rows = sizes.withColumn("__weight", weight).withColumn("__cap", F.col("__source_size") * most)
    rows = rows.withColumn("__all", F.sum("__source_size").over(whole)).withColumn("__capped", F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("__rest", F.sum("__weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("__level", (F.col("__all") - F.col("__capped")).cast("double") / F.col("__rest"))
    rows = rows.withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__cap") / F.col("__weight"), F.col("__level"))).over(whole))
    return rows.select("__source", "__source_size", F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__weight")).alias("__target"))


def word_count(text):
    """Words of a whole text: a run of word characters and what follows it becomes one character."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", ""), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")).cast("long")


def _mixed(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Every document's ``carry`` columns under the names ``__0``, ``__1`` and so on, with ``__size``,
    ``__source_size``, ``__target``, ``__copies``; so no input name can clash with ours."""
    kept = [F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(carry)]
    rows = docs.select(*kept, F.col(id_col).alias("__doc"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("__tie"))
    rows = numbered(rows, [F.col("__source").asc_nulls_last(), "__size", "__doc", "__tie"], "mixing")
    runs = rows.groupBy("__source", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"), F.sum("__size").alias("__words"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goals = targets(runs.groupBy("__source").agg(F.sum("__words").alias("__source_size"), F.sum("__n").alias("__documents")), weights, most)
    runs = runs.withColumn("__before", before)
    runs = runs.join(goals.withColumnRenamed("__source", "__goal"), F.col("__source").eqNullSafe(F.col("__goal"))).select(F.col("__source").alias("__run"), F.col("__part").alias("__run_part"), (F.col("__before") - F.col("__first")).alias("__shift"), "__source_size", "__target")
    rows = rows.join(runs, F.col("__source").eqNullSafe(F.col("__run")) & (F.col("__part") == F.col("__run_part")))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    at = (F.col("__at") + F.col("__shift")).cast("double")
    start = _offset(F.col("__source"))
    copies = F.floor(start + (at + 1) * rate) - F.floor(start + at * rate)
    return rows.select(*(f"__{k}" for k in range(len(carry))), "__size", "__source_size", "__target", F.least(copies, F.lit(most)).cast("long").alias("__copies"))


def _named(carry: list[str]) -> list[Column]:
    return [F.col(f"__{k}").alias(c) for k, c in enumerate(carry)]


def mixed_documents(docs: DataFrame, **given) -> DataFrame:
    """The documents of the mix in the columns of ``docs``; one row for each copy taken."""
    rows = _mixed(docs, docs.columns, **given).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*_named(docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", **given) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of every document."""
    rows = _mixed(docs, [id_col], id_col=id_col, **given)
    return rows.select(*_named([id_col]), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, least(cap::DOUBLE, max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight) AS target,
         ('0x' || substr(md5('{SEED}|' || CASE WHEN source IS NULL THEN 'null' ELSE 'source:' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM l),
n AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id, d.tie) - 1)::DOUBLE AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(u + (i + 1) * rate) - floor(u + i * rate), 3) * size AS BIGINT) AS taken
FROM n
"""

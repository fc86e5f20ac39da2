"""Chat formatting by multi-party perspective rotation, with DataFrame operations only.

For every participant of a conversation the dialogue is rendered once, with that speaker as the
assistant and the others as named users; system turns stay system turns. Only the assistant's contents
(and what ends them) are trained on. The rendering is given as its segments in order, one for each
turn, with their character offsets, so a conversation of any length is never gathered anywhere:
offsets come from sums per partition and a running sum inside it. Joining the segments of a
perspective in order gives its text.

Texts and names cannot forge a marker: wherever ``<`` and ``|`` stand together, or with backslashes
between them, one more backslash is put between (:func:`escaped`; taking one out again restores the
text). In names, line ends and backslashes become ``\\n``, ``\\r`` and ``\\\\`` first, so a head is one line. Offsets
and lengths are those of the escaped contents.

Participants are the roles of a conversation other than ``system``. A null role speaks as the user
``unknown`` and is no participant; a null text is an empty content; a conversation without
participants is not rendered; a null ``conv_id`` is a conversation of its own. Turns are ordered by
turn (null last), role and text; repeated rows are turns of their own. Columns other than the four
used are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.ordering import numbered

SYSTEM, UNKNOWN = "system", "unknown"
HEAD, NAMED, TAIL = "<|start|>", " name=", "<|end|>\n"
_MARKER = r"<(\\*)\|"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _MARKER, r"<\\$1|")


def _one_line(name: Column) -> Column:
    return escaped(F.replace(F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``perspective``, ``place`` (from 0), ``turn``, ``role``, ``name``, ``segment``,
    ``start``, ``trained``, ``content_start``, ``content_length``; offsets in characters."""
    rows = turns.select(F.col(conv_col).alias("__conv"), F.col(turn_col).alias("__turn"), F.col(role_col).alias("__role"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("__text", escaped(F.col("__text")))
    rows = numbered(rows, [F.col("__conv").asc_nulls_first(), F.col("__turn").asc_nulls_last(), F.col("__role").asc_nulls_last(), F.col("__text").asc()], "chat")
    speakers = rows.where((F.col("__role") != SYSTEM)).select(F.col("__conv").alias("__own"), F.col("__role").alias("__as")).distinct()
    seen = rows.join(speakers, F.col("__conv").eqNullSafe(F.col("__own")))
    name = F.coalesce("__role", F.lit(UNKNOWN))
    trained = F.coalesce(F.col("__role") == F.col("__as"), F.lit(False))
    role = F.when(trained, F.lit("assistant")).when(F.col("__role") == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user"))
    seen = seen.withColumn("__trained", trained).withColumn("__shown", role).withColumn("__name", F.when(role == "user", name))
    head = F.concat(F.lit(HEAD), F.col("__shown"), F.coalesce(F.concat(F.lit(NAMED), _one_line(F.col("__name"))), F.lit("")), F.lit("\n"))
    seen = seen.withColumn("__head", F.length(head)).withColumn("__segment", F.concat(head, F.col("__text"), F.lit(TAIL)))
    key = ["__own", "__as"]
    sums = seen.groupBy(*key, "__part").agg(F.sum(F.length("__segment")).alias("__chars"), F.count("*").alias("__turns"))
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__own").alias("__o"), F.col("__as").alias("__a"), F.col("__part").alias("__p"), F.coalesce(F.sum("__chars").over(earlier), F.lit(0)).alias("__chars_before"), F.coalesce(F.sum("__turns").over(earlier), F.lit(0)).alias("__turns_before"))
    within = Window.partitionBy(*key, "__part").orderBy("__at")
    seen = seen.withColumn("__start", F.sum(F.length("__segment")).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("__segment")).withColumn("__place", F.row_number().over(within) - 1)
    seen = seen.join(sums, F.col("__own").eqNullSafe(F.col("__o")) & (F.col("__as") == F.col("__a")) & (F.col("__part") == F.col("__p")))
    start = F.col("__start") + F.col("__chars_before")
    return seen.select(
        F.col("__conv").alias(conv_col), F.col("__as").alias("perspective"), (F.col("__place") + F.col("__turns_before")).alias("place"), F.col("__turn").alias(turn_col), F.col("__shown").alias("role"),
        F.col("__name").alias("name"), F.col("__segment").alias("segment"), start.alias("start"), F.col("__trained").alias("trained"), (start + F.col("__head")).alias("content_start"), F.length("__text").cast("long").alias("content_length"),
    )


_MARKER_SQL = r"'<(\\*)\|', '<\\\\\1|', 'g'"
_ESCAPED = f"regexp_replace(coalesce(text, ''), {_MARKER_SQL})"
_NAME_SQL = rf"regexp_replace(replace(replace(replace(name, '\', '\\'), chr(10), '\n'), chr(13), '\r'), {_MARKER_SQL})"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, {_ESCAPED} AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, {_ESCAPED}) - 1 AS place
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> '{SYSTEM}'),
r AS (
  SELECT t.*, s.perspective, coalesce(t.role = s.perspective, false) AS trained,
         CASE WHEN t.role = s.perspective THEN 'assistant' WHEN t.role = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS shown
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
n AS (SELECT *, CASE WHEN shown = 'user' THEN coalesce(role, '{UNKNOWN}') END AS name FROM r),
h AS (SELECT *, '{HEAD}' || shown || coalesce('{NAMED}' || {_NAME_SQL}, '') || chr(10) AS head FROM n),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(segment) AS BIGINT) AS start FROM g)
SELECT conv_id, perspective, CAST(place AS BIGINT) AS place, turn, shown AS role, name, segment, start, trained,
       CAST(start + length(head) AS BIGINT) AS content_start, CAST(length(text) AS BIGINT) AS content_length
FROM o
"""

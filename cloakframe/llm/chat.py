"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A logged conversation that is a prefix of a longer one says nothing new. Each turn is hashed with its place; the running
exclusive-or of those hashes is a rolling hash of the turn prefix (128 bits), which equal prefixes and only they share.
An anti-join removes conversations whose whole hash is a proper prefix of another; of equal conversations the one with
the smallest conv_id stays. What remains is rendered.

Defined results: null conv_ids are one conversation; null roles and texts equal only nulls and render as empty text;
turns with equal numbers are ordered by role and text (nulls first), so repeated rows are repeated turns. Only counts and hashes of
prefixes meet in a shuffle by hash, pre-aggregated; a conversation's own turns meet by conv_id, all turns without one too: give them ids first if there are many.
Other columns are left out, whatever their names; very long texts are kept whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cloakframe.llm.common import table

#: How a turn is written: its role's mark, its text, its end.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def turns_with_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), n_turns, role, text and the two halves of the rolling hash after each turn."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    parts = [F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    placed = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string")).withColumn("place", F.row_number().over(own))
    hashed = placed.withColumns({"h1": F.xxhash64(*parts), "h2": F.xxhash64(F.lit(7), *parts)})
    far = Window.partitionBy("conv_id")
    run = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select("conv_id", "place", F.count("*").over(far).alias("n_turns"), "role", "text", F.bit_xor("h1").over(run).alias("p1"), F.bit_xor("h2").over(run).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of each conversation that is no proper prefix of another."""
    rows = turns_with_prefixes(turns).drop("role", "text")
    whole = rows.where(F.col("place") == F.col("n_turns")).groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = rows.where(F.col("place") < F.col("n_turns")).select(F.col("place").cast("long").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies and its text."""
    kept = maximal(turns)
    rows = turns_with_prefixes(turns).select(F.col("conv_id").alias("__id"), "place", F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE), F.coalesce("text", F.lit("")), F.lit(END)).alias("line"))
    joined = rows.join(kept, F.col("__id").eqNullSafe(F.col("conv_id")))
    grouped = joined.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return grouped.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


QUERIES = {"op2_chat": op2_chat}
ORACLE_SQL = {
    "op2_chat": """
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations),
convs AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY place) AS turns, count(*) AS n_turns,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM placed GROUP BY conv_id),
whole AS (SELECT turns, n_turns, any_value(rendered) AS rendered, min(conv_id) AS conv_id, count(*) AS n_copies FROM convs GROUP BY turns, n_turns),
proper AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, n_turns, unnest(range(1, n_turns)) AS k FROM convs))
SELECT conv_id, n_turns, n_copies, rendered FROM whole WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.turns = whole.turns)"""
}

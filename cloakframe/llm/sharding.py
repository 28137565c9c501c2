"""Sharding by jump consistent hashing: a stable key and the number of shards alone decide the shard.

Defined results: a null key is one key like any other; rows with equal keys share a shard, repeated rows keep one row
each. Slots are gapless from 0 within a shard: rows are dealt to `blocks` blocks of each shard by a hash of the whole
row, a block's first slot is the sum of the blocks before it (a table of at most shards x blocks rows), and rows are
numbered inside their block. So no task ever holds a shard, and the rows of a hot key are spread over all blocks of its shard as far as they differ; equal rows share a block, as only what
is in a row may decide its slot. An empty table gives an empty one; very long values only matter by their hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cloakframe.llm.common import table

#: Fixed values of the published jump hash: its multiplier, and the 2^31 that scales a step.
JUMP_MULTIPLIER, JUMP_SCALE = 2862933555777941757, float(1 << 31)
#: Blocks a shard: fixed, so that slots don't depend on the cluster. The table of offsets has shards x BLOCKS rows at most.
BLOCKS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("there must be a shard")
    key = keys.astype(np.uint64, copy=True)
    at, step = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = step[live]
        key[live] = key[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        step[live] = ((at[live] + 1) * (JUMP_SCALE / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[step[live] < shards]
    return at.astype(np.int32)


def shard_of(key, shards: int):
    """A column: the shard of a long key column (null counts as one key)."""

    @F.pandas_udf("int")
    def over(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return over(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null key"))))


def sharded(df: DataFrame, key: str, shards: int, blocks: int = BLOCKS) -> DataFrame:
    """df with shard, slot and grown_shard (the shard if there were one more). Clashing columns of df are replaced."""
    df = df.drop("shard", "slot", "grown_shard")
    rest = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumns({"shard": shard_of(F.col(f"`{key}`"), shards), "grown_shard": shard_of(F.col(f"`{key}`"), shards + 1), "__block": F.pmod(F.xxhash64(*rest, F.lit(17)), F.lit(blocks)).cast("int")})
    sums = rows.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__block").orderBy(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in df.columns if c != key])
    placed = rows.withColumn("__in", F.row_number().over(inside))
    return placed.join(F.broadcast(starts), ["shard", "__block"]).withColumn("slot", F.col("__start") + F.col("__in") - 1).select(*df.columns, "shard", F.col("slot").cast("long"), "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `key`: doc_id and the shard count decide. Equal rows share one shard."""
    text = F.col("text").cast("string")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    return sharded(docs, "doc_id", 8).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op3_sharding": op3_sharding}
ORACLE_SQL: dict[str, str] = {}

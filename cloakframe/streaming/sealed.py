"""Sealing and opening streams: both are row by row, so they run unchanged in Structured Streaming; key relations are static sides of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators.protector import Protector


def seal_stream(protector: Protector, stream: DataFrame, table: str) -> DataFrame:
    """A stream of plain rows as one of stored rows. Its rows can't be counted ahead, so it books all that its key has left, and what is sealed after gets another key; a stream
    that may seal more than that must be ended and started again, which gives it a new key."""
    return protector.seal_df(stream, table)


def open_stream(protector: Protector, stream: DataFrame, table: str) -> DataFrame:
    """A stream of stored rows, opened and masked."""
    return protector.open_df(protector.tag(stream, table))


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there now to Parquet files, and ends."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

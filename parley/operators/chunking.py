"""Chunks: runs of one sender's messages without a long gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.ordered import SLICE_SECONDS, with_runs
from parley.schema import ChunkSettings

ORDER = ["timestamp", "message_id", "account_hash"]


def gap_seconds(before: Column, after: Column) -> Column:
    """Whole seconds between two instants, cut off towards zero."""
    return F.timestamp_diff("SECOND", before, after)


def chunk_boundaries(messages: DataFrame, settings: ChunkSettings = ChunkSettings(), slice_seconds: int | None = SLICE_SECONDS) -> DataFrame:
    """Messages with ``starts`` (does a chunk start here?) and ``opening`` (time and id of the chunk's first message).

    A chunk starts at a room's first message, where account or sender changes, on
    either side of a message that is no ``text``, and after a gap of more seconds than
    the room's kind allows.
    """
    limit = F.when(F.col("chat_type") == "group", settings.group_gap_seconds).otherwise(settings.direct_gap_seconds)

    def starts(prev: Column) -> Column:
        return (
            (prev["account_hash"] != F.col("account_hash"))
            | (prev["sender_nickname"] != F.col("sender_nickname"))
            | (prev["message_type"] != "text")
            | (F.col("message_type") != "text")
            | (gap_seconds(prev["timestamp"], F.col("timestamp")) > limit)
        )

    carried = {c: F.col(c) for c in ("account_hash", "sender_nickname", "message_type", "timestamp")}
    return with_runs(messages, ["chat_id"], ORDER, "timestamp", carried, [*carried, "chat_type"], starts, slice_seconds)


def chunk_id(account: Column, chat: Column, first: Column, last: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.left(F.sha2(F.concat_ws("|", account, chat, first, last, F.lit("v1")), 256), F.lit(16)))


def build_chunks(messages: DataFrame, settings: ChunkSettings = ChunkSettings(), slice_seconds: int | None = SLICE_SECONDS) -> DataFrame:
    """Chunks with their text (messages joined by line ends) and the ordered ids of their messages.

    The grouping key is a chunk's first message, so that a room with most of all
    messages is grouped by many tasks.
    """
    marked = chunk_boundaries(messages, settings, slice_seconds)
    row = F.struct("timestamp", "message_id", "account_hash", "text")
    grouped = marked.groupBy("chat_id", "opening").agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        *(F.min_by(c, F.struct(*ORDER)).alias(c) for c in ("chat_name", "sender_nickname")),
    )
    first, last = F.col("rows")[0], F.element_at("rows", -1)
    return grouped.select(
        chunk_id(first["account_hash"], F.col("chat_id"), first["message_id"], last["message_id"]).alias("chunk_id"),
        first["account_hash"].alias("account_hash"),
        "chat_id",
        "chat_name",
        "sender_nickname",
        first["timestamp"].alias("started_at"),
        last["timestamp"].alias("ended_at"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"),
        F.transform("rows", lambda r: r["message_id"]).alias("message_ids"),
        F.size("rows").cast("bigint").alias("message_count"),
    )


def chunk_messages(chunks: DataFrame) -> DataFrame:
    """(chunk_id, message_id, ordinal): the messages of chunks."""
    return chunks.select("chunk_id", "chat_id", F.posexplode("message_ids").alias("ordinal", "message_id"))

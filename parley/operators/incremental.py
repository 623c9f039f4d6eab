"""Rebuilding only the tail of a room that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.chunking import build_chunks, gap_seconds
from parley.operators.ordered import SLICE_SECONDS, with_previous
from parley.operators.upsert import replace_tail
from parley.operators.windows import build_windows
from parley.schema import PARENT_GAP_SECONDS, ChunkSettings


def tail_floors(chunks: DataFrame, touched: DataFrame, gap: int = PARENT_GAP_SECONDS, slice_seconds: int | None = SLICE_SECONDS) -> DataFrame:
    """(chat_id, floor): where each touched room's rebuild has to start; null means the whole room.

    The floor is the start of the latest chunk before the change that has a gap of
    more than ``gap`` seconds before it: no window reaches across it.  A chunk that
    overlaps another's time is no safe place, nor is a place that more than one chunk
    starts at.
    """
    hit = touched.select(F.col("chat_id").alias("_chat"), F.col("earliest").alias("_e"))
    mine = chunks.join(hit, F.col("chat_id") == F.col("_chat")).select("chat_id", "chunk_id", "started_at", "ended_at", "_e", F.col("message_ids")[0].alias("first_id"), "account_hash")
    rows = with_previous(mine, ["chat_id"], ["started_at", "first_id", "account_hash"], "started_at", {"ended_at": F.col("ended_at")}, slice_seconds)
    safe = rows.filter(F.col("started_at") < F.col("_e")).filter(gap_seconds(F.col("prev.ended_at"), F.col("started_at")) > gap)
    floors = safe.groupBy("chat_id").agg(F.max("started_at").alias("floor"))
    return touched.select("chat_id").join(floors, "chat_id", "left")


def long_gaps(windows: DataFrame, gap: int = PARENT_GAP_SECONDS, slice_seconds: int | None = SLICE_SECONDS) -> DataFrame:
    """(chat_id, started_at): where a room's chunks go on after a gap of more than ``gap`` seconds, from its windows.

    A window starts at each such place, so windows, which are far fewer than chunks,
    tell all of them.
    """
    mine = windows.filter("ordinal = 0").select("chat_id", "started_at", "ended_at", "parent_id")
    rows = with_previous(mine, ["chat_id"], ["started_at", "ended_at", "parent_id"], "started_at", {"ended_at": F.col("ended_at")}, slice_seconds)
    return rows.filter(gap_seconds(F.col("prev.ended_at"), F.col("started_at")) > gap).select("chat_id", "started_at")


def floors_of(gaps: DataFrame, touched: DataFrame) -> DataFrame:
    """(chat_id, earliest, floor): tail_floors from the places of ``long_gaps``."""
    hit = touched.select(F.col("chat_id").alias("_chat"), F.col("earliest").alias("_e"))
    last = gaps.join(hit, (F.col("chat_id") == F.col("_chat")) & (F.col("started_at") < F.col("_e"))).groupBy("chat_id").agg(F.max("started_at").alias("floor"))
    return touched.select("chat_id", "earliest").join(last, "chat_id", "left")


def tail_messages(messages: DataFrame, floors: DataFrame) -> DataFrame:
    """The messages of the touched rooms from their floor on."""
    f = floors.select(F.col("chat_id").alias("_chat"), F.col("floor").alias("_floor"))
    inside = (F.col("chat_id") == F.col("_chat")) & (F.col("_floor").isNull() | (F.col("timestamp") >= F.col("_floor")))
    return messages.join(f, inside, "left_semi")


def rebuild(
    messages: DataFrame, chunks: DataFrame, windows: DataFrame, touched: DataFrame, settings: ChunkSettings = ChunkSettings(), slice_seconds: int | None = SLICE_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """(chunks, windows) after a change, equal to what a full build over ``messages`` gives; ``touched`` has chat_id and earliest (null: the whole room)."""
    floors = tail_floors(chunks, touched, PARENT_GAP_SECONDS, slice_seconds)
    fresh = build_chunks(tail_messages(messages, floors), settings, slice_seconds)
    return replace_tail(chunks, fresh, floors), replace_tail(windows, build_windows(fresh, slice_seconds=slice_seconds), floors)

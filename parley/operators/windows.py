"""Parent windows: neighbouring chunks of a room, bounded in gap and length.

The gap part of the boundary compares neighbours.  The length part is a fold that no
window function expresses; it streams through the sorted rows of a partition, a few
numbers for each chunk, and holds one running length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.chunking import gap_seconds
from parley.operators.ordered import SLICE_SECONDS, with_runs
from parley.schema import PARENT_GAP_SECONDS, PARENT_MAX_CHARS, MissingChunk

#: Chunks of a room follow their first messages.
ORDER = ["started_at", "first_message_id", "account_hash"]


def window_line(sender: Column, text: Column) -> Column:
    return F.concat(F.lit("["), sender, F.lit("] "), text)


def _folder(limit: int, burst: int, chars: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, length, number = None, 0, 0
        for batch in batches:
            out = []
            for here, size in zip(batch.column(burst).to_pylist(), batch.column(chars).to_pylist()):
                if here != key:
                    key, length, number = here, size, 0
                elif length + 1 + size > limit:
                    length, number = size, number + 1
                else:
                    length += 1 + size
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "window_no"])

    return fold


def window_numbers(chunks: DataFrame, gap: int = PARENT_GAP_SECONDS, max_chars: int = PARENT_MAX_CHARS, slice_seconds: int | None = SLICE_SECONDS) -> DataFrame:
    """Chunks with ``burst`` (a run of chunks without a long gap) and ``window_no`` within it."""
    df = chunks.withColumn("first_message_id", F.col("message_ids")[0])

    def starts(prev: Column) -> Column:
        return gap_seconds(prev["ended_at"], F.col("started_at")) > gap

    df = with_runs(df, ["chat_id"], ORDER, "started_at", {"ended_at": F.col("ended_at")}, ["started_at"], starts, slice_seconds)
    df = df.withColumn("burst", F.sha2(F.to_json(F.struct("chat_id", "opening")), 256)).drop("starts", "opening")
    df = df.withColumn("_chars", F.length(window_line(F.col("sender_nickname"), F.col("text"))).cast("bigint"))
    df = df.repartition("burst").sortWithinPartitions("burst", *ORDER)
    schema = T.StructType([*df.schema.fields, T.StructField("window_no", T.LongType())])
    return df.mapInArrow(_folder(max_chars, df.columns.index("burst"), df.columns.index("_chars")), schema).drop("_chars")


def window_id(account: Column, chat: Column, first: Column, last: Column, ordinal: Column, text: Column) -> Column:
    head = F.concat_ws("|", account, chat, first, last, ordinal.cast("string"), F.lit("parent-window-v1"))
    return F.concat(F.lit("window_"), F.left(F.sha2(F.concat(head, text), 256), F.lit(16)))


def build_windows(chunks: DataFrame, gap: int = PARENT_GAP_SECONDS, max_chars: int = PARENT_MAX_CHARS, slice_seconds: int | None = SLICE_SECONDS) -> DataFrame:
    """Windows with their text and the ordered ids of their children.

    Only a window of a single chunk can be longer than ``max_chars``; it is cut into
    pieces with an ordinal, of which the first counts the messages.
    """
    numbered = window_numbers(chunks, gap, max_chars, slice_seconds)
    row = F.struct(*ORDER, "chunk_id", "ended_at", "sender_nickname", "text", "message_count")
    grouped = numbered.groupBy("chat_id", "burst", "window_no").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.min_by("chat_name", F.struct(*ORDER)).alias("chat_name")
    )
    whole = grouped.select(
        F.col("rows")[0]["account_hash"].alias("account_hash"),
        "chat_id",
        "chat_name",
        F.col("rows")[0]["started_at"].alias("started_at"),
        F.element_at("rows", -1)["ended_at"].alias("ended_at"),
        F.array_join(F.transform("rows", lambda r: window_line(r["sender_nickname"], r["text"])), "\n").alias("whole"),
        F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, r: a + r["message_count"]).alias("messages"),
        F.transform("rows", lambda r: r["chunk_id"]).alias("child_chunk_ids"),
    )
    pieces = whole.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.ceil(F.length("whole") / max_chars).cast("int") - 1)))
    pieces = pieces.withColumn("text", F.substring("whole", F.col("ordinal") * max_chars + 1, F.lit(max_chars)))
    first, last = F.col("child_chunk_ids")[0], F.element_at("child_chunk_ids", -1)
    return pieces.select(
        window_id(F.col("account_hash"), F.col("chat_id"), first, last, F.col("ordinal"), F.col("text")).alias("parent_id"),
        "account_hash",
        "chat_id",
        "chat_name",
        "started_at",
        "ended_at",
        "text",
        F.when(F.col("ordinal") == 0, F.col("messages")).otherwise(0).cast("bigint").alias("message_count"),
        F.size("child_chunk_ids").cast("bigint").alias("child_count"),
        "child_chunk_ids",
        F.col("ordinal").cast("bigint").alias("ordinal"),
    )


def window_children(windows: DataFrame) -> DataFrame:
    """(parent_id, chunk_id, ordinal): the chunks of windows."""
    return windows.select("parent_id", F.posexplode("child_chunk_ids").alias("ordinal", "chunk_id"))


def with_children(windows: DataFrame, children: DataFrame) -> DataFrame:
    """Windows with ``child_chunk_ids`` from a table of children (parent_id, chunk_id, ordinal), in the order of the ordinals.

    A window without a row there gets an empty list; a child of a window that isn't
    among ``windows`` is an error.
    """
    lost = children.join(windows.select("parent_id"), "parent_id", "left_anti").select("parent_id").limit(1).collect()
    if lost:
        raise MissingChunk(f"no window {lost[0][0]}, which has children")
    lists = children.groupBy(F.col("parent_id").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("_c"))
    rows = windows.drop("child_chunk_ids").join(lists, F.col("parent_id") == F.col("_p"), "left")
    ids = F.coalesce(F.transform("_c", lambda c: c["chunk_id"]), F.array().cast("array<string>"))
    return rows.withColumn("child_chunk_ids", ids).drop("_p", "_c")

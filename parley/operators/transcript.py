"""Transcripts of rooms."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import is_feed, rfc3339, sanitized_part
from parley.shared import file_system, staged


def in_range(messages: DataFrame, chat_id: str | None = None, since: str | None = None) -> DataFrame:
    """Messages of a room, or all, at or after an instant."""
    rows = messages if chat_id is None else messages.filter(F.col("chat_id") == chat_id)
    return rows if since is None else rows.filter(F.col("timestamp") >= F.to_timestamp(F.lit(since)))


def transcript_lines(messages: DataFrame) -> DataFrame:
    """(chat_id, timestamp, message_id, chat_name, feed, line) of every message."""
    line = F.concat(F.lit("**["), rfc3339(F.col("timestamp")), F.lit("] "), "sender_nickname", F.lit("**: "), "text")
    return messages.select("chat_id", "timestamp", "message_id", "chat_name", is_feed(F.col("message_type"), F.col("text")).alias("feed"), line.alias("line"))


def short_id(message_id: Column, chat_id: Column) -> Column:
    """A message id without its room's prefix."""
    head = F.concat(chat_id, F.lit("-"))
    return F.when(message_id.startswith(head), F.substring(message_id, F.length(head) + 1, F.length(message_id))).otherwise(message_id)


def transcript_reports(messages: DataFrame) -> DataFrame:
    """One row a room: name, counts, range and file name; no file name where there is nothing but feeds."""
    rows = transcript_lines(messages)
    place = F.struct("timestamp", "message_id")
    kept = ~F.col("feed")
    named = F.col("chat_name") != ""
    out = rows.groupBy("chat_id").agg(
        F.coalesce(F.max_by(F.when(named, F.col("chat_name")), F.when(named, place)), F.first("chat_id")).alias("chat_name"),
        F.count(F.when(kept, 1)).alias("messages"),
        F.count(F.when(F.col("feed"), 1)).alias("feed_skipped"),
        F.min_by("message_id", F.when(kept, place)).alias("first_message_id"),
        F.max_by("message_id", F.when(kept, place)).alias("last_message_id"),
    )
    parts = [sanitized_part(F.col("chat_id")), *(sanitized_part(short_id(F.col(c), F.col("chat_id"))) for c in ("first_message_id", "last_message_id"))]
    return out.withColumn("file_name", F.when(F.col("messages") > 0, F.concat(F.concat_ws("-", *parts), F.lit(".md"))))


def transcript_header(reports: DataFrame) -> Column:
    """The head of a transcript, with the empty line after it."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), "chat_name", F.lit(" (chat "), "chat_id", F.lit(")")),
        F.lit(""),
        F.concat(F.lit("- messages: "), F.col("messages").cast("string")),
        F.concat(F.lit("- range: "), "first_message_id", F.lit(" .. "), "last_message_id"),
        F.when(F.col("feed_skipped") > 0, F.concat(F.lit("- system feed messages skipped: "), F.col("feed_skipped").cast("string"))),
        F.lit(""),
    )


def transcripts(messages: DataFrame) -> DataFrame:
    """(file_name, body, ...): the whole transcript of each room in one value, for rooms that fit one."""
    reports = transcript_reports(messages).filter("messages > 0")
    lines = transcript_lines(messages).filter(~F.col("feed"))
    body = lines.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "message_id", "line"))).alias("_l"))
    body = body.select(F.col("chat_id").alias("_c"), F.array_join(F.transform("_l", lambda x: F.concat(x["line"], F.lit("\n"))), "\n").alias("_text"))
    rows = reports.join(body, F.col("chat_id") == F.col("_c"))
    return rows.withColumn("body", F.concat_ws("\n", transcript_header(reports), "_text")).drop("_c", "_text")


def write_transcripts(messages: DataFrame, path: str, since: str | None = None) -> DataFrame:
    """Write every room's transcript below ``path`` as sorted text parts in a folder for each file, and return the reports.

    Rooms may be of any length: lines are range-partitioned by room and time, so a part
    holds a stretch of lines and parts follow one another in order.  Rooms without a
    message in range get no folder.
    """
    rows = in_range(messages, since=since)
    reports = transcript_reports(rows)
    files = reports.filter("messages > 0")
    head = files.select("file_name", F.lit(0).alias("o"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit("").alias("message_id"), transcript_header(files).alias("line"))
    names = files.select(F.col("chat_id").alias("_c"), "file_name")
    lines = transcript_lines(rows).filter(~F.col("feed")).join(names, F.col("chat_id") == F.col("_c"))
    body = lines.select("file_name", F.lit(1).alias("o"), "timestamp", "message_id", F.concat("line", F.lit("\n")).alias("line"))
    order = ["file_name", "o", "timestamp", "message_id"]
    both = head.unionByName(body).repartitionByRange(*order).sortWithinPartitions(*order)
    both.select("file_name", F.col("line").alias("value")).write.partitionBy("file_name").mode("overwrite").text(path)
    return reports


#: Bytes that a copy holds at once.
COPIED = 8 << 20
EXPORTED = "file_name string, bytes bigint"


def export_transcripts(messages: DataFrame, path: str, parts: str, since: str | None = None) -> DataFrame:
    """Write every room's transcript to one file below ``path``, and return the reports with the files' ``bytes``.

    The lines are sorted and written as parts below ``parts``, a folder that all
    executors reach and that can be removed afterwards.  Then a task for each file puts its parts together, block by
    block, beside its place and moves it there: a file is whole or absent, a room may
    be of any length, and a task that runs again does no harm.
    """
    reports = staged(write_transcripts(messages, parts, since))
    if reports.filter("messages > 0").isEmpty():
        return reports.withColumn("bytes", F.lit(None).cast("bigint"))
    # the names of parts sort as their ranges do; bodies aren't read here
    written = messages.sparkSession.read.format("binaryFile").load(parts)
    files = written.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("path", "length"))).alias("parts"))

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = file_system(path)
        target.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for name, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # the end of the last line isn't part of the file
                left = size = sum(p["length"] for p in pieces) - 1
                beside = f"{root}/.{uuid.uuid4().hex}.part"
                with target.open_output_stream(beside) as out:
                    for piece in pieces:
                        system, at = file_system(piece["path"])
                        with system.open_input_stream(at) as source:
                            while left > 0 and (block := source.read(min(COPIED, left))):
                                out.write(block)
                                left -= len(block)
                target.move(beside, f"{root}/{name}")
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file_name", "bytes"])

    done = staged(files.mapInArrow(copied, EXPORTED)).withColumnRenamed("file_name", "_f")
    return reports.join(done, F.col("file_name") == F.col("_f"), "left").drop("_f")

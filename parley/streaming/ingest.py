"""Streams of messages into an archive.

Every micro-batch goes through the batch upsert and scoped rebuild, so late rows and
edits have exactly the effect that they have in a batch; there is no watermark to
drop them.  A batch that is delivered twice changes nothing the second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.plans.engine import Engine
from parley.schema import MESSAGES, ORDINAL


#: Where a line of a stream comes from: files by the time of their writing, then their names, then places within.
PLACE = ("_written", "_file", "_start")


def message_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Messages from a folder that JSON-lines files arrive in, with the columns PLACE."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    of = ("file_modification_time", "file_path", "file_block_start")
    lines = reader.text(path).filter(F.trim("value") != "").select("value", *(F.col(f"_metadata.{m}").alias(c) for m, c in zip(of, PLACE)))
    return lines.select(F.from_json("value", MESSAGES).alias("m"), *PLACE).select("m.*", *PLACE)


def sync_stream(engine: Engine, messages: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Sync each micro-batch; with ``available_now`` the query ends when all that is there has been read.

    Of several rows of one key in a micro-batch the last counts, if the stream has the
    columns PLACE: rows of a file's block come in order.
    """

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            if set(PLACE) <= set(batch.columns):
                batch = batch.withColumn(ORDINAL, F.struct(*PLACE, F.monotonically_increasing_id())).drop(*PLACE)
            engine.sync(batch, "stream")

    writer = messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def session_counts(messages: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Messages and characters by room and session of the built-in session window: an approximation of chunks by gap alone."""
    rows = messages.withWatermark("timestamp", late)
    window = F.session_window("timestamp", gap)
    return rows.groupBy(window, "chat_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"))

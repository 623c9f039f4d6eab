"""From a chunk to its neighbours and windows, and what names a room."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import untypable
from parley.operators.ordered import SLICE_SECONDS, slice_of, with_previous
from parley.schema import BadRoomName, MissingChunk

SUMMARY = ["chunk_id", "account_hash", "chat_id", "chat_name", "sender_nickname", "started_at", "ended_at", "message_count"]


def _lists(ids: DataFrame, key: str, value: str, to: str) -> DataFrame:
    return ids.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_set(value)).alias(to))


def chunk_summaries(chunks: DataFrame, refs: DataFrame, children: DataFrame, chat_id: str | None = None) -> DataFrame:
    """Chunks without their text, with the chunks they reply to and the windows they are in (``children``: parent_id, chunk_id)."""
    rows = chunks.select(*SUMMARY) if chat_id is None else chunks.filter(F.col("chat_id") == chat_id).select(*SUMMARY)
    parents = _lists(refs, "child_chunk_id", "parent_chunk_id", "parent_chunk_ids")
    inside = _lists(children, "chunk_id", "parent_id", "window_ids")
    rows = rows.join(parents, F.col("chunk_id") == F.col("_k"), "left").drop("_k")
    rows = rows.join(inside, F.col("chunk_id") == F.col("_k"), "left").drop("_k")
    none = F.array().cast("array<string>")
    return rows.withColumn("parent_chunk_ids", F.coalesce("parent_chunk_ids", none)).withColumn("window_ids", F.coalesce("window_ids", none))


def chunk_neighbours(chunks: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(chunk_id, previous_chunk_id, next_chunk_id) in the order (started_at, chunk_id) of each room."""
    light = chunks.select("chunk_id", "chat_id", "started_at")
    rows = with_previous(light, ["chat_id"], ["started_at", "chunk_id"], "started_at", {"id": F.col("chunk_id")}, slice_seconds)
    rows = rows.select("chunk_id", F.col("prev.id").alias("previous_chunk_id"))
    after = rows.filter("previous_chunk_id is not null").select(F.col("previous_chunk_id").alias("_p"), F.col("chunk_id").alias("next_chunk_id"))
    return rows.join(after, F.col("chunk_id") == F.col("_p"), "left").drop("_p")


def get_chunk(chunks: DataFrame, chunk_id: str, redact: bool = False, ids: bool = True) -> DataFrame:
    """The chunk of the id; its text can be withheld and the ids of its messages left out."""
    rows = chunks.filter(F.col("chunk_id") == chunk_id)
    if redact:
        rows = rows.withColumn("text", F.lit("[redacted]"))
    return rows if ids else rows.withColumn("message_ids", F.array().cast("array<string>"))


def get_window(windows: DataFrame, parent_id: str) -> DataFrame:
    return windows.filter(F.col("parent_id") == parent_id)


def windows_of_chunk(windows: DataFrame, children: DataFrame, chunk_id: str) -> DataFrame:
    """The windows that hold a chunk, by id; none is an error.

    Their ids come from the table of children and go into the filter of the windows,
    so that both scans can be pruned; a chunk is in a few windows at most.
    """
    ids = [r[0] for r in children.filter(F.col("chunk_id") == chunk_id).select("parent_id").distinct().collect()]
    if not ids:
        raise MissingChunk(f"no window holds {chunk_id}")
    return windows.filter(F.col("parent_id").isin(ids)).orderBy("parent_id")


def chunk_context(chunks: DataFrame, children: DataFrame, chunk_id: str) -> DataFrame:
    """One row: the chunk, its previous and next chunk in the room, and its windows' ids."""
    mine = chunks.filter(F.col("chunk_id") == chunk_id)
    key = mine.select(F.col("chat_id").alias("_chat"), F.struct("started_at", "chunk_id").alias("_key"))
    room = chunks.join(F.broadcast(key), F.col("chat_id") == F.col("_chat"))
    place, whole = F.struct("started_at", "chunk_id"), F.struct(*SUMMARY)
    around = room.agg(
        F.max_by(F.when(place < F.col("_key"), whole), F.when(place < F.col("_key"), place)).alias("previous"),
        F.min_by(F.when(place > F.col("_key"), whole), F.when(place > F.col("_key"), place)).alias("next"),
    )
    inside = children.filter(F.col("chunk_id") == chunk_id).agg(F.array_sort(F.collect_set("parent_id")).alias("window_ids"))
    return mine.crossJoin(F.broadcast(around)).crossJoin(F.broadcast(inside))


def chat_identity(messages: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(chat_id, chat_name, peers_later): how many other rooms of the name have a later last message.

    Rooms are counted by name and time before anything is sorted.  Of a name that very
    many rooms have, a window holds one number for each slice of time, or the different
    times within one slice.
    """
    last = messages.groupBy("chat_id", "chat_name").agg(F.max("timestamp").alias("t"))
    mine = messages.groupBy("chat_id").agg(F.max("timestamp").alias("t"), F.min_by("chat_name", F.struct("timestamp", "message_id")).alias("chat_name"))
    marks = last.select(F.col("chat_name").alias("n"), "t", F.lit(1).alias("one")).unionByName(mine.select(F.col("chat_name").alias("n"), "t", F.lit(0).alias("one")))
    times = marks.groupBy("n", "t").agg(F.sum("one").alias("c")).withColumn("slice", slice_of(F.col("t"), slice_seconds))
    before = (Window.unboundedPreceding, -1)
    slices = times.groupBy(F.col("n").alias("_n"), F.col("slice").alias("_s")).agg(F.sum("c").alias("_c"))
    slices = slices.withColumn("_later", F.coalesce(F.sum("_c").over(Window.partitionBy("_n").orderBy(F.col("_s").desc()).rowsBetween(*before)), F.lit(0))).drop("_c")
    times = times.withColumn("_in", F.coalesce(F.sum("c").over(Window.partitionBy("n", "slice").orderBy(F.col("t").desc()).rowsBetween(*before)), F.lit(0)))
    later = times.join(slices, F.col("n").eqNullSafe(F.col("_n")) & (F.col("slice") == F.col("_s")))
    later = later.select(F.col("n").alias("_n"), F.col("t").alias("_t"), (F.col("_later") + F.col("_in")).cast("bigint").alias("peers_later"))
    rows = mine.join(later, F.col("chat_name").eqNullSafe(F.col("_n")) & (F.col("t") == F.col("_t")))
    return rows.select("chat_id", "chat_name", "peers_later")


def validate_room_name(spark, room: str) -> None:
    """Raise if the name holds control or invisible characters, naming them."""
    bad = spark.range(1).select(untypable(F.lit(room)).alias("bad")).first()["bad"]
    if bad:
        raise BadRoomName("the name holds characters that can't be typed: " + ", ".join(bad))

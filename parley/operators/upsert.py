"""Upserts, change detection and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.schema import MESSAGE_KEY, MESSAGE_VALUES

FIRST = "_first"


def latest_of_batch(batch: DataFrame, key: list[str], ordinal: str | None = None, first: list[str] = ()) -> DataFrame:
    """One row of each key: the last by the input's ordinal, which isn't kept; the greatest row where there is none.

    With ``first``, also the column FIRST: of the key's first row, its place in the
    input (by ordinal, else by time and key) and these columns.
    """
    others = [c for c in batch.columns if c not in key and c != ordinal]
    rank = F.struct(ordinal, *others) if ordinal else F.struct(*others)
    found = [F.max_by(F.struct(*others), rank).alias("_r")]
    if first:
        place = F.struct(ordinal) if ordinal else F.struct("timestamp", *key)
        found.append(F.min(F.struct(place.alias("place"), *first)).alias(FIRST))
    picked = batch.groupBy(*key).agg(*found)
    return picked.select(*key, *(F.col("_r")[c].alias(c) for c in others), *([FIRST] if first else []))


def first_of_rooms(batch: DataFrame) -> DataFrame:
    """(chat_id, chat_name, chat_type): each room of a batch of latest_of_batch as the batch's first message of it has it."""
    return batch.groupBy("chat_id").agg(F.min(FIRST).alias("_f")).select("chat_id", "_f.chat_name", "_f.chat_type")


def differs(old: str, new: str, columns: list[str]) -> Column:
    """Does any of the columns differ, null being equal to null?"""
    return reduce(lambda a, b: a | b, (~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in columns))


def changes(archive: DataFrame, batch: DataFrame, key: list[str] = MESSAGE_KEY, values: list[str] = MESSAGE_VALUES) -> DataFrame:
    """The batch's rows with ``change`` (inserted, updated or unchanged) and the old row's ``old_timestamp`` if messages.

    The batch must hold each key once.
    """
    o, n = archive.alias("o"), batch.alias("n")
    on = reduce(lambda a, b: a & b, (F.col(f"o.{c}") == F.col(f"n.{c}") for c in key))
    joined = n.join(o, on, "left")
    change = F.when(F.col(f"o.{key[0]}").isNull(), "inserted").when(differs("o", "n", values), "updated").otherwise("unchanged")
    old = [F.col("o.timestamp").alias("old_timestamp")] if "timestamp" in values else []
    return joined.select(*(F.col(f"n.{c}").alias(c) for c in [*key, *values]), change.alias("change"), *old)


def merged(archive: DataFrame, batch: DataFrame, key: list[str] = MESSAGE_KEY, values: list[str] = MESSAGE_VALUES) -> DataFrame:
    """The archive after the upsert: the batch's row where it has the key, else the archive's."""
    kept = archive.join(batch.select(*key), key, "left_anti").select(*key, *values)
    return kept.unionByName(batch.select(*key, *values))


def chats_of(messages: DataFrame, ordinal: str | None = None) -> DataFrame:
    """(chat_id, chat_name, chat_type): each room once, as its first message has it."""
    rank = F.col(ordinal) if ordinal else F.struct("timestamp", "message_id", "account_hash")
    return messages.groupBy("chat_id").agg(F.min_by("chat_name", rank).alias("chat_name"), F.min_by("chat_type", rank).alias("chat_type"))


def sync_cursor(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(source_id, cursor_value): the latest message time of each account, never before what is stored."""
    new = batch.groupBy(F.col("account_hash").alias("source_id")).agg(F.max("timestamp").alias("cursor_value"))
    if stored is None:
        return new
    both = new.unionByName(stored.select("source_id", "cursor_value"))
    return both.groupBy("source_id").agg(F.max("cursor_value").alias("cursor_value"))


def touched_chats(changed: DataFrame) -> DataFrame:
    """(chat_id, earliest, inserted, updated): each room with a change, from the earliest of old and new times on."""
    hit = changed.filter("change <> 'unchanged'").withColumn("_at", F.least("timestamp", F.coalesce("old_timestamp", "timestamp")))
    return hit.groupBy("chat_id").agg(
        F.min("_at").alias("earliest"),
        F.count(F.when(F.col("change") == "inserted", 1)).alias("inserted"),
        F.count(F.when(F.col("change") == "updated", 1)).alias("updated"),
    )


def sync_counts(changed: DataFrame) -> DataFrame:
    """One row: how many rows were inserted, updated, unchanged."""
    return changed.agg(*(F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("inserted", "updated", "unchanged")))


def deletions(archive: DataFrame, source: DataFrame) -> DataFrame:
    """Archived messages within the span of their room in the source, edges included, that the source doesn't have.

    Rooms that the source doesn't mention are left alone.
    """
    span = source.groupBy("account_hash", "chat_id").agg(F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi"))
    inside = archive.join(span, ["account_hash", "chat_id"]).filter(F.col("timestamp").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return inside.join(source.select(*MESSAGE_KEY), MESSAGE_KEY, "left_anti")


def replace_tail(chunks: DataFrame, rebuilt: DataFrame, floors: DataFrame, at_floor: bool = False) -> DataFrame:
    """Chunks with those of the touched rooms from their floor on replaced; a null floor replaces the whole room.  ``at_floor``: what starts at the floor stays."""
    f = floors.select(F.col("chat_id").alias("_chat"), F.col("floor").alias("_floor"))
    beyond = F.col("started_at") > F.col("_floor") if at_floor else F.col("started_at") >= F.col("_floor")
    gone = (F.col("chat_id") == F.col("_chat")) & (F.col("_floor").isNull() | beyond)
    return chunks.join(f, gone, "left_anti").unionByName(rebuilt.select(*chunks.columns))


def first_of_sources(frames: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """The union of several databases' rows: of each key the row of the first database, then in order."""
    tagged = [f.withColumn("_db", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    rank = Window.partitionBy(key).orderBy("_db", *order)
    return rows.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n", "_db").orderBy(*order)

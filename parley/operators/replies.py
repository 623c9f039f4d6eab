"""The reply graph between messages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "parent_not_in_archive"
#: What an edge is, of a message's account and room, and what follows from where its ends are.
EDGE = ["account_hash", "chat_id", "child_message_id", "parent_message_id"]
OWNED = ["child_chunk_id", "parent_chunk_id", "unresolved_reason"]


def owner_of(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(message_id, chunk_id): the chunk of each message, or of those ``wanted``, the least where there are several."""
    each = chunks.select(F.explode("message_ids").alias("message_id"), "chunk_id")
    each = each if wanted is None else each.join(wanted, "message_id", "left_semi")
    return each.groupBy("message_id").agg(F.min("chunk_id").alias("chunk_id"))


def edges_of(messages: DataFrame) -> DataFrame:
    """The columns EDGE of every reply."""
    ends = [F.col("message_id").alias("child_message_id"), F.col("reply_to_message_id").alias("parent_message_id")]
    return messages.filter("reply_to_message_id is not null").select("account_hash", "chat_id", *ends).distinct()


def with_owners(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges with the columns OWNED; ``owners`` has one chunk of each message_id."""
    child = owners.select(F.col("message_id").alias("child_message_id"), F.col("chunk_id").alias("child_chunk_id"))
    parent = owners.select(F.col("message_id").alias("parent_message_id"), F.col("chunk_id").alias("parent_chunk_id"))
    edges = edges.join(child, "child_message_id", "left").join(parent, "parent_message_id", "left")
    return edges.select(*EDGE, "child_chunk_id", "parent_chunk_id", F.when(F.col("parent_chunk_id").isNull(), MISSING).alias("unresolved_reason"))


def reply_edges(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every reply with the chunks of both ends, and a reason where the parent isn't there."""
    edges = messages.filter("reply_to_message_id is not null").select(
        F.col("message_id").alias("child_message_id"), F.col("reply_to_message_id").alias("parent_message_id")
    )
    edges = edges.distinct()
    wanted = edges.select(F.explode(F.array("child_message_id", "parent_message_id")).alias("message_id")).distinct()
    owners = owner_of(chunks, wanted)
    child = owners.select(F.col("message_id").alias("child_message_id"), F.col("chunk_id").alias("child_chunk_id"))
    parent = owners.select(F.col("message_id").alias("parent_message_id"), F.col("chunk_id").alias("parent_chunk_id"))
    edges = edges.join(child, "child_message_id", "left").join(parent, "parent_message_id", "left")
    reason = F.when(F.col("parent_chunk_id").isNull(), MISSING)
    return edges.select("child_message_id", "parent_message_id", "child_chunk_id", "parent_chunk_id", reason.alias("unresolved_reason"))


def chunk_parent_refs(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (child_chunk_id, parent_chunk_id) of replies between different chunks."""
    edges = reply_edges(messages, chunks).filter("parent_chunk_id is not null and child_chunk_id <> parent_chunk_id")
    return edges.select("child_chunk_id", "parent_chunk_id").distinct()


def touching_refs(refs: DataFrame, chunks: DataFrame, touched: DataFrame) -> DataFrame:
    """The refs with either end in a touched room (``touched``: chat_id)."""
    inside = chunks.join(touched.select("chat_id").distinct(), "chat_id", "left_semi").select(F.col("chunk_id").alias("_c"))
    by_child = refs.join(inside, F.col("child_chunk_id") == F.col("_c"), "left_semi")
    by_parent = refs.join(inside, F.col("parent_chunk_id") == F.col("_c"), "left_semi")
    return by_child.unionByName(by_parent).distinct()

"""Messages from an application's tables.

The tables: rooms (chatId, linkId, type, chatName, activeMembersCount,
directChatMemberUserId, displayMemberIds), users (userId, friendNickName, nickName,
displayName), messages (chatId, logId, authorId, type, supplement, attachment,
message, sentAt), meta (chatId, type, revision, content) and links (linkId,
linkName).  meta, links and the column displayMemberIds may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.jsonpath import reply_parent
from parley.functions.plist import int_arrays
from parley.operators.upsert import first_of_sources
from parley.schema import MESSAGES

#: A name made of members lists so many at most.
MAX_MEMBERS = 8
SELF_NAME = "나"


def filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def room_class(room_type: Column, direct_member: Column, active: Column) -> Column:
    """``direct`` or ``group``."""
    direct = room_type.isin(0, 2) | (direct_member > 0) | (active == 2)
    return F.when(F.coalesce(direct, F.lit(False)), "direct").otherwise("group")


def user_names(users: DataFrame) -> DataFrame:
    """(userId, name): the first non-empty of friend name, display name and nickname; of several rows the least by name."""
    named = users.select("userId", F.coalesce(filled("friendNickName"), filled("displayName"), filled("nickName")).alias("name")).filter("name is not null")
    return named.groupBy("userId").agg(F.min("name").alias("name"))


def latest_titles(meta: DataFrame) -> DataFrame:
    """(chatId, title): of a room's titles the one of the highest revision, then the greatest."""
    rows = meta.filter((F.col("type") == 3) & filled("content").isNotNull())
    return rows.groupBy("chatId").agg(F.max_by("content", F.struct("revision", "content")).alias("title"))


def link_names(rooms: DataFrame, links: DataFrame) -> DataFrame:
    """(chatId, link_name) of rooms behind a named link."""
    named = links.filter(filled("linkName").isNotNull()).groupBy("linkId").agg(F.max("linkName").alias("link_name"))
    return rooms.filter("linkId <> 0").select("chatId", "linkId").join(named, "linkId").select("chatId", "link_name")


def member_names(rooms: DataFrame, names: DataFrame, self_id: int) -> DataFrame:
    """(chatId, members): the known names of the display members but oneself, at most MAX_MEMBERS, joined."""
    each = rooms.select("chatId", F.posexplode(int_arrays(F.col("displayMemberIds"))).alias("pos", "userId")).filter(F.col("userId") != self_id)
    known = each.join(names, "userId")
    top = Window.partitionBy("chatId").orderBy("pos")
    known = known.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= MAX_MEMBERS)
    lists = known.groupBy("chatId").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("l"))
    return lists.select("chatId", F.array_join(F.transform("l", lambda x: x["name"]), ", ").alias("members"))


def room_table(rooms: DataFrame, users: DataFrame, self_id: int, meta: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(chatId, chat_name, chat_type): room name, else title, link name, direct peer, members, ``chat-<id>``."""
    names = user_names(users)
    peers = names.select(F.col("userId").alias("_u"), F.col("name").alias("peer"))
    peer_id = F.col("directChatMemberUserId")
    rows = rooms.join(peers, (peer_id == F.col("_u")) & (peer_id != 0) & (peer_id != self_id), "left")
    steps = [filled("chatName")]
    if meta is not None:
        rows = rows.join(latest_titles(meta), "chatId", "left")
        steps.append(F.col("title"))
    if links is not None:
        rows = rows.join(link_names(rooms, links), "chatId", "left")
        steps.append(F.col("link_name"))
    steps.append(F.col("peer"))
    if "displayMemberIds" in rooms.columns:
        rows = rows.join(member_names(rooms, names, self_id), "chatId", "left")
        steps.append(F.col("members"))
    placeholder = F.concat(F.lit("chat-"), F.col("chatId").cast("string"))
    kind = room_class(F.col("type"), peer_id, F.col("activeMembersCount"))
    return rows.select("chatId", F.coalesce(*steps, placeholder).alias("chat_name"), kind.alias("chat_type"))


def account_hash(user_id: int) -> Column:
    return F.sha2(F.lit(str(user_id)), 256)


def normalized(messages: DataFrame, rooms: DataFrame, users: DataFrame, self_id: int, meta: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Application rows as messages; rows without a body or whose numbers can't be read are left out."""
    number = lambda c: F.col(c).cast("string").try_cast("bigint")
    rows = messages.filter(filled("message").isNotNull())
    rows = rows.filter(number("chatId").isNotNull() & number("logId").isNotNull() & number("authorId").isNotNull() & number("type").isNotNull())
    table = room_table(rooms, users, self_id, meta, links).withColumnRenamed("chatId", "_c")
    names = user_names(users).select(F.col("userId").alias("_u"), F.col("name").alias("_name"))
    rows = rows.join(table, F.col("chatId") == F.col("_c"), "left").join(names, F.col("authorId") == F.col("_u"), "left")
    chat, log = F.col("chatId").cast("string"), F.col("logId").cast("string")
    seconds = F.col("sentAt").cast("string").try_cast("double").try_cast("bigint")
    valid = seconds.between(-62_135_596_800, 253_402_300_799)
    parent = F.coalesce(reply_parent(F.col("attachment")), reply_parent(F.col("supplement")))
    unknown = F.when(F.col("authorId") == self_id, SELF_NAME).otherwise(F.concat(F.lit("user-"), F.col("authorId").cast("string")))
    return rows.select(
        account_hash(self_id).alias("account_hash"),
        chat.alias("chat_id"),
        F.coalesce("chat_name", F.concat(F.lit("chat-"), chat)).alias("chat_name"),
        F.coalesce("chat_type", F.lit("direct")).alias("chat_type"),
        F.concat_ws("-", chat, log).alias("message_id"),
        F.col("authorId").cast("string").alias("sender_id"),
        F.coalesce("_name", unknown).alias("sender_nickname"),
        F.timestamp_seconds(F.when(valid, seconds).otherwise(0)).alias("timestamp"),
        F.col("message").alias("text"),
        F.when(F.col("type") == 1, "text").otherwise(F.concat(F.lit("type_"), F.col("type").cast("string"))).alias("message_type"),
        F.when(parent != F.col("logId"), F.concat_ws("-", chat, parent.cast("string"))).alias("reply_to_message_id"),
    ).select(*(f.name for f in MESSAGES.fields))


def unreadable(messages: DataFrame) -> DataFrame:
    """One row: how many rows with a body can't be read."""
    number = lambda c: F.col(c).cast("string").try_cast("bigint")
    bad = number("chatId").isNull() | number("logId").isNull() | number("authorId").isNull() | number("type").isNull()
    return messages.filter(filled("message").isNotNull()).agg(F.count(F.when(bad, 1)).alias("skipped"))


def merged_messages(databases: list[DataFrame]) -> DataFrame:
    """Messages of several databases: of each id the first database's, by room and time."""
    return first_of_sources(databases, "message_id", ["chat_id", "timestamp", "message_id"])

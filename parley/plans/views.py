"""The driver's tables seen as messages, rooms and attachments, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.schema import MESSAGES
from parley.shared import shared_root

ACCOUNT = "acct"
#: The instant from which a conversation's times are counted.
BASE = "2024-01-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archived(df: DataFrame) -> DataFrame:
    """The frame as a stored table: the state that an archive would have."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: a room for each type of event."""
    chat = F.concat(F.lit("ev-"), "event_type")
    at = lambda n: F.concat(chat, F.lit("-"), n.cast("string"))
    n = F.col("event_id")
    return load(spark, sf_dir, "events").select(
        F.lit(ACCOUNT).alias("account_hash"),
        chat.alias("chat_id"),
        F.concat(F.lit("Room "), "event_type").alias("chat_name"),
        F.when(F.col("event_type").isin("click", "view"), "group").otherwise("direct").alias("chat_type"),
        at(n).alias("message_id"),
        F.col("user_id").cast("string").alias("sender_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 2).cast("string")).alias("sender_nickname"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("props").alias("text"),
        F.when(n % 10 == 0, "type_26").otherwise("text").alias("message_type"),
        F.when(n % 11 == 0, at(n - 7)).alias("reply_to_message_id"),
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: a room for each, an hour apart, a turn a minute."""
    conv, turn = F.col("conv_id"), F.col("turn")
    micros = F.unix_micros(F.to_timestamp(F.lit(BASE))) + conv * 3_600_000_000 + turn * 60_000_000
    return load(spark, sf_dir, "conversations").select(
        F.lit(ACCOUNT).alias("account_hash"),
        conv.cast("string").alias("chat_id"),
        F.concat(F.lit("Talk "), conv.cast("string")).alias("chat_name"),
        F.lit("direct").alias("chat_type"),
        F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("message_id"),
        F.col("role").alias("sender_id"),
        F.col("role").alias("sender_nickname"),
        F.timestamp_micros(micros).alias("timestamp"),
        "text",
        F.lit("text").alias("message_type"),
        F.lit(None).cast("string").alias("reply_to_message_id"),
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of one message each, a room for each source."""
    doc = F.col("doc_id")
    at = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(BASE))) + doc * 3_600_000_000)
    return load(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), doc.cast("string")).alias("chunk_id"),
        F.lit(ACCOUNT).alias("account_hash"),
        F.col("source").alias("chat_id"),
        F.col("source").alias("chat_name"),
        F.col("lang").alias("sender_nickname"),
        at.alias("started_at"),
        at.alias("ended_at"),
        "text",
        F.array(doc.cast("string")).alias("message_ids"),
        F.lit(1).cast("bigint").alias("message_count"),
    )


def older_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the event messages: without the last ten days, some texts and names before their edit."""
    rows = event_messages(spark, sf_dir)
    last = rows.agg((F.max("timestamp") - F.expr("INTERVAL 10 DAYS")).alias("_last"))
    rows = rows.crossJoin(F.broadcast(last)).filter("timestamp < _last").drop("_last")
    edited = F.left(F.md5("message_id"), F.lit(1)) == "0"
    return rows.withColumn("text", F.when(edited, F.concat("text", F.lit(" (draft)"))).otherwise(F.col("text"))).select(*(f.name for f in MESSAGES.fields))


def app_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an application's rooms."""
    k = F.col("c_custkey").cast("bigint")
    return load(spark, sf_dir, "customer").select(
        k.alias("chatId"),
        F.col("c_nationkey").cast("bigint").alias("linkId"),
        (k % 5).alias("type"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise("").alias("chatName"),
        (k % 7).alias("activeMembersCount"),
        F.when(k % 3 == 0, k % 50).otherwise(0).alias("directChatMemberUserId"),
    )


def app_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as users; some have only one of their names."""
    k = F.col("s_suppkey").cast("bigint")
    return load(spark, sf_dir, "supplier").select(
        k.alias("userId"),
        F.when(k % 3 == 0, F.concat(F.lit("Friend "), "s_name")).otherwise("").alias("friendNickName"),
        F.when(k % 2 == 0, F.col("s_name")).alias("displayName"),
        F.when(k % 5 != 0, F.concat(F.lit("Nick "), k.cast("string"))).otherwise("").alias("nickName"),
    )


def app_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the history of room titles."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("bigint").alias("chatId"),
        F.when(F.col("o_orderstatus") == "F", 3).otherwise(1).cast("bigint").alias("type"),
        (F.col("o_orderkey").cast("bigint") % 17).alias("revision"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat_ws(" ", F.lit("Title"), F.col("o_orderkey").cast("string"))).otherwise("").alias("content"),
    )


def app_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as open links."""
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("linkId"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("linkName"))


def app_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an application's message rows, some with reply metadata."""
    k = F.col("o_orderkey").cast("bigint")
    before = (k - 3).cast("string")
    attachment = (
        F.when(k % 6 == 0, F.concat(F.lit('{"src_logId":'), before, F.lit("}")))
        .when(k % 6 == 1, F.concat(F.lit('{"reply":{"srcLogId":" '), before, F.lit(' "},"src_logId":1}')))
        .when(k % 6 == 2, F.concat(F.lit('{"logId":'), before, F.lit("}")))
        .when(k % 6 == 3, F.lit('{"src_logId":'))
    )
    supplement = F.when(k % 4 == 0, F.concat(F.lit('{"parent":{"parentLogId":"'), before, F.lit('"}}'))).when(k % 4 == 1, F.lit('[{"src_logId":5}]'))
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("bigint").alias("chatId"),
        k.alias("logId"),
        (k % 120).alias("authorId"),
        F.when(k % 9 == 0, 26).otherwise(1).cast("bigint").alias("type"),
        supplement.alias("supplement"),
        attachment.alias("attachment"),
        F.when(k % 8 != 0, F.col("o_orderpriority")).otherwise("").alias("message"),
        F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).cast("bigint").alias("sentAt"),
    )


def media_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as message rows with attachments of every kind; these are made after repeated rows are gone, so that they aren't shuffled."""
    sent = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1_000_000).cast("bigint")
    numbers = [F.col(f"l_{c}").cast("bigint").alias(a) for c, a in (("orderkey", "_o"), ("linenumber", "_n"), ("suppkey", "authorId"))]
    rows = load(spark, sf_dir, "lineitem").select(*numbers, sent.alias("sentAt")).distinct()
    o, n = F.col("_o"), F.col("_n")
    log = o * 10 + n
    t = lambda c: c.cast("string")
    digest = F.sha1(t(log).cast("binary"))
    url = F.concat(F.lit("https://cdn.example/"), t(log), F.lit("?credential=a&expires="), t(F.lit(1_700_000_000) + log % 1000 * 1_000_000), F.lit("&x=1"))
    one = F.concat(F.lit('{"w":'), t(n * 100), F.lit(',"h":" '), t(n * 50), F.lit('","cs":"'), digest, F.lit('","s":'), t(log * 1000), F.lit(',"url":"'), url, F.lit('"}'))
    album = F.concat(F.lit('{"wl":[1,"2"],"hl":[3],"csl":["'), digest, F.lit('",""],"sl":['), t(log), F.lit('.7,5],"imageUrls":["'), url, F.lit('"]}'))
    item = F.concat(F.lit('{"name":"report '), t(log), F.lit('.pdf","size":'), t(log * 10), F.lit(',"s":1,"cs":"'), F.when(n % 2 == 0, F.upper(digest)).otherwise(""), F.lit('","url":"'), url, F.lit('"}'))
    kind = F.when(n == 1, 2).when(n == 2, 3).when(n == 3, 18).when(n == 4, 27).when(n == 5, 2).otherwise(1)
    body = F.when(n == 3, item).when(n == 4, album).when(n == 5, '{"w":1').otherwise(one)
    return rows.select(
        (o % 97).alias("chatId"),
        log.alias("logId"),
        "authorId",
        kind.cast("bigint").alias("type"),
        "sentAt",
        body.alias("attachment"),
    )


def media_probes(frames: DataFrame) -> DataFrame:
    """What a cache and a network would have given for frames: a fixed mix of outcomes."""
    log = F.col("logId")
    return frames.select(
        "chatId",
        "logId",
        "idx",
        (log % 19 == 0).alias("existing"),
        (log % 5 == 0).alias("full_cached"),
        (log % 10 == 0).alias("full_ok"),
        (log % 3 == 0).alias("thumb_cached"),
        (log % 6 == 0).alias("thumb_ok"),
        (log % 7 != 0).alias("fetched_ok"),
    ).distinct()


EV = """
ev AS (
  SELECT 'acct' AS account_hash, 'ev-' || event_type AS chat_id, 'Room ' || event_type AS chat_name,
         CASE WHEN event_type IN ('click', 'view') THEN 'group' ELSE 'direct' END AS chat_type,
         'ev-' || event_type || '-' || event_id AS message_id, CAST(user_id AS VARCHAR) AS sender_id,
         'u' || (user_id % 2) AS sender_nickname, CAST(ts AS TIMESTAMP) AS "timestamp", props AS text,
         CASE WHEN event_id % 10 = 0 THEN 'type_26' ELSE 'text' END AS message_type,
         CASE WHEN event_id % 11 = 0 THEN 'ev-' || event_type || '-' || (event_id - 7) END AS reply_to_message_id
  FROM events
)"""

CV = """
cv AS (
  SELECT 'acct' AS account_hash, CAST(conv_id AS VARCHAR) AS chat_id, 'Talk ' || conv_id AS chat_name, 'direct' AS chat_type,
         conv_id || '-' || turn AS message_id, role AS sender_id, role AS sender_nickname,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS "timestamp", text, 'text' AS message_type,
         CAST(NULL AS VARCHAR) AS reply_to_message_id
  FROM conversations
)"""

DC = """
dc AS (
  SELECT 'doc-' || doc_id AS chunk_id, 'acct' AS account_hash, source AS chat_id, source AS chat_name, lang AS sender_nickname,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS started_at, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS ended_at,
         text, CAST(1 AS BIGINT) AS message_count, CAST(doc_id AS VARCHAR) AS first_message_id, CAST(doc_id AS VARCHAR) AS message_ids
  FROM documents
)"""


def chunk_ctes(source: str, prefix: str = "") -> str:
    """CTEs ``{prefix}marked`` (messages with a chunk number) and ``{prefix}chunks`` of a message CTE."""
    return f"""
{prefix}lagged AS (
  SELECT *, lag(account_hash) OVER w AS pa, lag(sender_nickname) OVER w AS ps, lag(message_type) OVER w AS pt, lag("timestamp") OVER w AS pts
  FROM {source} WINDOW w AS (PARTITION BY chat_id ORDER BY "timestamp", message_id, account_hash)
), {prefix}flagged AS (
  SELECT *, (pa IS NULL OR pa <> account_hash OR ps <> sender_nickname OR pt <> 'text' OR message_type <> 'text'
             OR datesub('second', pts, "timestamp") > CASE WHEN chat_type = 'group' THEN 600 ELSE 1800 END) AS starts
  FROM {prefix}lagged
), {prefix}marked AS (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY "timestamp", message_id, account_hash ROWS UNBOUNDED PRECEDING) AS seq
  FROM {prefix}flagged
), {prefix}grouped AS (
  SELECT chat_id, seq, min(account_hash) AS account_hash, arg_min(chat_name, ("timestamp", message_id)) AS chat_name, min(sender_nickname) AS sender_nickname,
         min("timestamp") AS started_at, max("timestamp") AS ended_at, string_agg(text, chr(10) ORDER BY "timestamp", message_id) AS text,
         string_agg(message_id, ',' ORDER BY "timestamp", message_id) AS message_ids, count(*) AS message_count,
         arg_min(message_id, ("timestamp", message_id)) AS first_message_id, arg_max(message_id, ("timestamp", message_id)) AS last_message_id
  FROM {prefix}marked GROUP BY chat_id, seq
), {prefix}chunks AS (
  SELECT 'chunk_' || substr(sha256(account_hash || '|' || chat_id || '|' || first_message_id || '|' || last_message_id || '|v1'), 1, 16) AS chunk_id, *
  FROM {prefix}grouped
)"""


def window_ctes(chunks: str, prefix: str = "") -> str:
    """CTEs up to ``{prefix}windows`` of a chunk CTE; needs WITH RECURSIVE."""
    return f"""
{prefix}lined AS (
  SELECT *, '[' || sender_nickname || '] ' || text AS line, length('[' || sender_nickname || '] ' || text) AS n,
         lag(ended_at) OVER (PARTITION BY chat_id ORDER BY started_at, first_message_id, account_hash) AS pe
  FROM {chunks}
), {prefix}burst AS (
  SELECT *, sum(CASE WHEN pe IS NULL OR datesub('second', pe, started_at) > 300 THEN 1 ELSE 0 END)
              OVER (PARTITION BY chat_id ORDER BY started_at, first_message_id, account_hash ROWS UNBOUNDED PRECEDING) AS b
  FROM {prefix}lined
), {prefix}placed AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, b ORDER BY started_at, first_message_id, account_hash) AS pos FROM {prefix}burst
), {prefix}fold(chat_id, b, pos, total, win) AS (
  SELECT chat_id, b, pos, n, 0 FROM {prefix}placed WHERE pos = 1
  UNION ALL
  SELECT p.chat_id, p.b, p.pos, CASE WHEN f.total + 1 + p.n > 3000 THEN p.n ELSE f.total + 1 + p.n END,
         CASE WHEN f.total + 1 + p.n > 3000 THEN f.win + 1 ELSE f.win END
  FROM {prefix}fold f JOIN {prefix}placed p ON p.chat_id = f.chat_id AND p.b = f.b AND p.pos = f.pos + 1
), {prefix}whole AS (
  SELECT p.chat_id, p.b, f.win, arg_min(account_hash, p.pos) AS account_hash, arg_min(chat_name, p.pos) AS chat_name, min(started_at) AS started_at,
         arg_max(ended_at, p.pos) AS ended_at, string_agg(line, chr(10) ORDER BY p.pos) AS whole, sum(message_count) AS messages,
         string_agg(chunk_id, ',' ORDER BY p.pos) AS children, count(*) AS child_count, arg_min(chunk_id, p.pos) AS first_child, arg_max(chunk_id, p.pos) AS last_child
  FROM {prefix}placed p JOIN {prefix}fold f ON p.chat_id = f.chat_id AND p.b = f.b AND p.pos = f.pos GROUP BY p.chat_id, p.b, f.win
), {prefix}pieces AS (
  SELECT *, substr(whole, ordinal * 3000 + 1, 3000) AS text
  FROM (SELECT *, unnest(range(CAST(ceil(length(whole) / 3000.0) AS BIGINT))) AS ordinal FROM {prefix}whole)
), {prefix}windows AS (
  SELECT 'window_' || substr(sha256(account_hash || '|' || chat_id || '|' || first_child || '|' || last_child || '|' || ordinal || '|parent-window-v1' || text), 1, 16) AS parent_id,
         account_hash, chat_id, chat_name, started_at, ended_at, text, CAST(CASE WHEN ordinal = 0 THEN messages ELSE 0 END AS BIGINT) AS message_count,
         CAST(child_count AS BIGINT) AS child_count, children, ordinal
  FROM {prefix}pieces
)"""


OLD = """
old AS (
  SELECT * REPLACE (CASE WHEN substr(md5(message_id), 1, 1) = '0' THEN text || ' (draft)' ELSE text END AS text)
  FROM ev WHERE "timestamp" < (SELECT max("timestamp") - INTERVAL 10 DAYS FROM ev)
)"""

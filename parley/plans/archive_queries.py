"""Queries of sources, of the archive that an engine keeps, of its index and of media files, and their SQL.

Those of an archive write one to a new folder of the shared storage, in the steps that
a user would take, and return what is in it.
"""

from __future__ import annotations

import hashlib
import plistlib
import sys
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import media, navigate, replies, search, transcript, vectors
from parley.operators.chunking import build_chunks
from parley.operators.windows import build_windows, window_children
from parley.plans import queries as q
from parley.plans import views as v
from parley.plans.engine import Engine
from parley.plans.queries import clock, listed, query, sql_clock
from parley.schema import MESSAGES, Config
from parley.sources import tables as app
from parley.sources.adapters import open_source, read_documents
from parley.streaming.chunker import chunk_stream
from parley.streaming.ingest import message_stream, session_counts, sync_stream

MESSAGE_SQL = f"account_hash, chat_id, chat_name, chat_type, message_id, sender_id, sender_nickname, {sql_clock('timestamp')}, text, message_type, reply_to_message_id"


def folder(spark) -> str:
    return f"{v.shared_root(spark)}/parley-{uuid.uuid4().hex}"


def shown_messages(rows: DataFrame) -> DataFrame:
    return rows.select(*(clock(f.name) if f.name == "timestamp" else F.col(f.name) for f in MESSAGES.fields))


def _json(rows: DataFrame):
    return F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


# --- sources --------------------------------------------------------------------------------


@query(f"WITH {v.EV} SELECT {MESSAGE_SQL} FROM ev")
def jsonl_source(spark, d):
    path = folder(spark)
    rows = v.event_messages(spark, d)
    rows.select(_json(rows)).write.text(path)
    return shown_messages(open_source(spark, "fixture", path).messages())


NATION_SQL = f"""nm AS (SELECT 'h' AS account_hash, 'r' || n_regionkey AS chat_id, 'Room' AS chat_name, 'group' AS chat_type, 'n' || n_nationkey AS message_id, 's' AS sender_id, 's' AS sender_nickname,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(n_nationkey AS BIGINT)) AS "timestamp", n_name AS text, 'text' AS message_type, CAST(NULL AS VARCHAR) AS reply_to_message_id FROM nation)
SELECT {MESSAGE_SQL} FROM nm"""


def _nation_messages(spark, d):
    n = F.col("n_nationkey")
    at = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(v.BASE))) + n.cast("bigint") * 60_000_000)
    text = lambda s, *c: F.concat(F.lit(s), *(x.cast("string") for x in c))
    rows = v.load(spark, d, "nation")
    return rows.select(
        F.lit("h").alias("account_hash"), text("r", F.col("n_regionkey")).alias("chat_id"), F.lit("Room").alias("chat_name"), F.lit("group").alias("chat_type"), text("n", n).alias("message_id"),
        F.lit("s").alias("sender_id"), F.lit("s").alias("sender_nickname"), at.alias("timestamp"), F.col("n_name").alias("text"), F.lit("text").alias("message_type"), F.lit(None).cast("string").alias("reply_to_message_id"),
    )


#: About so many rows are in a file of an array.
ARRAY_ROWS = 16_384


def _arrays(rows: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Write rows as files of one JSON array each, rows of a key in one file and in order.

    A file is alone in a folder of its own and its records come in lines, sorted, from one task: no array is
    held whole, and no two can get into one file.
    """
    messages = [f.name for f in MESSAGES.fields]
    files = 1 + rows.count() // ARRAY_ROWS
    made = rows.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("array"), *order, _json(rows.select(*messages)).alias("j"))
    along = Window.partitionBy("array").orderBy(*order)
    before = F.when(F.lag("j").over(along).isNull(), "[").otherwise(",")
    after = F.when(F.lead("j").over(along).isNull(), "]").otherwise("")
    lines = made.withColumn("value", F.concat(before, "j", after)).sortWithinPartitions("array", *order)
    lines.select("array", "value").write.partitionBy("array").text(path)


@query(f"WITH {v.EV} SELECT {MESSAGE_SQL} FROM ev")
def json_array_source(spark, d):
    path = folder(spark)
    _arrays(v.event_messages(spark, d), path, "message_id", ["timestamp", "message_id"])
    return shown_messages(open_source(spark, "array", path).messages())


#: Puts lines of JSON together to an array.
ECHO = "import glob, sys; print('[' + ','.join(line for f in sorted(glob.glob(sys.argv[1] + '/part-*')) for line in open(f)) + ']')"


@query(f"WITH {NATION_SQL}")
def command_source(spark, d):
    path = folder(spark)
    rows = _nation_messages(spark, d)
    rows.select(_json(rows)).write.text(path)
    command = [sys.executable, "-c", ECHO, path.removeprefix("file://")]
    return shown_messages(open_source(spark, "command", command=command).messages())


CUSTOMER_SQL = """SELECT 'k' || c_custkey AS message_id, 'aaa ' || c_name AS text FROM customer"""


def _twice(spark, d) -> DataFrame:
    """Each customer as two messages of one key, of which the later has the lesser text."""
    rows = v.load(spark, d, "customer")
    key = F.col("c_custkey")
    at = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(v.BASE))) + key.cast("bigint") * 60_000_000)
    return rows.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.lit("h").alias("account_hash"), F.concat(F.lit("r"), (key % 40).cast("string")).alias("chat_id"), F.lit("Room").alias("chat_name"), F.lit("group").alias("chat_type"), F.concat(F.lit("k"), key.cast("string")).alias("message_id"),
        F.lit("s").alias("sender_id"), F.lit("s").alias("sender_nickname"), at.alias("timestamp"), F.concat(F.when(F.col("n") == 0, "zzz ").otherwise("aaa "), "c_name").alias("text"), F.lit("text").alias("message_type"),
        F.lit(None).cast("string").alias("reply_to_message_id"), "n",
    )


@query(CUSTOMER_SQL)
def last_row_of_an_array(spark, d):
    engine, path = _engine(spark), folder(spark)
    _arrays(_twice(spark, d), path, "message_id", ["message_id", "n"])
    engine.sync(open_source(spark, "array", path))
    return engine.table("messages").select("message_id", "text")


@query(CUSTOMER_SQL)
def last_line_of_a_stream(spark, d):
    engine = _engine(spark)
    inbox = f"{engine.root}/inbox"
    rows = _twice(spark, d)
    messages = [f.name for f in MESSAGES.fields]
    lines = rows.select("message_id", "n", _json(rows.select(*messages)).alias("j")).repartition(8, "message_id").sortWithinPartitions("message_id", "n")
    lines.select("j").write.text(inbox)
    sync_stream(engine, message_stream(spark, inbox), f"{engine.root}/progress").awaitTermination()
    return engine.table("messages").select("message_id", "text")


@query("SELECT DISTINCT 'r' || c_custkey % 40 AS chat_id, CASE WHEN c_custkey % 40 % 2 = 0 THEN 'New ' || c_custkey % 40 ELSE 'Room' END AS chat_name FROM customer")
def chats_after_a_rename(spark, d):
    engine = _engine(spark)
    rows = _twice(spark, d).filter("n = 1").drop("n")
    engine.sync(rows)
    room = F.substring("chat_id", 2, 9)
    later = rows.filter(room.cast("int") % 2 == 0).withColumns(
        {"message_id": F.concat("message_id", F.lit("-later")), "timestamp": F.col("timestamp") + F.expr("INTERVAL 900 DAYS"), "chat_name": F.concat(F.lit("New "), room)}
    )
    engine.sync(later)
    return engine.table("chats").select("chat_id", "chat_name")


@query("SELECT n_name || '.md' AS name, 'line one' || chr(10) || n_nationkey AS text FROM nation")
def document_folder(spark, d):
    path = folder(spark)
    n = v.load(spark, d, "nation")
    bodies = n.select(F.concat("n_name", F.lit(".md")).alias("name"), F.concat(F.lit("line one\n"), F.col("n_nationkey").cast("string")).cast("binary").alias("body"))
    media.write_bodies(bodies, path).write.format("noop").mode("overwrite").save()
    return read_documents(spark, path)


@query("SELECT count(*) AS skipped FROM orders WHERE o_orderkey % 8 <> 0 AND (o_orderkey % 13 = 0 OR o_orderkey % 17 = 0)")
def unreadable_rows(spark, d):
    rows = v.app_messages(spark, d)
    k = F.col("logId")
    log = F.when(k % 13 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    author = F.when(k % 17 == 0, F.lit(None).cast("bigint")).otherwise(F.col("authorId"))
    return app.unreadable(rows.withColumn("authorId", author).withColumn("logId", log))


@query(
    """WITH u AS (SELECT s_suppkey AS u, CASE WHEN s_suppkey % 3 = 0 THEN 'Friend ' || s_name WHEN s_suppkey % 2 = 0 THEN s_name WHEN s_suppkey % 5 <> 0 THEN 'Nick ' || s_suppkey END AS name FROM supplier),
    m AS (SELECT CAST(c_custkey AS BIGINT) AS k, unnest([c_custkey % 50, 7, c_custkey % 30, 900000, c_custkey % 11]) AS id, unnest([0, 1, 2, 3, 4]) AS pos FROM customer WHERE c_custkey % 4 = 1)
    SELECT k AS "chatId", string_agg(name, ', ' ORDER BY pos) AS members FROM m JOIN u ON u.u = m.id AND name IS NOT NULL WHERE id <> 7 GROUP BY k"""
)
def display_members(spark, d):
    @F.pandas_udf("binary")
    def plist(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: plistlib.dumps([k % 50, 7, k % 30, 900_000, k % 11], fmt=plistlib.FMT_BINARY) if k % 4 == 1 else b"bplist00 damaged")

    rooms = v.app_rooms(spark, d).withColumn("displayMemberIds", plist(F.col("chatId")))
    return app.member_names(rooms, app.user_names(v.app_users(spark, d)), 7)


@query(
    """WITH i AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN chr(8203) || c_name WHEN 1 THEN c_name || chr(7) || chr(8238) ELSE c_name END AS name FROM customer)
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'U+200B' WHEN 1 THEN 'U+0007,U+202E' ELSE '' END AS bad FROM i"""
)
def untypable_names(spark, d):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit("​"), "c_name")).when(k == 1, F.concat("c_name", F.lit("\x07‮"))).otherwise(F.col("c_name"))
    return v.load(spark, d, "customer").select("c_custkey", F.array_join(tx.untypable(name), ",").alias("bad"))


# --- navigation and hits --------------------------------------------------------------------

EV_WINDOWS = f"WITH RECURSIVE {v.EV}, {v.chunk_ctes('ev')}, {v.window_ctes('chunks')}"
#: The chunk that the queries below ask for: the middle one of a room.
ASKED = "asked AS (SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY started_at, chunk_id) AS n, count(*) OVER () AS c FROM chunks WHERE chat_id = 'ev-click') WHERE n = c // 2)"
EACH_CHILD = "each AS (SELECT parent_id, unnest(string_split(children, ',')) AS chunk_id FROM windows)"


def _asked(made: DataFrame) -> str:
    room = made.filter("chat_id = 'ev-click'").select("started_at", "chunk_id")
    n = room.count() // 2
    return room.orderBy("started_at", "chunk_id").limit(n).orderBy(F.col("started_at").desc(), F.col("chunk_id").desc()).first()["chunk_id"]


def _made(spark, d) -> DataFrame:
    return v.archived(build_chunks(v.event_messages(spark, d)))


@query(f"{EV_WINDOWS}, {ASKED} SELECT chunk_id, chat_id, '[redacted]' AS text, '' AS message_ids, CAST(message_count AS BIGINT) AS message_count FROM chunks JOIN asked USING (chunk_id)")
def chunk_redacted(spark, d):
    made = _made(spark, d)
    return navigate.get_chunk(made, _asked(made), redact=True, ids=False).select("chunk_id", "chat_id", "text", listed("message_ids"), "message_count")


@query(f"{EV_WINDOWS}, {ASKED}, {EACH_CHILD} SELECT {q.WINDOW_SQL} FROM windows WHERE parent_id IN (SELECT parent_id FROM each JOIN asked USING (chunk_id))")
def windows_of_a_chunk(spark, d):
    made = _made(spark, d)
    windows = v.archived(build_windows(made))
    return q.shown_windows(navigate.windows_of_chunk(windows, window_children(windows), _asked(made)))


@query(f"{EV_WINDOWS}, w AS (SELECT min(parent_id) AS parent_id FROM windows) SELECT {q.WINDOW_SQL} FROM windows JOIN w USING (parent_id)")
def window_by_id(spark, d):
    windows = v.archived(build_windows(_made(spark, d)))
    return q.shown_windows(navigate.get_window(windows, windows.agg(F.min("parent_id")).first()[0]))


@query(
    f"""{EV_WINDOWS}, {ASKED}, {EACH_CHILD}, n AS (SELECT chunk_id, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM chunks WHERE chat_id = 'ev-click' WINDOW w AS (ORDER BY started_at, chunk_id))
    SELECT n.*, (SELECT string_agg(DISTINCT parent_id, ',' ORDER BY parent_id) FROM each JOIN asked USING (chunk_id)) AS window_ids FROM n JOIN asked USING (chunk_id)"""
)
def context_of_a_chunk(spark, d):
    made = _made(spark, d)
    found = navigate.chunk_context(made, window_children(build_windows(made)), _asked(made))
    return found.select("chunk_id", F.col("previous.chunk_id").alias("previous_id"), F.col("next.chunk_id").alias("next_id"), listed("window_ids"))


@query(
    f"""{q.EV_CHUNKS}, {q.EDGES}, t AS (SELECT *, row_number() OVER (ORDER BY started_at, chunk_id) AS rank FROM chunks WHERE contains(text, '"k": 1')),
    p AS (SELECT child_chunk_id AS chunk_id, string_agg(parent_chunk_id, ',' ORDER BY parent_chunk_id) AS parent_chunk_ids FROM refs GROUP BY 1)
    SELECT rank, chunk_id, coalesce(parent_chunk_ids, '') AS parent_chunk_ids FROM t LEFT JOIN p USING (chunk_id) WHERE rank <= 500"""
)
def hits_with_reply_parents(spark, d):
    rows = v.event_messages(spark, d)
    made = v.archived(build_chunks(rows))
    found = search.keyword_search(made, '"k": 1', 500, refs=replies.chunk_parent_refs(rows, made))
    return found.select("rank", "chunk_id", listed("parent_chunk_ids"))


# --- an engine's archive and index ----------------------------------------------------------


def _engine(spark, config: Config | None = None) -> Engine:
    return Engine(spark, folder(spark), config or Config(vector_dimension=64))


def _synced(spark, d) -> Engine:
    """An archive of an earlier state that the newer one was synced into."""
    engine = _engine(spark)
    engine.sync(v.older_messages(spark, d))
    engine.sync(v.event_messages(spark, d))
    return engine


@query(f"{q.EV_CHUNKS} SELECT {q.CHUNK_SQL} FROM chunks")
def archive_chunks(spark, d):
    return q.shown_chunks(_synced(spark, d).table("chunks"))


@query(f"{EV_WINDOWS}, {EACH_CHILD} SELECT parent_id, chunk_id FROM each")
def archive_window_children(spark, d):
    return _synced(spark, d).table("window_children").select("parent_id", "chunk_id")


@query(f"{q.EV_CHUNKS}, {q.EDGES} SELECT * FROM edges")
def archive_reply_edges(spark, d):
    return _synced(spark, d).table("reply_edges").drop("chat_id")


@query(
    f"""WITH {v.EV}, s AS (SELECT * FROM ev WHERE chat_id = 'ev-click' AND CAST(sender_id AS BIGINT) % 5 <> 0), span AS (SELECT min("timestamp") AS a, max("timestamp") AS b FROM s)
    SELECT {MESSAGE_SQL} FROM ev WHERE chat_id <> 'ev-click' OR CAST(sender_id AS BIGINT) % 5 <> 0 OR "timestamp" NOT BETWEEN (SELECT a FROM span) AND (SELECT b FROM span)"""
)
def archive_after_pruning(spark, d):
    engine = _engine(spark)
    rows = v.event_messages(spark, d)
    engine.sync(rows)
    engine.sync(rows.filter("chat_id = 'ev-click' and cast(sender_id as bigint) % 5 <> 0"), prune="delete")
    return shown_messages(engine.table("messages"))


@query(f"WITH RECURSIVE {v.EV}, {v.chunk_ctes('ev').replace('THEN 600 ELSE 1800', 'THEN 60 ELSE 120')} SELECT {q.CHUNK_SQL} FROM chunks")
def chunks_after_a_change_of_settings(spark, d):
    first = _engine(spark)
    first.sync(v.event_messages(spark, d))
    engine = Engine(spark, first.root, Config(chunk_gap_group_seconds=60, chunk_gap_direct_seconds=120))
    engine.sync(v.event_messages(spark, d).limit(0))
    return q.shown_chunks(engine.table("chunks"))


@query(f"WITH {v.EV} SELECT {MESSAGE_SQL} FROM ev")
def streamed_messages(spark, d):
    engine = _engine(spark)
    inbox = f"{engine.root}/inbox"
    for rows in (v.older_messages(spark, d), v.event_messages(spark, d)):
        rows.select(_json(rows)).write.mode("append").text(inbox)
        sync_stream(engine, message_stream(spark, inbox), f"{engine.root}/progress").awaitTermination()
    return shown_messages(engine.table("messages"))


@query(q.ORACLES["chunks"])
def streamed_chunks(spark, d):
    """Chunks as they come out of a stream of the earlier half, of the later, and of a message long after that ends all."""
    root, rows = folder(spark), v.event_messages(spark, d)
    middle = rows.agg(F.percentile_approx("timestamp", 0.5)).first()[0]
    end = rows.agg(F.max_by(F.struct("*"), "timestamp").alias("m")).select("m.*").withColumns({"chat_id": F.lit(""), "timestamp": F.col("timestamp") + F.expr("INTERVAL 30 DAYS")})
    for part in (rows.filter(F.col("timestamp") <= F.lit(middle)), rows.filter(F.col("timestamp") > F.lit(middle)), end):
        part.select(_json(part)).write.mode("append").text(f"{root}/inbox")
        found = chunk_stream(message_stream(spark, f"{root}/inbox"))
        stream = found.writeStream.format("parquet").option("checkpointLocation", f"{root}/progress")
        stream.trigger(availableNow=True).start(f"{root}/chunks").awaitTermination()
    return q.shown_chunks(spark.read.schema(found.schema).parquet(f"{root}/chunks").filter("chat_id <> ''"))


@query(
    f"""WITH {v.EV}, g AS (SELECT chat_id, "timestamp" AS t, text, sum(CASE WHEN p IS NULL OR "timestamp" - p >= INTERVAL 10 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT *, lag("timestamp") OVER (PARTITION BY chat_id ORDER BY "timestamp") AS p FROM ev))
    SELECT chat_id, strftime(min(t), '%Y-%m-%d %H:%M:%S.%f') AS started_at, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM g GROUP BY chat_id, s"""
)
def sessions(spark, d):
    found = session_counts(v.event_messages(spark, d))
    return found.select("chat_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started_at"), "messages", "chars")


@query(
    f"""WITH RECURSIVE {v.EV}, {v.OLD}, {v.chunk_ctes('ev')}, {v.window_ctes('chunks')}, {v.chunk_ctes('old', 'o')}, {v.window_ctes('ochunks', 'o')}
    SELECT w.parent_id AS chunk_id, CASE WHEN o.parent_id IS NULL THEN 'embed' ELSE 'reuse' END AS action, w.parent_id || '.md' AS path
    FROM windows w LEFT JOIN owindows o ON o.parent_id = w.parent_id AND sha256(o.text) = sha256(w.text)"""
)
def index_plan(spark, d):
    engine = _engine(spark)
    engine.sync(v.older_messages(spark, d))
    engine.index()
    engine.sync(v.event_messages(spark, d))
    return engine.index(dry_run=True)


@query(f"{EV_WINDOWS} SELECT parent_id AS chunk_id, sha256(text) AS content_hash, chat_name AS heading_path, CAST(64 AS INTEGER) AS places FROM windows")
def index_generation(spark, d):
    engine = _engine(spark)
    engine.sync(v.event_messages(spark, d))
    engine.index()
    return engine.index_store.vectors().select("chunk_id", "content_hash", "heading_path", F.size("vector").alias("places"))


@query(f"{EV_WINDOWS} SELECT parent_id AS chunk_id, sha256(text) AS content_hash, chat_id, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at FROM windows")
def index_after_a_change(spark, d):
    """The generation after a second sync: parts that it left as they were are taken over, the others made anew."""
    engine = _engine(spark)
    engine.sync(v.older_messages(spark, d))
    engine.index()
    engine.sync(v.event_messages(spark, d))
    engine.index()
    return engine.index_store.vectors().select("chunk_id", "content_hash", "chat_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started_at"))


@query(f"""{EV_WINDOWS}, d AS (SELECT sha256(concat_ws(chr(31), parent_id, sha256(text), CAST(epoch_us(started_at) AS VARCHAR))) AS h, chat_id FROM windows)
    SELECT chat_id, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS low, CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR) AS high, count(*) AS n FROM d GROUP BY chat_id""")
def window_digests(spark, d):
    windows = build_windows(build_chunks(v.event_messages(spark, d)))
    sums = windows.groupBy("chat_id").agg(*vectors.digest_sums(F.col("parent_id"), vectors.content_hash(F.col("text")), F.col("started_at")))
    return sums.select("chat_id", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "n")


@query(
    """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin, round(CAST(embedding[1] AS DOUBLE), 4) AS first FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0"""
)
def vector_upsert(spark, d):
    rows = v.load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    stored, new = rows.filter("chunk_id % 2 = 0").withColumn("origin", F.lit("old")), rows.filter("chunk_id % 3 = 0").withColumn("origin", F.lit("new"))
    size = rows.select(F.size("vector")).first()[0]
    merged = vectors.merged_vectors(stored, new, size)
    return merged.select(F.col("chunk_id").alias("vec_id"), "origin", F.round(F.col("vector")[0].cast("double"), 4).alias("first"))


# --- transcripts and media ------------------------------------------------------------------


@query(f"SELECT file_name, line FROM (SELECT file_name, unnest(string_split(body, chr(10))) AS line FROM ({q.ORACLES['transcripts']})) WHERE line <> ''")
def transcript_files(spark, d):
    path = folder(spark)
    transcript.write_transcripts(q.feeds(spark, d), path)
    return spark.read.text(path).filter("value <> ''").select("file_name", F.col("value").alias("line"))


@query(f"SELECT file_name, octet_length(encode(body)) AS bytes, body FROM ({q.ORACLES['transcripts']})")
def exported_transcripts(spark, d):
    path = folder(spark)
    reports = transcript.export_transcripts(q.feeds(spark, d), path, f"{path}-parts")
    written = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_name"), F.col("value").alias("body"))
    return reports.join(written, F.col("file_name") == F.url_decode("_name")).select("file_name", "bytes", "body")


@query(
    """WITH m AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) % 97 AS c, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS l, l_linenumber AS n, CAST(floor(epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 1000000) AS BIGINT) AS t FROM lineitem WHERE l_linenumber IN (1, 2)),
    b AS (SELECT c, l, t FROM m WHERE l % 3 <> 0 UNION ALL SELECT c, l, t + 86400 FROM m WHERE l % 2 = 0), k AS (SELECT c, l, max(t) AS t FROM b GROUP BY c, l),
    r AS (SELECT *, row_number() OVER (ORDER BY t DESC, l DESC) AS n FROM k) SELECT c AS "chatId", l AS "logId", t AS "sentAt" FROM r WHERE n <= 300"""
)
def media_of_two_databases(spark, d):
    rows = media.media_rows(v.media_messages(spark, d).filter("type in (2, 3) and attachment <> '{\"w\":1'"))
    one = rows.filter("logId % 3 <> 0")
    two = rows.filter("logId % 2 = 0").withColumn("sentAt", F.col("sentAt") + 86_400)
    return media.merged_media_rows([one, two], 300).select("chatId", "logId", "sentAt")


@query(
    f"""WITH {q.MEDIA}, p AS (SELECT "chatId", "logId", idx, sha1(reverse(CAST("chatId" AS VARCHAR))) || '/' || sha1(reverse(output_stem)) || '.img' AS tail FROM mf)
    SELECT "chatId", "logId", idx, CASE WHEN "logId" % 6 = 0 THEN '/one/' || tail WHEN "logId" % 4 = 0 THEN '/two/' || tail END AS cached_path FROM p"""
)
def first_cached_paths(spark, d):
    frames = media.media_frames(v.media_messages(spark, d).filter(F.col("type").isin(media.types_of([]))))
    place = lambda root, each: F.when(F.col("logId") % each == 0, media.cache_path(root, F.col("chatId"), F.col("output_stem"), ".img"))
    listing = frames.select(F.explode(F.array_compact(F.array(place("/one", 6), place("/two", 4)))).alias("path"))
    return media.first_cached(frames, F.col("output_stem"), ".img", ["/one", "/two"], listing).select("chatId", "logId", "idx", "cached_path")


@query(
    """WITH p AS (SELECT s_suppkey AS k, sha1(reverse(CAST(s_suppkey % 7 AS VARCHAR))) || '/' || sha1(reverse('p' || s_suppkey)) || '.img' AS tail, s_name FROM supplier)
    SELECT k, CASE WHEN k % 6 = 0 THEN 'one/' || tail WHEN k % 4 = 0 THEN 'two/' || tail END AS cached_path, CASE WHEN k % 12 = 0 THEN 2 WHEN k % 6 = 0 OR k % 4 = 0 THEN 1 ELSE 0 END AS copies FROM p"""
)
def listed_cache_files(spark, d):
    """Which suppliers' bodies lie below two cache folders, by a listing of their files."""
    k, root = F.col("s_suppkey"), folder(spark)
    rows = v.load(spark, d, "supplier").select("s_suppkey", "s_name", (k % 7).alias("chatId"), k.alias("logId"), F.lit(0).alias("idx"), F.concat(F.lit("p"), k.cast("string")).alias("stem"))
    for name, each in (("one", 6), ("two", 4)):
        paths = media.cache_path("", F.col("chatId"), F.col("stem"), ".img")
        bodies = rows.filter(k % each == 0).select(paths.alias("p"), F.col("s_name").cast("binary").alias("body"))
        for room in range(7):  # a folder for each room
            mine = bodies.filter(F.split("p", "/")[1] == F.sha1(F.lit(str(room)).cast("binary")))
            media.write_bodies(mine.select(F.split("p", "/")[2].alias("name"), "body"), f"{root}/{name}/" + hashlib.sha1(str(room).encode()).hexdigest()).write.format("noop").mode("overwrite").save()
    roots = [f"{root}/one", f"{root}/two"]
    listing = media.cache_listing(spark, roots)
    found = media.first_cached(rows, F.col("stem"), ".img", roots, listing)
    tail = F.substring_index("path", "/", -2)
    copies = listing.groupBy(tail.alias("_t")).agg(F.count(F.lit(1)).alias("copies"))
    found = found.withColumn("_own", F.substring_index(media.cache_path("", F.col("chatId"), F.col("stem"), ".img"), "/", -2)).join(copies, F.col("_own") == F.col("_t"), "left")
    return found.select(k.alias("k"), F.substring_index("cached_path", "/", -3).alias("cached_path"), F.coalesce("copies", F.lit(0)).alias("copies"))


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AS matches, s_name AS body FROM supplier")
def checked_and_decrypted_bodies(spark, d):
    k = F.col("s_suppkey")
    rows = v.load(spark, d, "supplier").select("s_suppkey", "s_name")
    given = F.when(k % 2 == 0, F.upper(F.sha1(F.col("s_name").cast("binary")))).otherwise(F.sha1(F.lit("x").cast("binary")))
    plain = F.concat(F.repeat(F.lit("w"), F.lit(256)), "s_name").cast("binary")
    iv = F.unhex(F.left(F.md5("s_name"), F.lit(32)))
    cached = F.concat(F.unhex(F.lit("00010203")), F.aes_encrypt(plain, F.unhex(F.sha2(F.lit("pass"), 256)), F.lit("CBC"), F.lit("PKCS"), iv))
    opened = tx.decrypted_body(cached, F.lit("pass")).cast("string")
    return rows.select("s_suppkey", tx.sha1_matches(F.col("s_name").cast("binary"), given).alias("matches"), opened.alias("body"))


@query("SELECT s_name || '.bin' AS name, CAST(length(s_name) AS BIGINT) AS bytes, sha1(s_name) AS checksum_sha1 FROM supplier")
def written_bodies(spark, d):
    rows = v.load(spark, d, "supplier").select(F.concat("s_name", F.lit(".bin")).alias("name"), F.col("s_name").cast("binary").alias("body"))
    path = folder(spark)
    media.write_bodies(rows, path).write.format("noop").mode("overwrite").save()
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").cast("bigint").alias("bytes"), F.sha1("content").alias("checksum_sha1"))

"""One query for each operator over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.functions.jsonpath import reply_parent
from parley.operators import incremental, media, navigate, replies, search, transcript, upsert, vectors
from parley.operators.chunking import build_chunks, chunk_boundaries, chunk_messages
from parley.operators.windows import build_windows, window_children, window_numbers, with_children
from parley.plans import views as v
from parley.sources import tables as app

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def clock(c: str) -> Column:
    """An instant as text, to the microsecond."""
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def sql_clock(c: str) -> str:
    return f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S.%f') AS \"{c}\""


def listed(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


EV_CHUNKS = f"WITH RECURSIVE {v.EV}, {v.chunk_ctes('ev')}"
CV_WINDOWS = f"WITH RECURSIVE {v.CV}, {v.chunk_ctes('cv')}, {v.window_ctes('chunks')}"
DC_WINDOWS = f"WITH RECURSIVE {v.DC}, {v.window_ctes('dc')}"
CHUNK_SQL = f"chunk_id, account_hash, chat_id, chat_name, sender_nickname, {sql_clock('started_at')}, {sql_clock('ended_at')}, text, message_ids, CAST(message_count AS BIGINT) AS message_count"
WINDOW_SQL = f"parent_id, account_hash, chat_id, chat_name, {sql_clock('started_at')}, {sql_clock('ended_at')}, text, message_count, child_count, children AS child_chunk_ids, ordinal"


def shown_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "account_hash", "chat_id", "chat_name", "sender_nickname", clock("started_at"), clock("ended_at"), "text", listed("message_ids"), "message_count")


def shown_windows(windows: DataFrame) -> DataFrame:
    return windows.select("parent_id", "account_hash", "chat_id", "chat_name", clock("started_at"), clock("ended_at"), "text", "message_count", "child_count", listed("child_chunk_ids"), "ordinal")


# --- chunks and windows ---------------------------------------------------------------------


@query(f'{EV_CHUNKS} SELECT chat_id, message_id, {sql_clock("timestamp")}, starts FROM marked')
def chunk_boundary_flags(spark, d):
    return chunk_boundaries(v.event_messages(spark, d)).select("chat_id", "message_id", clock("timestamp"), "starts")


@query(f"{EV_CHUNKS} SELECT {CHUNK_SQL} FROM chunks")
def chunks(spark, d):
    return shown_chunks(build_chunks(v.event_messages(spark, d)))


@query(f"WITH {v.CV}, {v.chunk_ctes('cv')} SELECT {CHUNK_SQL} FROM chunks")
def chunks_of_conversations(spark, d):
    return shown_chunks(build_chunks(v.conversation_messages(spark, d)))


@query(
    f"""{EV_CHUNKS} SELECT chunk_id, chat_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY "timestamp", message_id) - 1 AS INTEGER) AS ordinal, message_id
    FROM marked JOIN (SELECT chat_id, seq, chunk_id FROM chunks) USING (chat_id, seq)"""
)
def chunk_message_links(spark, d):
    return chunk_messages(build_chunks(v.event_messages(spark, d)))


@query(f"{CV_WINDOWS} SELECT {WINDOW_SQL} FROM windows")
def parent_windows(spark, d):
    return shown_windows(build_windows(build_chunks(v.conversation_messages(spark, d))))


@query(f"WITH RECURSIVE {v.EV}, {v.chunk_ctes('ev')}, {v.window_ctes('chunks')} SELECT {WINDOW_SQL} FROM windows")
def parent_windows_of_events(spark, d):
    return shown_windows(build_windows(build_chunks(v.event_messages(spark, d))))


@query(f"{CV_WINDOWS} SELECT parent_id, CAST(n - 1 AS INTEGER) AS ordinal, c AS chunk_id FROM (SELECT parent_id, unnest(string_split(children, ',')) AS c, generate_subscripts(string_split(children, ','), 1) AS n FROM windows)")
def parent_window_children(spark, d):
    return window_children(build_windows(build_chunks(v.conversation_messages(spark, d))))


@query(f"{CV_WINDOWS} SELECT parent_id, chat_id, message_count, children AS child_chunk_ids FROM windows")
def windows_with_children(spark, d):
    made = v.archived(build_windows(build_chunks(v.conversation_messages(spark, d))))
    return with_children(made.drop("child_chunk_ids"), window_children(made)).select("parent_id", "chat_id", "message_count", listed("child_chunk_ids"))


@query(f"{CV_WINDOWS} SELECT chunk_id, CAST(f.win AS BIGINT) AS window_no FROM placed p JOIN fold f ON p.chat_id = f.chat_id AND p.b = f.b AND p.pos = f.pos")
def window_fold(spark, d):
    return window_numbers(build_chunks(v.conversation_messages(spark, d))).select("chunk_id", "window_no")


@query(f"{DC_WINDOWS} SELECT {WINDOW_SQL} FROM windows")
def window_segments(spark, d):
    return shown_windows(build_windows(v.document_chunks(spark, d)))


# --- upserts, reconciliation, incremental builds --------------------------------------------

DIFF = " OR ".join(f'o."{c}" IS DISTINCT FROM n."{c}"' for c in ("chat_name", "chat_type", "sender_id", "sender_nickname", "timestamp", "text", "message_type", "reply_to_message_id"))
CHANGED = f"""WITH RECURSIVE {v.EV}, {v.OLD}, changed AS (
  SELECT n.*, CASE WHEN o.message_id IS NULL THEN 'inserted' WHEN {DIFF} THEN 'updated' ELSE 'unchanged' END AS change, o."timestamp" AS old_timestamp
  FROM ev n LEFT JOIN old o ON o.account_hash = n.account_hash AND o.chat_id = n.chat_id AND o.message_id = n.message_id
)"""


def _changed(spark, d):
    return upsert.changes(v.older_messages(spark, d), v.event_messages(spark, d))


@query(f"{CHANGED} SELECT account_hash, chat_id, message_id, change FROM changed")
def upsert_changes(spark, d):
    return _changed(spark, d).select("account_hash", "chat_id", "message_id", "change")


@query(f"{CHANGED} SELECT count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS unchanged FROM changed")
def sync_counts(spark, d):
    return upsert.sync_counts(_changed(spark, d))


@query(
    f"""{CHANGED}, t AS (SELECT chat_id, min(least("timestamp", coalesce(old_timestamp, "timestamp"))) AS earliest,
      count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated FROM changed WHERE change <> 'unchanged' GROUP BY chat_id)
    SELECT chat_id, {sql_clock('earliest')}, inserted, updated FROM t"""
)
def touched_chats(spark, d):
    return upsert.touched_chats(_changed(spark, d)).select("chat_id", clock("earliest"), "inserted", "updated")


@query(f'WITH {v.EV} SELECT account_hash, chat_id, message_id, {sql_clock("timestamp")}, text FROM ev')
def merged_archive(spark, d):
    rows = upsert.merged(v.older_messages(spark, d), v.event_messages(spark, d))
    return rows.select("account_hash", "chat_id", "message_id", clock("timestamp"), "text")


@query(f'WITH {v.EV}, c AS (SELECT account_hash AS source_id, max("timestamp") AS cursor_value FROM ev GROUP BY ALL) SELECT source_id, {sql_clock("cursor_value")} FROM c')
def sync_cursors(spark, d):
    old = upsert.sync_cursor(v.older_messages(spark, d))
    return upsert.sync_cursor(v.event_messages(spark, d), old).select("source_id", clock("cursor_value"))


@query(f"WITH {v.EV} SELECT chat_id, min(chat_name) AS chat_name, min(chat_type) AS chat_type FROM ev GROUP BY chat_id")
def chats(spark, d):
    return upsert.chats_of(v.event_messages(spark, d))


NARROW = 'src AS (SELECT * FROM ev WHERE message_type = \'text\' AND chat_id <> \'ev-error\')'


@query(
    f"""WITH {v.EV}, {NARROW}, span AS (SELECT account_hash, chat_id, min("timestamp") AS lo, max("timestamp") AS hi FROM src GROUP BY ALL)
    SELECT chat_id, message_id FROM ev JOIN span USING (account_hash, chat_id) WHERE "timestamp" BETWEEN lo AND hi
      AND message_id NOT IN (SELECT message_id FROM src)"""
)
def reconcile_deletions(spark, d):
    rows = v.event_messages(spark, d)
    source = rows.filter((F.col("message_type") == "text") & (F.col("chat_id") != "ev-error"))
    return upsert.deletions(rows, source).select("chat_id", "message_id")


@query(
    f"""{CHANGED}, t AS (SELECT chat_id, min(least("timestamp", coalesce(old_timestamp, "timestamp"))) AS e FROM changed WHERE change <> 'unchanged' GROUP BY chat_id),
    {v.chunk_ctes('old', 'o')}, g AS (SELECT *, lag(ended_at) OVER (PARTITION BY chat_id ORDER BY started_at, first_message_id) AS pe FROM ochunks),
    f AS (SELECT chat_id, max(started_at) AS floor FROM g JOIN t USING (chat_id) WHERE started_at < e AND datesub('second', pe, started_at) > 300 GROUP BY chat_id)
    SELECT chat_id, strftime(floor, '%Y-%m-%d %H:%M:%S.%f') AS floor FROM t LEFT JOIN f USING (chat_id)"""
)
def tail_rebuild_start(spark, d):
    old = v.archived(build_chunks(v.older_messages(spark, d)))
    return incremental.tail_floors(old, upsert.touched_chats(_changed(spark, d))).select("chat_id", clock("floor"))


def _rebuilt(spark, d):
    old = v.archived(build_chunks(v.older_messages(spark, d)))
    hit = upsert.touched_chats(_changed(spark, d)).select("chat_id", "earliest")
    return incremental.rebuild(v.event_messages(spark, d), old, v.archived(build_windows(old)), v.archived(hit))


@query(f"{EV_CHUNKS} SELECT {CHUNK_SQL} FROM chunks")
def scoped_rebuild_chunks(spark, d):
    return shown_chunks(_rebuilt(spark, d)[0])


@query(f"WITH RECURSIVE {v.EV}, {v.chunk_ctes('ev')}, {v.window_ctes('chunks')} SELECT {WINDOW_SQL} FROM windows")
def scoped_rebuild_windows(spark, d):
    return shown_windows(_rebuilt(spark, d)[1])


@query(f'WITH {v.EV}, {v.OLD} SELECT chat_id, message_id, text FROM old UNION ALL SELECT chat_id, message_id, text FROM ev WHERE message_id NOT IN (SELECT message_id FROM old)')
def merged_databases(spark, d):
    rows = app.merged_messages([v.older_messages(spark, d), v.event_messages(spark, d)])
    return rows.select("chat_id", "message_id", "text")


# --- replies and navigation -----------------------------------------------------------------

OWNED = "own AS (SELECT message_id, min(chunk_id) AS chunk_id FROM marked JOIN (SELECT chat_id, seq, chunk_id FROM chunks) USING (chat_id, seq) GROUP BY message_id)"
EDGES = f"""{OWNED}, edges AS (
  SELECT DISTINCT e.message_id AS child_message_id, e.reply_to_message_id AS parent_message_id, c.chunk_id AS child_chunk_id, p.chunk_id AS parent_chunk_id,
         CASE WHEN p.chunk_id IS NULL THEN 'parent_not_in_archive' END AS unresolved_reason
  FROM ev e LEFT JOIN own c ON c.message_id = e.message_id LEFT JOIN own p ON p.message_id = e.reply_to_message_id WHERE e.reply_to_message_id IS NOT NULL
), refs AS (SELECT DISTINCT child_chunk_id, parent_chunk_id FROM edges WHERE parent_chunk_id IS NOT NULL AND child_chunk_id <> parent_chunk_id)"""


def _ev(spark, d):
    rows = v.event_messages(spark, d)
    return rows, build_chunks(rows)


@query(f"{EV_CHUNKS}, {EDGES} SELECT * FROM edges")
def reply_edges(spark, d):
    return replies.reply_edges(*_ev(spark, d))


@query(f"{EV_CHUNKS}, {EDGES} SELECT * FROM refs")
def chunk_parent_refs(spark, d):
    return replies.chunk_parent_refs(*_ev(spark, d))


@query(f"{EV_CHUNKS}, {EDGES} SELECT DISTINCT r.* FROM refs r JOIN chunks c ON c.chunk_id IN (r.child_chunk_id, r.parent_chunk_id) WHERE c.chat_id IN ('ev-click', 'ev-error')")
def scoped_chunk_refs(spark, d):
    rows, made = _ev(spark, d)
    touched = rows.filter(F.col("chat_id").isin("ev-click", "ev-error")).select("chat_id")
    return replies.touching_refs(replies.chunk_parent_refs(rows, made), made, touched)


@query(
    f"""{EV_CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunks
    WINDOW w AS (PARTITION BY chat_id ORDER BY started_at, chunk_id)"""
)
def chunk_neighbours(spark, d):
    return navigate.chunk_neighbours(_ev(spark, d)[1])


@query(
    f"""WITH RECURSIVE {v.EV}, {v.chunk_ctes('ev')}, {v.window_ctes('chunks')}, {EDGES},
    pr AS (SELECT child_chunk_id AS chunk_id, string_agg(parent_chunk_id, ',' ORDER BY parent_chunk_id) AS parent_chunk_ids FROM refs GROUP BY 1),
    wi AS (SELECT c AS chunk_id, string_agg(DISTINCT parent_id, ',' ORDER BY parent_id) AS window_ids FROM (SELECT parent_id, unnest(string_split(children, ',')) AS c FROM windows) GROUP BY 1)
    SELECT chunk_id, account_hash, chat_id, chat_name, sender_nickname, {sql_clock('started_at')}, {sql_clock('ended_at')}, CAST(message_count AS BIGINT) AS message_count,
           coalesce(parent_chunk_ids, '') AS parent_chunk_ids, coalesce(window_ids, '') AS window_ids
    FROM chunks LEFT JOIN pr USING (chunk_id) LEFT JOIN wi USING (chunk_id)"""
)
def chunk_summaries(spark, d):
    rows, made = _ev(spark, d)
    out = navigate.chunk_summaries(made, replies.chunk_parent_refs(rows, made), window_children(build_windows(made)))
    return out.select("chunk_id", "account_hash", "chat_id", "chat_name", "sender_nickname", clock("started_at"), clock("ended_at"), "message_count", listed("parent_chunk_ids"), listed("window_ids"))


@query(
    """WITH m AS (SELECT o_custkey AS chat_id, 'Room ' || (o_custkey % 40) AS chat_name, max(CAST(o_orderdate AS TIMESTAMP)) AS last FROM orders GROUP BY ALL)
    SELECT CAST(a.chat_id AS VARCHAR) AS chat_id, a.chat_name, count(b.chat_id) AS peers_later FROM m a LEFT JOIN m b ON b.chat_name = a.chat_name AND b.chat_id <> a.chat_id AND b.last > a.last
    GROUP BY a.chat_id, a.chat_name"""
)
def chat_identity(spark, d):
    rows = v.load(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("chat_id"),
        F.concat(F.lit("Room "), (F.col("o_custkey") % 40).cast("string")).alias("chat_name"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderkey").cast("string").alias("message_id"),
    )
    return navigate.chat_identity(rows)


@query(
    """WITH n AS (SELECT c_custkey, c_name || ', ' || c_mktsegment || ' ,' AS a, c_mktsegment || ',' || c_name AS b FROM customer)
    SELECT c_custkey, list_sort(list_filter(list_transform(string_split(a, ','), lambda x: trim(x)), lambda x: x <> '')) = list_sort(list_filter(list_transform(string_split(b, ','), lambda x: trim(x)), lambda x: x <> '')) AS matches,
      (SELECT arg_min(x, (-length(x), x)) FROM (SELECT unnest(list_filter(list_transform(string_split(a, ','), lambda y: trim(y)), lambda y: y <> '')) AS x)) AS search_member FROM n"""
)
def room_name_matching(spark, d):
    a = F.concat_ws("", "c_name", F.lit(", "), "c_mktsegment", F.lit(" ,"))
    b = F.concat_ws(",", "c_mktsegment", "c_name")
    return v.load(spark, d, "customer").select("c_custkey", tx.room_matches(a, b).alias("matches"), tx.search_member(a).alias("search_member"))


# --- search ---------------------------------------------------------------------------------

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HIT = f"rank, chunk_id, chat_id, sender_nickname, {sql_clock('started_at')}, snippet, score"


def sql_snippet(query: str, length: int = 80) -> str:
    t = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
    return f"CASE WHEN length({t}) <= {length} THEN {t} ELSE substr({t}, greatest(greatest(instr({t}, '{query}') - 1, 0) - 20, 0) + 1, {length}) END"


def shown_hits(hits: DataFrame) -> DataFrame:
    return hits.select("rank", "chunk_id", "chat_id", "sender_nickname", clock("started_at"), "snippet", "score")


@query(
    f"""WITH {v.DC}, t AS (SELECT *, row_number() OVER (ORDER BY started_at, chunk_id) AS rank FROM dc WHERE {FOLD.format('text')} LIKE '%the_on%'),
    s AS (SELECT *, {sql_snippet('The_ON')} AS snippet, 1.0::DOUBLE / rank AS score FROM t WHERE rank <= 50) SELECT {HIT} FROM s"""
)
def keyword_search(spark, d):
    return shown_hits(search.keyword_search(v.document_chunks(spark, d), "The_ON", 50))


@query(f"WITH {v.DC} SELECT chunk_id, {sql_snippet('license')} AS snippet FROM dc")
def snippets(spark, d):
    return v.document_chunks(spark, d).select("chunk_id", tx.snippet(F.col("text"), "license").alias("snippet"))


TOKENS = "tok AS (SELECT *, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}\\p{Co}]+') AS w FROM dc)"


def bm25_sql(phrases: list[list[str]], limit: int) -> str:
    def count(p: list[str]) -> str:
        same = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(p))
        return f"len(list_filter(range(1, len(w) - {len(p) - 2}), lambda i: {same}))"

    counts = ", ".join(f"{count(p)} AS f{i}" for i, p in enumerate(phrases))
    held = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(phrases)))
    score = " + ".join(
        f"(CASE WHEN ln((a - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((a - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * (f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / avg)))" for i in range(len(phrases))
    )
    every = " AND ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""WITH {v.DC}, {TOKENS}, c AS (SELECT * EXCLUDE (w), len(w) AS n, {counts} FROM tok), tot AS (SELECT count(*) AS a, avg(n) AS avg, {held} FROM c),
    s AS (SELECT chunk_id, started_at, -({score}) AS raw_score FROM c, tot WHERE {every}),
    r AS (SELECT *, row_number() OVER (ORDER BY raw_score, started_at, chunk_id) AS rank FROM s)
    SELECT rank, chunk_id, round(raw_score, 9) AS raw_score FROM r WHERE rank <= {limit}"""


def _index(spark, d) -> DataFrame:
    """The stored index that an archive would have."""
    return v.archived(search.postings(v.document_chunks(spark, d).select("chunk_id", "started_at", "text")))


def _bm25(spark, d, text: str, limit: int) -> DataFrame:
    found = search.bm25_search(v.document_chunks(spark, d), text, limit, index=_index(spark, d))
    return found.select("rank", "chunk_id", F.round("raw_score", 9).alias("raw_score"))


@query(bm25_sql([["license"], ["version"]], 100))
def bm25_search(spark, d):
    return _bm25(spark, d, "License vérsion", 100)


@query(bm25_sql([["apache", "license"]], 100))
def bm25_phrase(spark, d):
    return _bm25(spark, d, "Apache-License --", 100)


@query(
    f"""WITH {v.DC}, {TOKENS}, e AS (SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM tok)
    SELECT term, chunk_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM e GROUP BY term, chunk_id"""
)
def inverted_index(spark, d):
    rows = search.postings(v.document_chunks(spark, d).select("chunk_id", "text"))
    return rows.filter(F.col("term") != search.EVERY).select("term", "chunk_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(
    f"""WITH RECURSIVE {v.CV}, {v.chunk_ctes('cv')}, {v.window_ctes('chunks')},
    s AS (SELECT *, CAST(contains(text, 'the') AS BIGINT) + CAST(contains(text, 'ing') AS BIGINT) + CAST(contains(text, 'Zu') AS BIGINT) AS raw_score FROM windows),
    r AS (SELECT *, row_number() OVER (ORDER BY raw_score DESC, parent_id) AS rank FROM s WHERE raw_score > 0)
    SELECT rank, parent_id AS chunk_id, raw_score, children AS child_chunk_ids FROM r WHERE rank <= 100"""
)
def term_search(spark, d):
    made = build_windows(build_chunks(v.conversation_messages(spark, d)))
    return search.term_search(made, "the ing Zu", 100).select("rank", "chunk_id", "raw_score", listed("child_chunk_ids"))


QUERY_VECTOR = [round(((i * 37) % 64 - 32) / 64, 6) for i in range(64)]


@query(
    f"""WITH q AS (SELECT CAST({QUERY_VECTOR} AS FLOAT[]) AS q),
    s AS (SELECT vec_id, list_reduce(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS FLOAT) * q[i]), lambda a, x: a + x) AS raw_score FROM embeddings, q WHERE embedding IS NOT NULL),
    k AS (SELECT *, row_number() OVER (ORDER BY raw_score DESC, vec_id) AS rank FROM s WHERE raw_score > 0) SELECT rank, vec_id, raw_score FROM k WHERE rank <= 50"""
)
def vector_topk(spark, d):
    found = vectors.vector_topk(v.load(spark, d, "embeddings"), QUERY_VECTOR, 50, "vec_id", "embedding")
    return found.select("rank", "vec_id", "raw_score")


@query(
    r"""SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''),
      lambda t: CAST(CAST(('0x' || substr(sha256(t), 15, 2) || substr(sha256(t), 13, 2) || substr(sha256(t), 11, 2) || substr(sha256(t), 9, 2) || substr(sha256(t), 7, 2) || substr(sha256(t), 5, 2) || substr(sha256(t), 3, 2) || substr(sha256(t), 1, 2)) AS UBIGINT) % 768 AS INTEGER)) AS buckets
      FROM conversations"""
)
def embedding_buckets(spark, d):
    made = vectors.DeterministicEmbedder(768)
    return v.load(spark, d, "conversations").select("conv_id", "turn", made.buckets(F.col("text")).alias("buckets"))


@query(
    rf"""{CV_WINDOWS}, tok AS (SELECT parent_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS t FROM windows),
    cnt AS (SELECT parent_id, CAST('0x' || substr(sha256(t), 1, 2) AS INTEGER) AS b, count(*) AS n FROM tok GROUP BY ALL),
    len AS (SELECT parent_id, CAST(sqrt(CAST(sum(n * n) AS DOUBLE)) AS FLOAT) AS len FROM cnt GROUP BY parent_id),
    qc AS (SELECT CAST('0x' || substr(sha256(t), 1, 2) AS INTEGER) AS b, count(*) AS n FROM (SELECT unnest(['the', 'was', 'that', 'of']) AS t) GROUP BY 1),
    qv AS (SELECT b, CAST(n AS FLOAT) / (SELECT CAST(sqrt(CAST(sum(n * n) AS DOUBLE)) AS FLOAT) FROM qc) AS x FROM qc),
    p AS (SELECT parent_id, list_reduce(list(CAST(n AS FLOAT) / len * x ORDER BY b), lambda a, y: a + y) AS raw_score FROM cnt JOIN len USING (parent_id) JOIN qv USING (b) GROUP BY parent_id),
    r AS (SELECT parent_id AS chunk_id, raw_score, row_number() OVER (ORDER BY raw_score DESC, parent_id) AS rank FROM p WHERE raw_score > 0)
    SELECT rank, chunk_id, raw_score FROM r WHERE rank <= 50"""
)
def semantic_search(spark, d):
    made = v.archived(build_windows(build_chunks(v.conversation_messages(spark, d))))
    embedder = vectors.DeterministicEmbedder(256)
    pending = vectors.reused_or_pending(made, spark.createDataFrame([], "chunk_id string, content_hash string, vector array<float>"))
    return vectors.semantic_search(made, vectors.embedded(pending, embedder), embedder, "the was that of", 50).select("rank", "chunk_id", "raw_score")


# --- application tables ---------------------------------------------------------------------

APP = """
users AS (SELECT s_suppkey AS u, CASE WHEN s_suppkey % 3 = 0 THEN 'Friend ' || s_name WHEN s_suppkey % 2 = 0 THEN s_name WHEN s_suppkey % 5 <> 0 THEN 'Nick ' || s_suppkey END AS name FROM supplier),
titles AS (SELECT o_custkey AS k, arg_max('Title ' || o_orderkey, (o_orderkey % 17, 'Title ' || o_orderkey)) AS title FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1),
rooms AS (
  SELECT CAST(c_custkey AS BIGINT) AS k, CASE WHEN c_custkey % 5 IN (0, 2) OR (c_custkey % 3 = 0 AND c_custkey % 50 > 0) OR c_custkey % 7 = 2 THEN 'direct' ELSE 'group' END AS chat_type,
         coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END, title, CASE WHEN c_nationkey <> 0 AND c_nationkey % 2 = 0 THEN n_name END, p.name, 'chat-' || c_custkey) AS chat_name
  FROM customer LEFT JOIN titles t ON t.k = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
       LEFT JOIN users p ON c_custkey % 3 = 0 AND p.u = c_custkey % 50 AND c_custkey % 50 NOT IN (0, 7)
)"""


def _app(spark, d):
    return v.app_rooms(spark, d), v.app_users(spark, d), 7, v.app_meta(spark, d), v.app_links(spark, d)


@query(f"WITH {APP} SELECT k AS \"chatId\", chat_name, chat_type FROM rooms")
def room_names(spark, d):
    return app.room_table(*_app(spark, d))


@query("""SELECT CAST(c_custkey AS BIGINT) AS "chatId", CASE WHEN c_custkey % 5 IN (0, 2) OR (c_custkey % 3 = 0 AND c_custkey % 50 > 0) OR c_custkey % 7 = 2 THEN 'direct' ELSE 'group' END AS chat_type FROM customer""")
def room_class(spark, d):
    rooms = v.app_rooms(spark, d)
    return rooms.select("chatId", app.room_class(F.col("type"), F.col("directChatMemberUserId"), F.col("activeMembersCount")).alias("chat_type"))


PARENT = """coalesce(CASE WHEN k % 6 = 0 AND k > 3 THEN k - 3 WHEN k % 6 = 1 AND k > 3 THEN k - 3 WHEN k % 6 = 1 THEN 1 END, CASE WHEN k % 4 = 0 AND k > 3 THEN k - 3 END)"""


@query(f"""SELECT k AS "logId", {PARENT} AS parent FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)""")
def reply_parents(spark, d):
    return v.app_messages(spark, d).select("logId", F.coalesce(reply_parent(F.col("attachment")), reply_parent(F.col("supplement"))).alias("parent"))


@query(
    f"""WITH {APP}, m AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c, CAST(o_orderkey % 120 AS BIGINT) AS a, o_orderpriority AS text, date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) AS "timestamp" FROM orders WHERE o_orderkey % 8 <> 0)
    SELECT sha256('7') AS account_hash, CAST(c AS VARCHAR) AS chat_id, coalesce(chat_name, 'chat-' || c) AS chat_name, coalesce(chat_type, 'direct') AS chat_type, c || '-' || m.k AS message_id,
      CAST(a AS VARCHAR) AS sender_id, coalesce(name, CASE WHEN a = 7 THEN '나' ELSE 'user-' || a END) AS sender_nickname, {sql_clock('timestamp')}, text,
      CASE WHEN m.k % 9 = 0 THEN 'type_26' ELSE 'text' END AS message_type, CASE WHEN par <> m.k THEN c || '-' || par END AS reply_to_message_id
    FROM (SELECT *, {PARENT} AS par FROM m) m LEFT JOIN rooms r ON r.k = c LEFT JOIN users ON u = a"""
)
def normalized_messages(spark, d):
    rooms, users, me, meta, links = _app(spark, d)
    return app.normalized(v.app_messages(spark, d), rooms, users, me, meta, links).withColumn("timestamp", clock("timestamp"))


# --- transcripts and media ------------------------------------------------------------------

FEEDS = """
fm AS (
  SELECT chat_id, chat_name, message_id, sender_nickname, "timestamp", CASE WHEN e = 1 THEN '  {"feedType":' || n || '}' WHEN e = 2 THEN '{"member":null}' WHEN e = 3 THEN '["feedType"]' WHEN e = 4 THEN '{"feedType":' ELSE text END AS text,
         CASE WHEN e BETWEEN 1 AND 4 THEN 'type_0' ELSE message_type END AS message_type, e IN (1, 2) AS feed
  FROM (SELECT *, CAST(sender_id AS BIGINT) % 9 AS e, sender_id AS n FROM ev)
)"""


def feeds(spark, d):
    e = F.col("sender_id").cast("bigint") % 9
    text = F.when(e == 1, F.concat(F.lit('  {"feedType":'), "sender_id", F.lit("}"))).when(e == 2, '{"member":null}').when(e == 3, '["feedType"]').when(e == 4, '{"feedType":').otherwise(F.col("text"))
    kind = F.when(e.between(1, 4), "type_0").otherwise(F.col("message_type"))
    return v.event_messages(spark, d).select("*", text.alias("_t"), kind.alias("_k")).drop("text", "message_type").withColumnsRenamed({"_t": "text", "_k": "message_type"})


@query(f"WITH {v.EV}, {FEEDS} SELECT message_id, feed FROM fm")
def feed_filter(spark, d):
    return feeds(spark, d).select("message_id", tx.is_feed(F.col("message_type"), F.col("text")).alias("feed"))


LINE = """'**[' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime("timestamp", '%f') = '000000' THEN '' WHEN strftime("timestamp", '%f') LIKE '%000' THEN '.' || substr(strftime("timestamp", '%f'), 1, 3) ELSE '.' || strftime("timestamp", '%f') END || '+00:00] ' || sender_nickname || '**: ' || text"""


@query(f"WITH {v.EV}, {FEEDS} SELECT chat_id, message_id, feed, {LINE} AS line FROM fm")
def transcript_lines(spark, d):
    return transcript.transcript_lines(feeds(spark, d)).select("chat_id", "message_id", "feed", "line")


REPORTS = """
rep AS (
  SELECT chat_id, max(chat_name) AS chat_name, count(*) FILTER (NOT feed) AS messages, count(*) FILTER (feed) AS feed_skipped,
         arg_min(message_id, ("timestamp", message_id)) FILTER (NOT feed) AS first_message_id, arg_max(message_id, ("timestamp", message_id)) FILTER (NOT feed) AS last_message_id
  FROM fm GROUP BY chat_id
), named AS (SELECT *, chat_id || '-' || substr(first_message_id, length(chat_id) + 2) || '-' || substr(last_message_id, length(chat_id) + 2) || '.md' AS file_name FROM rep)"""


@query(f"WITH {v.EV}, {FEEDS}, {REPORTS} SELECT * FROM named")
def transcript_reports(spark, d):
    return transcript.transcript_reports(feeds(spark, d))


@query(
    f"""WITH {v.EV}, {FEEDS}, {REPORTS}, b AS (SELECT chat_id, string_agg({LINE} || chr(10), chr(10) ORDER BY "timestamp", message_id) AS body FROM fm WHERE NOT feed GROUP BY chat_id)
    SELECT file_name, '# ' || chat_name || ' (chat ' || chat_id || ')' || chr(10) || chr(10) || '- messages: ' || messages || chr(10) || '- range: ' || first_message_id || ' .. ' || last_message_id || chr(10)
      || CASE WHEN feed_skipped > 0 THEN '- system feed messages skipped: ' || feed_skipped || chr(10) ELSE '' END || chr(10) || body AS body FROM named JOIN b USING (chat_id)"""
)
def transcripts(spark, d):
    return transcript.transcripts(feeds(spark, d)).select("file_name", "body")


MEDIA = """
mm AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) % 97 AS "chatId", CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS l, CAST(l_linenumber AS BIGINT) AS n, CAST(l_suppkey AS VARCHAR) AS sender,
              CAST(floor(epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 1000000) AS BIGINT) AS sent_at FROM lineitem),
md AS (SELECT *, sha1(CAST(l AS VARCHAR)) AS h, 'https://cdn.example/' || l || '?credential=a&expires=' || (1700000000 + l % 1000 * 1000000) || '&x=1' AS u FROM mm),
mf AS (
  SELECT "chatId", l AS "logId", CAST(0 AS BIGINT) AS idx, CASE n WHEN 3 THEN 'file' WHEN 2 THEN 'video' ELSE 'photo' END AS kind, CASE WHEN n IN (1, 2) THEN n * 100 END AS width, CASE WHEN n IN (1, 2) THEN n * 50 END AS height,
         CASE WHEN n IN (1, 2) THEN h WHEN n = 3 THEN NULL END AS checksum_sha1, CASE WHEN n IN (1, 2) THEN l * 1000 WHEN n = 3 THEN l * 10 END AS size_bytes, CASE n WHEN 3 THEN 'report ' || l || '.pdf' END AS filename,
         CAST(l AS VARCHAR) AS output_stem, sender, sent_at, CASE WHEN n IN (1, 2, 3) THEN u END AS cdn_url FROM md WHERE n IN (1, 2, 3, 5)
  UNION ALL
  SELECT "chatId", l, i, 'photo', i + 1, CASE i WHEN 0 THEN 3 END, CASE i WHEN 0 THEN h END, CASE i WHEN 0 THEN l ELSE 5 END, NULL, l || '_' || i, sender, sent_at, CASE i WHEN 0 THEN u END
  FROM (SELECT *, unnest([CAST(0 AS BIGINT), CAST(1 AS BIGINT)]) AS i FROM md WHERE n = 4)
)"""


@query(f"WITH {MEDIA} SELECT * FROM mf")
def media_frames(spark, d):
    return media.media_frames(media.media_rows(v.media_messages(spark, d)))


@query(f"WITH {MEDIA} SELECT DISTINCT \"chatId\" FROM mm WHERE n IN (1, 3, 4, 5)")
def rooms_with_media(spark, d):
    return media.rooms_with_media(v.media_messages(spark, d), ["image", "file"])


NOW = 2_200_000_000
PLAN = f"""
pr AS (
  SELECT *, "logId" % 19 = 0 AS existing, "logId" % 5 = 0 AS fc, "logId" % 10 = 0 AS fo, "logId" % 3 = 0 AS tc, "logId" % 6 = 0 AS tok, "logId" % 7 <> 0 AS fetched,
         coalesce(CAST(nullif(regexp_extract(cdn_url, 'expires=([0-9]+)', 1), '') AS BIGINT) < {NOW}, false) AS expired, coalesce(size_bytes > 536870912, false) AS large, checksum_sha1 IS NOT NULL AS proof, kind <> 'file' AS local FROM mf
), pw AS (
  SELECT *, CASE WHEN local AND fc AND NOT fo THEN 'full-decrypt-failed' WHEN local AND NOT fc THEN 'full-not-cached' END AS fw,
         CASE WHEN cdn_url IS NULL THEN NULL WHEN expired THEN 'cdn-expired' WHEN large THEN 'cdn-too-large' WHEN NOT proof THEN 'cdn-unverifiable' WHEN $DRY THEN 'cdn-would-fetch' WHEN fetched THEN 'cdn-fetched' ELSE 'cdn-failed' END AS cw,
         cdn_url IS NOT NULL AND NOT expired AND NOT large AND proof AS reached FROM pr
), pt AS (
  SELECT *, CASE WHEN existing THEN 'existing' WHEN local AND fc AND fo THEN 'full' WHEN reached AND $DRY THEN 'planned' WHEN reached AND fetched THEN 'cdn' WHEN local AND tc AND tok THEN 'thumb' ELSE 'stub' END AS tier FROM pw
), plan AS (
  SELECT "chatId", "logId", idx, kind, tier, CASE tier WHEN 'existing' THEN 'already-present' WHEN 'full' THEN 'decrypted'
           WHEN 'stub' THEN concat_ws('+', CASE WHEN (local AND tc AND NOT tok) OR fw = 'full-decrypt-failed' THEN 'decrypt-failed' WHEN local THEN 'not-cached' ELSE 'unavailable' END, cw, CASE WHEN local AND tc AND NOT tok THEN 'thumb-decrypt-failed' END)
           ELSE concat_ws('+', fw, cw) END AS reason, CAST(CASE WHEN tier IN ('cdn', 'planned') THEN coalesce(size_bytes, 0) ELSE 0 END AS BIGINT) AS bytes,
         CASE kind WHEN 'file' THEN output_stem || '_' || filename END AS output_name FROM pt
)"""


def plan_sql(dry: str) -> str:
    return PLAN.replace("$DRY", dry)


def _plan(spark, d, dry: bool):
    frames = media.media_frames(v.media_messages(spark, d).filter(F.col("type").isin(media.types_of([]))))
    return media.tier_plan(frames, v.media_probes(frames), NOW, dry_run=dry)


@query(f"WITH {MEDIA}, {plan_sql('true')} SELECT * FROM plan")
def media_dry_run(spark, d):
    return _plan(spark, d, True)


@query(f"WITH {MEDIA}, {plan_sql('false')} SELECT * FROM plan")
def media_tier_plan(spark, d):
    return _plan(spark, d, False)


@query(
    f"""WITH {MEDIA}, {plan_sql('false')}, t AS (SELECT "chatId", tier, count(*) AS n, sum(bytes) AS b FROM plan GROUP BY ALL)
    SELECT "chatId", string_agg(tier || '=' || n, ',' ORDER BY tier) AS tier_counts, CAST(sum(n) AS BIGINT) AS frames, CAST(sum(b) AS BIGINT) AS bytes FROM t GROUP BY 1"""
)
def tier_counts(spark, d):
    rows = media.tier_counts(_plan(spark, d, False))
    shown = F.array_join(F.transform(F.map_entries("tier_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.select("chatId", shown.alias("tier_counts"), "frames", "bytes")


@query(f"WITH {MEDIA}, {plan_sql('false')} SELECT \"chatId\", tier, count(*) AS frames, CAST(sum(bytes) AS BIGINT) AS bytes FROM plan GROUP BY ROLLUP (\"chatId\", tier)")
def media_totals(spark, d):
    return media.media_totals(_plan(spark, d, False))


@query(
    f"""WITH {MEDIA} SELECT "logId", idx, CAST(nullif(regexp_extract(cdn_url, 'expires=([0-9]+)', 1), '') AS BIGINT) AS expires, split_part(cdn_url, '?', 1) AS shown,
      '/cache/' || sha1(reverse(CAST("chatId" AS VARCHAR))) || '/' || sha1(reverse(output_stem)) || '.img' AS path FROM mf"""
)
def media_urls_and_paths(spark, d):
    frames = media.media_frames(v.media_messages(spark, d).filter(F.col("type").isin(media.types_of([]))))
    url = F.col("cdn_url")
    return frames.select("logId", "idx", media.url_expires(url).alias("expires"), media.redacted_url(url).alias("shown"), media.cache_path("/cache", F.col("chatId"), F.col("output_stem"), ".img").alias("path"))


@query(
    f"""WITH {MEDIA}, r AS (SELECT *, row_number() OVER (ORDER BY sent_at DESC, l DESC) AS k FROM mm WHERE n IN (1, 4, 5)) SELECT "chatId", l AS "logId", sent_at AS "sentAt" FROM r WHERE k <= 200"""
)
def newest_media(spark, d):
    return media.media_rows(v.media_messages(spark, d), kinds=["photo"], limit=200).select("chatId", "logId", "sentAt")


@query(
    f"""WITH {v.EV}, {FEEDS} SELECT chat_id, message_id, {LINE} AS line FROM fm WHERE chat_id = 'ev-click' AND "timestamp" >= TIMESTAMP '2024-01-15 00:00:00' AND NOT feed"""
)
def transcript_range(spark, d):
    rows = transcript.in_range(feeds(spark, d), "ev-click", "2024-01-15 00:00:00")
    return transcript.transcript_lines(rows).filter(~F.col("feed")).select("chat_id", "message_id", "line")


DOC_TIME = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@query(
    f"""{CV_WINDOWS} SELECT parent_id || '.md' AS name, 'parent_id: ' || parent_id || chr(10) || 'unit: parent_window' || chr(10) || 'chat_id: ' || chat_id || chr(10)
      || 'time_range: ' || {DOC_TIME.format('started_at')} || '..' || {DOC_TIME.format('ended_at')} || chr(10) || 'child_chunk_ids: ' || children || chr(10) || '---' || chr(10) || text AS text FROM windows"""
)
def window_documents(spark, d):
    made = build_windows(build_chunks(v.conversation_messages(spark, d)))
    return made.select(F.concat("parent_id", F.lit(".md")).alias("name"), search.document(made).alias("text"))


@query(
    f"""WITH RECURSIVE {v.EV}, {v.OLD}, {v.chunk_ctes('ev')}, {v.window_ctes('chunks')}, {v.chunk_ctes('old', 'o')}, {v.window_ctes('ochunks', 'o')}
    SELECT w.parent_id, sha256(w.text) AS content_hash, o.parent_id IS NOT NULL AS reused FROM windows w LEFT JOIN owindows o ON o.parent_id = w.parent_id AND sha256(o.text) = sha256(w.text)"""
)
def vector_reuse(spark, d):
    embedder = vectors.DeterministicEmbedder(16)
    old = build_windows(v.archived(build_chunks(v.older_messages(spark, d)))).withColumn("content_hash", vectors.content_hash(F.col("text")))
    prior = v.archived(vectors.embedded(old.withColumn("vector", F.lit(None).cast("array<float>")), embedder))
    now = build_windows(v.archived(build_chunks(v.event_messages(spark, d))))
    return vectors.reused_or_pending(now, prior).select("parent_id", "content_hash", F.col("vector").isNotNull().alias("reused"))


@query(
    r"""WITH a AS (SELECT page_id, trim(regexp_replace(trim(regexp_replace(url, '[/\\:\x00-\x1F\x7F]', '_', 'g')), '^[.]+', '')) AS n FROM pages),
    b AS (SELECT *, regexp_matches(n, '^(.+)[.]([^.]{1,16})$') AS e FROM a)
    SELECT page_id, CASE WHEN n = '' THEN 'attachment' WHEN e THEN substr(regexp_extract(n, '^(.+)[.]([^.]{1,16})$', 1), 1, 120) || '.' || regexp_extract(n, '^(.+)[.]([^.]{1,16})$', 2) ELSE substr(n, 1, 120) END AS name FROM b"""
)
def safe_filenames(spark, d):
    return v.load(spark, d, "pages").select("page_id", tx.safe_filename(F.col("url")).alias("name"))


@query(
    """SELECT event_id, CASE CAST(event_id % 8 AS INTEGER) WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' WHEN 3 THEN '.webp' WHEN 4 THEN '.mp4' WHEN 5 THEN '.webm' ELSE '.bin' END AS ending FROM events"""
)
def body_endings(spark, d):
    heads = ["FFD8FF00", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "000000006674797000000000", "1A45DFA3", "524946460000000057415645", ""]
    body = F.unhex(F.get(F.array(*(F.lit(h) for h in heads)), (F.col("event_id") % 8).cast("int")))
    return v.load(spark, d, "events").select("event_id", tx.body_extension(body).alias("ending"))

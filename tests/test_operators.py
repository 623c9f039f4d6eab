import pathlib
import random
import sqlite3

import pytest
from helpers import T0, frame, message, rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx
from parley.functions.jsonpath import reply_parent
from parley.functions.plist import int_array
from parley.operators import media, navigate, replies, search, transcript, upsert, vectors
from parley.operators.chunking import build_chunks
from parley.operators.windows import build_windows, window_children, with_children
from parley.schema import MESSAGES, BadRoomName, Config, DimensionMismatch, EmptyQuery, InvalidLimit, MissingChunk


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def docs(spark, texts):
    rows = [(f"d{i:03}", "acct", "c", "Room", "a", T0, T0, t, [str(i)], 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, account_hash string, chat_id string, chat_name string, sender_nickname string, started_at timestamp, ended_at timestamp, text string, message_ids array<string>, message_count bigint")


@pytest.mark.parametrize("query, text, found", [("CAFE", "a cafe", True), ("É", "é", False), ("a%c", "abc", True), ("a_c", "abc", True), ("x\\y", "X\\Y", True), ("  b ", "abc", True)])
def test_keyword_predicate(spark, query, text, found):
    assert one(spark, tx.like_ascii(F.lit(text), query)) is found


def test_keyword_literal(spark):
    assert one(spark, tx.like_ascii(F.lit("abc"), "a%c", literal=True)) is False


@pytest.mark.parametrize("text, query, n, want", [("  short ", "x", 80, "short"), ("a" * 50 + "needle" + "b" * 100, "needle", 40, "a" * 20 + "needle" + "b" * 14), ("가" * 90, "없", 10, "가" * 10), ("x" * 30, "x", 10, "x" * 10)])
def test_snippet(spark, text, query, n, want):
    assert one(spark, tx.snippet(F.lit(text), query, n)) == want


def test_fold():
    got = tx.fold("NTRU+ SMAUG-T Café naïve_x 다중방인물 ①② 3.14")
    assert got == ["ntru", "smaug", "t", "cafe", "naive", "x", "다중방인물", "①②", "3", "14"]


def test_bm25_against_sqlite(spark):
    texts = ["the quick brown fox", "the lazy dog", "quick quick dog brown", "Café brown-fox naïve", "", "fox " * 20, "brown fox and a brown fox jumps", "nothing here"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, text)")
    db.executemany("INSERT INTO f VALUES (?, ?)", [(f"d{i:03}", t) for i, t in enumerate(texts)])
    frame_ = docs(spark, texts)
    index = search.postings(frame_.select("chunk_id", "started_at", "text")).cache()
    assert index.filter("term = ''").count() == len(texts) and index.filter("term = 'quick'").agg({"tf": "sum"}).first()[0] == 3
    for query in ("fox", "brown fox", "brown-fox", "cafe", "the dog", "missing"):
        match = " ".join(f'"{t}"' for t in query.split())
        want = dict(db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r.chunk_id: r.raw_score for r in search.bm25_rows(index, query).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    found = search.bm25_search(frame_, "brown fox", 2, index=index).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2] and [r.chunk_id for r in found] == [r.chunk_id for r in search.bm25_search(frame_, "brown fox", 2).orderBy("rank").collect()]


def test_search_limits_and_errors(spark):
    frame_ = docs(spark, ["abc"] * 12)
    assert search.keyword_search(frame_, "b").count() == 10
    assert [r["rank"] for r in search.keyword_search(frame_, "b", 100).orderBy("rank").collect()] == list(range(1, 13))
    for bad in (0, 100_001):
        with pytest.raises(InvalidLimit):
            search.keyword_search(frame_, "b", bad)
    with pytest.raises(EmptyQuery):
        search.bm25_search(frame_, "  ")
    assert search.bm25_search(frame_, "--- !!").count() == 0


def test_feed(spark):
    cases = [("type_0", ' {"feedType":1}', True), ("type_0", '{"member":null}', True), ("text", '{"feedType":1}', False), ("type_0", '{"x":1}', False), ("type_0", '["feedType"]', False), ("type_0", '{"feedType":', False)]
    for kind, body, want in cases:
        assert one(spark, tx.is_feed(F.lit(kind), F.lit(body))) is want


@pytest.mark.parametrize(
    "json, want",
    [('{"src_logId": 5}', 5), ('{"reply":{"srcLogId":" 7 "},"src_logId":1}', 7), ('{"logId":9}', None), ('{"src_logId":-1}', None), ("{", None), ("", None), ('[{"src_logId":5}]', None), ('{"reply":5,"parentLogId":"8"}', 8)],
)
def test_reply_parent(spark, json, want):
    assert one(spark, reply_parent(F.lit(json))) == want


def test_int_array():
    import plistlib

    dump = lambda x: plistlib.dumps(x, fmt=plistlib.FMT_BINARY)
    assert int_array(dump([1, 2, 300])) == [1, 2, 300]
    good = dump([1, 2])
    assert int_array(dump(["a"])) is None and int_array(dump({"a": 1})) is None and int_array(dump(list(range(257)))) is None
    assert all(int_array(good[:k]) is None for k in range(len(good)))
    assert int_array(None) is None


def test_sanitize_filename():
    s = tx.sanitize_filename
    assert s("../a/b.pdf") == "_a_b.pdf" and s("") == "attachment" and s("...") == "attachment"
    assert s("a‮gpj.exe") == "agpj.exe" and s("x" * 300 + ".pdf") == "x" * 120 + ".pdf"
    assert s("한.txt") == "한.txt" and s("a b") == "a b" and len(s("가" * 100).encode()) == 120


def test_room_names(spark):
    assert one(spark, tx.room_matches(F.lit("b, a"), F.lit("a,b "))) is True
    assert one(spark, tx.search_member(F.lit("bb, cc, a"))) == "bb"
    navigate.validate_room_name(spark, "fine room")
    with pytest.raises(BadRoomName, match=r"U\+200B"):
        navigate.validate_room_name(spark, "bad​room")


def test_body_extension_and_checksum(spark):
    assert one(spark, tx.body_extension(F.unhex(F.lit("FFD8FF")))) == ".jpg"
    assert one(spark, tx.body_extension(F.lit("").cast("binary"))) == ".bin"
    assert one(spark, tx.sha1_matches(F.lit("a").cast("binary"), F.lit("86F7E437FAA5A7FCE15D1DDCB9EAEAEA377667B8"))) is True


def test_rfc3339(spark):
    at = lambda s: one(spark, tx.rfc3339(F.to_timestamp(F.lit(s))))
    assert at("2024-01-01 00:00:00") == "2024-01-01T00:00:00+00:00" and at("2024-01-01 00:00:00.5") == "2024-01-01T00:00:00.500+00:00"


def test_upsert_and_deletions(spark):
    old = frame(spark, [message(1), message(2, 1), message(3, 2), message(4, 500), message(1, chat="d")])
    new = frame(spark, [message(1), message(2, 1, text="edited"), message(5, 3), message(3, 2, reply="c-1")])
    got = {r.message_id: r.change for r in upsert.changes(old, new).collect()}
    assert got == {"c-1": "unchanged", "c-2": "updated", "c-3": "updated", "c-5": "inserted"}
    assert upsert.merged(old, new).count() == 6
    assert rows_of(upsert.deletions(old, frame(spark, [message(1), message(3, 2)])).select("chat_id", "message_id")) == [("c", "c-2")]
    assert upsert.changes(upsert.merged(old, new), new).filter("change <> 'unchanged'").count() == 0


def test_last_of_a_batch_wins(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b")], "id string, n int, v string")
    assert upsert.latest_of_batch(rows, ["id"], "n").first().v == "c"


def test_replies_and_context(spark):
    rows = frame(spark, [message(1, 0), message(2, 1), message(3, 2, "b", reply="c-1"), message(4, 3, "a", reply="c-99"), message(5, 4, "b", reply="d-1"), message(1, 0, chat="d")])
    chunks = build_chunks(rows).cache()
    edges = {r.child_message_id: r for r in replies.reply_edges(rows, chunks).collect()}
    assert edges["c-3"].unresolved_reason is None and edges["c-4"].unresolved_reason == "parent_not_in_archive"
    assert edges["c-5"].parent_chunk_id is not None
    assert replies.chunk_parent_refs(rows, chunks).count() == 2
    windows = build_windows(chunks).cache()
    middle = chunks.filter(F.array_contains("message_ids", "c-3")).first().chunk_id
    context = navigate.chunk_context(chunks, window_children(windows), middle).first()
    assert context.previous.chunk_id != middle != context.next.chunk_id and len(context.window_ids) == 1
    ends = navigate.chunk_neighbours(chunks).filter(F.col("previous_chunk_id").isNull()).count()
    assert ends == 2
    with pytest.raises(MissingChunk):
        navigate.windows_of_chunk(windows, window_children(windows), "nope")


def test_chat_identity(spark):
    rows = frame(spark, [message(1, 0, chat="a"), message(1, 5, chat="b"), message(1, 5, chat="e"), message(1, 9, chat="f", name="Other")])
    assert rows_of(navigate.chat_identity(rows)) == [("a", "Room", 2), ("b", "Room", 0), ("e", "Room", 0), ("f", "Other", 0)]


def test_chat_identity_of_a_common_name(spark):
    """Very many rooms of one name, or of none, with ties, over several slices."""
    rng = random.Random(5)
    rows = [message(n, rng.choice([0, 1, 1440, 3000, 9000]) + rng.randrange(3), chat=f"r{n % 700}", name=None if n % 7 == 0 else "Hot" if n % 3 else "Cold") for n in range(1500)]
    names, last, named = {}, {}, {}
    for row in rows:
        key = (row[7], row[4])
        last[row[1]] = max(last.get(row[1], row[7]), row[7])
        named[row[1], row[2]] = max(named.get((row[1], row[2]), row[7]), row[7])
        names[row[1]] = min(names.get(row[1], (key, row[2])), (key, row[2]), key=lambda x: x[0])
    want = [(room, names[room][1], sum(n == names[room][1] and t > last[room] for (_, n), t in named.items())) for room in last]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in MESSAGES.fields])
    assert rows_of(navigate.chat_identity(spark.createDataFrame(rows, schema))) == sorted(want, key=repr)


def test_children_of_windows(spark):
    windows = build_windows(build_chunks(frame(spark, [message(n, n * 3, "ab"[n % 2]) for n in range(9)]))).cache()
    children = window_children(windows)
    assert rows_of(with_children(windows.drop("child_chunk_ids"), children).select(windows.columns)) == rows_of(windows)
    none = with_children(windows, children.limit(0)).select("child_chunk_ids").first()[0]
    assert none == []
    with pytest.raises(MissingChunk):
        with_children(windows, children.unionByName(spark.createDataFrame([("window_x", 0, "c")], children.schema)))


def test_vectors(spark):
    made = vectors.DeterministicEmbedder(768)
    assert vectors.term_bucket("보고서", 768) == 257
    frame_ = docs(spark, ["보고서 a a", "", "b"]).select(F.col("chunk_id").alias("parent_id"), "text")
    got = {r.parent_id: r.v for r in frame_.select("parent_id", made.embed(F.col("text")).alias("v")).collect()}
    assert got["d000"][257] == pytest.approx(1 / 5**0.5, abs=1e-6) and sum(got["d001"]) == 0
    assert one(spark, made.buckets(F.lit("보고서"))) == [257]
    small = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [-1.0, 0.0])], "chunk_id string, vector array<float>")
    assert [r.chunk_id for r in vectors.vector_topk(small, [1.0, 1.0]).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(DimensionMismatch):
        vectors.vector_topk(small, [1.0])
    with pytest.raises(DimensionMismatch):
        vectors.DeterministicEmbedder(0)


def test_vector_scan_in_blocks(spark):
    """Thousands of equal vectors tie by id whatever block they are in; absent ids, vectors and products that aren't numbers take no part."""
    rng = random.Random(3)
    rows = [(n, 1, [1.0, 0.5, 0.25]) for n in range(6000)] + [(6000 + n, 2, [rng.uniform(-1, 1) for _ in range(3)]) for n in range(3000)]
    rng.shuffle(rows)
    rows += [(None, 3, [9.0, 9.0, 9.0]), (9000, 3, None), (9001, 3, [None, 9.0, 9.0]), (9002, 3, [float("nan"), 1.0, 1.0]), (9003, 3, [0.0, 0.0, 0.0])]
    frame_ = spark.createDataFrame(rows, "id bigint, room int, v array<float>")
    query = [0.3, 0.7, -0.1]
    plain = {r.id: r.p for r in frame_.filter("id is not null").select("id", vectors.dot(F.col("v"), query).alias("p")).collect() if r.p is not None and r.p > 0}
    best = sorted(plain, key=lambda k: (-plain[k], k))
    for parts, limit in ((1, 50), (7, 5000)):
        got = vectors.vector_topk(frame_.repartition(parts), query, limit, "id", "v", ("room",)).orderBy("rank").collect()
        assert [(r.id, r.raw_score) for r in got] == [(k, plain[k]) for k in best[:limit]]
        assert all(r.room == (1 if r.id < 6000 else 2) and r.score == 1 / r["rank"] for r in got)
    assert vectors.vector_topk(frame_.limit(0), query, 5, "id", "v").count() == 0
    with pytest.raises(DimensionMismatch):
        vectors.vector_topk(frame_.unionByName(spark.createDataFrame([(-1, 1, [1.0])], frame_.schema)), query, 5, "id", "v")
    with pytest.raises(DimensionMismatch):
        vectors.vector_topk(frame_, [float("nan")] * 3, 5, "id", "v")


def test_transcript(spark, tmp_path):
    rows = frame(spark, [message(1, text="hi"), message(2, 1, text='{"feedType":1}', type_="type_0"), message(3, 2, text="a\nb"), message(1, 0, chat="x y", text='{"member":1}', type_="type_0")])
    got = transcript.transcripts(rows).collect()
    assert len(got) == 1 and got[0].file_name == "c-1-3.md"
    assert got[0].body == "# Room (chat c)\n\n- messages: 2\n- range: c-1 .. c-3\n- system feed messages skipped: 1\n\n**[2024-01-01T09:00:00+00:00] a**: hi\n\n**[2024-01-01T09:02:00+00:00] a**: a\nb\n"
    reports = transcript.write_transcripts(rows, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out/file_name=c-1-3.md").glob("part-*.txt"))
    assert "".join(p.read_text() for p in parts) == got[0].body + "\n"
    assert reports.filter("chat_id = 'x y'").first().file_name is None
    assert transcript.transcripts(transcript.in_range(rows, "c", "2024-01-01T18:01:30+09:00")).first().file_name == "c-3-3.md"


def test_transcripts_as_single_files(spark, tmp_path):
    """The parts of a room make up its file byte by byte, however many they are."""
    rows = [message(n, n % 90, text=f"line {n}\n" + "é" * (n % 7), chat=f"r {n % 3}") for n in range(900)]
    rows += [message(9, 0, chat="only feeds", text='{"feedType":1}', type_="type_0")]
    rows = frame(spark, rows).repartition(5)
    want = {r.file_name: r.body.encode() for r in transcript.transcripts(rows).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few lines are one part
    try:
        reports = transcript.export_transcripts(rows, str(tmp_path / "out"), str(tmp_path / "parts")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "parts").glob("*/part-*.txt"))) > 3
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")} == want and len(want) == 3
    assert {r.chat_id: r.bytes for r in reports} == {"only feeds": None} | {r.chat_id: len(want[r.file_name]) for r in reports if r.file_name}
    none = transcript.export_transcripts(rows.filter("chat_id = 'only feeds'"), str(tmp_path / "none"), str(tmp_path / "none-parts"))
    assert [(r.messages, r.bytes) for r in none.collect()] == [(0, None)]


MEDIA = "chatId bigint, logId bigint, authorId bigint, type bigint, sentAt bigint, attachment string"


def test_media_frames_and_tiers(spark):
    rows = spark.createDataFrame(
        [
            (1, 1, 9, 2, 10, '{"w":"10","h":20.9,"cs":"aa","s":5,"url":"http://x/a?expires=100"}'),
            (1, 2, 9, 27, 11, '{"wl":[1],"csl":["a","b"],"imageUrls":["u"]}'),
            (1, 3, 9, 18, 12, '{"name":"a.pdf","size":7,"cs":"","url":"http://x/b"}'),
            (1, 4, 9, 3, 13, "{oops"),
            (1, 5, 9, 1, 14, "{}"),
        ],
        MEDIA,
    )
    frames = media.media_frames(media.media_rows(rows, 1)).cache()
    got = {(r.logId, r.idx): r for r in frames.collect()}
    assert set(got) == {(1, 0), (2, 0), (2, 1), (3, 0), (4, 0)}
    assert (got[1, 0].width, got[1, 0].height) == (10, 20) and got[2, 1].width is None and got[2, 1].output_stem == "2_1"
    assert got[3, 0].filename == "a.pdf" and got[3, 0].checksum_sha1 is None
    none = spark.createDataFrame([], "chatId bigint, logId bigint, idx bigint, existing boolean, full_cached boolean, full_ok boolean, thumb_cached boolean, thumb_ok boolean, fetched_ok boolean")
    plan = {(r.logId, r.idx): (r.tier, r.reason) for r in media.tier_plan(frames, none, 50).collect()}
    assert plan[1, 0] == ("planned", "full-not-cached+cdn-would-fetch") and plan[2, 0] == ("planned", "full-not-cached+cdn-would-fetch")
    assert plan[3, 0] == ("stub", "unavailable+cdn-unverifiable") and plan[4, 0] == ("stub", "not-cached")
    late = {(r.logId, r.idx): (r.tier, r.reason) for r in media.tier_plan(frames, none, 500, dry_run=False).collect()}
    assert late[1, 0] == ("stub", "not-cached+cdn-expired")
    assert media.tier_counts(media.tier_plan(frames, none, 50)).first().frames == 5
    assert [r.logId for r in media.media_rows(rows, limit=2, kinds=["image"]).collect()] == [1, 2]


def test_cache_listing(spark, tmp_path):
    frames = spark.createDataFrame([(1, 5, 0, "5"), (1, 6, 0, "6"), (2, 7, 0, "7")], "chatId bigint, logId bigint, idx bigint, stem string")
    roots = [str(tmp_path / "a b"), str(tmp_path / "b")]
    paths = {(root, r.stem): r.p for root in roots for r in frames.select("stem", media.cache_path(root, F.col("chatId"), F.col("stem"), ".img").alias("p")).collect()}
    for at in ((roots[0], "5"), (roots[1], "5"), (roots[1], "7")):
        path = pathlib.Path(paths[at])
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"abc")
    listing = media.cache_listing(spark, roots)
    assert sorted(map(tuple, listing.collect())) == sorted((paths[at], 3) for at in ((roots[0], "5"), (roots[1], "5"), (roots[1], "7")))
    got = {r.logId: r.cached_path for r in media.first_cached(frames, F.col("stem"), ".img", roots, listing).collect()}
    assert got == {5: paths[roots[0], "5"], 6: None, 7: paths[roots[1], "7"]}


def test_cached_bodies(spark):
    body = b"\xff\xd8\xff" + b"picture"
    sealed = F.aes_encrypt(F.lit(b"w" * 256 + body), F.unhex(F.sha2(F.lit("pass").cast("binary"), 256)), F.lit("CBC"), F.lit("PKCS"))
    assert bytes(one(spark, tx.decrypted_body(F.concat(F.lit(b"MAGI"), sealed), F.lit("pass").cast("binary")))) == body
    assert one(spark, tx.decrypted_body(F.lit(b"MAGIshort"), F.lit("pass").cast("binary"))) is None
    frames = spark.createDataFrame([(1, 5, 0, "5"), (1, 6, 0, "6")], "chatId bigint, logId bigint, idx bigint, stem string")
    path = one(spark, media.cache_path("/b", F.lit(1), F.lit("5"), ".img"))
    listing = spark.createDataFrame([(path,), ("/other",)], "path string")
    got = {r.logId: r.cached_path for r in media.first_cached(frames, F.col("stem"), ".img", ["/a", "/b"], listing).collect()}
    assert got == {5: path, 6: None}


def test_cached_paths_are_not_shuffled(spark):
    """Frames travel once and without paths; each row of one message has its own key, and odd paths match nothing."""
    rows = [(c, i, 0, f"{i}x{c}") for i in range(60) for c in range(2)] + [(1, 5, 0, "other")]
    frames = spark.createDataFrame(rows, "chatId bigint, logId bigint, idx bigint, stem string")
    path = lambda root, c, stem: one(spark, media.cache_path(root, F.lit(c), F.lit(stem), ".img"))
    there = [path("/b", 1, "5x1"), path("/a/", 1, "5x1"), path("/b", 0, "7x0"), path("/b", 0, "7x0")]
    odd = [None, "", "/b", path("/c", 0, "8x0"), path("/b", 0, "9x0") + "~", path("", 0, "9x0"), path("/b", 0, "9x0").upper(), "/b/x/" + "0" * 81 + ".img"]
    listing = spark.createDataFrame([(p,) for p in there + odd], "path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = media.first_cached(frames, F.col("stem"), ".img", ["/a", "/b"], listing)
        got = {(r.chatId, r.logId, r.stem): r.cached_path for r in found.collect() if r.cached_path}
        plan = found._jdf.queryExecution().optimizedPlan().toString(), found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, 5, "5x1"): path("/a", 1, "5x1"), (0, 7, "7x0"): path("/b", 0, "7x0")} and found.count() == 121
    assert found.columns == [*frames.columns, "cached_path"]
    assert plan[1].split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2 and "Generate" not in plan[0]


def test_merged_media_rows(spark):
    a = spark.createDataFrame([(1, 1, 9, 2, 10, "old"), (1, 2, 9, 2, 30, "x")], MEDIA)
    b = spark.createDataFrame([(1, 1, 9, 2, 20, "new"), (1, 3, 9, 2, 5, "y")], MEDIA)
    assert [r.attachment for r in media.merged_media_rows([a, b], 2).collect()] == ["new", "x"]


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("chunk_gap_group_seconds = 5\n")
    assert Config.load(str(path)).chunks.group_gap_seconds == 5
    path.write_text("nope = 1\n")
    with pytest.raises(Exception, match="unknown"):
        Config.load(str(path))

import json
import random
import shutil
import time

import pytest
from helpers import frame, message, rows_of
from pyspark.sql import functions as F

from parley.operators.chunking import build_chunks
from parley.operators.vectors import DeterministicEmbedder
from parley.plans import archive_queries
from parley.plans.engine import Engine, result_json
from parley.plans.freshness import recommendation
from parley.plans.semantic import SemanticIndex
from parley.plans.store import Change, Files, TableStore
from parley.schema import MESSAGES, BadConfig, BadSource, Busy, Config, EmptyQuery, IndexCorrupt, IndexMissing, IndexStale, NotConfirmed
from parley.sources import tables
from parley.sources.adapters import open_source, read_documents, read_json_array, read_jsonl
from parley.sources.records import records
from parley.streaming.ingest import message_stream, session_counts, sync_stream


def record(n, minute, text="hello there", **more):
    return {"account_hash": "h", "chat_id": "g", "chat_name": "Room", "chat_type": "group", "message_id": f"g-{n}", "sender_id": "1", "sender_nickname": "s", "timestamp": f"2024-01-01T09:{minute:02}:00Z", "text": text, "message_type": "text", **more}


def lines(path, records):
    path.write_text("\n\n".join(json.dumps(r) for r in records) + "\n")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", [record(1, 0, extra=5), record(2, 1, reply_to_message_id="g-1")])
    assert [r.reply_to_message_id for r in read_jsonl(spark, path).orderBy("message_id").collect()] == [None, "g-1"]
    bad = tmp_path / "b.jsonl"
    bad.write_text(json.dumps(record(1, 0)) + "\n" + '{"account_hash": "secret')
    with pytest.raises(BadSource, match="line 2") as e:
        read_jsonl(spark, str(bad))
    assert "secret" not in str(e.value)
    lacking = record(1, 0)
    del lacking["text"]
    with pytest.raises(BadSource, match="line 1"):
        read_jsonl(spark, lines(tmp_path / "c.jsonl", [lacking]))


def test_other_sources(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([record(1, 0), record(2, 1)]))
    assert read_json_array(spark, str(path)).count() == 2
    source = open_source(spark, "command", command=["cat", str(path)])
    assert source.messages().count() == 2 and source.chats().count() == 1
    with pytest.raises(BadSource, match="boom"):
        open_source(spark, "command", command=["sh", "-c", "echo boom >&2; exit 3"]).messages()
    with pytest.raises(BadSource):
        open_source(spark, "nope")
    with pytest.raises(BadSource):
        open_source(spark, "fixture")
    (tmp_path / "w.md").write_text("one\ntwo")
    assert read_documents(spark, str(tmp_path)).first().text == "one\ntwo"


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"), Config(vector_dimension=64))
    first = [message(i, i * 2, "ab"[i % 2], text=f"alpha {i}", reply=f"c-{i - 1}" if i == 3 else None) for i in range(6)]
    report = engine.sync(frame(spark, first), "test", touched=True)
    assert (report["inserted"], report["total_messages"], report["full_rebuild"], report["touched"]) == (6, 6, True, ["c"])
    again = engine.sync(frame(spark, first), "test")
    assert (again["inserted"], again["updated"], again["rebuilt_chats"], again["full_rebuild"]) == (0, 0, 0, False)
    more = engine.sync(frame(spark, [message(9, 900, text="omega"), message(1, 2, "b", text="beta 1")]), "test")
    assert (more["inserted"], more["updated"], more["total_messages"]) == (1, 1, 7)
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.sync(engine.table("messages"), "test")
    for name in ("chunks", "windows", "reply_edges", "chunk_parent_refs", "chats"):
        assert rows_of(engine.table(name)) == rows_of(whole.table(name)), name
    assert engine.search("keyword", "omega").count() == 1 and engine.search("bm25", "alpha").count() == 5
    with pytest.raises(IndexMissing):
        engine.search("semantic", "omega")
    assert {r.action for r in engine.index(dry_run=True).collect()} == {"embed"}
    built = engine.index()
    assert built["embedded_texts"] == built["semantic_units"] > 0 and not built["self_healed"]
    assert engine.search("semantic", "omega").first().unit == "parent_window"
    assert engine.index()["embedded_texts"] == 0
    assert engine.doctor()["recommendation"]["index_before_semantic_search"] is False
    engine.sync(frame(spark, [message(10, 2000, text="news")]), "test")
    with pytest.raises(IndexStale):
        engine.search("semantic", "omega")
    assert 0 < engine.index()["reused"]
    pruned = engine.sync(frame(spark, [message(0, 0, "a", text="alpha 0"), message(10, 2000, text="news")]), "test", prune="preview")
    assert pruned["deletable"] == 6 and pruned["total_messages"] == 8
    pruned = engine.sync(frame(spark, [message(0, 0, "a", text="alpha 0"), message(10, 2000, text="news")]), "test", prune="delete")
    assert pruned["total_messages"] == 2 and engine.table("chunks").count() == 2
    chunk = engine.chunks("c").first()
    assert engine.chunk_get(chunk.chunk_id, redact=True).first().text == "[redacted]"
    assert engine.chunk_parent(chunk.chunk_id).count() == 1 and engine.chunk_context(chunk.chunk_id).count() == 1
    engine.register_views()
    assert spark.sql("SELECT count(*) FROM chunk_messages JOIN chunks USING (chunk_id)").first()[0] == 2
    with pytest.raises(NotConfirmed):
        engine.wipe_index()
    engine.wipe_index(confirm=True)
    assert json.loads(result_json(EmptyQuery("x")))["error"]["code"] == "empty_query"
    assert json.loads(result_json(engine.chunks("c")))[0]["chat_id"] == "c"


def test_a_sync_writes_only_what_it_touches(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    month = 60 * 24 * 31
    rows = [message(i, i * month / 4 + k, "ab"[k % 2], chat=f"r{r}", reply=f"r{r}-{i}" if k == 1 else None) for r in range(3) for i in range(12) for k in (0, 1)]
    rows = [(*m[:4], f"{m[4]}-{k % 2}" if k % 2 else m[4], *m[5:]) for k, m in enumerate(rows)]
    engine.sync(frame(spark, rows))
    before = engine.store.manifest()["tables"]
    late = message(99, 11 * month / 4 + 2, chat="r1", text="late", reply="r0-0")
    moved = message(3, 5 * month / 4, chat="r2", text="moved")
    engine.sync(frame(spark, [late]))
    after = engine.store.manifest()["tables"]
    for name in ("messages", "chunks", "windows", "postings"):
        new = {p for p, tag in after[name]["parts"].items() if before[name]["parts"].get(p) != tag}
        assert len(new) == 1 and len(after[name]["parts"]) > 8, name
    engine.sync(frame(spark, [moved]))
    # a parent of another room's reply gets another chunk
    engine.sync(frame(spark, [message(500, 1, "a", chat="r0", text="beside")]))
    whole = Engine(spark, str(tmp_path / "whole"), Config(archive_period="day", room_buckets=3))
    whole.sync(engine.table("messages"))
    for name in ("messages", "chunks", "windows", "window_children", "reply_edges", "chunk_parent_refs", "chats", "postings"):
        assert rows_of(engine.table(name)) == rows_of(whole.table(name)), name
    assert engine.search("bm25", "late").first().parent_chunk_ids == [r.chunk_id for r in engine.table("chunks").collect() if "r0-0" in r.message_ids]
    # what the change before the last one replaced is gone, what readers of the last version need is there
    parts = {f"{p}" for p in after["messages"]["parts"]}
    assert parts and engine.sync(frame(spark, [late]))["rebuilt_chats"] == 0


def test_an_append_reads_only_what_can_hold_its_keys_and_ends(spark, tmp_path, monkeypatch):
    """Of messages, gaps and places only the parts named by the keys and the change's time are read."""
    from parley.plans import engine as module

    monkeypatch.setattr(module, "DELTAS", 2)  # so that a small archive's places aren't gathered anew at once
    engine = Engine(spark, str(tmp_path / "lake"))
    month = 60 * 24 * 31
    engine.sync(frame(spark, [message(10 * r + i, i * month, chat=f"r{r}") for r in range(4) for i in range(9)]))
    whole = {n: set(t["parts"]) for n, t in engine.store.manifest()["tables"].items()}
    read: dict[str, set] = {}
    plain = TableStore.read

    def noted(self, name, table, parts=None):
        read.setdefault(name, set()).update(set(table["parts"]) if parts is None else set(parts) & set(table["parts"]))
        return plain(self, name, table, parts)

    monkeypatch.setattr(TableStore, "read", noted)
    late = message(99, 8 * month + 600, chat="r1", text="late")
    report = engine.sync(frame(spark, [late]))
    assert (report["inserted"], report["total_messages"], report["chunks"]) == (1, 37, 37)
    room = next(p[:4] for p in whole["chunks"] if len(read["chunks"]) == 1 and p in read["chunks"])
    assert all(p.startswith(room) for n in ("messages", "chunks", "windows", "gaps", "postings") for p in read[n])
    assert {n: len(read[n]) for n in ("messages", "chunks", "windows", "postings")} == {"messages": 1, "chunks": 1, "windows": 1, "postings": 1} and len(read["gaps"]) <= 2
    assert len(read["message_places"]) <= 1 < len(whole["message_places"])
    read.clear()
    moved = engine.sync(frame(spark, [message(11, month, chat="r1", text="edited"), late]))
    assert (moved["inserted"], moved["updated"], moved["unchanged"], moved["total_messages"]) == (0, 1, 1, 37)
    assert len(read["message_places"]) <= 3  # two ids' buckets, and what the sync before added


@pytest.mark.parametrize("few", [True, False])
def test_many_small_changes_equal_a_full_build(spark, tmp_path, monkeypatch, few):
    """Appends, edits, moves, deletions, replies across rooms and ids that two accounts share; places are gathered anew in between."""
    from parley.plans import engine as module

    monkeypatch.setattr(module, "DELTAS", 3)
    monkeypatch.setattr(module, "FEW", 1000 if few else -1)
    rng = random.Random(31)
    config = Config(room_buckets=4)
    engine = Engine(spark, str(tmp_path / "lake"), config)
    reply = lambda: rng.choice([None, None, f"{rng.choice('ab')}-{rng.randrange(40)}"])
    some = lambda n, ids: [message(i, rng.randrange(4000), rng.choice("xy"), chat=chat, reply=reply(), account=account, text=f"t{rng.randrange(9)}") for i in rng.choices(ids, k=n) for chat in "ab" for account in rng.choice([["p"], ["p", "q"]])]
    engine.sync(frame(spark, list({(m[0], m[1], m[4]): m for m in some(20, range(30))}.values())))
    for step in range(4):
        batch = list({(m[0], m[1], m[4]): m for m in some(2, range(40))}.values())
        if step == 2:
            engine.sync(frame(spark, batch[:2]), prune="delete")
        report = engine.sync(frame(spark, batch))
        assert report["total_messages"] == engine.table("messages").count() and report["chunks"] == engine.table("chunks").count()
    whole = Engine(spark, str(tmp_path / "whole"), config)
    whole.sync(engine.table("messages"))
    for name in ("messages", "chunks", "windows", "window_children", "reply_edges", "chunk_parent_refs", "postings", "gaps"):
        assert rows_of(engine.table(name)) == rows_of(whole.table(name)), name


def test_plans_of_a_prune_do_not_multiply(spark, tmp_path, monkeypatch):
    """What a sync writes is planned over files, not over the plans of all frames before it; the files go."""
    rows = [message(i, 7 * i, chat=f"c{i % 3}", reply=f"c{i % 3}-{i - 3}" if i % 5 == 0 else None) for i in range(120)]
    engine = Engine(spark, str(tmp_path / "a"))
    engine.sync(frame(spark, rows))
    sizes, write = [], Change.write

    def noted(self, name, made, *args, **more):
        sizes.append(made._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return write(self, name, made, *args, **more)

    monkeypatch.setattr(Change, "write", noted)
    left = [r for i, r in enumerate(rows) if i % 3 or i % 4]
    assert engine.sync(frame(spark, left), prune="delete")["deletable"] == 9
    assert max(sizes) < 500
    inside = [r for i, r in enumerate(rows) if i not in range(12, 109, 12)]  # the first message of the room is beyond the span of the source
    assert rows_of(engine.table("messages").select(MESSAGES.fieldNames())) == rows_of(frame(spark, inside))
    assert rows_of(engine.table("chunks")) == rows_of(build_chunks(frame(spark, inside)))
    assert not list((tmp_path / "a").glob("sync-*"))


def test_rooms_follow_renames(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    engine.sync(frame(spark, [message(1, name="Old"), message(1, chat="d", name="Other")]))
    engine.sync(frame(spark, [message(2, 5, name="New"), message(3, 9, name="Newer")]))
    assert rows_of(engine.table("chats").select("chat_id", "chat_name")) == [("c", "New"), ("d", "Other")]
    engine.sync(frame(spark, [message(0, -5, name="Old again")]))
    assert rows_of(engine.table("chats").select("chat_id", "chat_name")) == [("c", "Old again"), ("d", "Other")]


def test_the_last_row_of_a_key_wins(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    rows = frame(spark, [message(1, text="zzz"), message(1, text="aaa")])
    tagged = spark.createDataFrame([(*r, i) for i, r in enumerate(rows.collect())], "account_hash string, chat_id string, chat_name string, chat_type string, message_id string, sender_id string, sender_nickname string, timestamp timestamp, text string, message_type string, reply_to_message_id string, ordinal bigint")
    engine.sync(tagged)
    assert [r.text for r in engine.table("messages").collect()] == ["aaa"] and "ordinal" not in engine.table("messages").columns
    path = lines(tmp_path / "a.jsonl", [record(1, 0, "zzz"), record(2, 1), record(1, 0, "later edit")])
    other = Engine(spark, str(tmp_path / "other"))
    other.sync(open_source(spark, "fixture", path))
    assert {r.text for r in other.table("messages").collect()} == {"later edit", "hello there"}


def test_a_second_writer_is_turned_away_and_a_dead_one_is_not_waited_for(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    with engine.store.files.lock(), pytest.raises(Busy):
        engine.sync(frame(spark, [message(1)]))
    engine.store.files.write("LOCK.000000000041", "of a writer that died")
    with pytest.raises(Busy):
        engine.sync(frame(spark, [message(1)]))
    with engine.store.files.lock(stale_after=-1):
        assert engine.store.files.exists("LOCK.000000000042")
    assert engine.sync(frame(spark, [message(1)]))["inserted"] == 1
    with pytest.raises(RuntimeError), engine.store.change() as change:
        change.write("extra", spark.range(3).toDF("x"))
        raise RuntimeError
    assert not engine.store.has("extra") and not engine.store.files.names("extra")


def test_two_writers_who_find_one_stale_lock(spark, tmp_path):
    """Only one of them gets the next lease, and a writer whose lease has passed on can't commit."""
    store = TableStore(spark, str(tmp_path / "s"))
    store.files.write("LOCK.000000000007", "of a writer that died")
    with store.files.lock(stale_after=-1) as first:
        assert first.file == "LOCK.000000000008" and store.files._leases("LOCK") == [first.file]
        with pytest.raises(Busy), store.files.lock():  # it saw the dead one too, but comes second
            pass
    assert not store.files._leases("LOCK")
    with pytest.raises(Busy), store.change() as change:
        change.write("t", spark.range(2).toDF("x"))
        store.files.write("LOCK.000000000002", "taken by another while this one slept")
        change.commit()
    assert not store.has("t") and not store.files.names("t") and store.files._leases("LOCK")[-1] == "LOCK.000000000002"
    for lease in store.files._leases("LOCK"):
        store.files.delete(lease)
    with pytest.raises(Busy), store.change() as change:
        change.write("t", spark.range(2).toDF("x"))
        Files(spark, str(tmp_path / "s")).write("CURRENT", json.dumps({"version": 5, "tables": {}, "facts": {}, "dropped": []}))
        change.commit()
    with store.files.lock(stale_after=0.5) as held:
        before = store.files.age(held.file)
        time.sleep(1.2)
        assert held.held() and store.files.age(held.file) < 1 and before < 1  # renewed meanwhile


def test_a_call_reads_one_version(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    engine.sync(frame(spark, [message(1, text="alpha")]))
    now = engine.store.manifest()
    engine.sync(frame(spark, [message(2, 1, text="beta")]))
    assert engine.table("chunks", now).count() == 1 and engine.table("chunks", now).first().text == "alpha" and engine.table("postings", now).count() == 2


def test_records_of_an_array_in_pieces():
    whole = [{"a": i, "b": "]},{" * (i % 3), "c": ["x", {"d": '"'}]} for i in range(50)]
    for text in (json.dumps(whole), json.dumps(whole, indent=2), json.dumps(whole, ensure_ascii=False) + " \n"):
        for size in (1, 7, 10_000):
            assert [json.loads(r) for r in records(iter([text[i : i + size] for i in range(0, len(text), size)]))] == whole
    assert list(records(iter([" [ ", "] "]))) == []
    for bad in ("", "{}", "[1]", '[{"a":1}', '[{"a":1} {"b":2}]', '[{"a":1}] x', '[{"a":', "[,]"):
        with pytest.raises(ValueError):
            list(records(iter(bad)))


def test_each_array_is_a_file_of_its_own(spark, tmp_path, monkeypatch):
    """However many tasks deal the rows out, a file holds one array, rows of a key in order."""
    monkeypatch.setattr(archive_queries, "ARRAY_ROWS", 8)
    rows = frame(spark, [message(i // 2, i, text=f"{i}") for i in range(600)]).repartition(7).withColumn("n", F.col("text").cast("int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        archive_queries._arrays(rows, str(tmp_path / "a"), "message_id", ["message_id", "n"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = [[r["message_id"] + " " + r["text"] for r in json.loads(p.read_text())] for p in (tmp_path / "a").rglob("part-*")]
    assert len(found) > 50 and sorted(x for f in found for x in f) == sorted(f"c-{i // 2} {i}" for i in range(600))
    assert all(f.index(f"c-{i // 2} {i}") + 1 == f.index(f"c-{i // 2} {i + 1}") for f in found for i in range(0, 600, 2) if f"c-{i // 2} {i}" in f)
    assert read_json_array(spark, str(tmp_path / "a")).count() == 600
    assert open_source(spark, "array", str(tmp_path / "a")).messages().count() == 600


def test_rows_of_a_key_come_from_one_array(spark):
    """The later of each customer's two rows counts, also where many tasks deal the rows out."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = archive_queries.last_row_of_an_array(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect()
    assert sorted(map(tuple, found)) == sorted((f"k{r.c_custkey}", f"aaa {r.c_name}") for r in want)


def test_orders_of_sources(spark, tmp_path):
    """Of two rows of a key in an array, in a command's output and in a stream the later one counts."""
    both = [record(1, 0, "zzz first"), record(2, 1), record(1, 0, "aaa edited")]
    (tmp_path / "a.json").write_text(json.dumps(both))
    inbox = tmp_path / "in"
    inbox.mkdir()
    lines(inbox / "0.jsonl", both)
    engines = [Engine(spark, str(tmp_path / f"lake{i}")) for i in range(3)]
    engines[0].sync(open_source(spark, "array", str(tmp_path / "a.json")))
    engines[1].sync(open_source(spark, "command", command=["cat", str(tmp_path / "a.json")]))
    sync_stream(engines[2], message_stream(spark, str(inbox)), str(tmp_path / "cp")).awaitTermination()
    for engine in engines:
        assert {r.text for r in engine.table("messages").collect()} == {"aaa edited", "hello there"}
    with pytest.raises(BadSource, match="no array"):
        open_source(spark, "command", command=["echo", "nothing"]).messages()
    with pytest.raises(BadSource):
        open_source(spark, "command", command=["/nowhere/at/all"]).messages()


def test_settings_are_followed(spark, tmp_path):
    from parley.operators.vectors import register_model

    register_model("lengths", lambda texts: [[float(len(t)), 1.0, 0.0] for t in texts])
    engine = Engine(spark, str(tmp_path / "lake"), Config(embedder_model="lengths", vector_dimension=3, embedding_batch_size=2, source_adapter="array"))
    assert (engine.embedder.id, engine.embedder.dimension, engine.embedder.batch) == ("lengths", 3, 2)
    (tmp_path / "a.json").write_text(json.dumps([record(1, 0), record(2, 1)]))
    assert engine.sync(engine.source(str(tmp_path / "a.json")))["inserted"] == 2
    engine.index()
    assert engine.search("semantic", "x").count() == 1
    with pytest.raises(BadConfig):
        Engine(spark, str(tmp_path / "x"), Config(embedder_model="unknown"))
    (tmp_path / "bad.json").write_text(json.dumps([record(1, 0), {"account_hash": "h"}]))
    with pytest.raises(BadSource):
        engine.source(str(tmp_path / "bad.json")).messages()


def test_index_heals_validates_and_looks_again(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"), embedder=DeterministicEmbedder(8))
    engine.sync(frame(spark, [message(i, i * 400) for i in range(4)]))
    assert not engine.index()["self_healed"] and not engine.index()["self_healed"]
    other = Engine(spark, str(tmp_path / "lake"), embedder=DeterministicEmbedder(16))
    with pytest.raises(IndexStale):
        other.search("semantic", "text")
    # a generation that lost vectors is found out where the archive's version doesn't vouch for it, and healed
    [(part, held)] = engine.index_store.parts().items()
    folder = engine.index_store.folder(part, held["tag"])
    kept = engine.index_store.vectors().limit(2).toPandas()
    spark.createDataFrame(kept, engine.index_store.vectors().schema).write.mode("overwrite").parquet(folder)
    with pytest.raises(IndexCorrupt):
        engine.index_store.verify(engine.table("windows"))
    healed = engine.index()
    assert healed["self_healed"] and (healed["embedded_texts"], healed["reused"]) == (2, 2)
    versions = iter([7, 8])
    with pytest.raises(IndexStale):
        engine.index_store.search(engine.table("windows"), "text", version=lambda: next(versions))
    assert engine.search("semantic", "text").count() == 4
    engine.sync(frame(spark, [message(9, 9000)]))
    assert engine.index()["self_healed"]


def test_index_writes_only_the_parts_that_changed(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"), Config(archive_period="day"), DeterministicEmbedder(8))
    store, day = engine.index_store, 24 * 60
    rows = [message(i, i * 400 + day * (i % 3), chat=f"r{i % 4}", text=f"words of {i}") for i in range(24)]
    engine.sync(frame(spark, rows))
    first = engine.index()
    parts = store.parts()
    assert len(parts) > 8 and (first["embedded_texts"], first["self_healed"]) == (24, False) and set(parts) == set(store._held(store._read(parts)))

    def same_as_anew():
        fresh = SemanticIndex(spark, str(tmp_path / f"fresh{random.random()}"), engine.embedder)
        made = fresh.build(engine.table("windows"))
        assert rows_of(fresh.vectors()) == rows_of(store.vectors()) and made["archive_revision"] == store.cursor()["archive_revision"]
        names = lambda s: sorted(r.name for r in spark.read.parquet(*(s.folder(p, t["tag"]).replace("/vectors/", "/documents/") for p, t in s.parts().items())).collect())
        assert names(fresh) == names(store)
        assert store.verify(engine.table("windows")) == store._current()

    def written():
        before, now = parts, store.parts()
        return {p for p in now if p not in before or before[p]["tag"] != now[p]["tag"]}, set(before) - set(now)

    # nothing new: nothing is written, and nothing of the archive is read
    assert engine.index()["embedded_texts"] == 0 and written() == (set(), set())
    # one message more in a room: one part is, with one vector
    engine.sync(frame(spark, [message(100, 400 * 30, chat="r1", text="one more")]))
    assert [r.action for r in engine.index(dry_run=True).collect()].count("embed") == 1
    report = engine.index()
    assert report["embedded_texts"] == 1 and report["reused"] == 24 and len(written()[0]) == 1 and not written()[1]
    same_as_anew()
    # an edit: the part of the edited window, whose other texts keep their vectors
    parts = store.parts()
    engine.sync(frame(spark, [message(1, 400 + day, chat="r1", text="edited")]))
    assert engine.index()["embedded_texts"] == 1 and len(written()[0]) == 1
    same_as_anew()
    # what lies between a room's first and last message goes: so do its parts
    parts = store.parts()
    left = [rows[6], rows[22]]
    engine.sync(frame(spark, left), prune="delete")
    engine.index()
    assert written()[1] and store.vectors().filter("chat_id = 'r2'").count() == 2
    same_as_anew()
    # other periods: other parts, the same vectors
    monthly = Engine(spark, engine.root, Config(archive_period="month"), engine.embedder)
    monthly.sync(frame(spark, left[:1]))
    report = monthly.index()
    assert report["embedded_texts"] == 0 and report["reused"] == report["semantic_units"]
    same_as_anew()


def test_a_damaged_part_heals_alone(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"), embedder=DeterministicEmbedder(8))
    engine.sync(frame(spark, [message(i, i * 400, chat=f"r{i % 5}") for i in range(20)]))
    engine.index()
    store = engine.index_store
    want, parts = rows_of(store.vectors()), store.parts()
    a, b = sorted(parts)[:2]
    # one part's file is no Parquet, another part is gone
    for file in (tmp_path / "lake").rglob(f"vectors/*/part={a}/*.parquet"):
        file.write_bytes(b"damaged")
    shutil.rmtree(store.folder(b, parts[b]["tag"]))
    with pytest.raises(IndexCorrupt):
        store.verify(engine.table("windows"))
    (tmp_path / "lake" / engine.config.semantic_dir / "vectors" / "gbroken").mkdir()  # of a build that was killed
    healed = engine.index()
    now = store.parts()
    assert healed["self_healed"] and healed["embedded_texts"] == parts[a]["n"] + parts[b]["n"]
    assert {p for p in now if now[p]["tag"] != parts[p]["tag"]} == {a, b} and rows_of(store.vectors()) == want
    assert not store.files.exists("vectors/gbroken")
    # a copied file: its rows count once
    [file] = (tmp_path / "lake").rglob(f"vectors/{now[a]['tag']}/part={a}/*.parquet")
    shutil.copy(file, file.with_name("part-copy.parquet"))
    assert engine.index()["embedded_texts"] == 0 and rows_of(store.vectors()) == want
    # the list of parts is no JSON: all is made anew
    store.files.write(f"generations/{store._current()}/parts.json", "{")
    with pytest.raises(IndexCorrupt):
        engine.search("semantic", "text")
    assert engine.index()["self_healed"] and rows_of(store.vectors()) == want
    # an empty archive has an index without parts
    bare = SemanticIndex(spark, str(tmp_path / "bare"), engine.embedder)
    assert bare.build(engine.table("windows").limit(0))["semantic_units"] == 0 and bare.vectors().isEmpty()
    assert bare.search(engine.table("windows").limit(0), "text").isEmpty()


def test_media_calls(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    rows = spark.createDataFrame([(1, 10, 5, 2, 100, '{"url":"http://x/a?expires=999999","cs":"ab","s":5}'), (1, 11, 5, 18, 101, '{"name":"f.txt","size":3}'), (2, 12, 6, 3, 102, None)], "chatId bigint, logId bigint, authorId bigint, type int, sentAt bigint, attachment string")
    probes = spark.createDataFrame([(1, 10, 0, False, True, True, False, False, False)], "chatId bigint, logId bigint, idx bigint, existing boolean, full_cached boolean, full_ok boolean, thumb_cached boolean, thumb_ok boolean, fetched_ok boolean")
    got = {r.chatId: (r.tier_counts, r.frames) for r in engine.media_backfill(rows, probes, 0).collect()}
    assert got == {1: ({"full": 1, "stub": 1}, 2), 2: ({"stub": 1}, 1)}
    assert [r.tier for r in engine.media_get(rows, probes, 0, 1, 10).collect()] == ["full"]
    bodies = spark.createDataFrame([("a.bin", b"xyz"), ("../b", b"x"), ("c", None), ("é.jpg", b"")], "name string, body binary")
    done = {r.name: (r.bytes, r.error) for r in engine.media_write(bodies, str(tmp_path / "out")).collect()}
    assert done == {"a.bin": (3, None), "../b": (None, "not a file name"), "c": (None, "no body"), "é.jpg": (0, None)}
    assert (tmp_path / "out" / "a.bin").read_bytes() == b"xyz" and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.bin", "é.jpg"]


def test_settings_drift_rebuilds(spark, tmp_path):
    rows = frame(spark, [message(1), message(2, 5)])
    Engine(spark, str(tmp_path / "l")).sync(rows)
    report = Engine(spark, str(tmp_path / "l"), Config(chunk_gap_group_seconds=60)).sync(rows)
    assert report["full_rebuild"] and report["chunks"] == 2


def test_lock(spark, tmp_path):
    files = Files(spark, str(tmp_path / "x"))
    with files.lock(), pytest.raises(Busy), files.lock():
        pass
    with files.lock():
        pass


def test_damaged_index_heals(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "l"), embedder=DeterministicEmbedder(8))
    engine.sync(frame(spark, [message(1)]))
    engine.index()
    engine.index_store.files.write("CURRENT", "../evil")
    assert engine.doctor()["recommendation"]["index_before_semantic_search"]
    assert engine.index()["self_healed"]


@pytest.mark.parametrize("args, want", [((False, False), (True, True)), ((True, False), (False, True)), ((True, True, None, False), (True, True)), ((True, True, None, True, False), (False, True)), ((True, True, None, True, True), (False, False)), ((True, True, "bad"), (False, True))])
def test_freshness(args, want):
    got = recommendation(*args)
    assert (got["sync_before_search"], got["index_before_semantic_search"]) == want


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    engine = Engine(spark, str(tmp_path / "lake"))
    for k, records in enumerate([[record(1, 0), record(2, 30)], [record(3, 15), record(1, 0, "edited")]]):
        lines(inbox / f"{k}.jsonl", records)
        sync_stream(engine, message_stream(spark, str(inbox), 1), str(tmp_path / "cp")).awaitTermination()
    assert engine.table("messages").count() == 3 and engine.search("keyword", "edited").count() == 1
    counts = session_counts(message_stream(spark, str(inbox)))
    query = counts.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("sessions").count() == 3


def test_application_tables(spark):
    import plistlib

    blob = plistlib.dumps([7, 1, 2, 5], fmt=plistlib.FMT_BINARY)
    rooms = spark.createDataFrame(
        [(100, 0, 1, "Named", 3, 0, None), (200, 0, 0, "", 2, 1, None), (300, 0, 1, None, 5, 0, blob), (400, 9, 1, "", 5, 0, None), (500, 0, 1, "", 9, 7, None), (600, 0, 1, "", 9, 0, None)],
        "chatId bigint, linkId bigint, type bigint, chatName string, activeMembersCount bigint, directChatMemberUserId bigint, displayMemberIds binary",
    )
    users = spark.createDataFrame([(1, "", "", "Nick"), (2, "Friend", "Display", "N"), (7, None, None, None)], "userId bigint, friendNickName string, displayName string, nickName string")
    meta = spark.createDataFrame([(600, 3, 2, "Old"), (600, 3, 5, "New"), (600, 1, 9, "No")], "chatId bigint, type bigint, revision bigint, content string")
    links = spark.createDataFrame([(9, "Open")], "linkId bigint, linkName string")
    got = {r.chatId: (r.chat_name, r.chat_type) for r in tables.room_table(rooms, users, 7, meta, links).collect()}
    assert got == {100: ("Named", "group"), 200: ("Nick", "direct"), 300: ("Nick, Friend", "group"), 400: ("Open", "group"), 500: ("chat-500", "direct"), 600: ("New", "group")}
    rows = spark.createDataFrame(
        [(100, 1, 7, 1, None, None, "a", 10), (100, 2, 2, 26, None, '{"src_logId":1}', "b", 11), (100, 3, 5, 26, '{"src_logId":3}', None, "c", None), (999, 4, 1, 1, None, None, "d", 12), (100, 5, 1, 1, None, None, "", 13)],
        "chatId bigint, logId bigint, authorId bigint, type bigint, supplement string, attachment string, message string, sentAt bigint",
    )
    old = tables.normalized(rows, rooms.drop("displayMemberIds"), users, 7)
    new = {r.message_id: r for r in tables.normalized(rows, rooms, users, 7, meta, links).collect()}
    assert set(new) == {"100-1", "100-2", "100-3", "999-4"} and old.count() == 4
    assert new["100-1"].sender_nickname == "나" and new["100-2"].reply_to_message_id == "100-1" and new["100-3"].reply_to_message_id is None
    assert new["100-3"].sender_nickname == "user-5" and new["100-3"].timestamp.year == 1970 and new["999-4"].chat_type == "direct"
    assert tables.merged_messages([old, tables.normalized(rows, rooms, users, 7)]).count() == 4


def test_hits_are_fetched_from_their_parts(spark, tmp_path):
    """A search reads the chunks or windows of the parts that its hits are in, and no others."""
    engine = Engine(spark, str(tmp_path / "lake"), embedder=DeterministicEmbedder(64))
    rows = [message(n, n * 50_000, chat=f"r{n % 3}", text="needle here" if n == 5 else f"hay{n}") for n in range(12)]
    engine.sync(frame(spark, rows))
    engine.index()
    for ranker, name in (("bm25", "chunks"), ("semantic", "windows")):
        every = {f for f in engine.table(name).inputFiles()}
        found = engine.search(ranker, "needle here")
        read = {f for f in found.inputFiles() if f"/{name}/" in f}
        assert 0 < len(read) <= found.count() < len(every) and read < every
        assert "needle" in found.orderBy("rank").first().snippet


def test_engine_writes_one_file_a_room(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "lake"))
    engine.sync(frame(spark, [message(n, n, chat=f"r{n % 2}") for n in range(8)]))
    reports = engine.transcript(str(tmp_path / "out")).collect()
    files = {p.name: p.stat().st_size for p in (tmp_path / "out").iterdir() if p.suffix == ".md"}
    assert files == {r.file_name: r.bytes for r in reports} and len(files) == 2
    assert not list((tmp_path / "lake").glob("transcript-*"))

import json
import random

from helpers import frame, message, rows_of

from parley.operators.chunking import build_chunks
from parley.schema import MESSAGES
from parley.streaming.chunker import chunk_stream
from parley.streaming.ingest import message_stream


def put(folder, n, rows):
    names = [f.name for f in MESSAGES.fields]
    lines = [json.dumps({k: v.isoformat() + "Z" if k == "timestamp" else v for k, v in zip(names, r)}) for r in rows]
    (folder / f"{n:03}.json").write_text("\n".join(lines) + "\n")


def streamed(spark, tmp_path, parts, late):
    """The chunks that come out of a stream of one file after the other, by the number of the file."""
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for n, part in enumerate(parts):
        put(inbox, n, part)
        chunks = chunk_stream(message_stream(spark, str(inbox)), late=late)
        chunks.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def test_chunks_of_a_stream(spark, tmp_path):
    rng = random.Random(9)
    rows, at = [], 0.0
    for i in range(300):
        at += rng.choice((0.2, 1, 4, 12, 31))
        room = rng.randrange(3)
        rows.append(message(i, at, rng.choice("ab"), f"r{room}", ("group", "direct", "group")[room], type_=rng.choice(("text", "text", "text", "photo")), account=rng.choice(("x", "x", "y"))))
    # rows come up to 50 rows late, one comes twice, and a message long after them ends all chunks
    order = sorted(range(len(rows)), key=lambda i: i + rng.random() * 50)
    parts = [[rows[i] for i in order[k : k + 100]] for k in range(0, 300, 100)]
    parts[2].append(parts[2][-1])
    end = message(0, at + 60 * 24 * 60, chat="end")
    found = streamed(spark, tmp_path, [*parts, [end]], "20 hours")
    want = build_chunks(frame(spark, rows))
    assert rows_of(found) == rows_of(want.select(*found.columns)) and found.count() > 100


def test_a_late_message_changes_no_chunk_that_came_out(spark, tmp_path):
    rows = [message(1, 0), message(2, 1), message(3, 60 * 24)]
    parts = [rows[:2], rows[2:], [message(9, 2, text="late")], [message(0, 60 * 24 * 9, chat="end")]]
    found = streamed(spark, tmp_path, parts, "1 hour")
    assert rows_of(found) == rows_of(build_chunks(frame(spark, rows)).select(*found.columns))


def test_a_busy_room_is_held_in_slices(spark, tmp_path):
    """What waits of one room is the state of many keys, and its chunks that begin and end in a slice, or go over many, are whole."""
    rows = [message(i, 3 * i, "a" if i < 300 or i % 4 else "b") for i in range(900)]
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for n, part in enumerate((rows, [message(0, 60 * 24 * 60, chat="end")])):
        put(inbox, n, part)
        stream = chunk_stream(message_stream(spark, str(inbox))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        stream.awaitTermination()
        held = [max(op.numRowsTotal for op in p.stateOperators) for p in stream.recentProgress]
        assert n or max(held) >= 45  # hours
    found = spark.read.parquet(out)
    assert rows_of(found) == rows_of(build_chunks(frame(spark, rows)).select(*found.columns))
    assert max(r.message_count for r in found.collect()) == 300


def test_a_chunk_waits_for_the_slices_that_it_can_go_on_in(spark, tmp_path):
    rows = [message(1, 58), message(2, 66)]
    parts = [[rows[0], message(0, 95, chat="other")], rows[1:], [message(1, 60 * 24 * 9, chat="end")]]
    found = streamed(spark, tmp_path, parts, "1 minute").filter("chat_id = 'c'")
    assert rows_of(found) == rows_of(build_chunks(frame(spark, rows)).select(*found.columns)) and found.count() == 1


def test_an_edit_in_a_slice_replaces_what_waits(spark, tmp_path):
    rows = [message(1, 1), message(2, 2), message(3, 3, text=None)]
    parts = [[message(1, 1, text="draft"), *rows[1:]], rows[:1], [message(0, 60 * 24 * 9, chat="end")]]
    found = streamed(spark, tmp_path, parts, "1 hour")
    assert rows_of(found) == rows_of(build_chunks(frame(spark, rows)).select(*found.columns)) and found.count() == 1

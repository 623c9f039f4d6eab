import datetime as dt
import hashlib
import random

import pytest
from helpers import T0, frame, message, rows_of

from parley.operators import incremental, upsert
from parley.operators.chunking import build_chunks, chunk_messages
from parley.operators.windows import build_windows, window_line, window_numbers
from parley.schema import ChunkSettings


def chunk_id(account, chat, first, last):
    return "chunk_" + hashlib.sha256(f"{account}|{chat}|{first}|{last}|v1".encode()).hexdigest()[:16]


def plain_chunks(rows, group=600, direct=1800):
    out = []
    for r in sorted(rows, key=lambda r: (r[1], r[7], r[4], r[0])):
        p = out[-1][-1] if out else None
        fresh = p is None or (p[0], p[1], p[6]) != (r[0], r[1], r[6]) or p[9] != "text" or r[9] != "text" or int((r[7] - p[7]).total_seconds()) > (group if r[3] == "group" else direct)
        if fresh:
            out.append([])
        out[-1].append(r)
    return out


def noise(seed, n, chats=3):
    rng = random.Random(seed)
    rows, at = [], dict.fromkeys(range(chats), 0.0)
    for i in range(n):
        c = rng.randrange(chats)
        at[c] += rng.choice([0, 0.2, 1, 4, 9, 12, 40, 1500])
        reply = f"c{c}-{rng.randrange(n)}" if rng.random() < 0.2 else None
        rows.append(message(i, at[c], rng.choice("ab"), f"c{c}", rng.choice(["group", "direct"]), "x" * rng.choice([3, 200, 900]), rng.choice(["text"] * 6 + ["type_26"]), reply, rng.choice(["acct"] * 8 + ["other"])))
    return rows


def test_group_gap(spark):
    rows = frame(spark, [message(1, 0), message(2, 5), message(3, 16)])
    assert sorted(r.message_count for r in build_chunks(rows).collect()) == [1, 2]
    assert build_chunks(rows, ChunkSettings(9999)).count() == 1


def test_gap_is_cut_to_whole_seconds(spark):
    a = message(1)
    b = list(message(2))
    b[7] = T0 + dt.timedelta(seconds=600, milliseconds=600)
    assert build_chunks(frame(spark, [a, tuple(b)])).count() == 1
    b[7] = T0 + dt.timedelta(seconds=601)
    assert build_chunks(frame(spark, [a, tuple(b)])).count() == 2


@pytest.mark.parametrize("slice_seconds", [60, 86_400])
def test_chunks_against_a_plain_loop(spark, slice_seconds):
    rows = noise(1, 300)
    want = [
        (chunk_id(c[0][0], c[0][1], c[0][4], c[-1][4]), c[0][7], c[-1][7], "\n".join(r[8] for r in c), [r[4] for r in c])
        for c in plain_chunks(rows)
    ]
    got = build_chunks(frame(spark, rows), slice_seconds=slice_seconds).select("chunk_id", "started_at", "ended_at", "text", "message_ids")
    assert rows_of(got) == sorted(want, key=repr)


def test_an_instant_of_very_many_messages_is_cut_by_count(spark, monkeypatch):
    """All messages of one room have one time: their slices stay small, and chunks and windows are those of the plain loops."""
    from parley.operators import ordered

    monkeypatch.setattr(ordered, "CUT_EACH", 50)
    rows = [message(i, 5, "ab"[i // 7 % 2], text="x" * (i % 90), type_="text" if i % 11 else "type_2") for i in range(3000)]
    rows += [message(9000 + i, i / 3, "ab"[i % 2], chat="d") for i in range(40)]
    df = frame(spark, rows)
    sizes = [r["count"] for r in ordered.sliced(df, ["chat_id"], ["timestamp", "message_id", "account_hash"], "timestamp", 86_400).groupBy("chat_id", "slice").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 20 and max(sizes) < 800
    got = build_chunks(df).select("chunk_id", "started_at", "ended_at", "text", "message_ids")
    want = [(chunk_id(c[0][0], c[0][1], c[0][4], c[-1][4]), c[0][7], c[-1][7], "\n".join(r[8] for r in c), [r[4] for r in c]) for c in plain_chunks(rows)]
    assert rows_of(got) == sorted(want, key=repr)
    made = build_chunks(df)
    assert rows_of(build_windows(made)) == rows_of(build_windows(made, slice_seconds=None))
    assert rows_of(build_chunks(df, slice_seconds=None)) == rows_of(made)


def test_two_accounts_break_chunks_and_no_message_is_lost(spark):
    rows = [message(i, i, account=a) for i in range(4) for a in ("x", "y")]
    chunks = build_chunks(frame(spark, rows))
    assert chunk_messages(chunks).count() == 8
    assert chunks.select("chunk_id").distinct().count() == chunks.count()


def test_empty_messages(spark):
    chunks = build_chunks(frame(spark, []))
    assert chunks.count() == 0 and build_windows(chunks).count() == 0


def plain_windows(chunks):
    out = []
    for c in sorted(chunks, key=lambda c: (c.chat_id, c.started_at, c.message_ids[0], c.account_hash)):
        line = len(f"[{c.sender_nickname}] {c.text}")
        p = out[-1] if out else None
        if p is None or p["chat"] != c.chat_id or int((c.started_at - p["end"]).total_seconds()) > 300 or p["n"] + 1 + line > 3000:
            out.append({"chat": c.chat_id, "n": line, "end": c.ended_at, "ids": [c.chunk_id]})
        else:
            p["n"] += 1 + line
            p["end"] = c.ended_at
            p["ids"].append(c.chunk_id)
    return [w["ids"] for w in out]


@pytest.mark.parametrize("slice_seconds", [60, 86_400])
def test_windows_against_a_plain_fold(spark, slice_seconds):
    chunks = build_chunks(frame(spark, noise(2, 400))).cache()
    want = sorted(map(tuple, plain_windows(chunks.collect())))
    got = build_windows(chunks, slice_seconds=slice_seconds).filter("ordinal = 0")
    assert sorted(tuple(r.child_chunk_ids) for r in got.collect()) == want


def test_oversized_chunk_is_cut(spark):
    text = "y" * 3256
    chunks = build_chunks(frame(spark, [message(1, text=text)]))
    got = build_windows(chunks).orderBy("ordinal").collect()
    whole = "[a] " + text
    assert [r.text for r in got] == [whole[:3000], whole[3000:]]
    assert [r.message_count for r in got] == [1, 0]
    assert len({r.parent_id for r in got}) == 2


def test_repeated_text_has_distinct_windows(spark):
    chunks = build_chunks(frame(spark, [message(i, text="z" * 999) for i in range(9)]))
    windows = build_windows(chunks)
    assert windows.select("parent_id").distinct().count() == windows.count() >= 3


def test_window_line(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(window_line(F.lit("s"), F.lit("t"))).first()[0] == "[s] t"


def test_burst_numbers(spark):
    chunks = build_chunks(frame(spark, [message(1, 0, "a"), message(2, 1, "b"), message(3, 30, "a")]))
    assert window_numbers(chunks).select("burst").distinct().count() == 2


def edit(rows, how):
    rows = list(rows)
    if how == "append":
        return [*rows, message(9001, 90_000, chat="c1", text="new")]
    if how == "backfill":
        return [*rows, message(9002, 3.1, chat="c0", text="late")]
    if how == "rename":
        return [tuple([*r[:6], "renamed", *r[7:]]) if i == 40 else r for i, r in enumerate(rows)]
    if how == "edit":
        return [tuple([*r[:8], "edited " * 60, *r[9:]]) if i % 70 == 5 else r for i, r in enumerate(rows)]
    if how == "later":
        return [tuple([*r[:7], r[7] + dt.timedelta(days=30), *r[8:]]) if i == 33 else r for i, r in enumerate(rows)]
    return rows


@pytest.mark.parametrize("how", ["append", "backfill", "rename", "edit", "later", "nothing"])
def test_scoped_rebuild_equals_full_build(spark, how):
    before = noise(3, 250)
    after = edit(before, how)
    old, new = frame(spark, before), frame(spark, after).cache()
    chunks = build_chunks(old).cache()
    windows = build_windows(chunks).cache()
    changed = upsert.changes(old, upsert.latest_of_batch(new, ["account_hash", "chat_id", "message_id"]))
    hit = upsert.touched_chats(changed).select("chat_id", "earliest").cache()
    got = incremental.rebuild(new, chunks, windows, hit)
    full = build_chunks(new)
    assert rows_of(got[0]) == rows_of(full)
    assert rows_of(got[1]) == rows_of(build_windows(full))
    assert (hit.count() == 0) == (how == "nothing")

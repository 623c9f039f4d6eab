"""Chunks of a stream, each as soon as nothing on time can change it any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from parley.operators.chunking import chunk_id
from parley.schema import ChunkSettings

#: What a slice's state holds of a room's messages, and how long a slice of a room is.
HELD = ("us", "message_id", "account_hash", "sender_nickname", "message_type", "chat_type", "chat_name", "text")
SLICE_SECONDS = 3_600
#: A run of messages: what a chunk takes from it, and by what the one before and the one after are told apart from it.
RUN = {
    **{c: "bigint" for c in ("started", "ended")},
    **{c: "string" for c in ("account_hash", "chat_name", "sender_nickname", "message_type", "chat_type", "last_account", "last_sender", "last_type", "text")},
    "message_ids": "array<string>",
}
CHUNK = ["chat_id", "account_hash", "chat_name", "sender_nickname", "started", "ended", "text", "message_ids"]
CLOSED = ", ".join(f"{c} {RUN.get(c, 'string')}" for c in CHUNK)
STATE = ", ".join(f"{c} {kind}" for c, kind in RUN.items())
#: ``inner``: others of its slice are on both sides; ``begins``: one of its slice is before it.
CUT = f"array<struct<{', '.join(f'{c}: {kind}' for c, kind in RUN.items())}, inner: boolean, begins: boolean>>"
CUT_TYPE = pa.list_(pa.struct([(c, {"bigint": pa.int64(), "string": pa.string()}.get(kind, pa.list_(pa.string()))) for c, kind in RUN.items()] + [("inner", pa.bool_()), ("begins", pa.bool_())]))
#: So many closed chunks are handed on at once, and the closed ones of all rooms' slices are dealt out to so many groups.
AT_ONCE, DEALT = 4_096, 256
#: State of more messages than memory holds: a store on disk with a bounded cache, which takes no disk ahead; and batches of slices that aren't larger than this.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
Run = dict


def differ(a, b) -> bool:
    return a is not None and b is not None and a != b


def begins(prev: Run, now: Run, settings: ChunkSettings) -> bool:
    """Does a chunk start at a run that follows another?"""
    gap = settings.group_gap_seconds if now["chat_type"] == "group" else settings.direct_gap_seconds
    other = differ(prev["last_account"], now["account_hash"]) or differ(prev["last_sender"], now["sender_nickname"])
    return other or differ(prev["last_type"], "text") or differ(now["message_type"], "text") or (now["started"] - prev["ended"]) // 1_000_000 > gap


def single(m: dict) -> Run:
    """A message as a run."""
    last = {"last_account": m["account_hash"], "last_sender": m["sender_nickname"], "last_type": m["message_type"]}
    return {**{c: m.get(c) for c in RUN}, "started": m["us"], "ended": m["us"], **last, "message_ids": [m["message_id"]]}


def joined(runs: list[Run]) -> Run:
    """Runs that follow each other as one."""
    if len(runs) == 1:
        return runs[0]
    texts = [r["text"] for r in runs if r["text"] is not None]
    last = {c: runs[-1][c] for c in ("ended", "last_account", "last_sender", "last_type")}
    return {**runs[0], **last, "text": "\n".join(texts) if texts else None, "message_ids": [i for r in runs for i in r["message_ids"]]}


def chunk_of(room: str | None, runs: list[Run]) -> list:
    """The columns CHUNK of a chunk."""
    made = joined(runs)
    return [room, *(made[c] if c != "text" or made[c] is not None else "" for c in CHUNK[1:])]


def cut(messages: list[dict], settings: ChunkSettings) -> list[dict]:
    """The runs of a room's slice; of a message that came more than once the last copy."""
    once = {(m["message_id"], m["account_hash"]): single(m) for m in messages}
    runs: list[list[Run]] = []
    for m in sorted(once.values(), key=lambda m: (m["started"], m["message_ids"][0] or "", m["account_hash"] or "")):
        if runs and not begins(runs[-1][-1], m, settings):
            runs[-1].append(m)
        else:
            runs.append([m])
    return [{**joined(r), "inner": 0 < i < len(runs) - 1, "begins": i > 0} for i, r in enumerate(runs)]


def last_slice(ended: int, settings: ChunkSettings) -> int:
    """When the slices that a run can go on in have gone by, in milliseconds; ``ended`` is the run's last instant."""
    longest = (max(settings.group_gap_seconds, settings.direct_gap_seconds) + 1) * 1_000_000
    return -(-(ended + longest) // (SLICE_SECONDS * 1_000_000)) * SLICE_SECONDS * 1_000


class Rooms(StatefulProcessor):
    """Puts together the runs at the edges of a room's slices; the state is the room's open chunk."""

    def __init__(self, settings: ChunkSettings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if key[1] >= 0:  # closed on both sides
            for batch in rows:
                yield batch.assign(text=batch["text"].fillna(""))[CHUNK]
            return
        names = [*RUN, "begins"]
        runs = [dict(zip(names, r)) for batch in rows for r in zip(*(batch[c].tolist() for c in names))]
        begun, closed = [dict(zip(RUN, self.open.get()))] if self.open.exists() else [], []
        for r in sorted(runs, key=lambda r: (r["started"], r["begins"])):
            if begun and (r["begins"] or begins(begun[-1], r, self.settings)):
                closed.append(chunk_of(key[0], begun))
                begun = []
            begun.append(r)
            if len(closed) == AT_ONCE:
                yield pd.DataFrame(closed, columns=CHUNK)
                closed = []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # the slices up to the watermark have all come
        if last_slice(begun[-1]["ended"], self.settings) <= timerValues.getCurrentWatermarkInMs():
            closed.append(chunk_of(key[0], begun))
            self.open.clear()
        else:
            made = joined(begun)
            self.open.update(tuple(list(made[c]) if c == "message_ids" else made[c] for c in RUN))
            self.handle.registerTimer(last_slice(made["ended"], self.settings))
        yield pd.DataFrame(closed, columns=CHUNK)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield pd.DataFrame([chunk_of(key[0], [dict(zip(RUN, self.open.get()))])], columns=CHUNK)
            self.open.clear()

    def close(self) -> None:
        pass


def chunk_stream(messages: DataFrame, settings: ChunkSettings = ChunkSettings(), late: str = "1 hour") -> DataFrame:
    """The chunks of ``build_chunks`` from a stream of messages that come at most ``late`` after later ones.

    A message waits until the watermark has passed its slice of its room's time, so that
    they are taken in their order whatever order they come in.  A slice is cut into runs
    by a task for each slice; those between others are chunks.  Only its first and
    last run can go on beyond it: these, at most two a slice, go to their room, whose state is the
    open chunk.  A chunk comes out, once, when another begins or when no slice
    that is still to come is within the longest gap after its last message.  A message that
    comes twice while its slice waits counts once, as it came last; with a time in another
    slice it is another message.  Messages that come after their slice has gone are not in these chunks;
    ``sync_stream`` beside this rebuilds the archive's with them.

    State is kept on disk, by settings of the session (STORE) that a stream takes when it starts.
    """
    for k, v in STORE.items():
        messages.sparkSession.conf.set(k, v)

    @F.arrow_udf(CUT)
    def runs_of(slices: pa.Array) -> pa.Array:
        return pa.array([cut(s.as_py(), settings) for s in slices], CUT_TYPE)

    held = F.struct(F.unix_micros("timestamp").alias("us"), *HELD[1:])
    slices = messages.withWatermark("timestamp", late).groupBy("chat_id", F.window("timestamp", f"{SLICE_SECONDS} seconds").alias("slice")).agg(F.collect_list(held).alias("messages"))
    runs = slices.select("chat_id", F.window_time("slice").alias("at"), F.explode(runs_of("messages")).alias("run"))
    inner = F.col("run.inner")
    part = F.when(inner, F.pmod(F.xxhash64("chat_id", "at"), F.lit(DEALT))).otherwise(-1)
    runs = runs.select(F.when(~inner, F.col("chat_id")).alias("room"), part.cast("bigint").alias("part"), "chat_id", "at", *(F.col(f"run.{c}").alias(c) for c in [*RUN, "begins"]))
    found = runs.groupBy("room", "part").transformWithStateInPandas(Rooms(settings), CLOSED, "append", "eventtime")
    ids = F.col("message_ids")
    return found.select(
        chunk_id(F.col("account_hash"), F.col("chat_id"), ids[0], F.element_at(ids, -1)).alias("chunk_id"),
        "account_hash",
        "chat_id",
        "chat_name",
        "sender_nickname",
        F.timestamp_micros("started").alias("started_at"),
        F.timestamp_micros("ended").alias("ended_at"),
        "text",
        "message_ids",
        F.size("message_ids").cast("bigint").alias("message_count"),
    )

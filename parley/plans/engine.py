"""The engine: ingest, index, search, navigate, export, over one data folder."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import incremental, media, navigate, replies, search, transcript, upsert
from parley.operators.chunking import build_chunks, chunk_messages
from parley.operators.ordered import SLICE_SECONDS
from parley.operators.vectors import Embedder, archive_revision, embedder_of
from parley.operators.windows import build_windows
from parley.plans.freshness import recommendation
from parley.plans.semantic import Archived, SemanticIndex
from parley.plans.store import PART, Change, Files, TableStore, bucket_of, by_part
from parley.schema import DEFAULT_LIMIT, MESSAGE_KEY, MESSAGE_VALUES, MESSAGES, ORDINAL, PERIODS, ROOM, ChunkSettings, Config, IndexMissing, MissingChunk, ParleyError
from parley.sources.adapters import Source, open_source

TABLES = ("messages", "chats", "sync_cursors", "chunks", "windows", "window_children", "reply_edges", "chunk_parent_refs", "postings")
#: Stored tables that follow from the messages, and the number of their layout.
DERIVED, LAYOUT = ("chunks", "windows", "window_children", "reply_edges", "chunk_parent_refs", "postings", "gaps", "message_places"), 2
#: The first letters of the parts that messages' new places are added in, and how many such parts gather before all are written anew.
DELTA, DELTAS = "delta-", 32
#: So many ids are looked up by a list, and a batch of no more rows is a small one.
FEW = 1_000
#: What a small batch touches goes through the driver if it has no more rows and bytes of text than these: plans of local rows are short.
FEW_TOUCHED, FEW_BYTES = 20_000, 8 << 20


def _within(parts: set[str], buckets: set[str]) -> set[str]:
    """The parts of some buckets."""
    return {p for p in parts if p[:4] in buckets}


def _together(few: bool, *calls: Callable[[], object]) -> None:
    """Run calls that each start jobs, at the same time if these are of few rows; the first error is raised when all have ended.

    Jobs of many rows fill the executors one by one, and at the same time their plans would fill the driver.
    """
    with ThreadPoolExecutor(len(calls) if few else 1) as pool:
        for done in [pool.submit(call) for call in calls]:
            done.result()


class Kept:
    """Frames that are worked out once: in files beside the archive, or as local rows where they are known to be few.

    A plan over files ends there.  One over a persisted frame holds that frame's plan
    again in each place that reads it, and so those of the frames below: with frames
    kept from kept frames the driver's plans multiply.  Only the batch is persisted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.few, self._frames = spark, False, []
        self._files, self._names = Files(spark, f"{root}/sync-{uuid.uuid4().hex}"), itertools.count()

    def persist(self, frame: DataFrame) -> DataFrame:
        self._frames.append(frame.persist())
        return frame

    def keep(self, frame: DataFrame) -> DataFrame:
        if self.few:
            return self.local(frame)
        path = self._files.at(str(next(self._names)))
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def local(self, frame: DataFrame) -> DataFrame:
        return self.spark.createDataFrame(frame.toArrow(), frame.schema)

    def release(self) -> None:
        for frame in self._frames:
            frame.unpersist()
        self._files.delete()


class Engine:
    """One archive and its index."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embedder: Embedder | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.store = TableStore(spark, f"{self.root}/archive")
        self.embedder = embedder or embedder_of(self.config)
        self.index_store = SemanticIndex(spark, f"{self.root}/{self.config.semantic_dir}", self.embedder)

    def table(self, name: str, now: dict | None = None, parts: set[str] | None = None) -> DataFrame:
        """A table of the archive as it is now, or by a manifest that was read before: all of a call's tables are of one version.

        With ``parts`` only these are read.
        """
        tables = (now or self.store.manifest())["tables"]
        if name == "window_children":
            windows = self.store.read("windows", tables["windows"], parts)
            return windows.select("chat_id", "started_at", "parent_id", F.posexplode("child_chunk_ids").alias("ordinal", "chunk_id"))
        stored = "reply_edges" if name == "chunk_parent_refs" else name
        rows = self.store.read(stored, tables[stored], parts)
        if name == "reply_edges":
            return rows.drop("account_hash").distinct()
        if name == "chunk_parent_refs":
            return rows.filter("parent_chunk_id is not null and child_chunk_id <> parent_chunk_id").select("chat_id", "child_chunk_id", "parent_chunk_id").distinct()
        return rows

    def register_views(self) -> None:
        """The tables as temporary views, with the table of messages in chunks."""
        now = self.store.manifest()
        for name in TABLES:
            self.table(name, now).createOrReplaceTempView(name)
        chunk_messages(self.table("chunks", now)).createOrReplaceTempView("chunk_messages")

    def sync(self, source: Source | DataFrame, source_name: str = "source", prune: str | None = None, touched: bool = False) -> dict:
        """Upsert a source's messages and rebuild what they touch.

        Of several rows of one key the last by the column ``ordinal`` counts, if the
        source has one.  Tables lie in parts, by bucket of the room and by period, and
        only parts that hold something changed are written.  ``prune``: ``preview``
        reports archived messages that the source no longer has, ``delete`` removes
        them.  Everything becomes visible at once, or not at all; a second writer is
        turned away.
        """
        began = time.time()
        batch = source if isinstance(source, DataFrame) else source.messages()
        kept = Kept(self.spark, self.root)
        batch = kept.persist(upsert.latest_of_batch(batch, MESSAGE_KEY, ORDINAL if ORDINAL in batch.columns else None, ROOM))
        try:
            with self.store.change() as change:
                return self._sync(change, batch, kept, source_name, prune, touched, began)
        finally:
            kept.release()

    def _part(self, rows: DataFrame, ts: str | None = None, bucket: str = "chat_id") -> DataFrame:
        return by_part(rows, bucket, ts, PERIODS[self.config.archive_period], self.config.room_buckets)

    def _parts_of(self, rows: DataFrame, ts: str | None = None, few: bool = False) -> set[str]:
        """The parts of rows: at most a few for each bucket and period.  ``few``: are there so few rows that they need no aggregation?"""
        parts = self._part(rows, ts).select(PART)
        return {r[0] for r in (parts if few else parts.distinct()).collect()}

    def _holding(self, best: DataFrame) -> set[str]:
        """The parts of the chunks or windows that hold ranked local rows: hits are fetched from these alone."""
        return self._parts_of(best, "started_at", few=True)

    def _sync(self, change: Change, batch: DataFrame, kept: Kept, source_name: str, prune: str | None, touched: bool, began: float) -> dict:
        settings = self.config.chunks
        layout = {"period": self.config.archive_period, "buckets": self.config.room_buckets, "tables": LAYOUT}
        facts = change.old["facts"]
        drifted = facts.get("chunk_settings") != asdict(settings) or facts.get("layout") != layout or not change.has("chunks")
        room, key = self._bucket("chat_id"), self._bucket("message_id")
        if not drifted and not prune:
            some = batch.limit(FEW + 1).toArrow()
            kept.few = some.num_rows <= FEW and some.nbytes <= FEW_BYTES
            batch = self.spark.createDataFrame(some, batch.schema) if kept.few else batch
        rows = batch.select(*MESSAGE_KEY, *MESSAGE_VALUES)
        if kept.few:  # local rows: no job
            near = batch.select(room.alias("room"), key.alias("key"), "message_id").collect()
            rooms, keys, ids = {r["room"] for r in near}, {r["key"] for r in near}, [r["message_id"] for r in near]
        else:
            near = batch.agg(F.collect_set(room).alias("rooms"), F.collect_set(key).alias("keys")).first()
            rooms, keys, ids = set(near["rooms"]), set(near["keys"]), rows.select("message_id").distinct()

        # what is archived of the batch's keys: of the parts that the index of places names, no others are read
        if not change.has("messages"):
            archive = self.spark.createDataFrame([], MESSAGES)
        elif drifted:
            archive = change.table("messages")
        else:
            found = self._places(change, ids, keys)
            archive = change.table("messages", self._parts_of(found.withColumnRenamed("at", "timestamp"), "timestamp", kept.few))
        changed = kept.keep(upsert.changes(archive, rows))
        real = F.col("change") != "unchanged"
        new_part = self._part(changed.withColumn("_t", F.col("timestamp")), "_t").withColumnRenamed(PART, "_new")
        both = self._part(new_part.withColumn("_o", F.coalesce("old_timestamp", "timestamp")), "_o")
        what = both.agg(
            *(F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("inserted", "updated", "unchanged")),
            F.collect_set(F.when(real, F.col("_new"))).alias("new"), F.collect_set(F.when(F.col("change") == "updated", F.col(PART))).alias("old"),
            F.count_distinct(F.when(real, F.col("chat_id"))).alias("rooms"), F.collect_set(F.when(real, room)).alias("buckets"),
        ).first()
        counts = {c: what[c] for c in ("inserted", "updated", "unchanged")}
        news = changed.filter(real).select(*MESSAGE_KEY, *MESSAGE_VALUES)
        hit = upsert.touched_chats(changed).select("chat_id", "earliest")
        parts, buckets, rebuilt = {*what["new"], *what["old"]}, set(what["buckets"]), what["rooms"]
        gone = None
        if prune:
            mine = archive if drifted or not change.has("messages") else change.table("messages", _within(change.parts("messages"), rooms))
            gone = kept.keep(upsert.deletions(upsert.merged(mine, news), batch))
            counts["deletable"] = gone.count()
            if prune == "delete" and counts["deletable"]:
                whole = gone.select("chat_id", F.lit(None).cast("timestamp").alias("earliest")).distinct()
                hit = hit.join(whole.select("chat_id"), "chat_id", "left_anti").unionByName(whole)
                parts |= self._parts_of(gone.select("chat_id", "timestamp"), "timestamp")
                buckets |= self._parts_of(whole)
                rebuilt = hit.count()
        gone = gone if prune == "delete" and counts["deletable"] else None
        hit = kept.keep(hit)
        read_ms = int((time.time() - began) * 1000)
        rebuild_from = time.time()

        always = [lambda: self._write_cursors(change, batch), lambda: self._write_chats(change, batch, rooms, drifted)]
        if drifted:
            merged = upsert.merged(archive, news)
            merged = merged if gone is None else merged.join(gone.select(*MESSAGE_KEY), MESSAGE_KEY, "left_anti")
            _together(kept.few, *always, lambda: self._rebuild_all(change, merged, settings))
            rebuilt = change.table("messages").select("chat_id").distinct().count()
        elif rebuilt:
            self._rebuild(change, news, gone, hit, parts, buckets, settings, kept, always)
        else:
            _together(kept.few, *always)
        report = {**counts, "rebuilt_chats": rebuilt, "full_rebuild": drifted}
        report["total_messages"], report["chunks"] = change.rows("messages"), change.rows("chunks")
        if touched:
            report["touched"] = sorted(r["chat_id"] for r in hit.select("chat_id").limit(100_000).collect())
        at = dt.datetime.now(dt.UTC).isoformat()
        change.commit({"chunk_settings": asdict(settings), "layout": layout, "last_sync": {"completed_at": at, "source": source_name}})
        report["timings_ms"] = {"read_source": read_ms, "rebuild_chunks": int((time.time() - rebuild_from) * 1000)}
        return report

    def _bucket(self, column: str) -> Column:
        return bucket_of(F.col(column), self.config.room_buckets)

    def _places(self, change: Change, ids: list[str] | DataFrame, buckets: set[str]) -> DataFrame:
        """(MESSAGE_KEY, at, chunk_id) of the archived messages that have one of the ids, a short list or a column ``message_id`` without repeats.

        Reads the ids' buckets and what was added since these were written.  The latest
        row of a message counts; one without a time says that it was deleted.
        """
        rows = change.table("message_places", {p for p in change.parts("message_places") if p in buckets or p.startswith(DELTA)})
        # a list skips row groups by their bounds
        rows = rows.filter(F.col("message_id").isin(ids)) if isinstance(ids, list) else rows.join(ids, "message_id", "left_semi")
        last = rows.groupBy(*MESSAGE_KEY).agg(F.max_by(F.struct("at", "chunk_id"), "version").alias("_p"))
        return last.select(*MESSAGE_KEY, "_p.at", "_p.chunk_id").filter("at is not null")

    def _write_cursors(self, change: Change, batch: DataFrame) -> None:
        cursors = change.table("sync_cursors") if change.has("sync_cursors") else None
        change.write("sync_cursors", upsert.sync_cursor(batch, cursors).coalesce(1))

    def _write_chats(self, change: Change, batch: DataFrame, rooms: set[str], drifted: bool) -> None:
        """The rooms' rows, as the batch's first message of each has it; only parts in which something differs are written."""
        new = upsert.first_of_rooms(batch)
        old = change.table("chats", None if drifted else rooms) if change.has("chats") else self.spark.createDataFrame([], new.schema)
        every = not change.has("chats") or drifted
        if not every:
            rooms = self._parts_of(upsert.changes(old, new, ["chat_id"], ["chat_name", "chat_type"]).filter("change <> 'unchanged'"))
            if not rooms:
                return
            old, new = change.table("chats", rooms), new.filter(self._bucket("chat_id").isin(sorted(rooms)))
        change.write("chats", self._part(upsert.merged(old, new, ["chat_id"], ["chat_name", "chat_type"])), None if every else rooms)

    def _rebuild_all(self, change: Change, messages: DataFrame, settings: ChunkSettings) -> None:
        """Write all tables that follow from all messages."""
        for name in DERIVED:
            change.drop(name)
        change.write("messages", self._part(messages, "timestamp"), None, ("chat_id", "timestamp", "message_id"), counted=True)
        messages = change.table("messages")
        change.write("chunks", self._part(build_chunks(messages, settings), "started_at"), None, ("chat_id", "started_at"), counted=True)
        chunks = change.table("chunks")
        change.write("windows", self._part(build_windows(chunks), "started_at"), None, ("chat_id", "started_at"))
        light = chunks.select("chunk_id", "chat_id", "started_at", "text")
        owners = replies.owner_of(chunks)
        places = self._placed(messages.select(*MESSAGE_KEY, F.col("timestamp").alias("at")), chunks, change.old["version"] + 1)
        _together(
            False,
            lambda: change.write("gaps", self._part(incremental.long_gaps(change.table("windows")), "started_at"), None, ("chat_id", "started_at")),
            lambda: change.write("postings", self._part(search.postings(light), "started_at"), None, ("term",)),
            lambda: change.write("reply_edges", self._part(replies.with_owners(replies.edges_of(messages), owners))),
            lambda: change.write("message_places", self._part(places, bucket="message_id"), None, ("message_id",)),
        )

    def _placed(self, messages: DataFrame, chunks: DataFrame, version: int) -> DataFrame:
        """Rows of the table of places: each message's time, and the chunk of its account and room that holds it."""
        each = chunks.select("account_hash", "chat_id", F.explode("message_ids").alias("message_id"), "chunk_id")
        return messages.join(each, MESSAGE_KEY, "left").select(*MESSAGE_KEY, "at", "chunk_id", F.lit(version).cast("bigint").alias("version"))

    def _rebuild(
        self, change: Change, news: DataFrame, gone: DataFrame | None, hit: DataFrame, parts: set[str], buckets: set[str], settings: ChunkSettings, kept: Kept,
        always: list[Callable[[], object]],
    ) -> None:
        """Write the parts that hold changed messages, and those of their rooms from the rebuild's floors on."""
        left = lambda rows: rows if gone is None else rows.join(gone.select(*MESSAGE_KEY), MESSAGE_KEY, "left_anti")
        floors, firsts = self._floors(change, hit, buckets, kept)
        late = {name: {p for p in change.parts(name) if p[:4] in firsts and p >= firsts[p[:4]]} for name in ("messages", "chunks", "windows", "gaps", "postings")}
        before = incremental.tail_messages(change.table("messages", late["messages"]), floors)
        keys = before.select(*MESSAGE_KEY) if gone is None else before.select(*MESSAGE_KEY).unionByName(gone.select(*MESSAGE_KEY))
        tail = left(upsert.merged(before, news))
        if kept.few:
            # no more rows than are few, and one beyond that says that there are more
            some = before.limit(FEW_TOUCHED + 1).toArrow()
            kept.few = some.num_rows <= FEW_TOUCHED and some.nbytes <= 4 * FEW_BYTES
            if kept.few:
                before = self.spark.createDataFrame(some, before.schema)
                keys, tail = before.select(*MESSAGE_KEY), upsert.merged(before, news)
        slices = None if kept.few else SLICE_SECONDS
        tail = kept.keep(tail)
        fresh = kept.keep(build_chunks(tail, settings, slices))
        n = some.num_rows + news.count() if kept.few else tail.count()
        old = {name: change.table(name, late[name]) for name in ("chunks", "windows", "gaps", "postings")}
        messages = change.table("messages", parts)
        light = fresh.select("chunk_id", "chat_id", "started_at", "text")
        put = lambda name, rows, order, **more: change.write(name, self._part(rows, "started_at"), late[name], order, **more)

        def windows() -> None:
            made = kept.keep(build_windows(fresh, slice_seconds=slices))
            gaps = upsert.replace_tail(old["gaps"], incremental.long_gaps(made, slice_seconds=slices), floors, at_floor=True)
            _together(
                kept.few,
                lambda: put("windows", upsert.replace_tail(old["windows"], made, floors), ("chat_id", "started_at")),
                lambda: put("gaps", gaps, ("chat_id", "started_at")),
            )

        _together(
            kept.few,
            *always,
            lambda: change.write("messages", self._part(left(upsert.merged(messages, news)), "timestamp"), parts, ("chat_id", "timestamp", "message_id"), counted=True),
            lambda: put("chunks", upsert.replace_tail(old["chunks"], fresh, floors), ("chat_id", "started_at"), counted=True),
            windows,
            lambda: put("postings", upsert.replace_tail(old["postings"], search.postings(light), floors), ("term",)),
            lambda: self._relink(change, tail, fresh, keys, gone, buckets, n, kept),
        )

    def _floors(self, change: Change, hit: DataFrame, buckets: set[str], kept: Kept) -> tuple[DataFrame, dict[str, str]]:
        """Where each touched room's rebuild starts, and the first part of each bucket that this reaches.

        The long gaps are looked for in the latest periods up to the change first; all
        earlier ones are read only where a room has none there.
        """
        upto = {r["b"]: r["p"] for r in self._part(self._part(hit.filter("earliest is not null")).withColumnRenamed(PART, "b"), "earliest").groupBy("b").agg(F.max(PART).alias("p")).collect()}
        mine = sorted(p for p in change.parts("gaps") if p[:4] in upto and p <= upto[p[:4]])
        recent = {p for b in upto for p in [x for x in mine if x[:4] == b][-2:]}
        for chosen in (recent, set(mine)):
            floors = kept.keep(incremental.floors_of(change.table("gaps", chosen), hit))
            reach = self._part(self._part(floors).withColumnRenamed(PART, "b").withColumn("_at", F.coalesce("floor", F.to_timestamp(F.lit("0001-01-01")))), "_at")
            first = F.min(F.when(F.col("floor").isNull(), F.col("b")).otherwise(F.col(PART))).alias("first")
            found = reach.groupBy("b").agg(first, F.count(F.when(F.col("floor").isNull() & F.col("earliest").isNotNull(), 1)).alias("open")).collect()
            if chosen == set(mine) or not any(r["open"] for r in found):
                break
        return floors.drop("earliest"), {r["b"]: r["first"] for r in found}

    def _relink(self, change: Change, tail: DataFrame, fresh: DataFrame, keys: DataFrame, gone: DataFrame | None, buckets: set[str], n: int, kept: Kept) -> None:
        """Write the reply edges with an end in the rebuilt tails anew, and the places of the tails' messages.

        ``keys`` are the messages that the tails had before.  Other edges keep their chunks.
        """
        version = change.old["version"] + 1
        placed = kept.keep(self._placed(tail.select(*MESSAGE_KEY, F.col("timestamp").alias("at")), fresh, version))
        inside = keys.unionByName(tail.select(*MESSAGE_KEY))
        ids = inside.select("message_id").distinct()
        ends = [ids.select(F.col("message_id").alias(f"_{c}"), F.lit(True).alias(c)) for c in ("p", "c")]
        child = inside.withColumnRenamed("message_id", "child_message_id")
        tied = F.coalesce("p", "c", F.lit(False))

        def others(parts: set[str] | None) -> DataFrame:
            """Edges that aren't those of the tails' messages, which come from the messages; with ``p`` or ``c`` where an end is in a tail."""
            rows = change.table("reply_edges", parts).join(child, [*MESSAGE_KEY[:2], "child_message_id"], "left_anti")
            return rows.join(ends[0], F.col("parent_message_id") == F.col("_p"), "left").join(ends[1], F.col("child_message_id") == F.col("_c"), "left")

        again = kept.keep(others(None).filter(tied).select(*replies.EDGE).unionByName(replies.edges_of(tail)))
        buckets = buckets | self._parts_of(again, few=kept.few)
        moved = lambda: change.write("message_places", *self._moved(change, placed, gone, version, n))
        if kept.few:  # local rows: no job
            near = again.select("child_message_id", "parent_message_id", self._bucket("child_message_id").alias("c"), self._bucket("parent_message_id").alias("p")).collect()
            wanted, where = sorted({x for r in near for x in r[:2]}), {x for r in near for x in r[2:]}
        else:
            wanted = again.select(F.explode(F.array("child_message_id", "parent_message_id")).alias("message_id")).distinct()
            where = set(wanted.agg(F.collect_set(self._bucket("message_id"))).first()[0])
        # chunks of messages with these ids that aren't in the tails
        elsewhere = self._places(change, wanted, where).join(inside, MESSAGE_KEY, "left_anti").select("message_id", "chunk_id")
        owners = elsewhere.unionByName(placed.select("message_id", "chunk_id")).filter("chunk_id is not null").groupBy("message_id").agg(F.min("chunk_id").alias("chunk_id"))
        same = others(buckets).filter(~tied).select(*replies.EDGE, *replies.OWNED)
        rows = same.unionByName(replies.with_owners(again, kept.keep(owners)))
        _together(kept.few, moved, lambda: change.write("reply_edges", self._part(rows), buckets))

    def _moved(self, change: Change, placed: DataFrame, gone: DataFrame | None, version: int, n: int) -> tuple[DataFrame, set[str] | None, tuple[str, ...]]:
        """What to write of the table of places, and which parts that replaces: a part beside the others, or all anew where much has gathered."""
        if gone is not None:
            none = [F.lit(None).cast(kind).alias(c) for c, kind in (("at", "timestamp"), ("chunk_id", "string"))]
            placed = placed.unionByName(gone.select(*MESSAGE_KEY, *none, F.lit(version).cast("bigint").alias("version")))
        deltas = sum(p.startswith(DELTA) for p in change.parts("message_places"))
        if deltas < DELTAS and n * DELTAS <= change.rows("messages"):
            return placed.withColumn(PART, F.lit(f"{DELTA}{version:012}")), set(), ("message_id",)
        every = change.table("message_places").unionByName(placed)
        last = every.groupBy(*MESSAGE_KEY).agg(F.max_by(F.struct("at", "chunk_id", "version"), "version").alias("_p")).select(*MESSAGE_KEY, "_p.*").filter("at is not null")
        return self._part(last, bucket="message_id"), None, ("message_id",)

    def index(self, full: bool = False, dry_run: bool = False) -> dict | DataFrame:
        if dry_run:
            return self.index_store.plan(self.table("windows"))
        now = self.store.manifest()
        table = now["tables"]["windows"]
        return self.index_store.build(Archived(now["version"], table["parts"], lambda parts: self.store.read("windows", table, parts, placed=True)), full)

    def wipe_index(self, confirm: bool = False) -> None:
        self.index_store.wipe(confirm)

    def search(self, ranker: str, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Hits by ``keyword``, ``bm25``, ``semantic`` or ``terms``."""
        length, now = self.config.snippet_length, self.store.manifest()
        if ranker == "keyword":
            return search.keyword_search(self.table("chunks", now), query, limit, length, self.table("chunk_parent_refs", now))
        if ranker == "bm25":
            best = search.bm25_best(self.table("postings", now), query, limit)
            parts = self._holding(best)
            refs = self.table("chunk_parent_refs", now, {p[:4] for p in parts})
            return search.bm25_hits(self.table("chunks", now, parts), best, query, length, refs)
        if ranker == "semantic":
            version = lambda: self.store.manifest()["version"]
            return self.index_store.search(self.table("windows", now), query, limit, length, version, lambda best: self.table("windows", now, self._holding(best)))
        if ranker == "terms":
            return search.term_search(self.table("windows", now), query, limit, length)
        raise ParleyError(f"unknown ranker {ranker!r}")

    def chunk_get(self, chunk_id: str, redact: bool = False, ids: bool = False) -> DataFrame:
        found = navigate.get_chunk(self.table("chunks"), chunk_id, redact, ids)
        if found.isEmpty():
            raise MissingChunk(f"no chunk {chunk_id}")
        return found

    def chunk_context(self, chunk_id: str) -> DataFrame:
        now = self.store.manifest()
        return navigate.chunk_context(self.table("chunks", now), self.table("window_children", now), chunk_id)

    def chunk_parent(self, chunk_id: str) -> DataFrame:
        now = self.store.manifest()
        return navigate.windows_of_chunk(self.table("windows", now), self.table("window_children", now), chunk_id)

    def chunks(self, chat_id: str | None = None) -> DataFrame:
        now = self.store.manifest()
        rows = navigate.chunk_summaries(self.table("chunks", now), self.table("chunk_parent_refs", now), self.table("window_children", now), chat_id)
        return rows.orderBy("started_at", "chunk_id")

    def source(self, path: str | None = None, command: list[str] | None = None, read: Callable[[], DataFrame] | None = None) -> Source:
        """The source of the kind that the settings name."""
        return open_source(self.spark, self.config.source_adapter, path, command, read)

    def source_chats(self, source: Source) -> DataFrame:
        return source.chats().orderBy("chat_id")

    def transcript(self, path: str, chat_id: str | None = None, since: str | None = None) -> DataFrame:
        """Write one file a room below ``path``; the reports of all rooms."""
        parts = Files(self.spark, f"{self.root}/transcript-{uuid.uuid4().hex}")
        try:
            return transcript.export_transcripts(transcript.in_range(self.table("messages"), chat_id), path, parts.root, since)
        finally:
            parts.delete()

    def media_plan(self, rows: DataFrame, probes: DataFrame, now_epoch: int, **options) -> DataFrame:
        return media.tier_plan(media.media_frames(rows), probes, now_epoch, **options)

    def media_get(self, rows: DataFrame, probes: DataFrame, now_epoch: int, chat_id: int, log_id: int, **options) -> DataFrame:
        """The plan of one message's media."""
        return self.media_plan(media.media_rows(rows, chat_id, log_id=log_id), probes, now_epoch, **options)

    def media_backfill(self, rows: DataFrame, probes: DataFrame, now_epoch: int, kinds: list[str] = (), **options) -> DataFrame:
        """(chatId, tier_counts, frames, bytes) of every room with media of the kinds, planned at once."""
        wanted = rows.filter(F.col("type").isin(media.types_of(list(kinds))))
        return media.tier_counts(self.media_plan(wanted, probes, now_epoch, **options))

    def media_write(self, bodies: DataFrame, folder: str) -> DataFrame:
        return media.write_bodies(bodies, folder)

    def doctor(self) -> dict:
        """Whether a sync or an index is due, and why."""
        now = self.store.manifest()
        facts = now["facts"]
        corrupt, indexed, equal = None, False, None
        try:
            cursor = self.index_store.cursor()
            indexed = True
        except IndexMissing:
            cursor = None
        except ParleyError as e:
            cursor, corrupt = None, str(e)
        present = "windows" in now["tables"]
        if cursor and present:
            equal = cursor.get("archive_version") == now["version"] or cursor["archive_revision"] == archive_revision(self.table("windows", now))
        return {"last_sync": facts.get("last_sync"), "last_index": cursor, "recommendation": recommendation("last_sync" in facts, indexed, corrupt, present, equal)}


def result_json(result, pretty: bool = False) -> str:
    """A result, or an error, as JSON."""
    if isinstance(result, ParleyError):
        result = {"ok": False, "error": {"code": result.code, "message": str(result), "cause": str(result.__cause__) if result.__cause__ else None}}
    elif isinstance(result, DataFrame):
        result = [json.loads(x[0]) for x in result.select(F.to_json(F.struct("*"))).toLocalIterator()]
    return json.dumps(result, ensure_ascii=False, indent=2 if pretty else None)

"""Attachments: their frames, and where each one's body can come from."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.jsonpath import as_long, as_text, object_only
from parley.functions.text import safe_filename
from parley.shared import file_system

#: Message types by kind.
KINDS = {"photo": (2, 27), "video": (3,), "file": (18,)}
ALIASES = {"image": "photo"}
ALBUM, VIDEO, FILE = 27, 3, 18
#: What an album's attachment lists, and what another's has.
LISTS, SINGLES = ("wl", "hl", "csl", "sl", "imageUrls"), ("w", "h", "cs", "s", "size", "name", "url")
#: No body of more bytes is fetched.
MAX_FETCH_BYTES = 512 << 20


def types_of(kinds: list[str]) -> list[int]:
    """The message types of kinds; no kinds means all."""
    names = [ALIASES.get(k, k) for k in kinds] or list(KINDS)
    return sorted({t for n in names for t in KINDS[n]})


def media_rows(messages: DataFrame, chat_id: int | None = None, kinds: list[str] = (), log_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a room, or all, that can hold media: one row, the newest ``limit`` or all, oldest first."""
    rows = messages.filter(F.col("type").isin(types_of(list(kinds))))
    if chat_id is not None:
        rows = rows.filter(F.col("chatId") == chat_id)
    if log_id is not None:
        return rows.filter(F.col("logId") == log_id)
    if limit is not None:
        rows = rows.orderBy(F.col("sentAt").desc(), F.col("logId").desc()).limit(limit)
    return rows.orderBy("sentAt", "logId")


def merged_media_rows(frames: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Rows of several databases: the newest of each log id, the newest ``limit``, oldest first."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    newest = Window.partitionBy("chatId", "logId").orderBy(F.col("sentAt").desc())
    rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    if limit is not None:
        rows = rows.orderBy(F.col("sentAt").desc(), F.col("logId").desc()).limit(limit)
    return rows.orderBy("sentAt", "logId")


def rooms_with_media(messages: DataFrame, kinds: list[str] = ()) -> DataFrame:
    """(chatId): the rooms that hold media of the kinds."""
    return messages.filter(F.col("type").isin(types_of(list(kinds)))).select("chatId").distinct()


def media_frames(rows: DataFrame) -> DataFrame:
    """The frames of media rows (chatId, logId, authorId, type, sentAt, attachment): one for each picture of an album, else one a row.

    A malformed attachment counts as an empty one.
    """
    # one parse an attachment; every value as text, that of an array as its JSON
    parsed = F.from_json(object_only(F.col("attachment")), ", ".join(f"{k} string" for k in (*LISTS, *SINGLES)))
    rows = rows.select("chatId", "logId", "authorId", "type", "sentAt", parsed.alias("_a"))
    album = (F.col("type") == ALBUM) & F.coalesce(F.col("_a.csl").startswith("["), F.lit(False))
    many = lambda key: F.when(album, F.from_json(F.col(f"_a.{key}"), "array<string>"))
    rows = rows.select("*", *(many(k).alias(f"_{k}") for k in LISTS))
    album = F.col("_csl").isNotNull()
    places = F.when(album, F.when(F.size("_csl") > 0, F.sequence(F.lit(0), F.size("_csl") - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.array(F.lit(0)))
    rows = rows.select("chatId", "logId", "authorId", "type", "sentAt", album.alias("_album"), *(f"_{k}" for k in LISTS), F.explode(places).alias("idx"), *(F.col(f"_a.{k}").alias(f"_1{k}") for k in SINGLES))
    at = lambda key: F.get(F.col(f"_{key}"), F.col("idx"))
    is_file = F.col("type") == FILE
    kind = F.when(is_file, "file").when(F.col("type") == VIDEO, "video").otherwise("photo")
    pick = lambda whole, single: F.when(F.col("_album"), whole).otherwise(single)
    size = F.when(is_file, F.coalesce(as_long(F.col("_1size")), as_long(F.col("_1s")))).otherwise(F.coalesce(as_long(F.col("_1s")), as_long(F.col("_1size"))))
    none = F.lit(None)
    return rows.select(
        "chatId",
        "logId",
        F.col("idx").cast("bigint").alias("idx"),
        kind.alias("kind"),
        pick(as_long(at("wl")), F.when(~is_file, as_long(F.col("_1w")))).alias("width"),
        pick(as_long(at("hl")), F.when(~is_file, as_long(F.col("_1h")))).alias("height"),
        pick(as_text(at("csl")), as_text(F.col("_1cs"))).alias("checksum_sha1"),
        pick(as_long(at("sl")), size).alias("size_bytes"),
        F.when(is_file, as_text(F.col("_1name"))).otherwise(none.cast("string")).alias("filename"),
        F.when(F.col("_album"), F.concat_ws("_", F.col("logId").cast("string"), F.col("idx").cast("string"))).otherwise(F.col("logId").cast("string")).alias("output_stem"),
        F.col("authorId").cast("string").alias("sender"),
        F.col("sentAt").cast("bigint").alias("sent_at"),
        pick(as_text(at("imageUrls")), as_text(F.col("_1url"))).alias("cdn_url"),
    )


def url_expires(url: Column) -> Column:
    """The value of the first ``expires`` parameter, or null."""
    found = F.regexp_extract(url, r"[?&]expires=(-?[0-9]+)(?:&|$)", 1)
    return F.nullif(found, F.lit("")).try_cast("bigint")


def redacted_url(url: Column) -> Column:
    """What stands before the first ``?``."""
    return F.substring_index(url, "?", 1)


def cache_digests(chat_id: Column, key: Column) -> tuple[Column, Column]:
    """The two last steps of a cache's path, the second without its ending: digests of the reversed room id and key."""
    return F.sha1(F.reverse(chat_id.cast("string")).cast("binary")), F.sha1(F.reverse(key).cast("binary"))


def cache_path(root: str, chat_id: Column, key: Column, ending: Column | str) -> Column:
    """Where a cache keeps a body."""
    ending = F.lit(ending) if isinstance(ending, str) else ending
    room, name = cache_digests(chat_id, key)
    return F.concat(F.lit(root.rstrip("/") + "/"), room, F.lit("/"), name, ending)


def cache_listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, length) of the files below cache folders, bodies unread; paths are written as ``cache_path`` writes them."""
    frames = []
    for root in roots:
        base = root.rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length")
        # what stands before the two last steps of a path is the root, however the file system spells it
        frames.append(files.select(F.concat(F.lit(base + "/"), F.substring_index("path", "/", -2)).alias("path"), "length"))
    return reduce(DataFrame.unionByName, frames)


def first_cached(frames: DataFrame, key: Column, ending: str, roots: list[str], listing: DataFrame) -> DataFrame:
    """``frames`` with ``cached_path``: the path below the first root that the listing (path) has.

    Rows meet by the two digests of a path as bytes.  Frames are shuffled once and
    without paths, which are made from their rows again; of the listing's paths the
    digests and the number of the first root are.
    """
    path, size = F.col("path"), 81 + len(ending)
    head, tail = F.left(path, F.length(path) - size), F.right(path, F.lit(size))
    root = F.coalesce(*(F.when(head == r.rstrip("/") + "/", i) for i, r in enumerate(roots)))
    digest = lambda at: F.unhex(F.substring(tail, at, 40))
    placed = listing.filter(tail.rlike(rf"\A[0-9a-f]{{40}}/[0-9a-f]{{40}}\Q{ending}\E\z")).select(digest(42).alias("_name"), digest(1).alias("_room"), root.alias("_n"))
    first = placed.filter("_n is not null").groupBy("_name", "_room").agg(F.min("_n").alias("_n"))
    room, name = cache_digests(F.col("chatId"), key)
    rows = frames.join(first, (F.unhex(name) == F.col("_name")) & (F.unhex(room) == F.col("_room")), "left")
    found = F.coalesce(*(F.when(F.col("_n") == i, cache_path(r, F.col("chatId"), key, ending)) for i, r in enumerate(roots)))
    return rows.withColumn("cached_path", found).drop("_name", "_room", "_n")


def tier_plan(
    frames: DataFrame, probes: DataFrame, now_epoch: int, cdn: bool = True, dry_run: bool = True, skip_existing: bool = True, max_fetch_bytes: int = MAX_FETCH_BYTES
) -> DataFrame:
    """(chatId, logId, idx, kind, tier, reason, bytes, output_name) of each frame.

    ``probes`` says by (chatId, logId, idx) what inputs and outputs gave: booleans
    ``existing``, ``full_cached``, ``full_ok``, ``thumb_cached``, ``thumb_ok`` and
    ``fetched_ok``; a missing row means false.  The ladder goes existing, full, cdn or
    planned, thumb, stub; the reason joins what was tried by ``+``.
    """
    keys = ["chatId", "logId", "idx"]
    flags = ["existing", "full_cached", "full_ok", "thumb_cached", "thumb_ok", "fetched_ok"]
    rows = frames.join(probes.select(*keys, *flags), keys, "left")
    f = {n: F.coalesce(F.col(n), F.lit(False)) for n in flags}
    local = F.col("kind") != "file"
    url = F.col("cdn_url")
    tried = F.lit(cdn) & url.isNotNull()
    expired = F.coalesce(url_expires(url) < now_epoch, F.lit(False))
    too_large = F.coalesce((F.col("size_bytes") > 0) & (F.col("size_bytes") > max_fetch_bytes), F.lit(False))
    proof = F.coalesce(F.col("checksum_sha1") != "", F.lit(False))
    full_failed = local & f["full_cached"] & ~f["full_ok"]
    full_why = F.when(full_failed, "full-decrypt-failed").when(local & ~f["full_cached"], "full-not-cached")
    reached = tried & ~expired & ~too_large & proof
    cdn_why = F.when(~tried, None).when(expired, "cdn-expired").when(too_large, "cdn-too-large").when(~proof, "cdn-unverifiable").when(F.lit(dry_run), "cdn-would-fetch").when(f["fetched_ok"], "cdn-fetched").otherwise("cdn-failed")
    thumb_failed = local & f["thumb_cached"] & ~f["thumb_ok"]
    tier = (
        F.when(F.lit(skip_existing) & f["existing"], "existing")
        .when(local & f["full_cached"] & f["full_ok"], "full")
        .when(reached & F.lit(dry_run), "planned")
        .when(reached & f["fetched_ok"], "cdn")
        .when(local & f["thumb_cached"] & f["thumb_ok"], "thumb")
        .otherwise("stub")
    )
    head = F.when(thumb_failed | full_failed, "decrypt-failed").when(local, "not-cached").otherwise("unavailable")
    rows = rows.withColumn("tier", tier)
    reason = (
        F.when(F.col("tier") == "existing", "already-present")
        .when(F.col("tier") == "full", "decrypted")
        .when(F.col("tier") == "stub", F.concat_ws("+", head, cdn_why, F.when(thumb_failed, "thumb-decrypt-failed")))
        .otherwise(F.concat_ws("+", full_why, cdn_why))
    )
    size = F.when(F.col("tier").isin("cdn", "planned"), F.coalesce("size_bytes", F.lit(0))).otherwise(0).cast("bigint")
    name = F.when(F.col("kind") == "file", F.concat_ws("_", "output_stem", safe_filename(F.coalesce("filename", F.lit("")))))
    return rows.select(*keys, "kind", "tier", reason.alias("reason"), size.alias("bytes"), name.alias("output_name"))


def tier_counts(plan: DataFrame) -> DataFrame:
    """(chatId, tier_counts, frames, bytes): how many frames of each room are of each tier, and the bytes fetched or to fetch."""
    each = plan.groupBy("chatId", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    return each.groupBy("chatId").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "n")))).alias("tier_counts"), F.sum("n").alias("frames"), F.sum("b").alias("bytes")
    )


def media_totals(plan: DataFrame) -> DataFrame:
    """Frames and bytes by room and tier with all subtotals."""
    return plan.rollup("chatId", "tier").agg(F.count(F.lit(1)).alias("frames"), F.sum("bytes").alias("bytes"))


WRITTEN = "name string, bytes bigint, checksum_sha1 string, error string"


def write_bodies(bodies: DataFrame, folder: str) -> DataFrame:
    """(name, bytes, checksum_sha1, error) of each row (name, body) after its body has been written to a file of that name.

    ``folder`` is on any file system that all executors reach.  A body is written
    beside its place and then moved there, so that a file is whole or absent, and a
    task that runs again does no harm.  A name that leaves the folder, a null body and
    a failure to write are reported in ``error`` and stop nothing else.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            out: dict[str, list] = {"name": [], "bytes": [], "checksum_sha1": [], "error": []}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                problem = None
                if not name or "/" in name or "\\" in name or name.startswith("."):
                    problem = "not a file name"
                elif body is None:
                    problem = "no body"
                else:
                    beside = f"{root}/.{uuid.uuid4().hex}.part"
                    try:
                        with system.open_output_stream(beside) as stream:
                            stream.write(body)
                        system.move(beside, f"{root}/{name}")
                    except OSError as e:
                        problem = type(e).__name__
                out["name"].append(name)
                out["bytes"].append(None if problem else len(body))
                out["checksum_sha1"].append(None if problem else hashlib.sha1(body).hexdigest())
                out["error"].append(problem)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("checksum_sha1", pa.string()), ("error", pa.string())]))

    return bodies.select(F.col("name").cast("string"), F.col("body").cast("binary")).mapInArrow(written, WRITTEN)

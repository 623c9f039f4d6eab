"""Schemas, defaults and errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import types as T


def _strings(*names: str, null: bool = False) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), null) for n in names]


MESSAGES = T.StructType(
    [
        *_strings("account_hash", "chat_id", "chat_name", "chat_type", "message_id", "sender_id", "sender_nickname"),
        T.StructField("timestamp", T.TimestampType(), False),
        *_strings("text", "message_type"),
        *_strings("reply_to_message_id", null=True),
    ]
)
#: The column by which a source says which of several rows of one key came last.
ORDINAL = "ordinal"
#: What a sync takes of a room from the first of its messages.
ROOM = ["chat_name", "chat_type"]
MESSAGE_KEY = ["account_hash", "chat_id", "message_id"]
#: Columns whose difference makes an archived message an updated one.
MESSAGE_VALUES = [f.name for f in MESSAGES.fields if f.name not in MESSAGE_KEY]

#: A change of this number makes every chunk be built anew.
CHUNKER_VERSION = 2
PARENT_GAP_SECONDS = 300
PARENT_MAX_CHARS = 3000
MAX_LIMIT = 100_000
#: Patterns of the periods that tables are partitioned by.
PERIODS = {"month": "yyyy-MM", "day": "yyyy-MM-dd"}
DEFAULT_LIMIT = 10


class ParleyError(Exception):
    """An error with a code that callers can tell apart."""

    code = "error"


class EmptyQuery(ParleyError):
    code = "empty_query"


class InvalidLimit(ParleyError):
    code = "invalid_limit"


class BadSource(ParleyError):
    code = "bad_source"


class MissingChunk(ParleyError):
    code = "missing_chunk"


class IndexMissing(ParleyError):
    code = "semantic_index_missing"


class IndexStale(ParleyError):
    code = "semantic_index_stale"


class IndexCorrupt(ParleyError):
    code = "semantic_index_corrupt"


class Busy(ParleyError):
    code = "index_busy"


class BadConfig(ParleyError):
    code = "config"


class DimensionMismatch(ParleyError):
    code = "dimension_mismatch"


class NotConfirmed(ParleyError):
    code = "confirmation_required"


class BadRoomName(ParleyError):
    code = "room_name"


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise InvalidLimit(f"the limit must be between 1 and {MAX_LIMIT}, not {limit}")
    return limit


@dataclass(frozen=True)
class ChunkSettings:
    """Gaps in whole seconds beyond which a new chunk starts."""

    group_gap_seconds: int = 600
    direct_gap_seconds: int = 1800
    chunker_version: int = CHUNKER_VERSION


@dataclass(frozen=True)
class Config:
    """Settings of an engine; unknown keys of a file are an error."""

    source_adapter: str = "fixture"
    chunk_gap_group_seconds: int = 600
    chunk_gap_direct_seconds: int = 1800
    semantic_dir: str = "semantic"
    embedder_model: str = "deterministic"
    embedding_batch_size: int = 64
    vector_dimension: int = 768
    snippet_length: int = 80
    #: Tables are written by bucket of the room and by ``month`` or ``day``; a change rewrites the parts that it touches.
    archive_period: str = "month"
    room_buckets: int = 64

    @classmethod
    def load(cls, path: str | None) -> Config:
        if path is None:
            return cls()
        try:
            values = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        except tomllib.TOMLDecodeError as e:
            raise BadConfig(str(e)) from e
        known = {f.name: type(f.default) for f in fields(cls)}
        for name, value in values.items():
            if name not in known:
                raise BadConfig(f"unknown setting {name!r}")
            if type(value) is not known[name]:
                raise BadConfig(f"{name} must be of type {known[name].__name__}")
        if values.get("archive_period", "month") not in PERIODS:
            raise BadConfig(f"archive_period must be one of {', '.join(PERIODS)}")
        return cls(**values)

    @property
    def chunks(self) -> ChunkSettings:
        return ChunkSettings(self.chunk_gap_group_seconds, self.chunk_gap_direct_seconds)

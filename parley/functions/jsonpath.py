"""Tolerant scalars from JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of a reply's parent, and the containers that may hold them, in their order.
REPLY_KEYS = ("src_logId", "srcLogId", "parentLogId", "src_log_id")
CONTAINERS = ("reply", "src", "origin", "parent")
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"


def object_only(json: Column) -> Column:
    """The JSON text if it is a well-formed object, else null."""
    return F.when(F.json_object_keys(json).isNotNull(), json)


def reply_parent(json: Column) -> Column:
    """The positive log id that a JSON object names as its reply's parent, containers before the top level; else null."""
    paths = [f"$.{c}.{k}" for c in CONTAINERS for k in REPLY_KEYS] + [f"$.{k}" for k in REPLY_KEYS]
    # one lambda over the paths: twenty expressions side by side outgrow generated code
    texts = F.transform(F.array(*(F.lit(p) for p in paths)), lambda p: F.call_function("get_json_object", json, p))
    numbers = F.transform(texts, lambda t: F.when(t.rlike(_INTEGER), F.trim(t).try_cast("bigint")))
    return F.when(F.json_object_keys(json).isNotNull(), F.get(F.filter(numbers, lambda n: n > 0), F.lit(0)))


def as_long(text: Column) -> Column:
    """An integer from a number (fractions cut off) or a numeric string."""
    t = F.trim(text)
    return F.coalesce(t.try_cast("bigint"), F.when(t.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"), t.try_cast("double").try_cast("bigint")))


def as_text(text: Column) -> Column:
    """A non-empty string, or a number as text."""
    return F.nullif(text, F.lit(""))

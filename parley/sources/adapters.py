"""Sources of messages."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.upsert import chats_of
from parley.schema import MESSAGES, ORDINAL, BadSource
from parley.shared import staged
from parley.sources.records import array_records, command_records


class Source(Protocol):
    """What gives messages, and the rooms they are in."""

    def messages(self) -> DataFrame: ...

    def chats(self) -> DataFrame: ...


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _rows(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Lines (``value`` and further columns) parsed as ``m``, and whether one is malformed or lacks a field."""
    parsed = T.StructType([*_nullable(MESSAGES).fields, T.StructField("_bad", T.StringType())])
    rows = lines.filter(F.trim("value") != "").withColumn("m", F.from_json("value", parsed, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    wrong = F.col("m").isNull() | F.col("m._bad").isNotNull()
    for f in MESSAGES.fields:
        if not f.nullable:
            wrong = wrong | F.col(f"m.{f.name}").isNull()
    return rows, wrong


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files, with the file and a number that grows along it.

    Rows of a file's split come in order, and its splits start at growing offsets, so
    the two together are the line's place.
    """
    lines = spark.read.text(path).withColumn("_file", F.input_file_name()).withColumn("_start", F.input_file_block_start())
    return lines.withColumn("_n", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Messages from lines of JSON, with the column ORDINAL by their place; blank lines are skipped, unknown fields ignored.

    The first line that is malformed or lacks a field raises BadSource with its number,
    without its content.
    """
    rows, wrong = _rows(_lines(spark, path))
    bad = rows.filter(wrong).agg(F.min(F.struct("_file", "_start", "_n")).alias("at")).first()["at"]
    if bad is not None:
        raise BadSource(f"line {_line_number(spark, path, bad)} of the source is malformed")
    place = F.struct("_file", "_start", "_n").alias(ORDINAL)
    return rows.select("m.*", place).select(*(f.name for f in MESSAGES.fields), ORDINAL)


def _line_number(spark: SparkSession, path: str, bad) -> int:
    """The number in its file of a line that is asked for by its place: a count of the lines before it."""
    before = (F.col("_start") < bad["_start"]) | ((F.col("_start") == bad["_start"]) & (F.col("_n") < bad["_n"]))
    return _lines(spark, path).filter((F.col("_file") == bad["_file"]) & before).count() + 1


def _messages(records: DataFrame, place: Column) -> DataFrame:
    """Messages of records (column ``value``), with the column ORDINAL; any that is malformed or lacks a field is an error."""
    rows, wrong = _rows(records)
    try:
        lacking = rows.filter(wrong).count()
    except Exception as e:
        raise BadSource("the source is not an array of messages") from e
    if lacking:
        raise BadSource(f"{lacking} records of the source lack a field")
    return rows.select("m.*", place.alias(ORDINAL)).select(*(f.name for f in MESSAGES.fields), ORDINAL)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Messages from files that are one JSON array each, with the column ORDINAL by their place; any record that is none or lacks a field is an error."""
    return _messages(array_records(spark, path), F.struct("file", "place"))


def read_command(spark: SparkSession, command: list[str], timeout: float = 600.0) -> DataFrame:
    """Messages that a command prints as one JSON array, with the column ORDINAL; a failure carries what it says on its error stream.

    The command runs once, in a task; its records are stored as they come.
    """
    try:
        found = staged(command_records(spark, command, timeout))
    except Exception as e:
        said = re.search(r"the source command [^\n]*", str(e))
        raise BadSource(said[0] if said else "the source command failed") from e
    return _messages(found, F.struct("place"))


class FrameSource:
    """A source over a function that reads; the frame is read once and kept."""

    def __init__(self, read: Callable[[], DataFrame]):
        self._read, self._kept = read, None

    def messages(self) -> DataFrame:
        if self._kept is None:
            self._kept = self._read().persist()
        return self._kept

    def chats(self) -> DataFrame:
        return chats_of(self.messages())


def open_source(spark: SparkSession, name: str, path: str | None = None, command: list[str] | None = None, read: Callable[[], DataFrame] | None = None) -> Source:
    """The source of a name: ``fixture`` (lines of JSON), ``array``, ``command`` or ``tables`` (a reader of application tables)."""
    makers: dict[str, Callable[[], DataFrame] | None] = {
        "fixture": (lambda: read_jsonl(spark, path)) if path else None,
        "array": (lambda: read_json_array(spark, path)) if path else None,
        "command": (lambda: read_command(spark, command)) if command else None,
        "tables": read,
    }
    if name not in makers:
        raise BadSource(f"unknown source {name!r}")
    if makers[name] is None:
        raise BadSource(f"the source {name!r} needs its path, command or reader")
    return FrameSource(makers[name])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): the ``.md`` files of a folder, each whole."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))

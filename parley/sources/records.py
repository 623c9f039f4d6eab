"""Records of JSON arrays, of files and of what a command prints, one after the other with their place."""

from __future__ import annotations

import json
import subprocess
import tempfile
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Characters that are read at once, at first; records in a batch.
PIECE, BATCH = 1 << 16, 4096
PLACED = "place bigint, value string"
COMMAND = "parley_command"


def records(pieces: Iterator[str]) -> Iterator[str]:
    """The texts of the objects of one JSON array that comes in pieces; ValueError where it isn't such an array.

    Held is what has been read of one record; where that is incomplete, as much again is
    read before it is looked at again, so the time grows with the length.
    """
    decoder, held, ended = json.JSONDecoder(), "", False

    def more(least: int) -> bool:
        nonlocal held, ended
        got, size = [], 0
        for piece in pieces:
            got.append(piece)
            size += len(piece)
            if size >= least:
                break
        held += "".join(got)
        ended = not got
        return not ended

    def ahead() -> str:
        nonlocal held
        while not (held := held.lstrip(" \t\r\n")) and more(1):
            pass
        return held[:1]

    def expect(marks: str) -> str:
        nonlocal held
        if (mark := ahead()) not in marks or not mark:
            raise ValueError("the source is no array of objects")
        held = held[1:]
        return mark

    expect("[")
    if ahead() == "]":
        expect("]")
    else:
        while True:
            if ahead() != "{":
                raise ValueError("the source is no array of objects")
            while True:
                try:
                    end = decoder.raw_decode(held)[1]
                    break
                except ValueError:
                    if not more(max(1, len(held))):
                        raise ValueError("a record of the source is incomplete") from None
            yield held[:end]
            held = held[end:]
            if expect(",]") == "]":
                break
    if ahead():
        raise ValueError("something follows the source's array")


def batches(found: Iterator[str], names: list[str], *same: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the columns ``same``, the place and the text of each record."""
    at, rows = 0, []

    def made() -> pa.RecordBatch:
        columns = [pa.array([s] * len(rows), pa.string()) for s in same]
        return pa.RecordBatch.from_arrays([*columns, pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.string())], names=names)

    for value in found:
        rows.append(value)
        if len(rows) == BATCH:
            yield made()
            at, rows = at + len(rows), []
    if rows:
        yield made()


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): the records of files that each hold one JSON array; a file is one task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for file, text in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = (text[i : i + PIECE] for i in range(0, len(text), PIECE))
                yield from batches(records(pieces), ["file", "place", "value"], file)

    return files.mapInArrow(cut, f"file string, {PLACED}")


class CommandReader(DataSourceReader):
    def __init__(self, command: list[str], timeout: float):
        self.command, self.timeout = command, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as said, subprocess.Popen(self.command, stdout=subprocess.PIPE, stderr=said, encoding="utf-8") as run:
            watch = threading.Timer(self.timeout, run.kill)
            watch.start()
            try:
                wrong = None
                try:
                    yield from batches(records(iter(lambda: run.stdout.read(PIECE), "")), ["place", "value"])
                except ValueError as e:
                    wrong = e
                    run.stdout.read()  # so that it can end by itself
                if run.wait():
                    said.seek(0)
                    raise RuntimeError(f"the source command failed with {run.returncode}: {said.read(2000).decode(errors='replace').strip()[:500]}")
                if wrong:
                    raise RuntimeError(f"the source command printed no array of messages: {wrong}")
            finally:
                watch.cancel()
                run.kill()


class CommandSource(DataSource):
    """What a command prints as one JSON array, read as it comes where the task runs."""

    @classmethod
    def name(cls) -> str:
        return COMMAND

    def schema(self) -> str:
        return PLACED

    def reader(self, schema) -> CommandReader:
        return CommandReader(json.loads(self.options["command"]), float(self.options["timeout"]))


def command_records(spark: SparkSession, command: list[str], timeout: float) -> DataFrame:
    """(place, value) of a command's records."""
    spark.dataSource.register(CommandSource)
    return spark.read.format(COMMAND).option("command", json.dumps(command)).option("timeout", str(timeout)).load()

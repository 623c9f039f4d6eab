"""Byte-level BPE: long texts are cut in chunks that are pre-tokenised by themselves and stitched.

A text of at most CHUNK characters is one chunk and is encoded where it is read.  A longer
one becomes chunks that each reach OVERLAP characters into the next, dealt over all tasks:

1. every chunk is cut into pre-tokens from its own start, which may lie within one;
2. in each overlap the first boundary that both chunks have is where they
   resynchronise: the pre-tokens of the later chunk hold from there on, as a match
   depends only on what follows its start.  Texts are joined there;
3. the pieces between such places are encoded, and their ids put in order.

A boundary serves only where the piece before it would be cut alike without what follows:
behind a character that is neither white space nor an apostrophe (which may open a
contraction).  The regex library that finds boundaries may know newer letters than the
encoder; so both sides must be white space or characters of Unicode 3.2, whose classes the
two share.  Where chunks don't meet (a word of more than OVERLAP letters) the rest of that
text, from the last good place on, is one piece.

Runs of RUN or more characters of white space are handed to the merges by themselves,
since the encoder's matcher overflows its stack on long ones.  Decoding joins the bytes of
the ids.

Null texts count as empty ones, which have no ids.  Repeated rows each get their row; ids
of documents may repeat or be null.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import map_texts, slices, stored

CHUNK, OVERLAP = 32_768, 1_024
#: Characters of white space in a row, from which on a run is a piece of its own.
RUN = 4_096
#: White space as the pattern's ``\s`` has it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE}]{{{RUN},}}")
IS_WHITE = re.compile(f"[{WHITE}]")
#: A match looks at most so many characters past its end.
AHEAD = 2


class Codec:
    """The encoder of a rank file's content, and the bytes of its ids."""

    def __init__(self, ranks: bytes, pattern: str):
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes_of = {i: token for token, i in known.items()}
        self._known = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """The ids of a text, or of a piece of one that ends behind a character that isn't white space."""
        out: list[int] = []
        at = 0
        for m in LONG_RUN.finditer(text):
            end = m.end() - (m.end() < len(text))  # the last one belongs to what follows
            out += self._known.encode_ordinary(text[at : m.start()])
            out += self._known._encode_single_piece(text[m.start() : end])
            at = end
        return out + self._known.encode_ordinary(text[at:])

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(2)
def codec(ranks: bytes, pattern: str) -> Codec:
    """Kept by the worker."""
    return Codec(ranks, pattern)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


@functools.lru_cache(100_000)
def settled(c: str) -> bool:
    """Has the character been there since Unicode 3.2, so that all versions in use agree on its class?"""
    return unicodedata.ucd_3_2_0.category(c) != "Cn"


def boundaries(text: str, whole: bool, pattern: regex.Pattern) -> list[int]:
    """The ends of a chunk's pre-tokens at which texts may be joined; ``whole``: does the text end with the chunk?"""
    most = len(text) - (1 if whole else AHEAD)
    found = []
    for m in pattern.finditer(text):
        end = m.end()
        if end > most:
            break
        before, after = text[end - 1], text[end]
        if before != "'" and not IS_WHITE.match(before) and (IS_WHITE.match(after) or (settled(before) and settled(after))):
            found.append(end)
    return found


def _chunks(docs: DataFrame, text: Column, ids: list[Column], chunk: int, overlap: int) -> DataFrame:
    """(ids, uid, k, last, piece): the chunks of texts with their overlaps; ``uid`` tells rows apart, ``last`` is the number of a text's last chunk."""
    source = docs.select(*ids, F.monotonically_increasing_id().alias("_uid"), text.alias("_text"))
    keep = len(ids) + 1
    numbers = [T.StructField(n, T.LongType()) for n in ("_k", "_last")]
    schema = T.StructType([*source.schema.fields[:keep], *numbers, T.StructField("_piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, keep):
                for row, t in enumerate(part.column(keep).to_pylist()):
                    n = -(-len(t) // chunk)
                    pieces = [t[k * chunk : (k + 1) * chunk + overlap] for k in range(n)]
                    same = [part.column(i).take(pa.array([row] * n)) for i in range(keep)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int64()), pa.array([n - 1] * n, pa.int64()), pa.array(pieces)], names=schema.names)

    return source.mapInArrow(run, schema)


def _places(chunks: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """(_uid, _k, _seg, _start, _stop): from which place on a chunk's text is its own, in the whole text, and up to which.

    ``_seg`` is the last chunk up to this one that has met all before it.  A null
    ``_start`` says that this one hasn't, a null ``_stop`` that the next one hasn't or
    that there is none.
    """

    def make():
        cut = regex.compile(pattern)

        def call(part: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {"left": [], "right": []}
            for k, last, t in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                found = [k * chunk + e for e in boundaries(t, k == last, cut)]
                out["left"].append([e for e in found if e < k * chunk + overlap])
                out["right"].append([e for e in found if e >= (k + 1) * chunk])
            return out

        return call

    longs = T.ArrayType(T.LongType())
    added = T.StructType([T.StructField("left", longs), T.StructField("right", longs)])
    marked = map_texts(chunks, [F.col(c) for c in ("_uid", "_k", "_last", "_piece")], make, added, 3)
    # the places in overlaps travel, not the texts
    along = Window.partitionBy("_uid").orderBy("_k")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = F.array_min(F.array_intersect(F.lag("right").over(along), "left"))
    marked = marked.withColumn("_cut", F.when(F.col("_k") == 0, F.lit(0).cast("bigint")).otherwise(met))
    marked = marked.withColumn("_start", F.when(F.min(F.col("_cut").isNotNull()).over(upto), F.col("_cut")))
    seg = F.last(F.when(F.col("_start").isNotNull(), F.col("_k")), ignorenulls=True).over(upto)
    return marked.select("_uid", "_k", seg.alias("_seg"), "_start", F.lead("_start").over(along).alias("_stop"))


def encode(
    docs: DataFrame, text: Column, *ids: Column, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(ids, n_tokens, tokens): the token ids of each text by ``ranks``, the content of a rank file, as packed little-endian unsigned 32-bit integers."""
    text = F.coalesce(text, F.lit(""))
    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def make():
        known = codec(ranks, pattern)

        def call(part: pa.RecordBatch) -> dict[str, list]:
            found = [known.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
            return {"n_tokens": [len(x) for x in found], "tokens": [packed(x) for x in found]}

        return call

    short = map_texts(docs.filter(F.length(text) <= chunk), [*ids, text.alias("_text")], make, added, len(ids))
    names = short.columns[: len(ids)]
    chunks = _chunks(docs.filter(F.length(text) > chunk), text, list(ids), chunk, overlap)
    chunks = stored(chunks.repartition(F.col("_uid"), F.col("_k")))
    places = _places(chunks, chunk, overlap, pattern).select(F.col("_uid").alias("_u"), F.col("_k").alias("_n"), "_seg", "_start", "_stop")
    placed = chunks.join(places, (F.col("_uid") == F.col("_u")) & (F.col("_k") == F.col("_n"))).drop("_u", "_n")
    first = F.col("_k") * chunk
    begin = F.coalesce("_start", first) - first
    end = F.when(F.col("_stop").isNotNull(), F.col("_stop") - first).when(F.col("_k") < F.col("_last"), F.lit(chunk)).otherwise(F.length("_piece"))
    placed = placed.withColumn("_piece", F.substring("_piece", begin.cast("int") + 1, (end - begin).cast("int")))
    # a piece of one chunk, or the rest of a text whose chunks didn't meet
    single = F.col("_start").isNotNull() & (F.col("_stop").isNotNull() | (F.col("_k") == F.col("_last")))
    inner = [*(F.col(c) for c in names), F.col("_uid"), F.col("_seg")]
    rest = placed.filter(~single).groupBy("_uid", "_seg").agg(
        *(F.first(c).alias(c) for c in names), F.array_sort(F.collect_list(F.struct("_k", "_piece"))).alias("_all")
    )
    rest = rest.select(*inner, F.array_join("_all._piece", "").alias("_piece"))
    pieces = placed.filter(single).select(*inner, "_piece").unionByName(rest)
    found = map_texts(pieces, [*inner, F.col("_piece")], make, added, len(inner))

    schema = T.StructType([*found.schema.fields[: len(ids)], *added.fields])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_seg")
        return pd.DataFrame([[*(rows[c].iloc[0] for c in names), rows["n_tokens"].sum(), b"".join(rows["tokens"])]], columns=schema.names)

    return short.unionByName(found.groupBy("_uid").applyInPandas(joined, schema))


def decode(encoded: DataFrame, tokens: Column, *keep: Column, ranks: bytes, pattern: str) -> DataFrame:
    """(keep, decoded): the bytes that packed ids stand for, of null none."""
    added = T.StructType([T.StructField("decoded", T.BinaryType())])

    def make():
        known = codec(ranks, pattern)

        def call(part: pa.RecordBatch) -> dict[str, list]:
            packs = part.column(part.num_columns - 1).to_pylist()
            return {"decoded": [None if p is None else known.decode(np.frombuffer(p, dtype="<u4").tolist()) for p in packs]}

        return call

    return map_texts(encoded, [*keep, tokens.alias("_tokens")], make, added, len(keep))

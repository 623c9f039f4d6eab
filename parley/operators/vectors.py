"""Embeddings of windows and exact vector search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.search import window_hits
from parley.schema import DEFAULT_LIMIT, BadConfig, Config, DimensionMismatch, EmptyQuery, checked_limit


class Embedder(Protocol):
    """What makes vectors of texts."""

    id: str
    dimension: int

    def embed(self, text: Column) -> Column:
        """Vectors (array<float>) of passages."""

    def embed_query(self, query: str) -> list[float]:
        """The vector of a query."""


def term_bucket(term: str, dimension: int) -> int:
    return int.from_bytes(hashlib.sha256(term.encode()).digest()[:8], "little") % dimension


class DeterministicEmbedder:
    """Counts of hashed white-space terms, scaled to length 1; a text without terms is a zero vector."""

    def __init__(self, dimension: int = 768):
        if dimension < 1:
            raise DimensionMismatch("the dimension must be at least 1")
        self.dimension, self.id = dimension, f"deterministic-{dimension}"

    def buckets(self, text: Column) -> Column:
        """The bucket of each term, by built-in functions."""
        terms = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")

        def whole(t: Column) -> Column:
            digest = F.sha2(t, 256)
            return F.conv(F.concat(*(F.substring(digest, 2 * k + 1, 2) for k in range(7, -1, -1))), 16, 10).cast("decimal(20,0)")

        return F.transform(terms, lambda t: (whole(t) % self.dimension).cast("int"))

    def embed(self, text: Column) -> Column:
        dimension = self.dimension

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            known: dict[str, int] = {}

            def one(text: str | None) -> np.ndarray:
                out = np.zeros(dimension, dtype=np.float32)
                for term in (text or "").split():
                    at = known.get(term)
                    if at is None:
                        at = known[term] = term_bucket(term, dimension)
                    out[at] += 1
                norm = np.sqrt((out * out).sum(dtype=np.float32))
                return out / norm if norm > 0 else out

            return texts.map(one)

        return vectors(text)

    def embed_query(self, query: str) -> list[float]:
        out = np.zeros(self.dimension, dtype=np.float32)
        for term in query.strip().split():
            out[term_bucket(term, self.dimension)] += 1
        norm = math.sqrt(float((out * out).sum()))
        return (out / np.float32(norm) if norm > 0 else out).tolist()


class ModelEmbedder:
    """A model given as a function from a list of texts to a list of vectors, called in batches on the executors.

    Passages and queries get the prefixes ``passage: `` and ``query: ``.
    """

    def __init__(self, name: str, dimension: int, call, batch: int = 64):
        self.id, self.dimension, self.call, self.batch = name, dimension, call, max(1, batch)

    def embed(self, text: Column) -> Column:
        call, batch, dimension = self.call, self.batch, self.dimension

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            out: list = []
            whole = [f"passage: {t}" for t in texts]
            for i in range(0, len(whole), batch):
                out += [np.asarray(v, dtype=np.float32) for v in call(whole[i : i + batch])]
            if any(len(v) != dimension for v in out):
                raise DimensionMismatch(f"the model gave vectors that don't have {dimension} places")
            return pd.Series(out)

        return vectors(text)

    def embed_query(self, query: str) -> list[float]:
        return [float(x) for x in self.call([f"query: {query.strip()}"])[0]]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def dot(vector: Column, query: list[float]) -> Column:
    """The inner product with a constant, summed in float in the order of the places."""
    q = F.array(*(F.lit(float(x)).cast("float") for x in query))
    zero = F.lit(0).cast("float")
    return F.aggregate(F.zip_with(vector, q, lambda x, y: x * y), zero, lambda a, x: (a + x).cast("float"))


#: Vectors that a scan multiplies at once.
BLOCK = 4_096


def vector_topk(
    vectors: DataFrame, query: list[float], limit: int = DEFAULT_LIMIT, id_col: str = "chunk_id", vector_col: str = "vector", carried: tuple[str, ...] = ()
) -> DataFrame:
    """(id, carried columns, raw_score, rank, score): the vectors with the greatest positive inner product, then the least id.

    One scan: a task multiplies blocks of vectors by the query, place by place, so that
    a sum is that of ``dot`` whatever block it is in, and keeps its best ``limit``; the
    best of all tasks' come to the driver.  A vector of another length is an error.  Rows
    without an id or a vector, or whose product isn't a number, take no part.
    """
    if any(not math.isfinite(x) for x in query):
        raise DimensionMismatch("the query has places that aren't finite")
    limit, dimension = checked_limit(limit), len(query)
    places = np.array(query, dtype=np.float32)
    kept = [vectors.schema[c] for c in (id_col, *carried)]
    schema = T.StructType([*kept, T.StructField("raw_score", T.FloatType()), T.StructField("_wrong", T.BooleanType())])
    order = [("_wrong", "descending"), ("raw_score", "descending"), (id_col, "ascending")]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                block = block.filter(pc.and_(pc.is_valid(block.column(0)), pc.is_valid(block.column(block.num_columns - 1))))
                vector = block.column(block.num_columns - 1)
                other = pc.not_equal(pc.list_value_length(vector), dimension)
                wrong = bool(pc.any(other).as_py())
                if wrong:  # one is enough to tell of
                    block = block.filter(other).slice(0, 1)
                    scores, chosen = np.zeros(1, dtype=np.float32), np.ones(1, dtype=bool)
                else:
                    matrix = np.ascontiguousarray(vector.flatten().to_numpy(zero_copy_only=False).reshape(len(vector), dimension).T)
                    scores = np.zeros(len(vector), dtype=np.float32)
                    with np.errstate(all="ignore"):
                        for column, place in zip(matrix, places):
                            scores += column * place
                    chosen = scores > 0
                columns = [*block.columns[:-1], pa.array(scores, pa.float32()), pa.array(np.full(len(scores), wrong), pa.bool_())]
                found = pa.Table.from_arrays(columns, names=schema.names).filter(pa.array(chosen))
                best = found if best is None else pa.concat_tables([best, found])
                if best.num_rows > limit:
                    best = best.take(pc.sort_indices(best, sort_keys=order)[:limit])
        if best is not None:
            yield from best.combine_chunks().to_batches()

    rows = vectors.select(id_col, *carried, F.col(vector_col).cast("array<float>").alias("_vector")).mapInArrow(scanned, schema)
    top = rows.orderBy(F.col("_wrong").desc(), F.col("raw_score").desc(), id_col).limit(limit).collect()
    if top and top[0]["_wrong"]:
        raise DimensionMismatch(f"the query has {dimension} places, a vector has not")
    fields = [*kept, schema["raw_score"], T.StructField("rank", T.LongType()), T.StructField("score", T.DoubleType())]
    return vectors.sparkSession.createDataFrame([(*r[:-1], n, 1 / n) for n, r in enumerate(top, 1)], T.StructType(fields))


def reused_or_pending(windows: DataFrame, prior: DataFrame) -> DataFrame:
    """Windows with ``content_hash`` and the prior ``vector`` of the same id and hash, null where it has to be made."""
    now = windows.withColumn("content_hash", content_hash(F.col("text")))
    old = prior.select(F.col("chunk_id").alias("_id"), F.col("content_hash").alias("_hash"), "vector")
    return now.join(old, (F.col("parent_id") == F.col("_id")) & (F.col("content_hash") == F.col("_hash")), "left").drop("_id", "_hash")


#: Stored vectors.
VECTORS = "chunk_id string, content_hash string, heading_path string, chat_id string, started_at timestamp, vector array<float>"


def embedded(prepared: DataFrame, embedder: Embedder, *carried: str) -> DataFrame:
    """VECTORS of prepared windows and carried columns; only missing vectors are made.

    Room and time tell which part of the windows a hit is in.
    """
    have = prepared.filter("vector is not null")
    new = prepared.filter("vector is null").withColumn("vector", embedder.embed(F.col("text")))
    rows = have.unionByName(new)
    return rows.select(F.col("parent_id").alias("chunk_id"), "content_hash", F.col("chat_name").alias("heading_path"), "chat_id", "started_at", "vector", *carried)


def merged_vectors(stored: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """Stored vectors with those of ``new`` put in or in place of theirs; a wrong dimension is an error."""
    if new.filter(F.size("vector") != dimension).limit(1).count():
        raise DimensionMismatch(f"vectors must have {dimension} places")
    return stored.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def digest_sums(id_: Column, content: Column, at: Column) -> list[Column]:
    """Aggregates (low, high, n) that tell sets of (id, content hash, time) apart, whatever the order of the rows."""
    row = F.sha2(F.concat_ws("\x1f", id_, content, F.unix_micros(at).cast("string")), 256)
    low, high = (F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(20,0)") for k in (1, 13))
    return [F.sum(low).alias("low"), F.sum(high).alias("high"), F.count(F.lit(1)).alias("n")]


def revision_of(sums: Iterable[tuple[int, int, int]]) -> str:
    """The revision of windows whose parts have these sums."""
    low, high, n = (sum(x) for x in zip((0, 0, 0), *sums))
    return hashlib.sha256(f"{low}:{high}:{n}".encode()).hexdigest()


def archive_revision(windows: DataFrame) -> str:
    """A digest of the windows' ids, contents and times.

    The rows' digests are summed, so that it needs no order and can be put together from
    those of parts; one row reaches the driver.
    """
    found = windows.agg(*digest_sums(F.col("parent_id"), content_hash(F.col("text")), F.col("started_at"))).first()
    return revision_of([(int(found["low"] or 0), int(found["high"] or 0), found["n"])])


def nearest(vectors: DataFrame, embedder: Embedder, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(chunk_id, chat_id, started_at, raw_score, rank, score) of the vectors most like a query: local rows."""
    if not query.strip():
        raise EmptyQuery("the query is empty")
    return vector_topk(vectors, embedder.embed_query(query), limit, carried=("chat_id", "started_at"))


def semantic_hits(windows: DataFrame, best: DataFrame, query: str, length: int = 80) -> DataFrame:
    """Window hits of ranked vectors."""
    best = best.select(F.col("chunk_id").alias("_id"), "raw_score", "rank", "score")
    rows = windows.join(F.broadcast(best), F.col("parent_id") == F.col("_id")).drop("_id")
    return window_hits(rows, "semantic", query, length)


def semantic_search(windows: DataFrame, vectors: DataFrame, embedder: Embedder, query: str, limit: int = DEFAULT_LIMIT, length: int = 80) -> DataFrame:
    """Window hits by vector similarity."""
    return semantic_hits(windows, nearest(vectors, embedder, query, limit), query, length)


#: How to make the embedder of a model's name, from dimension and batch size; ``register_model`` adds to it.
MODELS: dict[str, Callable[[int, int], Embedder]] = {"deterministic": lambda dimension, batch: DeterministicEmbedder(dimension)}


def register_model(name: str, call: Callable[[list[str]], list]) -> None:
    """Let settings name a model: a function from texts to vectors, called in batches on the executors."""
    MODELS[name] = lambda dimension, batch: ModelEmbedder(name, dimension, call, batch)


def embedder_of(config: Config) -> Embedder:
    """The embedder that the settings name."""
    if config.embedder_model not in MODELS:
        raise BadConfig(f"unknown embedder_model {config.embedder_model!r}")
    return MODELS[config.embedder_model](config.vector_dimension, config.embedding_batch_size)

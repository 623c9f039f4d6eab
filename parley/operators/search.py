"""Keyword and BM25 search over chunks, and their hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import fold, like_ascii, rfc3339, snippet
from parley.schema import DEFAULT_LIMIT, EmptyQuery, checked_limit

K1, B = 1.2, 0.75
#: The inverse document frequency that replaces one that isn't positive.
LEAST_IDF = 1e-6


def _checked(query: str) -> None:
    if not query.strip():
        raise EmptyQuery("the query is empty")


def ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in the order, with ``rank`` and the score 1 / rank."""
    top = rows.orderBy(*order).limit(checked_limit(limit))
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return top.withColumn("score", F.lit(1.0) / F.col("rank"))


def hits(top: DataFrame, ranker: str, query: str, length: int, refs: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Search hits of ranked chunks; ``refs`` gives the chunks they reply to, ``ids`` their ids if these are known apart."""
    if refs is None:
        rows = top.withColumn("parent_chunk_ids", F.array().cast("array<string>"))
    else:
        parents = refs.join(F.broadcast((top if ids is None else ids).select("chunk_id")), F.col("child_chunk_id") == F.col("chunk_id"), "left_semi")
        parents = parents.groupBy(F.col("child_chunk_id").alias("_c")).agg(F.array_sort(F.collect_set("parent_chunk_id")).alias("parent_chunk_ids"))
        rows = top.join(parents, F.col("chunk_id") == F.col("_c"), "left")
        rows = rows.withColumn("parent_chunk_ids", F.coalesce("parent_chunk_ids", F.array().cast("array<string>")))
    return rows.select(
        F.lit(ranker).alias("ranker"),
        F.lit("micro_chunk").alias("unit"),
        "rank",
        "chunk_id",
        "chat_id",
        "chat_name",
        "sender_nickname",
        "started_at",
        "ended_at",
        snippet(F.col("text"), query, length).alias("snippet"),
        "score",
        *(c for c in ("raw_score",) if c in top.columns),
        "parent_chunk_ids",
        F.array().cast("array<string>").alias("child_chunk_ids"),
    )


def window_hits(top: DataFrame, ranker: str, query: str, length: int) -> DataFrame:
    """Search hits of ranked windows."""
    return top.select(
        F.lit(ranker).alias("ranker"),
        F.lit("parent_window").alias("unit"),
        "rank",
        F.col("parent_id").alias("chunk_id"),
        "chat_id",
        "chat_name",
        F.lit("multiple").alias("sender_nickname"),
        "started_at",
        "ended_at",
        snippet(F.col("text"), query, length).alias("snippet"),
        "score",
        *(c for c in ("raw_score",) if c in top.columns),
        F.array().cast("array<string>").alias("parent_chunk_ids"),
        "child_chunk_ids",
    )


def keyword_search(
    chunks: DataFrame, query: str, limit: int = DEFAULT_LIMIT, length: int = 80, refs: DataFrame | None = None, literal: bool = False
) -> DataFrame:
    """Chunks that contain the trimmed query, A-Z in either case, earliest first."""
    _checked(query)
    found = chunks.filter(like_ascii(F.col("text"), query, literal))
    return hits(ranked(found, [F.col("started_at"), F.col("chunk_id")], limit), "keyword", query, length, refs)


def phrases(query: str) -> list[list[str]]:
    """The token sequences of a query's terms; terms without tokens are left out."""
    return [p for p in (fold(term) for term in query.split()) if p]


#: The term of the row that every chunk has in the index, whether it has tokens or not.
EVERY = ""
#: About the tokens in a batch of postings.
BATCH_TOKENS = 200_000


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, positions, len, and the chunks' other columns but the text): an inverted index of the chunks' tokens.

    A chunk is one row, so its terms are gathered where it is read: nothing is
    shuffled.  ``len`` is the chunk's number of tokens; each chunk also has a row of
    the term EVERY, without positions.
    """
    others = [f for f in chunks.schema.fields if f.name not in ("text", "tf", "positions", "len", "term")]
    rows = chunks.select(*(f.name for f in others), "text")
    added = "term string, tf bigint, positions array<int>, len bigint"
    schema = T.StructType([*others, *T.StructType.fromDDL(added).fields])

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, terms, sizes, offsets, places = [], [], [], [0], []

            def made() -> pa.RecordBatch:
                kept = [batch.column(i).take(pa.array(owners, pa.int64())) for i in range(len(others))]  # noqa: B023
                counts = np.diff(offsets).astype(np.int64)  # noqa: B023
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, pa.array(terms, pa.string()), pa.array(counts), lists, pa.array(sizes, pa.int64())], names=schema.names)  # noqa: B023

            for i, text in enumerate(batch.column(len(others)).to_pylist()):
                words = fold(text)
                at: dict[str, list[int]] = {EVERY: []}
                for k, word in enumerate(words):
                    at.setdefault(word, []).append(k)
                for word, found in at.items():
                    terms.append(word)
                    places += found
                    offsets.append(len(places))
                owners += [i] * len(at)
                sizes += [len(words)] * len(at)
                if len(places) > BATCH_TOKENS:
                    yield made()
                    owners, terms, sizes, offsets, places = [], [], [], [0], []
            if owners:
                yield made()

    return rows.mapInArrow(posted, schema)


def bm25_rows(index: DataFrame, query: str) -> DataFrame:
    """(chunk_id, chat_id where the index has it, started_at, raw_score) of the chunks that hold every phrase of the query; the lower the score, the better.

    Only the postings of the query's terms are read, and one row of every chunk for
    the totals; where a phrase stands is the common part of its terms' shifted places.
    """
    wanted = phrases(query)
    own = [c for c in ("chat_id", "started_at") if c in index.columns]
    if not wanted:
        return index.select("chunk_id", *own, F.lit(0.0).alias("raw_score")).filter("false")
    words = sorted({w for p in wanted for w in p})
    mine = index.filter(F.col("term").isin(words)).groupBy("chunk_id").agg(
        F.max("len").alias("_len"), *(F.max(c).alias(c) for c in own), *(F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"_p{i}") for i, w in enumerate(words))
    )

    def frequency(phrase: list[str]) -> Column:
        places = [F.transform(F.col(f"_p{words.index(w)}"), _back(k)) for k, w in enumerate(phrase)]
        return F.coalesce(F.size(reduce(F.array_intersect, places)), F.lit(0))

    found = [F.greatest(frequency(p), F.lit(0)).alias(f"_f{i}") for i, p in enumerate(wanted)]
    mine = mine.select("chunk_id", *own, "_len", *found)
    held = mine.agg(*(F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_n{i}") for i in range(len(wanted))))
    totals = index.filter(F.col("term") == EVERY).agg(F.count(F.lit(1)).alias("_all"), F.avg("len").alias("_avg"))
    rows = mine.filter(reduce(lambda a, b: a & b, (F.col(f"_f{i}") > 0 for i in range(len(wanted)))))
    rows = rows.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(held))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        n, f = F.col(f"_n{i}"), F.col(f"_f{i}").cast("double")
        idf = F.log((F.col("_all") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        score = score + idf * (f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg"))))
    return rows.select("chunk_id", *own, (-score).alias("raw_score"))


def _back(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


def bm25_best(index: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(chunk_id, chat_id where the index has it, started_at, raw_score, rank, score) of the best chunks, worked out once: local rows."""
    _checked(query)
    order = [F.col("raw_score"), F.col("started_at"), F.col("chunk_id")]
    best = ranked(bm25_rows(index, query), order, limit)
    return index.sparkSession.createDataFrame(best.collect(), best.schema)


def bm25_hits(chunks: DataFrame, best: DataFrame, query: str, length: int = 80, refs: DataFrame | None = None) -> DataFrame:
    """Hits of the rows of ``bm25_best``."""
    best = best.select("chunk_id", "raw_score", "rank", "score")
    return hits(chunks.join(F.broadcast(best), "chunk_id"), "bm25", query, length, refs, best)


def bm25_search(chunks: DataFrame, query: str, limit: int = DEFAULT_LIMIT, length: int = 80, refs: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """Chunks that hold every term of the query, best BM25 score first, then earliest.

    ``index`` is the stored ``postings`` of the chunks; without it they are made here.
    The ids of the first ``limit`` chunks come to the driver and go out again to fetch
    their rows, so the ranking is worked out once.
    """
    index = postings(chunks.select("chunk_id", "started_at", "text")) if index is None else index
    return bm25_hits(chunks, bm25_best(index, query, limit), query, length, refs)


def term_search(windows: DataFrame, query: str, limit: int = DEFAULT_LIMIT, length: int = 80, headers: bool = False) -> DataFrame:
    """Windows by the number of query terms they contain, case counting; with ``headers`` their document's head counts too."""
    _checked(query)
    terms = query.split()
    text = document(windows) if headers else F.col("text")
    score = reduce(lambda a, b: a + b, (F.contains(text, F.lit(t)).cast("bigint") for t in terms))
    found = windows.withColumn("raw_score", score).filter("raw_score > 0")
    return window_hits(ranked(found, [F.col("raw_score").desc(), F.col("parent_id")], limit), "semantic", query, length)


def document(windows: DataFrame) -> Column:
    """A window's document: a head of five lines, a rule and the text."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("parent_id: "), "parent_id"),
        F.lit("unit: parent_window"),
        F.concat(F.lit("chat_id: "), "chat_id"),
        F.concat(F.lit("time_range: "), rfc3339(F.col("started_at")), F.lit(".."), rfc3339(F.col("ended_at"))),
        F.concat(F.lit("child_chunk_ids: "), F.array_join("child_chunk_ids", ",")),
        F.lit("---"),
        "text",
    )

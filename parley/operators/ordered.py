"""Comparing a row with its predecessor without a task for each key.

A window over a whole room puts the busiest room in one task.  Rooms are therefore
cut into slices: by time, and where very many rows have one time or a short span, also at
rows that a hash picks out, one of CUT_EACH on average, wherever they stand in the order.
Within a slice a window does the work, and the few rows at
slice edges get what they need from a table of one row a slice.  Without a slice length a
plain window over the key does it, which is the shorter plan where the rows are known to
be few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice.
SLICE_SECONDS = 86_400
#: Of so many rows about one begins a new slice.
CUT_EACH = 65_536


def slice_of(ts: Column, seconds: int = SLICE_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def sliced(df: DataFrame, key: list[str], order: list[str], ts: str, seconds: int) -> DataFrame:
    """``df`` with the column ``slice``: its span of time, and the number of picked rows of this span up to the row.

    The picked rows are a hash's choice, so every reading of ``df`` cuts it alike; they
    are joined to rows of their key and span, by a broadcast where Spark finds
    them few, else in tasks that it can split.
    """
    span, place = slice_of(F.col(ts), seconds), F.struct(*order)
    picked = df.filter(F.pmod(F.xxhash64(*key, *order), F.lit(CUT_EACH)) == 0)
    cuts = picked.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), span.alias("_s")).agg(F.collect_set(place).alias("_cuts"))
    rows = df.withColumn("_span", span).join(cuts, (F.col("_span") == F.col("_s")) & _equal(key), "left")
    number = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0))
    rows = rows.withColumn("slice", F.struct(F.col("_span").alias("span"), F.greatest(number, F.lit(0)).alias("n")))
    return rows.drop("_span", "_s", "_cuts", *(f"_k{i}" for i in range(len(key))))


def with_previous(df: DataFrame, key: list[str], order: list[str], ts: str, carried: dict[str, Column], seconds: int | None = SLICE_SECONDS) -> DataFrame:
    """``df`` with the columns ``prev`` (a struct of ``carried`` of the row before in the order within the key) and, if cut, ``slice``.

    ``order`` must be a total order that starts with ``ts``.
    """
    if seconds is None:
        own = F.struct(*(c.alias(n) for n, c in carried.items()))
        return df.withColumn("prev", F.lag(own).over(Window.partitionBy(*key).orderBy(*order)))
    df = sliced(df, key, order, ts, seconds).withColumn("_own", F.struct(*(c.alias(n) for n, c in carried.items())))
    inner = Window.partitionBy(*key, "slice").orderBy(*order)
    df = df.withColumn("prev", F.lag("_own").over(inner))
    edges = df.groupBy(*key, "slice").agg(F.max_by("_own", F.struct(*order)).alias("_last"))
    edges = edges.withColumn("_before", F.lag("_last").over(Window.partitionBy(*key).orderBy("slice")))
    edges = edges.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), F.col("slice").alias("_s"), "_before")
    same = (F.col("slice") == F.col("_s")) & _equal(key)
    return df.join(edges, same, "left").withColumn("prev", F.coalesce("prev", "_before")).drop("_own", "_before", "_s", *(f"_k{i}" for i in range(len(key))))


def with_runs(
    df: DataFrame, key: list[str], order: list[str], ts: str, carried: dict[str, Column], needs: list[str], starts: Callable[[Column], Column], seconds: int | None = SLICE_SECONDS
) -> DataFrame:
    """``df`` with ``starts`` (does a run start at this row?) and ``opening`` (``order`` of the first row of its run).

    ``starts(prev)`` says so from the row's columns ``needs`` and the struct of
    ``carried`` of the row before; a key's first row starts a run.  ``order`` must be a
    total order that starts with ``ts``.  The rows are read twice, once for the slices'
    edges, and shuffled by key and slice.
    """
    if seconds is None:
        along = Window.partitionBy(*key).orderBy(*order)
        df = with_previous(df, key, order, ts, carried, None)
        df = df.withColumn("starts", F.col("prev").isNull() | starts(F.col("prev"))).drop("prev")
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("opening", F.last(F.when(F.col("starts"), F.struct(*order)), ignorenulls=True).over(upto))
    df = sliced(df, key, order, ts, seconds).withColumn("_own", F.struct(*(c.alias(n) for n, c in carried.items())))
    inner = Window.partitionBy(*key, "slice").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("prev", F.lag("_own").over(inner))
    df = df.withColumn("starts", F.when(F.col("prev").isNotNull(), starts(F.col("prev"))))
    df = df.withColumn("opening", F.last(F.when(F.col("starts"), F.struct(*order)), ignorenulls=True).over(upto)).drop("prev")
    place = F.struct(*order)
    edges = df.groupBy(*key, "slice").agg(
        F.max_by("_own", place).alias("_last"), F.min_by(F.struct(*needs), place).alias("_first"), F.min(place).alias("_at"), F.max("opening").alias("_open")
    )
    along = Window.partitionBy(*key).orderBy("slice")
    edges = edges.withColumn("prev", F.lag("_last").over(along))
    edges = edges.select(*key, "slice", "prev", "_at", "_open", *(F.col(f"_first.{c}").alias(c) for c in needs if c not in key))
    edges = edges.withColumn("_starts", F.col("prev").isNull() | starts(F.col("prev")))
    edges = edges.withColumn("_own_open", F.when(F.col("_starts"), F.col("_at")))
    before = F.last(F.coalesce("_open", "_own_open"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("_opening", F.coalesce("_own_open", before))
    edges = edges.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), F.col("slice").alias("_s"), "_starts", "_opening")
    df = df.join(edges, (F.col("slice") == F.col("_s")) & _equal(key), "left")
    df = df.withColumn("starts", F.coalesce("starts", "_starts")).withColumn("opening", F.coalesce("opening", "_opening"))
    return df.drop("slice", "_own", "_s", "_starts", "_opening", *(f"_k{i}" for i in range(len(key))))


def _equal(key: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(key):
        out = out & (F.col(c) == F.col(f"_k{i}"))
    return out

"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of characters other than ASCII non-alphanumerics, with A-Z in lower
case.  Each text keeps the least hash of K-word grams in every window of W grams; two
texts that share ``K + W - 1`` words keep a common one, so a join of kept hashes finds
every shared span of that length.  A hit is then extended to the words of the text's window, which
is joined with the windows of the items; overlapping windows of one span add up to the
whole span, and every word in one of them is a hit.

Hashing runs on full lower case, which only merges more words than A-Z does; the
comparison of words is exact, so nothing is found by a hash alone.

Null and empty texts have no words.  Items of fewer words than WINDOW, but not none,
are one window; they are looked up by hashes of grams of their own length.  Equal
rows give equal results; different texts of one id are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import text_keys

#: Words of a window; of a hashed gram; grams of a winnowing window.  K + W - 1 = WINDOW.
WINDOW = 10
K, W = 7, 4
#: The item side is broadcast up to so many fingerprint rows and bytes of windows; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 64 << 20
#: Fixed value: a word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The hash that every text has once, so that a text without hits keeps a row.
_MARK = -1


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _paired(df: DataFrame, source: str, to: str, shift: int, f) -> DataFrame:
    """Column ``to``: f of every element of ``source`` and the one ``shift`` places on.

    Each step is a column of its own that the next refers to more than once, so the
    optimiser doesn't fold them into one expression that computes them again.
    """
    x = F.col(source)
    n = F.greatest(F.size(x) - shift, F.lit(0))
    return df.withColumn(to, F.zip_with(F.slice(x, 1, n), F.slice(x, F.lit(1 + shift), n), f))


def _spread(df: DataFrame, source: str, to: str, k: int, f) -> DataFrame:
    """Column ``to``: f over every run of k elements, by doubling; the last step may overlap."""
    width = 1
    while width < k:
        shift = min(width, k - width)
        df = _paired(df, source, to, shift, f)
        source, width = to, width + shift
    return df if source == to else df.withColumn(to, F.col(source))


def fingerprints(df: DataFrame, k: int, w: int) -> DataFrame:
    """``df`` (with a column ``words``) and its column ``kept``: for each run of k + w - 1 words the least hash of its k-grams."""
    df = df.withColumn("kept", F.transform("words", lambda x: F.xxhash64(F.lower(x))))
    df = _spread(df, "kept", "kept", k, lambda x, y: F.xxhash64(x, y))
    return _spread(df, "kept", "kept", w, lambda x, y: F.least(x, y))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), *text_keys(id_col, text_col), words(F.col(text_col)).alias("words"))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(n, window, item_id): the distinct windows of the items; n is their number of words."""
    rows = items.select(F.col(id_col).alias("item_id"), words(lowered(F.col(text_col))).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("n", F.least(F.size("w"), F.lit(window)))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return rows.select("n", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("n"))).alias("window"), "item_id").distinct()


def _shape(n: int, window: int) -> tuple[int, int]:
    """K and W for runs of n words."""
    return (K, n - K + 1) if n == window and n >= K else (n, 1)


def hits(docs: DataFrame, windows: DataFrame, n: int, window: int, broadcast_rows: int) -> tuple[DataFrame, bool]:
    """Rows (doc_id, k1, k2, n_words, at, item_id, n) of windows of n words that texts share with items.

    Where the items' fingerprints fit a broadcast, every text also has a row without
    a hit, and True is returned.  Only ``n``, null there, tells hits: an item's id may be null.
    """
    mine = windows.filter(F.col("n") == n).select("window", "item_id", "n")
    k, w = _shape(n, window)
    # exploding the bare column would make the optimiser infer a filter that holds all steps nested, computed many times over
    every = F.concat("kept", F.array(F.lit(_MARK).cast("bigint")))
    prints = fingerprints(mine.select(F.split("window", " ").alias("words")), k, w).select(F.explode(every).alias("_kept")).distinct()
    size = mine.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length(F.coalesce(F.col("item_id").cast("string"), F.lit("")))), F.lit(0)).alias("bytes")).first()
    few = size["rows"] <= broadcast_rows and size["bytes"] <= BROADCAST_BYTES and prints.count() <= broadcast_rows
    rows = fingerprints(docs, k, w)
    span = lowered(F.concat_ws(" ", F.slice("words", F.col("at") + 1, n)))
    if few:
        rows = rows.select("doc_id", "k1", "k2", "words", F.posexplode(every).alias("at", "hash"))
        rows = rows.join(F.broadcast(prints), F.col("hash") == F.col("_kept"), "left_semi")
        rows = rows.select("doc_id", "k1", "k2", F.size("words").alias("n_words"), "at", "hash", F.when(F.col("hash") != _MARK, span).alias("_span"))
        rows = rows.join(F.broadcast(mine), F.col("_span") == F.col("window"), "left").filter(F.col("n").isNotNull() | (F.col("hash") == _MARK))
        return rows.drop("hash", "_span", "window"), True
    # many items: first the texts with a common fingerprint, by a shuffle of hashes alone
    some = rows.select("k1", "k2", F.explode(F.array_distinct(every)).alias("hash")).filter(F.col("hash") != _MARK)
    some = some.join(prints, F.col("hash") == F.col("_kept"), "left_semi").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    rows = docs.join(some, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left_semi")
    rows = rows.filter(F.size("words") >= n).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - n)))
    rows = rows.select("doc_id", "k1", "k2", F.size("words").alias("n_words"), "at", span.alias("_span"))
    return rows.join(mine, F.col("_span") == F.col("window")).drop("_span", "window"), False


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_rows: int = BROADCAST_ROWS,
    keys: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items): for each document its words, its words within shared windows, and the items they occur in.

    A row for each row of ``docs``; ``items`` is a sorted array of ids as strings,
    a null id last.
    With ``keys``, also the columns k1 and k2 of ``text_keys``.
    """
    keyed = _keyed(docs, id_col, text_col)
    windows = item_windows(items, item_col, item_text_col, window)
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``window`` values
    found, has_all = None, False
    for n in lengths:
        part, whole = hits(keyed, windows, n, window, broadcast_rows)
        if has_all and whole:
            part = part.filter("n is not null")
        has_all = has_all or whole
        found = part if found is None else found.unionByName(part)
    if not has_all:
        base = keyed.select("doc_id", "k1", "k2", F.size("words").alias("n_words"))
        base = base.select("*", F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("int").alias("n"))
        found = base if found is None else base.unionByName(found.withColumn("item_id", F.col("item_id").cast("string")))
    whole = found.groupBy("doc_id", "k1", "k2").agg(
        F.first("n_words").alias("n_words"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("_rows"),
        F.collect_set(F.when(F.col("n").isNotNull(), F.struct("at", "n"))).alias("_at"),
        F.collect_set(F.when(F.col("n").isNotNull(), F.struct(F.col("item_id").cast("string").alias("id")))).alias("_items"),
    )
    places = F.flatten(F.transform("_at", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    whole = whole.select(
        "doc_id",
        *(("k1", "k2") if keys else ()),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size(F.array_distinct(places)).cast("bigint").alias("n_hit"),
        F.array_sort(F.col("_items.id")).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"),
    )
    return whole.drop("_copy")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)
), h AS (
  SELECT rid, dw.n, s, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), c AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM h) GROUP BY rid
), i AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""

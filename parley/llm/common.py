"""What the corpus operators share: Arrow batches, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one call of a batch function gets at most (one text may be longer).
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between the JVM and Python at most (one row may be larger).
BATCH_BYTES = 16 << 20
#: Bytes of text that reach the driver to fit a model, at most.
FIT_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Only in local mode may that setting be absent: then one machine's temporary
    folder is used.  Elsewhere that would lose rows without a word, so it raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/parley-checkpoints"
    return f"{root.rstrip('/')}/parley-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _size(value) -> int:
    return len(value.as_buffer()) if value.is_valid else 0


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part hold about ``limit`` bytes."""
    start = held = 0
    for i, value in enumerate(batch.column(column)):
        n = _size(value)
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_texts(
    docs: DataFrame,
    columns: list[Column],
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]],
    added: T.StructType,
    keep: int,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply a batch function to ``columns``, of which the last is the text.

    ``make()`` runs once in each Python worker's partition and gives the batch
    function; that returns the added columns.  The first ``keep`` columns pass
    through unchanged.  ``limit``: the bytes of text a call gets, see SLICE_BYTES.
    The session's Arrow batches are held to BATCH_BYTES, so that a worker's memory
    doesn't depend on the length of the texts.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    source = docs.select(*columns)
    schema = T.StructType([*source.schema.fields[:keep], *added.fields])
    kept, last = source.columns[:keep], len(columns) - 1
    fields = [(f.name, arrow_schema(T.StructType([f])).field(0).type) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for part in slices(batch, last, limit):
                out = call(part)
                arrays = [part.column(i) for i in range(keep)] + [pa.array(out[n], t) for n, t in fields]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(n for n, _ in fields)])

    return source.mapInArrow(run, schema)


def arrow_rows(rows: DataFrame, call: Callable[[pa.RecordBatch], list[list]], added: str, keep: int) -> DataFrame:
    """The first ``keep`` columns and those that ``call`` makes of each Arrow batch of ``rows``."""
    extra = T._parse_datatype_string(added)
    schema = T.StructType([*rows.schema.fields[:keep], *extra.fields])
    types = [f.type for f in arrow_schema(extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(i) for i in range(keep)] + [pa.array(c, t) for c, t in zip(call(batch), types)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def text_keys(id_col: str, text_col: str) -> list[Column]:
    """k1 and k2: 128 bits that stand for a document's id and text, so that texts of one id are told apart."""
    i, t = F.col(id_col), F.col(text_col)
    return [F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit(1)).alias("k2")]


def held_to(rows: DataFrame, group: Column, order: list[str], text_col: str, most: int) -> DataFrame:
    """The first rows, by ``order``, of each group, as far as their texts hold ``most`` bytes; texts of over a sixteenth of that aren't used.

    For bounded tables of few columns only: ``order`` must tell the rows apart, and
    each group's sizes are summed in one task.
    """
    rows = stored(rows.withColumn("_group", group).filter(F.octet_length(text_col) <= most // 16))
    upto = Window.partitionBy("_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select("_group", *order, F.sum(F.octet_length(text_col)).over(upto).alias("_sum")).filter(F.col("_sum") <= most)
    return rows.join(F.broadcast(sums.drop("_sum")), ["_group", *order], "left_semi").drop("_group")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, most: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[str, int]]:
    """At most ``bound`` (text, label) rows of each label value 0 and 1, and ``most`` bytes of text in all, lowest hash of the id first.

    Only ids travel to the sort; the texts of the chosen ids follow by a join
    against a list of at most ``2 * bound`` ids, and that is what reaches the
    driver.  An id counts once, with its greatest label and its least text.  Rows
    with a null id, label or text are not used.
    """
    mine = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
    mine = mine.filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))
    mine = mine.withColumnRenamed("_id", id_col).filter(train).withColumnRenamed(id_col, "_id")
    mine = mine.withColumn("_h", F.xxhash64("_id"))
    picked = None
    for y in (0, 1):
        some = mine.filter(F.col("_y") == y).orderBy("_h", "_id").limit(bound)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.col("_t").isNotNull())
    found = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_h", "_y").agg(F.min("_t").alias("_t"))
    found = held_to(found, F.col("_y"), ["_h", "_id"], "_t", most // 2).select("_id", "_t", "_y").collect()
    return [(r["_t"], r["_y"]) for r in sorted(found, key=lambda r: (r["_id"], r["_t"]))]


def sample(docs: DataFrame, train: Column, bound: int, most: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The texts of at most ``bound`` rows and ``most`` bytes, lowest hash of the id first, whatever is known of them.

    The hash isn't that of labelled_sample, so the two choose independently.  As
    there, only ids travel to the sort.  Equal rows count once.  Rows with a null id
    or text are not used.
    """
    mine = docs.filter(train & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    mine = mine.select(F.col(id_col).alias("_id"), F.xxhash64(F.lit("sample"), F.col(id_col)).alias("_h"), F.xxhash64(text_col).alias("_v"))
    picked = mine.orderBy("_h", "_id", "_v").limit(bound).distinct()
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("_w"))
    found = texts.join(F.broadcast(picked), (F.col("_i") == F.col("_id")) & (F.col("_w") == F.col("_v")))
    found = found.groupBy("_h", "_id", "_v").agg(F.min("_t").alias("_t"))
    found = held_to(found, F.lit(0), ["_h", "_id", "_v"], "_t", most).select("_id", "_t").collect()
    return [r["_t"] for r in sorted(found, key=lambda r: (r["_id"], r["_t"]))]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by contraction: rows (node, root) for every node of an edge.

    Each round hangs every node on the least of itself and its neighbours and
    contracts the edges, all by aggregations with partial sums and by joins whose
    one side has unique keys, so a node with very many edges is no hot task.
    Each round's tables are written to the shared folder.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    roots = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        level = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        left, right = (level.select(F.col("a").alias(f"_{x}"), F.col("m").alias(f"_m{x}")) for x in "xy")
        if roots is None:
            roots = left.select(F.col("_x").alias("node"), F.col("_mx").alias("root"))
        else:
            roots = stored(roots.join(left, F.col("root") == F.col("_x"), "left").select("node", F.coalesce("_mx", "root").alias("root")))
        # the edge (u, m(u)) becomes (m(u), m(m(u))), so a root that moved stays tied to its followers
        edges = edges.join(left, F.col("a") == F.col("_x")).join(right, F.col("b") == F.col("_y"))
        edges = stored(edges.select(F.least("_mx", "_my").alias("a"), F.greatest("_mx", "_my").alias("b")).filter("a <> b").distinct())
        if edges.isEmpty():
            return roots

"""Hard negatives by inner product, over one-dimensional distance keys.

Vectors are integers ``x``, extended by one entry so that all have the length M of the
longest; an anchor ``a`` gets a zero there.  Then ``|x - a|**2 = M**2 + |a|**2 - 2 * <x, a>``:
the higher the inner product, the nearer.  Every extended vector belongs to its nearest
pivot, and the index holds all of them sorted by (pivot, distance to it), in cells of at most
CELL vectors.  A vector within a radius r of an anchor lies, for each pivot, in the annulus
of the keys from ``d - r`` to ``d + r``, d being the anchor's distance to the pivot.

A search goes through its own cell first.  What it finds there bounds the radius that is
left to look at: beyond the distance of the k-th result nothing can count.  Then the key
intervals of half that radius are scanned, the bound is drawn again, and the intervals of
the whole remaining radius certify the result.  No cell is scanned twice for an anchor.

Two searches run: the positives of each anchor (the best rows of its own label), then for
each positive the best rows of other labels within a band of its score.  Anchors of one cell travel together in blocks of at most
BLOCK; pairs of blocks and cells are joined, and results are held to the best of each anchor
and band before and after each shuffle.

Scores are exact.  Pivots come from at most SAMPLE vectors; they decide only how much is
scanned.  Results don't depend on them, nor on the sizes.

Rows without id, label or vector take no part, nor do vectors with null or non-finite
entries or of another length than the longest.  Rows that repeat, or share an id, count each by itself;
an anchor's own row is none of its positives, a copy of it is one.  Ties go to the lesser id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import BATCH_BYTES, arrow_schema, stored
from parley.llm.whitening import matrix

PIVOTS, SAMPLE = 16, 2_048
CELL, BLOCK = 8_192, 256
#: Shares of the radius that is left to look at, scanned one after the other.
STEPS = (0.5, 1.0)
#: Cells whose key intervals are joined by a broadcast, at most.
BROADCAST_CELLS = 100_000
LOWEST = -(1 << 62)


def packed(rows: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them, its size in front."""
    for kind in (np.int16, np.int32):
        if not rows.size or (rows.min() >= np.iinfo(kind).min and rows.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + rows.astype(kind).tobytes()
    return bytes([8]) + rows.astype(np.int64).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; raises where they might pass 62 bits."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    raise OverflowError("inner products don't fit 62 bits")


def pivots_of(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from one another: each next one is the farthest from those before."""
    chosen = [0]
    apart = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def extended(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the entry that brings each to the length ``longest``."""
    rows = rows.astype(np.float64)
    rest = np.sqrt(np.maximum(0.0, longest - (rows * rows).sum(axis=1)))
    return np.column_stack([rows, rest])


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots."""
    square = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


class Space:
    """Dimension, squared length of the longest vector, and pivots."""

    def __init__(self, dim: int, longest: float, pivots: np.ndarray):
        self.dim, self.longest, self.pivots = dim, longest, pivots

    def radius(self, anchors: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The distance at which a score is reached, a little more for rounding; infinite where any score counts."""
        square = self.longest + (anchors.astype(np.float64) ** 2).sum(axis=1) - 2.0 * least
        r = np.sqrt(np.maximum(0.0, square)) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(self.longest))
        return np.where(least <= LOWEST, np.inf, r)


INDEX = "cell bigint, pivot int, lo double, hi double, ids binary, labels binary, anchors binary, vectors binary"


def build_index(rows: DataFrame, space: Space) -> DataFrame:
    """Cells of rows (id, label, anchor, x), sorted by (pivot, distance); at most CELL rows each."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(extended(matrix(batch.column("x"), space.dim), space.longest), space.pivots)
            nearest = far.argmin(axis=1)
            arrays = [pa.array(nearest, pa.int32()), pa.array(far[np.arange(len(far)), nearest], pa.float64()), *batch.columns]
            yield pa.RecordBatch.from_arrays(arrays, names=["pivot", "key", *batch.schema.names])

    def cell(number: int, part: pa.Table) -> pa.RecordBatch:
        key = part.column("key").to_numpy()
        numbers = [packed(part.column(c).to_numpy()) for c in ("id", "label")]
        values = [number, part.column("pivot")[0].as_py(), key.min(), key.max(), *numbers, packed(part.column("anchor").cast(pa.int16()).to_numpy())]
        flat = part.column("x").combine_chunks().flatten().to_numpy()
        names = ["cell", "pivot", "lo", "hi", "ids", "labels", "anchors", "vectors"]
        types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*values, packed(flat)], types)], names=names)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                pivots = held.column("pivot").to_numpy()
                end = int(np.searchsorted(pivots, pivots[0], side="right"))
                if end == held.num_rows and end < CELL:
                    break  # more of this pivot may follow
                yield cell(number, held.slice(0, min(end, CELL)))
                number, held = number + 1, held.slice(min(end, CELL))
        if held is not None and held.num_rows:
            yield cell(number, held)

    with_keys = rows.mapInArrow(keyed, "pivot int, key double, id bigint, label bigint, anchor boolean, x array<bigint>")
    dealt = with_keys.repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id")
    return stored(dealt.mapInArrow(cells, INDEX))


BLOCKS = "block bigint, own bigint, at binary, ids binary, labels binary, vectors binary"


def anchor_blocks(index: DataFrame, space: Space) -> DataFrame:
    """Blocks of at most BLOCK anchors of one cell; ``at`` are their places in it."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, *data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                flags, ids, labels, vectors = map(unpacked, data)
                places = np.flatnonzero(flags)
                for n, a in enumerate(range(0, len(places), BLOCK)):
                    at = places[a : a + BLOCK]
                    values = [own * CELL + n, own, packed(at), packed(ids[at]), packed(labels[at]), packed(vectors.reshape(-1, space.dim)[at].ravel())]
                    types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["block", "own", "at", "ids", "labels", "vectors"])

    return stored(index.select("cell", "anchors", "ids", "labels", "vectors").mapInArrow(blocks, BLOCKS))


class Search:
    """For each anchor and band the ``k`` best rows of its own label, or of others, with scores from ``low`` to ``high``.

    ``bands`` has (block, pos, band, low, high); ``pos`` is an anchor's place in its block.
    """

    def __init__(self, index: DataFrame, blocks: DataFrame, space: Space, same: bool, k: int):
        self.index, self.blocks, self.space, self.same, self.k = index, blocks, space, same, k
        self.light = index.select(F.col("cell"), F.col("pivot").alias("_pivot"), "lo", "hi")
        self.few = index.count() <= BROADCAST_CELLS

    def run(self, bands: DataFrame) -> DataFrame:
        """(block, pos, band, id, score, rank)."""
        bands = stored(bands.withColumn("done", F.lit(float("-inf"))))
        own = self._scan(self._asked(bands), None)
        best = self._best(own)
        for share in STEPS:
            bands = self._narrowed(bands, best)
            asked = self._asked(bands, share)
            best = self._best(best.drop("rank").unionByName(self._scan(asked, self._pairs(asked))))
            bands = asked.select("block", F.explode("asks").alias("a")).select("block", "a.*").withColumn("done", F.col("reach")).drop("reach")
        return best

    def _best(self, found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("block", "pos", "band").orderBy(F.col("score").desc(), "id"))
        return stored(found.withColumn("rank", rank).filter(F.col("rank") <= self.k))

    def _narrowed(self, bands: DataFrame, best: DataFrame) -> DataFrame:
        """The bands, not below their k-th result where they have one."""
        last = best.filter(F.col("rank") == self.k).select("block", "pos", "band", F.col("score").alias("_last"))
        return bands.join(last, ["block", "pos", "band"], "left").withColumn("low", F.greatest("low", F.coalesce("_last", "low"))).drop("_last")

    def _asked(self, bands: DataFrame, share: float = 0.0) -> DataFrame:
        """Blocks with their bands ``asks``, the distances that those reach with a share of the radius, and the key intervals ``keys`` of each pivot.

        An interval is what any anchor of the block reaches, [from, upto], and what all of them have
        had before, [had_from, had_upto].
        """
        space = self.space
        each = bands.groupBy("block").agg(F.collect_list(F.struct("pos", "band", "low", "high", "done")).alias("asks"))
        rows = self.blocks.join(each, "block")
        kinds = rows.schema
        names = [*rows.columns[:-1], "asks", "keys"]
        ask = "array<struct<pos:int,band:int,low:bigint,high:bigint,done:double,reach:double>>"
        key = "array<struct<pivot:int,from:double,upto:double,had_from:double,had_upto:double>>"
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields[:-1]) + f", asks {ask}, keys {key}"

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    asks = row.column("asks")[0].as_py()
                    vectors = unpacked(row.column("vectors")[0].as_py()).reshape(-1, space.dim)
                    pos = np.array([a["pos"] for a in asks])
                    done = np.array([a["done"] for a in asks])
                    reach = share * space.radius(vectors[pos], np.array([a["low"] for a in asks], dtype=np.float64)) if share else np.zeros(len(asks))
                    reach = np.maximum(np.where(np.isnan(reach), 0.0, reach), done)
                    # the anchors lie at extended entry 0
                    far = distances(np.column_stack([vectors, np.zeros(len(vectors))]).astype(np.float64), space.pivots)[pos]
                    keys = []
                    for p in range(len(space.pivots)):
                        d = far[:, p]
                        keys.append({"pivot": p, "from": (d - reach).min(), "upto": (d + reach).max(), "had_from": (d - done).max(), "had_upto": (d + done).min()})
                    asks = [a | {"reach": float(r)} for a, r in zip(asks, reach)]
                    yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([asks], types[0]), pa.array([keys], types[1])], names=names)

        types = [f.type for f in arrow_schema(T._parse_datatype_string(f"asks {ask}, keys {key}"))]
        return stored(rows.mapInArrow(plan, schema))

    def _pairs(self, asked: DataFrame) -> DataFrame:
        """(block, cell): the cells that a block's key intervals meet and that not all of its anchors have had."""
        keys = asked.select("block", "own", F.explode("keys").alias("_key")).select("block", "own", "_key.*")
        cells = F.broadcast(self.light) if self.few else self.light
        meets = (F.col("lo") <= F.col("upto")) & (F.col("hi") >= F.col("from"))
        had = (F.col("lo") <= F.col("had_upto")) & (F.col("hi") >= F.col("had_from"))
        met = keys.join(cells, (F.col("pivot") == F.col("_pivot")) & meets & ~had & (F.col("cell") != F.col("own")))
        return met.select("block", "cell")

    def _scan(self, asked: DataFrame, pairs: DataFrame | None) -> DataFrame:
        """(block, pos, band, id, score): each pair's best rows; without pairs, those of the blocks' own cells."""
        space, k, same = self.space, self.k, self.same
        mine = asked.select(F.col("block"), "own", "at", F.col("labels").alias("mine"), F.col("vectors").alias("anchors"), "asks")
        if pairs is None:
            mine = mine.withColumn("_cell", F.col("own"))
        else:
            mine = mine.join(pairs.select(F.col("block").alias("_b"), F.col("cell").alias("_cell")), F.col("block") == F.col("_b")).drop("_b")
        whole = self.index.select("cell", "pivot", "lo", "hi", "ids", "labels", "vectors")
        joined = mine.join(whole, F.col("_cell") == F.col("cell"))
        first = pairs is None

        def best(rows: dict) -> Iterator[tuple]:
            anchors, cell = (unpacked(rows[c]).reshape(-1, space.dim) for c in ("anchors", "vectors"))
            ids, labels, own, at = (unpacked(rows[c]) for c in ("ids", "labels", "mine", "at"))
            asks = rows["asks"]
            pos = np.array([a["pos"] for a in asks])
            if not first:
                d = distances(np.column_stack([anchors, np.zeros(len(anchors))]).astype(np.float64), space.pivots[rows["pivot"]][None, :])[pos, 0]
                gap = np.maximum(0.0, np.maximum(rows["lo"] - d, d - rows["hi"]))
                due = np.flatnonzero((gap <= [a["reach"] for a in asks]) & (gap > [a["done"] for a in asks]))
                asks = [asks[i] for i in due]
            if not asks:
                return
            used = sorted({a["pos"] for a in asks})
            scores = dict(zip(used, products(anchors[used], cell)))
            fits = {p: (labels == own[p]) == same for p in used}
            if same and rows["own"] == rows["cell"]:
                for p in used:
                    fits[p][at[p]] = False
            for a in asks:
                s = scores[a["pos"]]
                good = np.flatnonzero(fits[a["pos"]] & (s >= a["low"]) & (s <= a["high"]))
                if len(good) > k:
                    line = np.partition(s[good], len(good) - k)[len(good) - k]
                    good = good[s[good] >= line]
                    good = good[np.lexsort((ids[good], -s[good]))][:k]
                for g in good:
                    yield rows["block"], a["pos"], a["band"], int(ids[g]), int(s[g])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                    found = list(best(rows))
                    columns = list(zip(*found)) if found else [[]] * 5
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "pos", "band", "id", "score"])

        return joined.mapInArrow(scan, "block bigint, pos int, band int, id bigint, score bigint")


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _hundredth(number: Column) -> Column:
    """A hundredth of an integer, rounded down."""
    return F.floor((number - F.pmod(number, F.lit(100))).cast("decimal(20,0)") / 100).cast("bigint")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pos, anchor_id) of each anchor of blocks (block, ids)."""
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), map(unpacked, batch.column(1).to_pylist())):
            arrays = [pa.array([block] * len(ids), pa.int64()), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "pos", "anchor_id"])


def mine(
    rows: DataFrame, vector: Column, anchor: Column, label: Column, id_col: str = "vec_id", positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector`` gives integers (null: the row takes no part), ``anchor`` says which rows are
    anchors.  For each anchor the ``positives`` best rows of its label, and for each of
    these the ``negatives`` best rows of other labels whose score is from ``lowest`` to
    ``highest`` hundredths of the positive's.
    """
    use = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("x"))
    use = use.filter("id is not null and label is not null and x is not null")
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    most = use.agg(F.max(F.struct(F.size("x"), square))).first()[0]
    dim, longest = most or (0, 0.0)
    if not dim:
        return rows.sparkSession.createDataFrame([], RESULT)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    use = use.filter(F.size("x") == dim)
    some = use.select("x", "id").orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).collect()
    space = Space(dim, longest, np.zeros((0, 0)))
    space.pivots = pivots_of(extended(np.array([r["x"] for r in some]), longest), PIVOTS)
    index = build_index(use, space)
    blocks = anchor_blocks(index, space)

    # one row for each anchor: its place in its block, and its id
    ids = blocks.select("block", "ids").mapInArrow(_places, "block bigint, pos int, anchor_id bigint")
    everything = ids.select("block", "pos", F.lit(0).alias("band"), F.lit(LOWEST).cast("bigint").alias("low"), F.lit(-LOWEST).cast("bigint").alias("high"))
    near = Search(index, blocks, space, True, positives).run(everything)
    score = F.col("score")
    # the least and the greatest integer within each band
    low, high = -_hundredth(-score * lowest), _hundredth(score * highest)
    bands = near.select("block", "pos", F.col("rank").alias("band"), low.alias("low"), high.alias("high")).filter("low <= high")
    hard = Search(index, blocks, space, False, negatives).run(bands)
    near = near.select("block", "pos", F.col("rank").alias("band"), F.col("id").alias("positive_id"), score.alias("positive_score"))
    found = hard.join(near, ["block", "pos", "band"]).join(ids, ["block", "pos"])
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The contract's rows over the table ``embeddings``, all scores of all anchors, in DuckDB's SQL.
ORACLE = """WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS mine, r.vec_id, r.label, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = mine QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.mine WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM n WHERE place <= 3"""

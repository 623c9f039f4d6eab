"""Jaccard join of texts by word n-grams: a MinHash LSH forest with exact verification.

A text is the set of its runs of ``n`` words (lower case; a shorter text is one run).
Texts with equal sets are one class member from the start.  Each tree labels a set with
a sequence of DEEPEST minimum hashes; the labels with a common prefix are a node of that
tree's trie.  The trie is kept as sorted labels: the labels that share the shortest
prefix of all are brought together by one shuffle, most of them standing alone, and only
the others have deeper nodes.

A pair of similarity s shares a prefix of d minimum hashes in one of the trees with
probability ``1 - (1 - s**d)**trees``.  The shortest prefix is the longest at which a
pair at the threshold itself reaches the target.  The matched prefixes of all sets are
shortened from whole labels, level by level, down to it and never end before: whatever
the similarities of other matches are, a link at the threshold needs the shortest one.

Candidates are joined as a star around the least member of each node, never as
pairs; that member alone goes on to the next shorter prefix.  What hangs together is
dealt out in cells of a bounded number of members and bytes, and each pair of cells is verified exactly in one task that returns a row for each member, so large
groups are neither emitted as pairs nor gathered in one task, and no link between
members of different cells is lost.

Null texts and texts without words are all equal to one another and to nothing else.
Equal ids with different texts count as different documents of one class if similar;
repeated rows each get their row.  Of equal class members the least id names the class.
Texts are found again by 128 bits of id and text, never by the id, which may be null or on very many rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import components, map_texts, stored, text_keys

WORD = re.compile(r"\w+")
TREES = 24
#: Minimum hashes in the whole label of a tree.
DEEPEST = 6
#: Members of a cell of a component, and about the bytes of their texts; one text may be longer.
CELL, CELL_BYTES = 512, 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, n: int, hashes: Hashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of n words."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    runs = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        runs *= _ODD
        runs += h[i : len(h) - k + 1 + i]
    return np.unique(mixed(runs))


def set_key(grams: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return xxhash.xxh3_128_digest(grams.tobytes())


def recall(s: list[float], depth: int, trees: int) -> float:
    """The share of pairs of these similarities that some tree is expected to bring together at a depth."""
    return float(np.mean([1 - (1 - x**depth) ** trees for x in s])) if s else 1.0


def depth_of(s: list[float], floor: int, target: float, trees: int) -> int:
    """The deepest level that reaches the target for pairs of these similarities; the floor if there are none."""
    depth = DEEPEST
    while depth > floor and (not s or recall(s, depth, trees) < target):
        depth -= 1
    return depth


def depth_for(threshold: float, target: float, trees: int = TREES) -> int:
    """The shortest prefix that is needed: the longest at which a pair at the threshold meets in some tree with probability ``target``."""
    return depth_of([threshold], 1, target, trees)


def multipliers(trees: int, depth: int) -> np.ndarray:
    """Odd factors of the hash functions, by tree and place in the label; a longer label only adds to a shorter one."""
    at = np.arange(1, trees * DEEPEST + 1, dtype=np.uint64).reshape(trees, DEEPEST)[:, :depth]
    return mixed(at * _ODD).ravel() | np.uint64(1)


def labels(grams: np.ndarray, factors: np.ndarray, trees: int, floor: int) -> np.ndarray:
    """(trees, levels): 64-bit hashes of the prefixes of each tree's label, from ``floor`` minimum hashes to all."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(grams), 2048):
        np.minimum(least, (factors[:, None] * grams[None, a : a + 2048]).min(axis=1), out=least)
    rows = least.reshape(trees, -1)
    out = np.empty((trees, rows.shape[1] - floor + 1), dtype=np.uint64)
    node = np.arange(1, trees + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        node = mixed(node * _ODD + rows[:, k])
        if k + 1 >= floor:
            out[:, k + 1 - floor] = node
    return out.view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, n: int, floor: int, trees: int) -> DataFrame:
    """(id, k1, k2, set_key, labels) of each document; ``labels`` tree by tree, empty for texts without words."""
    added = T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("labels", T.ArrayType(T.LongType()))])

    def make():
        hashes, factors = Hashes(), multipliers(trees, DEEPEST)

        def call(part: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {"set_key": [], "labels": []}
            for text in part.column(part.num_columns - 1).to_pylist():
                grams = shingles(text, n, hashes)
                out["set_key"].append(set_key(grams))
                out["labels"].append(labels(grams, factors, trees, floor).ravel() if len(grams) else [])
            return out

        return call

    return map_texts(docs, [F.col(id_col).alias("doc_id"), *text_keys(id_col, text_col), F.col(text_col).alias("_text")], make, added, 3)


def ties(forest: DataFrame, levels: int) -> DataFrame:
    """(set_key, head): what ties together the sets that share the shortest prefix of a tree, from the rows (set_key, path) of the forest.

    From whole labels to the shortest prefix, each node's sets are tied to its least
    one, which alone stands for them in the node of the next shorter prefix.
    """
    found = None
    for level in reversed(range(levels)):
        node = F.get("path", F.lit(level))
        heads = forest.groupBy(node.alias("_node")).agg(F.min("set_key").alias("head"), F.first("path").alias("path"), F.count(F.lit(1)).alias("c"))
        heads = stored(heads)
        leaves = forest.select("set_key", node.alias("node"))
        tied = leaves.join(heads.filter("c > 1").select("_node", "head"), F.col("node") == F.col("_node")).filter("set_key <> head").select("set_key", "head")
        found = tied if found is None else found.unionByName(tied)
        # of the sets below a node any path will do: they are the same up to it
        forest = heads.select(F.col("head").alias("set_key"), "path")
    return stored(found.distinct())


def counted(sets: list[np.ndarray], left: int, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of members, and the least place each is tied to.

    ``left`` of the sets are cell i; the rest are cell j.  With no rest all pairs
    within the cell are compared, otherwise the pairs across.  Runs through the
    distinct n-grams of the smaller side by sorted search; memory is a row of counts
    for one member at a time.
    """
    total = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(total), sizes)
    grams = np.concatenate(sets) if total else np.zeros(0, dtype=np.uint64)
    order = np.argsort(grams, kind="stable")
    _, codes = np.unique(grams, return_inverse=True)
    holders = owner[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    within = left == total
    links = np.zeros(total, dtype=np.int64)
    root = np.arange(total)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(left):
        mine = codes[starts[i] : starts[i + 1]]
        a, b = bounds[mine], bounds[mine + 1]
        spans = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
        both = np.bincount(holders[spans], minlength=total)
        enough = both >= threshold * (sizes[i] + sizes - both) - 1e-9
        enough[: i + 1 if within else left] = False
        for j in np.flatnonzero(enough):
            links[i] += weights[j]
            links[j] += weights[i]
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    return links, np.array([find(x) for x in range(total)], dtype=np.int64)


VERIFIED = "set_key binary, links bigint, root binary"


def verifier(n: int, threshold: float):
    """The function that verifies one pair of cells; takes (comp, i, j, cell, set_key, weight, text) rows."""

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = Hashes()
        sets = [shingles(t, n, hashes) for t in rows["text"]]
        keys = [bytes(k) for k in rows["set_key"]]
        cells = rows["cell"].to_numpy()
        i, j = key[1], key[2]
        at = sorted(range(len(keys)), key=lambda r: (cells[r] != i, keys[r]))
        left = sum(cells[r] == i for r in at)
        if i != j and left == len(at):
            at = []
        links, root = counted([sets[r] for r in at], left, rows["weight"].to_numpy()[at], threshold)
        return pd.DataFrame({"set_key": [keys[r] for r in at], "links": links, "root": [keys[at[x]] for x in root]})

    return verify


def texts_of(sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, unique: bool) -> DataFrame:
    """``sets`` (with set_key and the struct ``key`` of one document's text_keys) with that document's text as ``text``.

    ``unique``: is no document's row repeated?  Otherwise copies of a row are joined too,
    in tasks that can be split, and one of each set is kept.
    """
    k1, k2 = (k.alias(f"_{n}") for k, n in zip(text_keys(id_col, text_col), ("k1", "k2")))
    texts = docs.select(k1, k2, F.col(text_col).alias("text"))
    found = sets.join(texts, (F.col("key.k1") == F.col("_k1")) & (F.col("key.k2") == F.col("_k2"))).drop("_k1", "_k2", "key")
    if unique:
        return found
    others = [c for c in found.columns if c != "set_key"]
    return stored(found).groupBy("set_key").agg(*(F.first(c).alias(c) for c in others))


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, target: float = 0.99999, trees: int = TREES,
    keys: bool = False,
) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each document.

    ``class_id`` is the least id among the documents tied together by links, a link
    being a similarity of ``threshold`` or more; ``n_links`` is the number of other
    documents that this one is linked to, copies included.  ``target`` is the least
    probability that a link, of whatever similarity, becomes a candidate, where a prefix
    of one minimum can give it.  With ``keys``, also the columns k1 and k2 of
    ``text_keys`` and ``class_key``, which tells classes apart where ids repeat.
    """
    floor = depth_for(threshold, target, trees)
    rows = stored(signed(docs, id_col, text_col, n, floor, trees))
    sets = stored(
        rows.groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("labels").alias("labels"), F.min(F.struct("k1", "k2")).alias("key")
        )
    )
    unique = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()

    # the forest: labels that share their shortest prefix with another set's
    levels = DEEPEST - floor + 1
    leaves = sets.select("set_key", F.posexplode("labels").alias("at", "node")).filter(F.col("at") % levels == 0)
    met = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("node").alias("_node"))
    met = leaves.join(met, F.col("node") == F.col("_node"), "left_semi").groupBy("set_key").agg(F.collect_list("at").alias("at"))
    met = sets.select("set_key", "labels").join(met, "set_key")
    paths = F.transform("at", lambda p: F.slice("labels", p + 1, levels))
    forest = stored(met.select("set_key", F.explode(paths).alias("path")))
    comps = components(ties(forest, levels).select(F.col("head").alias("a"), F.col("set_key").alias("b")))

    # cells: a component is dealt by hash into as many as its members and their bytes need
    light = sets.select("set_key", "rep", "weight")
    members = comps.join(sets.select("set_key", "weight", "key"), F.col("node") == F.col("set_key")).drop("node")
    members = stored(texts_of(members, docs, id_col, text_col, unique).select("set_key", "weight", "root", "text"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    cells = F.ceil(F.greatest(F.col("c") / CELL, F.col("bytes") / CELL_BYTES)).cast("int")
    sizes = sizes.select(F.col("root").alias("_root"), F.greatest(cells, F.lit(1)).alias("cells"))
    members = members.join(sizes, F.col("root") == F.col("_root")).withColumn("cell", F.pmod(F.xxhash64("set_key"), F.col("cells")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    pairs = members.select(
        F.col("root").alias("comp"), F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "set_key", "weight", "text"
    )
    # dealt by cells and not, as the join before would leave them, by components
    pairs = pairs.repartition("comp", "i", "j")
    verified = stored(pairs.groupBy("comp", "i", "j").applyInPandas(verifier(n, threshold), VERIFIED))

    links = verified.groupBy("set_key").agg(F.sum("links").alias("links"))
    tied = components(verified.select(F.col("root").alias("a"), F.col("set_key").alias("b")).filter("a <> b").distinct())
    known = light.join(links.withColumnRenamed("set_key", "_k"), F.col("set_key") == F.col("_k"), "left")
    known = known.join(tied.withColumnRenamed("root", "_root"), F.col("set_key") == F.col("node"), "left")
    known = known.select("set_key", "rep", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("_root", "set_key").alias("_class"))
    known = stored(known)
    least = known.groupBy("_class").agg(F.min("rep").alias("class_id")).withColumnRenamed("_class", "class_key")
    facts = known.join(least, F.col("_class") == F.col("class_key"))
    facts = facts.select(F.col("set_key").alias("_k"), "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "class_key")
    found = rows.join(facts, F.col("set_key") == F.col("_k"), "left")
    return found.select("doc_id", "class_id", "n_links", *(("k1", "k2", "class_key") if keys else ()))

"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (after ``.``, ``!``, ``?`` and their like in other scripts, and at line ends).  A sentence
of more than LONG words is cut further, before the word of least hash in each WINDOW of
its words: such places depend on the words around them alone, so a passage is cut in the
same places wherever in a sentence it stands.  Only a word said over and over leaves no
such place; there pieces have PIECE words.  The pieces count as sentences.  From every sentence on, and up to every sentence, the shortest run
of SEVERAL or more sentences with LEAST or more words is hashed.  Hashes that occur
more than once in the corpus are repeated spans; the occurrence in the least id, at
the least place, is the first and stays.  Sentences that any other occurrence covers
are removed.

Because runs start at every sentence and end at every sentence, a repeated passage of
several sentences is covered from its first whole sentence to its last.  No piece has
more than LONG words, so any 50 words in a row that two texts share hold a hashed run,
wherever in their sentences they start and end (a word longer where one repeats the
word before it).

Null texts stay null, empty ones empty; white space belongs to the sentence after it.
Words are what white space separates, and each character of a script that is written without
spaces; they are compared in lower case.  Rows equal in id and text are one document and get one result;
different texts of one id, or of none, are kept apart by 128 bits of id and text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import map_texts, stored, text_keys

SEVERAL, LEAST = 2, 20
#: A passage of 50 words loses at most 2 * WINDOW - 1 or LONG - 1 words at either end, which leaves LEAST.
LONG, PIECE, WINDOW = 16, 20, 8
#: Marks that end a sentence before white space, and those of scripts that put none after them.
END = re.compile(r"[.!?؟۔։।॥።፧]+(?=\s)|[。！？．｡…།။។]+[」』”’）)]*|\n")
#: Letters of scripts that write words without spaces between them; each character counts as a word.
UNSPACED = "\u0e00-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u1950-\u19df\u1a20-\u1aad\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48c\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
DENSE = re.compile(f"[{UNSPACED}]")
WORD = re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")
#: A run has at most LEAST sentences, so its length fits these bits beside its first sentence.
RUN_BITS = 6
#: At most so many hashes that occur so often in a sample are dealt to so many groups each.
COMMON, OFTEN, SALTS = 10_000, 48, 1024
#: Odd factors of the two hashes of a run of sentence hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def split(text: str) -> list[str]:
    """The lower-case words of a part of a text."""
    if text.isascii() or not DENSE.search(text):
        return text.lower().split()
    return [m.lower() for m in WORD.findall(text)]


class Ranks(dict):
    """31-bit hashes of words, remembered; short words, which are common, rank behind the others."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = (xxhash.xxh32_intdigest(word) >> 2) | (len(word) < 4) << 30
        return h


RANKS = Ranks()


def cuts(parts: list[list[str]]) -> list[list[int]]:
    """For each list of words, of WINDOW or more, the places before which it is cut, 0 first.

    The leftmost least rank of every window is one, unless its word repeats the one before.
    A piece of more than LONG words, which only repeated words leave, is cut each PIECE words.
    """
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ranks = np.fromiter((RANKS[w] for words in parts for w in words), dtype=np.int64, count=int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(parts)), sizes)
    least, width = ranks << 32 | np.arange(len(ranks)), 1
    while width < WINDOW:
        shift = min(width, WINDOW - width)
        least, width = np.minimum(least[:-shift], least[shift:]), width + shift
    at = np.unique(least[of[: len(least)] == of[WINDOW - 1 :]] & 0xFFFFFFFF)
    at = at[ranks[at] != ranks[at - 1]]
    at = np.unique(np.concatenate([starts, at]))
    gaps = np.diff(np.append(at, len(ranks)))
    for i in np.flatnonzero(gaps > LONG):
        at = np.append(at, np.arange(at[i], at[i] + gaps[i], PIECE)[1:])
    at = np.sort(at)
    return [x.tolist() for x in np.split(at - starts[of[at]], np.searchsorted(at, starts[1:]))]


def parted(text: str) -> list[tuple[int, int, list[str], list[int]]]:
    """(start, end, lower-case words, places) of each sentence: what white space alone fills is none; ``places`` as in cuts."""
    out = []
    at = 0
    ends = [m.end() for m in END.finditer(text)]
    ends.append(len(text))
    for end in ends:
        if words := split(text[at:end]):
            out.append((at, end, words, [0]))
        at = end
    long = [i for i, x in enumerate(out) if len(x[2]) > LONG]
    for i, places in zip(long, cuts([out[i][2] for i in long]) if long else ()):
        out[i] = (*out[i][:3], places)
    return out


def pieces(text: str) -> list[list[str]]:
    """The words of each sentence or piece of one."""
    out = []
    for _, _, words, places in parted(text):
        out += (words[a:b] for a, b in zip(places, [*places[1:], len(words)]))
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence or piece of one."""
    out = []
    for start, end, _, places in parted(text):
        if len(places) > 1:
            where = [m.start() for m in WORD.finditer(text, start, end)]
            edges = [start, *(where[i] for i in places[1:]), end]
            out += zip(edges[:-1], edges[1:])
        else:
            out.append((start, end))
    return out


def runs(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (first, past the last) sentences of the shortest runs from and up to each sentence, in order."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    at = np.arange(n + 1)
    first = np.minimum(np.searchsorted(total, total - LEAST, side="right") - 1, at - SEVERAL)  # the latest start of a run up to here
    last = np.maximum(np.searchsorted(total, total + LEAST, side="left"), at + SEVERAL)  # the earliest end of a run from here
    up, on = first >= 0, last <= n
    pairs = np.unique(np.concatenate([first[up] * (n + 1) + at[up], at[on] * (n + 1) + last[on]]))
    return pairs // (n + 1), pairs % (n + 1)


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as asked for."""

    def __init__(self, factor: int):
        self.factor, self.inverse = factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1024)
            self.up, self.down = (np.full(size, f, dtype=np.uint64) for f in (self.factor, self.inverse))
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)
        return self.up[:n], self.down[:n]


def run_hash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each run's sentence hashes, in order."""
    up, down = powers.to(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[1:], dtype=np.uint64)])
    mixed = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(FACTORS[1])


def _hashed(docs: DataFrame, text: Column, *ids: Column) -> DataFrame:
    """(ids, h, x, n): each run's 64-bit hash, 32 check bits above its first sentence and length, and the number of sentences."""
    longs = T.ArrayType(T.LongType())
    added = T.StructType([T.StructField("h", longs), T.StructField("x", longs), T.StructField("n", T.LongType())])

    def make():
        powers = [Powers(f) for f in FACTORS]

        def call(part: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {"h": [], "x": [], "n": []}
            for text in part.column(part.num_columns - 1).to_pylist():
                words = pieces(text) if text else []
                out["n"].append(len(words))
                a, b = runs(list(map(len, words)))
                if not len(a):
                    out["h"].append([])
                    out["x"].append([])
                    continue
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(w)) for w in words), dtype=np.uint64, count=len(words))
                h, check = (run_hash(hashes, a, b, p) for p in powers)
                place = (a.astype(np.uint64) << np.uint64(RUN_BITS)) | (b - a).astype(np.uint64)
                out["h"].append(h.view(np.int64))
                out["x"].append(((check & np.uint64(0xFFFFFFFF00000000)) | place).view(np.int64))
            return out

        return call

    return map_texts(docs, [*ids, text.alias("_text")], make, added, len(ids))


def common_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_h): at most COMMON hashes that a sixteenth of the documents hold most often, OFTEN or more times.

    They only say how rows are dealt out; what is found doesn't depend on them, as
    each of them is known to stand in several places.
    """
    some = docs.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(16)) == 0)
    each = _hashed(some, F.col(text_col), F.col(id_col).alias("doc_id")).select(F.explode("h").alias("_h"))
    counts = each.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    return stored(counts.orderBy(F.col("n").desc(), "_h").limit(COMMON).select("_h"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, n_sentences, drop): each document by its text_keys, with its number of sentences and the runs to remove.

    One shuffle by hash picks the spans whose hash stands in several places; those of
    hashes that are known to be common already are dealt to many tasks instead.  A row
    without a hash carries a document's number of sentences through it.  These rows
    are stored, since a second use would hash all texts again, and spans are brought
    together with their first occurrence by sums with partial sums before their shuffle
    and by a join with unique keys on one side, so a passage that many documents share can
    be split there.
    """
    common = F.broadcast(common_hashes(docs, id_col, text_col))
    spans = _hashed(docs, F.col(text_col), F.col(id_col).alias("doc_id"), *text_keys(id_col, text_col))
    counted = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.col("n").alias("x")))
    each = spans.select("doc_id", "k1", "k2", F.explode(F.concat(F.arrays_zip("h", "x"), counted)).alias("s")).select("doc_id", "k1", "k2", "s.h", "s.x")
    each = each.join(common, F.col("h") == F.col("_h"), "left")
    dealt = F.when(F.col("h").isNull(), F.col("k1")).when(F.col("_h").isNotNull(), F.pmod(F.xxhash64("k1", "x"), F.lit(SALTS))).otherwise(0)
    each = each.withColumn("salt", dealt)
    each = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h", "salt"))).filter("n > 1 or _h is not null or h is null")
    key = F.when(F.col("h").isNotNull(), F.struct("h", F.shiftright("x", 32).alias("c"))).alias("k")
    each = stored(each.select("doc_id", "k1", "k2", key, F.col("x").bitwiseAND(0xFFFFFFFF).alias("p")))
    place = F.struct("doc_id", "k1", "k2", "p")
    found = each.filter("k is not null")
    first = found.groupBy("k").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # stored, so that the join's sides are plain shuffles and the tasks of a common span can be split
    first = stored(first.select(F.col("k").alias("_k"), "first"))
    later = found.join(first, F.col("k") == F.col("_k")).filter(~place.eqNullSafe(F.col("first")))
    nothing = F.lit(None).cast("bigint")
    rows = later.select("k1", "k2", nothing.alias("n"), "p").unionByName(each.filter("k is null").select("k1", "k2", F.col("p").alias("n"), nothing.alias("p")))
    return rows.groupBy("k1", "k2").agg(F.max("n").alias("n_sentences"), F.collect_set("p").alias("drop"))


REMOVED = T.StructType(
    [
        T.StructField("n_removed", T.LongType()),
        T.StructField("words_removed", T.LongType()),
        T.StructField("removed", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def without(text: str | None, drop: list[int]) -> tuple[int, int, str, str | None]:
    """The columns of REMOVED for a text; ``removed`` lists code point ranges start:end."""
    gone = {i for p in drop for i in range(p >> RUN_BITS, (p >> RUN_BITS) + (p & ((1 << RUN_BITS) - 1)))}
    if not gone:
        return 0, 0, "", text
    found = sentences(text) if text else []
    edges = [s for s, _ in found] + [len(text)]
    kept = [text[: edges[0]]] + [text[edges[i] : edges[i + 1]] for i in range(len(found)) if i not in gone]
    ranges: list[list[int]] = []
    for i in sorted(gone):
        if ranges and ranges[-1][1] == edges[i]:
            ranges[-1][1] = edges[i + 1]
        else:
            ranges.append([edges[i], edges[i + 1]])
    words = sum(len(split(text[edges[i] : edges[i + 1]])) for i in gone)
    return len(gone), words, ",".join(f"{a}:{b}" for a, b in ranges), "".join(kept).strip()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, columns of REMOVED): one row for each row of ``docs``, its text without the repeated sentences."""
    gone = repeated(docs, id_col, text_col).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "n_sentences", "drop")
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_keys(id_col, text_col), F.col(text_col).alias("text"))
    rows = rows.join(gone, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")

    def make():
        def call(part: pa.RecordBatch) -> dict[str, list]:
            drops, texts = (part.column(i).to_pylist() for i in (2, 3))
            found = [without(t, d or []) for t, d in zip(texts, drops)]
            return {f.name: [x[k] for x in found] for k, f in enumerate(REMOVED.fields)}

        return call

    return map_texts(rows, [F.col(c) for c in ("doc_id", "n_sentences", "drop", "text")], make, REMOVED, 2)

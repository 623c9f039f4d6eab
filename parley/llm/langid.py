"""Language identification of mixed text.

Each word gets a score for each language from hashed letter trigrams; the scripts
of its letters narrow the candidates; a Viterbi pass with a penalty for switching
labels the spans of a text.  All texts of a batch take each Viterbi step together.

A text that is null or has no letters has no spans and the language ``und``.
Digits and symbols belong to no word, and marks only to that of a letter before them.
Offsets count code points.  Of languages with equally many letters the first by name
wins.  Repeated rows each get their result.  A very long text is one row of a batch:
memory grows with it, by some hundred bytes a word.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import FIT_BYTES, held_to, map_texts

BITS = 16
#: First and last code point of scripts; what none of them holds is script 0.
SCRIPTS = [
    (0x0041, 0x024F), (0x1E00, 0x1EFF), (0x0370, 0x03FF), (0x1F00, 0x1FFF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x077F),
    (0x0900, 0x097F), (0x0980, 0x09FF), (0x0B80, 0x0BFF), (0x0E00, 0x0E7F), (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x3040, 0x30FF), (0x3400, 0x9FFF),
    (0xAC00, 0xD7AF), (0x20000, 0x3FFFF),
]
#: Ranges that are one script.
SAME = {2: 1, 4: 3, 14: 17, 18: 16}
_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or the mark or 0, the script, and whether it is a mark."""
    if not _TABLES:
        letter, mark = np.zeros(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                low = chr(c).lower()
                letter[c] = ord(low) if len(low) == 1 else c
            elif kind in ("Mn", "Mc"):
                letter[c], mark[c] = c, True
        script = np.zeros(0x110000, dtype=np.uint8)
        for i, (a, b) in enumerate(SCRIPTS, 1):
            script[a : b + 1] = SAME.get(i, i)
        _TABLES[:] = [letter, script, mark]
    return _TABLES[0], _TABLES[1], _TABLES[2]


@dataclass
class Words:
    """The words of texts laid end to end: their start and end in ``codes``, the text they belong to, their script."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    letters_from: np.ndarray
    offsets: np.ndarray


def split(texts: list[str | None]) -> Words:
    letter, script, marks = tables()
    joined = "\0".join(["", *(t or "" for t in texts), ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = letter[codes]
    inside = low > 0
    # a mark belongs to the word that a letter began; marks without a letter are none
    mark = marks[codes]
    if mark.any():
        at = np.arange(len(codes))
        began = np.maximum.accumulate(np.where(inside & ~mark, at, -1))  # the last letter up to here
        broken = np.maximum.accumulate(np.where(~inside, at, -1))  # the last place up to here that is in no word
        inside &= began > broken
        low = np.where(inside, low, 0)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
    offsets = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    at = np.flatnonzero(inside)
    mix = low[at - 1] * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + low[at + 1] * np.uint32(0xC2B2AE3D)
    mix ^= mix >> np.uint32(15)
    mix *= np.uint32(0x2C1B3C6D)
    grams = (mix >> np.uint32(32 - BITS)).astype(np.int32)
    return Words(start, end, np.searchsorted(offsets, start, side="right") - 1, script[codes[start]], grams, np.concatenate([[0], np.cumsum(end - start)]), offsets)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (languages, 2**BITS) of log probabilities
    scripts: np.ndarray  # (scripts, languages): may the language be written so

    def emissions(self, words: Words) -> np.ndarray:
        out = np.empty((len(words.start), len(self.langs)), dtype=np.float32)
        if len(out):
            for i in range(len(self.langs)):
                out[:, i] = np.add.reduceat(self.table[i][words.grams], words.letters_from[:-1])
            allowed = self.scripts[words.script]
            out[(~allowed) & allowed.any(axis=1)[:, None]] -= 1e4
        return out


def fit(texts: list[str], langs: list[str], smooth: float = 0.5) -> Model:
    names = sorted(set(langs))
    counts = np.zeros((len(names), 1 << BITS))
    scripts = np.zeros((256, len(names)), dtype=bool)
    for i, name in enumerate(names):
        words = split([t for t, x in zip(texts, langs) if x == name])
        counts[i] = np.bincount(words.grams, minlength=1 << BITS)
        use = np.bincount(words.script, minlength=256)
        scripts[:, i] = use > 0.001 * max(1, use.sum())
    table = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * (1 << BITS)))
    return Model(names, table.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, first: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word, where a switch between words of one text costs ``penalty``."""
    path = np.zeros(len(scores), dtype=np.int16)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return path
    first, sizes = first[order], sizes[order]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t words
    stay = np.ones(scores.shape, dtype=bool)
    source = np.zeros(len(scores), dtype=np.int16)
    v = scores[first].copy()
    for t in range(1, longest):
        n = active[t]
        rows = first[:n] + t
        old = v[:n]
        best = old.argmax(axis=1)
        jump = old[np.arange(n), best] - penalty
        kept = old >= jump[:, None]
        stay[rows], source[rows] = kept, best
        v[:n] = np.where(kept, old, jump[:, None]) + scores[rows]
    state = v.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        rows = first[:n] + t
        path[rows] = state[:n]
        state[:n] = np.where(stay[rows, state[:n]], state[:n], source[rows])
    return path


FOUND = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])),
        ),
    ]
)


def label(texts: list[str | None], model: Model, penalty: float, spans: bool = True) -> dict[str, list]:
    words = split(texts)
    n = len(texts)
    first = np.searchsorted(words.text, np.arange(n), side="left")
    sizes = np.bincount(words.text, minlength=n) if len(words.text) else np.zeros(n, dtype=np.int64)
    path = viterbi(model.emissions(words), first, sizes, penalty) if model.langs else np.zeros(0, dtype=np.int16)
    if not model.langs:
        sizes = np.zeros(n, dtype=np.int64)
    weight = np.zeros((n, max(1, len(model.langs))))
    if len(path):
        np.add.at(weight, (words.text, path), words.end - words.start)
    out: dict[str, list] = {"lang_pred": [], "score": [], "spans": []}
    for i in range(n):
        if not sizes[i]:
            out["lang_pred"].append("und")
            out["score"].append(0.0)
            out["spans"].append([])
            continue
        k = int(weight[i].argmax())
        out["lang_pred"].append(model.langs[k])
        out["score"].append(float(weight[i, k] / weight[i].sum()))
        a, b = first[i], first[i] + sizes[i]
        if not spans:
            out["spans"].append(None)
            continue
        cuts = np.concatenate([[a], a + 1 + np.flatnonzero(path[a + 1 : b] != path[a : b - 1]), [b]])
        out["spans"].append(
            [
                {"start": int(words.start[s] - words.offsets[i]), "end": int(words.end[e - 1] - words.offsets[i]), "lang": model.langs[path[s]]}
                for s, e in zip(cuts[:-1], cuts[1:])
            ]
        )
    return out


def identify(docs: DataFrame, text: Column, *ids: Column, model: Model, penalty: float = 8.0, spans: bool = True) -> DataFrame:
    """(ids, lang_pred, score, spans): the language with most letters, its share of the letters, and the labelled spans.

    ``penalty`` is the cost, in log probability, of a change of language between two
    words.  ``spans=False`` leaves that column out.
    """
    added = T.StructType([f for f in FOUND.fields if spans or f.name != "spans"])

    def make():
        return lambda part: label(part.column(part.num_columns - 1).to_pylist(), model, penalty, spans)

    return map_texts(docs, [*ids, text.alias("_text")], make, added, len(ids))


def sample(
    docs: DataFrame, train: Column, per_lang: int, most: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> list[tuple[str, str]]:
    """About ``per_lang`` (text, language) rows of each language, those with the lowest hash of the id, and ``most`` bytes of text in all.

    A count of every language's rows over the whole table sets the hash bound;
    never more than twice as many rows as asked for reach the driver.  An id counts
    once for each of its languages, with its least text.
    """
    rows = docs.filter(train & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_lang"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    span = 1 << 30
    bound = F.lit(0)
    for lang, n in sorted(counts.items()):
        bound = F.when(F.col("_lang") == lang, F.lit(-(-span * per_lang // n))).otherwise(bound)
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(span))).filter(F.col("_h") < bound)
    chosen = rows.groupBy("_h", "_id", "_lang").agg(F.min("_t").alias("_t")).orderBy("_h", "_id", "_lang").limit(2 * per_lang * len(counts))
    chosen = held_to(chosen, F.lit(0), ["_h", "_id", "_lang"], "_t", most).collect()
    return [(r["_t"], r["_lang"]) for r in sorted(chosen, key=lambda r: (r["_id"], r["_t"], r["_lang"]))]

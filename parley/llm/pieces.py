"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read here; from it come the normaliser (compiled map,
spaces), the metaspace marker, the vocabulary with its scores (as unigram scores, or
as the order of merges of a BPE model) and byte fallback.  Texts are cut where the
marker follows something else, if no piece of the vocabulary spans such a place, and
each distinct cut is encoded and decoded once by multithreaded batch calls.  Each is also encoded
by the sentencepiece library itself; ``parity`` says whether the two agree.

A null text has null ids; an empty one has none.  The marker's own character in a
text decodes to a space, as in the sentencepiece library.  Repeated rows each get
their result, and equal texts equal ids.  A worker keeps one codec, whose memory is
bounded in bytes; a very long text is held whole, but no other beside it.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import map_texts

MARK = "▁"
#: Types of pieces in a model file, and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: At most so many bytes of model are sent to the executors; about so many are remembered by a worker for known cuts.
MODEL_BYTES = 64 << 20
REMEMBERED = 40 << 20
#: Bytes of a known cut besides its characters (two bytes each) and ids (four bytes each): objects and their place in a dict.
OVERHEAD = 200
#: Bytes of text that are encoded at once: their cuts take some sixteen times that.
AT_ONCE = 1 << 20


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values come as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
        if size is None or at + size > len(data):
            raise ValueError("not a SentencePiece model file")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Parsed:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def cuttable(self) -> bool:
        """Can a text be cut before every marker that follows something else?"""
        return self.escape and not any(MARK in p.lstrip(MARK) for p, *_ in self.pieces)


def parse(data: bytes) -> Parsed:
    out = Parsed()
    for number, value in wire(data):
        if number == 1:
            piece = dict(wire(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            out.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(wire(value))
            out.kind, out.byte_fallback, out.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(wire(value))
            out.charsmap, out.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
            out.squeeze, out.escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
    if out.kind not in (UNIGRAM, BPE) or out.suffix or any(p[2] == USER for p in out.pieces):
        raise ValueError("only unigram and BPE models without user-defined symbols and with the marker before words are supported")
    return out


def merges(parsed: Parsed) -> list[tuple[str, str]]:
    """The pairs that make up the pieces, best score first: the order in which they are merged."""
    known = {p for p, _, t in parsed.pieces if t == NORMAL}
    found = []
    for i, (piece, score, kind) in enumerate(parsed.pieces):
        if kind == NORMAL:
            found += [(-score, i, k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
    return [(a, b) for *_, a, b in sorted(found)]


def backend(parsed: Parsed):
    """A tokenizers.Tokenizer with the model's normaliser, scores and decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if parsed.kind == BPE:
        vocabulary = {p: i for i, (p, *_) in enumerate(parsed.pieces)}
        model = models.BPE(vocabulary, merges(parsed), unk_token=parsed.pieces[parsed.unknown][0], fuse_unk=True, byte_fallback=parsed.byte_fallback)
    else:
        model = models.Unigram([(p, s) for p, s, _ in parsed.pieces], parsed.unknown, parsed.byte_fallback)
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(parsed.charsmap)] if parsed.charsmap else []
    if parsed.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if parsed.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if parsed.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


class Codec:
    """Encodes and decodes texts; remembers cuts."""

    CUT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import Tokenizer

        self.parsed, self.threads = parse(data), threads
        p = self.parsed
        self.cuttable = p.cuttable
        #: Are the cuts of a text with single spaces just its words?
        self.wordy = self.cuttable and p.dummy_prefix and not p.charsmap and not p.squeeze
        self.full = backend(self.parsed)
        #: The same model without the normaliser: cuts are normal already.
        self.model = Tokenizer(self.full.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.control = {i for i, p in enumerate(self.parsed.pieces) if p[2] == CONTROL}
        self.known: dict[str, bytes] = {}
        self.held = 0
        #: Known cuts on which the libraries differ, and those that decoding doesn't give back.
        self.apart: set[str] = set()
        self.lossy: set[str] = set()

    def normal(self, text: str) -> str:
        """The text as the model sees it."""
        p = self.parsed
        if p.charsmap or p.squeeze:
            return self.full.normalizer.normalize_str(text) if text else ""
        if text and p.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if p.escape else text

    def cuts(self, text: str) -> tuple[list[str], str | None]:
        """The cuts of a text, and the text as the model sees it or None where the cuts are just its words.

        A word stands for the cut with a marker before it; any other cut begins with its marker.
        """
        if self.wordy:
            words = text.split(" ")
            if "" not in words and MARK not in text:
                return words, None
        normal = self.normal(text)
        return (self.CUT.findall(normal) if self.cuttable else [normal] if normal else []), normal

    def learn(self, cuts: list[str]) -> None:
        """Encode cuts that aren't known by both libraries, and decode them."""
        words = [c for c in cuts if c[0] != MARK] if self.wordy else []
        others = [c for c in cuts if c[0] == MARK] if self.wordy else cuts
        whole = [MARK + c for c in words]
        plain = [" " + c for c in words]
        # the sentencepiece library normalises itself and puts the marker before a text, so not every cut can be asked for
        asked = words
        if self.parsed.dummy_prefix:
            mark = MARK if self.parsed.escape else " "
            alone = [c for c in others if len(c) == 1 or c[0] != mark]
            others = [c for c in others if len(c) > 1 and c[0] == mark]
            asked = asked + [c[1:].replace(MARK, " ") for c in others]
        else:
            alone = []
            asked = [c.replace(MARK, " ") for c in others]
        theirs = self.reference.encode(asked, num_threads=self.threads) + [[self.reference.piece_to_id(c)] for c in alone]
        others += alone
        found = [e.ids for e in self.model.encode_batch_fast(whole + others, add_special_tokens=False)]
        cuts = words + others
        self.known.update(zip(cuts, [array("i", ids).tobytes() for ids in found]))
        self.held += OVERHEAD * len(cuts) + 2 * sum(map(len, cuts)) + 4 * sum(map(len, found))
        if found != theirs:
            self.apart.update(c for c, x, y in zip(cuts, found, theirs) if x != y)
        back, plain = self.texts(found), plain + [c.replace(MARK, " ") for c in others]
        if back != plain:
            self.lossy.update(c for c, x, y in zip(cuts, back, plain) if x != y)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """For each text its ids as little-endian 32-bit integers, whether both libraries agree, and whether decoding gives it back."""
        cut = list(map(self.cuts, texts))
        here = set().union(*(cs for cs, _ in cut))
        if self.held > REMEMBERED:
            self.known = {c: code for c, code in self.known.items() if c in here}
            self.held = sum(OVERHEAD + 2 * len(c) + len(code) for c, code in self.known.items())
            self.apart &= here
            self.lossy &= here
        new = list(here.difference(self.known))
        if new:
            self.learn(new)
        look = self.known.__getitem__
        out = []
        for text, (cs, normal) in zip(texts, cut):
            ids = b"".join(map(look, cs))
            if self.lossy and not self.lossy.isdisjoint(cs):
                back = self.decode(ids) == text
            else:  # where every cut is given back, the whole is: markers stand before cuts only
                back = normal is None or self.unmarked(normal.replace(MARK, " ")) == text
            out.append((ids, not self.apart or self.apart.isdisjoint(cs), back))
        return out

    def unmarked(self, text: str) -> str:
        return text[1:] if self.parsed.dummy_prefix and text[:1] == " " else text

    def texts(self, ids: list[list[int]]) -> list[str]:
        """What the library decodes ids to, the marker before the text included; control pieces have no text."""
        if not self.control.isdisjoint(chain.from_iterable(ids)):
            ids = [[i for i in x if i not in self.control] for x in ids]
        return self.full.decode_batch(ids, skip_special_tokens=False)

    def decode(self, ids: bytes) -> str:
        return self.unmarked(self.texts([np.frombuffer(ids, dtype="<i4").tolist()])[0])


_CODECS: dict[tuple[str, int], Codec] = {}


def codec_for(data: bytes, threads: int) -> Codec:
    """The worker's codec of a model: made once in each process, the last one kept."""
    key = (hashlib.sha256(data).hexdigest(), threads)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


CODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
        T.StructField("parity", T.BooleanType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
)


def _sent(docs: DataFrame, model_path: str):
    """The model file, read by the driver and broadcast, at most MODEL_BYTES."""
    with open(model_path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"the model has more than {MODEL_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(data)


def encode(docs: DataFrame, text: Column, *ids: Column, model_path: str, threads: int = 2, keep: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(ids, columns of CODED): the token ids of each whole text, and what decoding them gives.

    ``keep`` names which of the large columns ``ids`` and ``decoded`` are returned.
    ``ids_sha256`` is over the ids as little-endian 32-bit integers; ``round_trip``
    says whether the decoded text is the text.
    """
    sent = _sent(docs, model_path)
    added = T.StructType([f for f in CODED.fields if f.name not in ("ids", "decoded") or f.name in keep])

    def make():
        codec = codec_for(sent.value, threads)

        def call(part: pa.RecordBatch) -> dict[str, list]:
            texts = part.column(part.num_columns - 1).to_pylist()
            coded = codec.encode([t or "" for t in texts])
            out: dict[str, list] = {f.name: [] for f in CODED.fields}
            for text, (codes, same, back) in zip(texts, coded):
                values = (len(codes) // 4, hashlib.sha256(codes).hexdigest(), back, same, np.frombuffer(codes, dtype="<i4") if "ids" in keep else None, codec.decode(codes) if "decoded" in keep else None)
                for f, v in zip(CODED.fields, values):
                    out[f.name].append(v if text is not None else None)
            return out

        return call

    return map_texts(docs, [*ids, text.alias("_text")], make, added, len(ids), AT_ONCE)


def decode(coded: DataFrame, tokens: Column, *ids: Column, model_path: str, threads: int = 2) -> DataFrame:
    """(ids, text): the text of each row's token ids; null for null ids or an id that the model doesn't have."""
    sent = _sent(coded, model_path)
    packed = F.array_join(tokens, " ")

    def make():
        codec = codec_for(sent.value, threads)
        n = len(codec.parsed.pieces)

        def call(part: pa.RecordBatch) -> dict[str, list]:
            rows = [None if t is None else list(map(int, t.split())) for t in part.column(part.num_columns - 1).to_pylist()]
            rows = [x if x is not None and all(0 <= i < n for i in x) else None for x in rows]
            found = iter(codec.texts([x for x in rows if x is not None]))
            return {"text": [None if x is None else codec.unmarked(next(found)) for x in rows]}

        return call

    return map_texts(coded, [*ids, packed.alias("_ids")], make, T.StructType([T.StructField("text", T.StringType())]), len(ids), AT_ONCE)

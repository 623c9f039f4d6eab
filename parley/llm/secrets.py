"""Secret scans: fixed patterns, and strings that a tokenizer can't compress.

A string of random characters needs about one token for every one or two
characters under a byte-level BPE vocabulary, prose one for four.  Beside the fixed
patterns a scan therefore takes long strings of key-like characters and keeps those
with few characters a token, after excluding what is random by nature but no
secret: digests, UUIDs and other hexadecimal or decimal identifiers, and names made
of words.

Nulls and empty texts have no spans.  Offsets count code points, ends are exclusive.
Repeated rows each get their result; spans that start together follow one another by
kind.  A very long text is scanned in time that grows with its length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from parley.llm.common import map_texts

#: Kinds in their order, their patterns, and the least length of what counts.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "api")

#: Strings of 20 or more key-like characters.
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
NOT_SECRET = re.compile(
    r"(?:[0-9a-fA-F]+|[0-9+/_=-]+|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|(?:sha(?:1|256|384|512)|md5)[-_][0-9A-Za-z+/=]+)"
)
#: Names made of words, if their words are words.
NAME = re.compile(r"(?:[A-Za-z]{3,}|[0-9]{1,4})(?:[_/+=-]+(?:[A-Za-z]{2,}[0-9]{0,2}|[0-9]{1,4}|[a-z]))+[_/=-]*|[A-Za-z+/_=-]+")
LETTERS = re.compile(r"[A-Za-z]+")

#: At most so many bytes of vocabulary are sent to the executors.
VOCABULARY_BYTES = 16 << 20
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(vocabulary: bytes):
    """A tiktoken encoding of a file of ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in the order start, kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def named(text: str, encode, least_ratio: float) -> bool:
    """Whether a string is a name of words: the letters of its words are no denser than prose; one letter alone is a word."""
    if not NAME.fullmatch(text):
        return False
    words = LETTERS.findall(text)
    return sum(map(len, words)) >= least_ratio * sum(len(encode(w)) for w in words if len(w) > 1)


def dense_spans(text: str, encode, least_ratio: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings with fewer than ``least_ratio`` characters a token that no other span covers."""
    out = []
    # of the spans that start before a place, the one that ends last says whether any reaches beyond it
    starts = [a for _, a, _ in sorted(taken, key=lambda x: x[1])]
    reach = list(accumulate((b for _, _, b in sorted(taken, key=lambda x: x[1])), max))
    for m in LONG.finditer(text):
        s, e = m.span()
        before = bisect_left(starts, e)
        if NOT_SECRET.fullmatch(m[0]) or before and reach[before - 1] > s:
            continue
        if len(m[0]) < least_ratio * len(encode(m[0])) and not named(m[0], encode, least_ratio):
            out.append((3, s, e))
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


FOUND = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("n_token", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("masked", T.StringType()),
    ]
)


def scan(docs: DataFrame, text: Column, *ids: Column, vocabulary_path: str, ratio: float = 2.0, mask: str | None = None) -> DataFrame:
    """(ids, columns of FOUND): the spans of each text and, if ``mask`` is given, the text with each span replaced.

    ``vocabulary_path``: a file of tiktoken ranks that the driver reads and sends.
    ``ratio``: characters a token below which a string counts as random.
    Overlapping spans are masked as one.  A null text stays null when masked.
    """
    with open(vocabulary_path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {VOCABULARY_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    added = T.StructType([f for f in FOUND.fields if f.name != "masked" or mask is not None])

    def make():
        encoder: list = []

        def encode(s: str) -> list[int]:
            if not encoder:
                encoder.append(encoding(sent.value))
            return encoder[0].encode_ordinary(s)

        def call(part: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in FOUND.fields}
            for text in part.column(part.num_columns - 1).to_pylist():
                base = base_spans(text) if text else []
                spans = base + dense_spans(text, encode, ratio, base) if text else []
                spans.sort(key=lambda s: (s[1], s[0]))
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(s[0] == k for s in spans))
                out["base_sha256"].append(hashlib.sha256(render(base).encode()).hexdigest())
                out["spans"].append(render(spans))
                if mask is not None:
                    out["masked"].append(masked(text, spans, mask))
            return out

        return call

    return map_texts(docs, [*ids, text.alias("_text")], make, added, len(ids))


def masked(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for _, s, e in spans:
        if s >= at:
            parts += [text[at:s], mask]
        at = max(at, e)
    return "".join([*parts, text[at:]])

"""Telephony audio in media columns: G.711 and IMA ADPCM in WAVE containers.

``store`` puts raw codes into a WAVE container without loss.  ``decode`` reads
stored containers back, expands mu-law and A-law by lookup tables, decodes ADPCM
blocks with one numpy step a sample position across all blocks of a batch, and
resamples 8 kHz to 16 kHz PCM.

Nulls: a null payload is stored as null and decoded as null columns.  A container
that is no readable WAVE of these codecs gets a null codec and null PCM; nothing
raises.  Equal payloads give equal media and equal features; repeated rows each get
their result.  A very long recording is decoded in slices of its own, its PCM held whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import map_texts

RATE = 8000
#: Bytes of a block: the unit to which payloads are padded, and an ADPCM block.
BLOCK = 192
#: WAVE format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")
#: Bytes of codes that are decoded at once: PCM and sums take some forty times that.
AT_ONCE = 1 << 20

#: The step sizes and index changes of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
INDEX_CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """The 256 linear values of G.711 mu-law codes."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 linear values of G.711 A-law codes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each (index, nibble), as index * 16 + nibble: the change of the sample, and the next index * 16."""
    step, nibble = np.array(STEPS, dtype=np.int32)[:, None], np.arange(16, dtype=np.int32)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    change = np.where(nibble & 8, -size, size)
    index = np.clip(np.arange(len(STEPS))[:, None] + np.array(INDEX_CHANGES)[nibble & 7], 0, len(STEPS) - 1)
    return change.astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) of mono IMA blocks to (n, samples) int16; every step covers all blocks."""
    change, after = adpcm_tables()
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    sample = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = sample
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for row, nibble in ((2 * k + 1, codes[k] & 15), (2 * k + 2, codes[k] >> 4)):
            at += nibble
            sample += change[at]
            np.clip(sample, -32768, 32767, out=sample)
            at = after[at]
            out[row] = sample
    return np.ascontiguousarray(out.T)


def resample_taps(half: int = 4) -> np.ndarray:
    """Fixed-point taps (sum 2**14) of a Hann-windowed sinc for the samples halfway between two."""
    at = np.arange(-half + 0.5, half)
    taps = np.sinc(at) * (0.5 + 0.5 * np.cos(np.pi * at / half))
    taps = np.round(taps / taps.sum() * 16384).astype(np.int64)
    taps[half] += 16384 - taps.sum()
    return taps


def upsample(pcm: np.ndarray, lengths: np.ndarray, half: int = 4) -> np.ndarray:
    """Double the rate of recordings laid end to end; beyond its ends a recording is silent."""
    if not len(pcm):
        return np.zeros(0, dtype=np.int16)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(pcm)) + owner * half
    wide = np.zeros(len(pcm) + half * (len(lengths) + 1), dtype=np.int32)
    wide[place + half] = pcm
    between = np.zeros(len(pcm), dtype=np.int64)
    for k, tap in enumerate(resample_taps(half)):
        between += tap * wide[place + k + 1]
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(between >> 14, -32768, 32767)
    assert ends[-1] == len(pcm)
    return out


def wave(codes: bytes, codec: str, rate: int = RATE) -> bytes:
    """A RIFF/WAVE container of raw codes."""
    tag = TAGS[codec]
    if codec == "adpcm":
        per_block = 1 + 2 * (BLOCK - 4)
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    odd = b"\0" * (len(codes) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(codes)) + codes + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(media: bytes) -> tuple[str, int, bytes] | None:
    """(codec, block bytes, codes) of a container, or None."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec, block = 12, None, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            tag, channels, _, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            codec = next((c for c, t in TAGS.items() if t == tag and channels == 1), None)
        elif name == b"data":
            codes = media[at + 8 : at + 8 + size]
            if codec is None or len(codes) < size or codec == "adpcm" and (block < 5 or size % block):
                return None
            return codec, block, codes
        at += 8 + size + (size & 1)
    return None


def padded(data: bytes, unit: int = BLOCK) -> bytes:
    return data + b" " * (-len(data) % unit or (0 if data else unit))


def store(df: DataFrame, payload: Column, *ids: Column, codec: str | None = None) -> DataFrame:
    """(ids, n_bytes, media): each payload padded with spaces to whole blocks and stored as codes.

    ``codec`` None chooses one of the three by the padded payload's crc32, so that
    equal payloads have equal media.
    """
    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def make():
        def call(part: pa.RecordBatch) -> dict[str, list]:
            sizes, media = [], []
            for data in part.column(part.num_columns - 1).to_pylist():
                if data is None:
                    sizes.append(None)
                    media.append(None)
                    continue
                sizes.append(len(data))
                data = padded(data)
                media.append(wave(data, codec or CODECS[zlib.crc32(data) % 3]))
            return {"n_bytes": sizes, "media": media}

        return call

    return map_texts(df, [*ids, payload.alias("_payload")], make, added, len(ids), AT_ONCE)


DECODED = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("peak", T.LongType()),
        T.StructField("energy", T.LongType()),
        T.StructField("crossings", T.LongType()),
        T.StructField("pcm_crc32", T.LongType()),
        T.StructField("pcm", T.BinaryType()),
    ]
)


def decode(df: DataFrame, media: Column, *ids: Column, keep: tuple[str, ...] = ("pcm",)) -> DataFrame:
    """(ids, columns of DECODED): read stored containers back and decode them to 16 kHz 16-bit PCM.

    ``keep`` names which of the two large columns, ``codes`` and ``pcm``, are
    returned; the digests and features are always there.  ``energy`` is the sum of
    squares, ``crossings`` the number of sign changes of the resampled PCM.
    """
    added = T.StructType([f for f in DECODED.fields if f.name not in ("codes", "pcm") or f.name in keep])

    def make():
        tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}

        def call(part: pa.RecordBatch) -> dict[str, list]:
            media = part.column(part.num_columns - 1).to_pylist()
            read = [unwave(m) if m is not None else None for m in media]
            pcm: list[np.ndarray] = [np.zeros(0, dtype=np.int16)] * len(read)
            groups: dict[int, list[int]] = {}
            for i, r in enumerate(read):
                if r and r[0] == "adpcm":
                    groups.setdefault(r[1], []).append(i)
                elif r:
                    pcm[i] = tables[r[0]][np.frombuffer(r[2], dtype=np.uint8)]
            for block, rows in groups.items():
                blocks = np.frombuffer(b"".join(read[i][2] for i in rows), dtype=np.uint8).reshape(-1, block)
                samples, at = decode_adpcm(blocks), 0
                for i in rows:
                    n = len(read[i][2]) // block
                    pcm[i] = samples[at : at + n].ravel()
                    at += n
            lengths = np.array([len(p) for p in pcm], dtype=np.int64)
            wide = upsample(np.concatenate(pcm), lengths) if len(pcm) else np.zeros(0, dtype=np.int16)
            starts = np.concatenate([[0], np.cumsum(2 * lengths)])
            out: dict[str, list] = {f.name: [] for f in DECODED.fields}
            for i, r in enumerate(read):
                m = media[i]
                out["media_bytes"].append(None if m is None else len(m))
                out["media_sha256"].append(None if m is None else hashlib.sha256(m).hexdigest())
                if r is None:
                    for name in ("codec", "codes", "payload_bytes", "payload_sha256", "tail_crc32", "n_samples", "peak", "energy", "crossings", "pcm_crc32", "pcm"):
                        out[name].append(None)
                    continue
                mine = wide[starts[i] : starts[i + 1]]
                loud = mine.astype(np.int64)
                raw = mine.astype("<i2", copy=False).tobytes()
                values = (r[0], r[2], len(r[2]), hashlib.sha256(r[2]).hexdigest(), zlib.crc32(r[2][-16:]), len(mine), int(np.abs(loud).max(initial=0)), int((loud * loud).sum()), int(np.count_nonzero((mine[1:] < 0) != (mine[:-1] < 0))), zlib.crc32(raw), raw)
                for name, v in zip(("codec", "codes", "payload_bytes", "payload_sha256", "tail_crc32", "n_samples", "peak", "energy", "crossings", "pcm_crc32", "pcm"), values):
                    out[name].append(v)
            return out

        return call

    return map_texts(df, [*ids, media.alias("_media")], make, added, len(ids), AT_ONCE)


def features(decoded: DataFrame) -> Column:
    """One line of the features of a decoded recording."""
    return F.concat_ws(":", *(decoded[c].cast("string") for c in ("codec", "n_samples", "peak", "energy", "crossings", "pcm_crc32")))

"""Functions of texts, as Column expressions unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Invisible and text-reordering code points.
INVISIBLE = "­​-‏‪-‮⁠-⁤⁦-⁩﻿"
FEED_KEYS = ("feedType", "inviter", "member", "leaver", "members")


def ascii_lower(s: Column) -> Column:
    """A-Z in lower case; other letters keep their case."""
    return F.translate(s, UPPER, LOWER)


def trimmed(s: Column) -> Column:
    """Without white space, in Unicode's sense, at either end."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def left_trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "")


def like_ascii(text: Column, query: str, literal: bool = False) -> Column:
    """Does the text contain the trimmed query, A-Z in either case?

    ``%`` and ``_`` in the query are wildcards unless ``literal``.
    """
    q = query.strip().translate(str.maketrans(UPPER, LOWER))
    if literal:
        return F.contains(ascii_lower(text), F.lit(q))
    return ascii_lower(text).like("%" + q.replace("\\", "\\\\") + "%")


def snippet(text: Column, query: str, length: int = 80) -> Column:
    """The trimmed text if short enough, else ``length`` characters from 20 before the query's first occurrence."""
    t = trimmed(text)
    at = F.instr(t, F.lit(query)) - 1
    start = F.greatest(F.greatest(at, F.lit(0)) - 20, F.lit(0))
    return F.when(F.length(t) <= length, t).otherwise(F.substring(t, start + 1, F.lit(length)))


def is_feed(message_type: Column, text: Column) -> Column:
    """Is the message a system feed: of type ``type_0`` with a JSON object that has one of FEED_KEYS?"""
    body = left_trimmed(text)
    keys = F.json_object_keys(body)
    some = F.arrays_overlap(keys, F.array(*(F.lit(k) for k in FEED_KEYS)))
    return (message_type == "type_0") & body.startswith("{") & F.coalesce(some, F.lit(False))


def room_members(title: Column) -> Column:
    """The sorted, trimmed, non-empty parts of a comma-separated title."""
    return F.array_sort(F.filter(F.transform(F.split(title, ","), trimmed), lambda x: x != ""))


def room_matches(a: Column, b: Column) -> Column:
    """Are two titles equal, or lists of the same members?"""
    return (a == b) | (room_members(a) == room_members(b))


def search_member(title: Column) -> Column:
    """The longest member of a title, the first in sorted order on a tie; the title itself if it has none."""
    ranked = F.transform(room_members(title), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.coalesce(F.array_max(ranked)["x"], title)


def untypable(title: Column) -> Column:
    """The control and invisible code points of a title as ``U+XXXX``, in order."""
    found = F.regexp_extract_all(title, F.lit(rf"([\p{{Cc}}{INVISIBLE}])"), F.lit(1))

    def shown(c: Column) -> Column:
        return F.concat(F.lit("U+"), F.regexp_replace(F.right(F.hex(F.encode(c, "UTF-32")), F.lit(8)), "^0{1,4}", ""))

    return F.transform(found, shown)


_WORD = regex.compile(r"[\p{L}\p{N}\p{Co}]+")


def fold(text: str | None) -> list[str]:
    """The search tokens of a text: without diacritics, lower case, runs of letters, numbers and private-use characters."""
    if not text:
        return []
    if not text.isascii():
        bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
        text = unicodedata.normalize("NFC", bare)
    return _WORD.findall(text.lower())


#: The longest stem and ending of a file name in bytes, and the name where nothing is left.
STEM_BYTES, ENDING_BYTES, NAMELESS = 120, 16, "attachment"
_DROPPED = regex.compile("[\u00ad\u180e\ufeff\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069]+")
_REPLACED = regex.compile(r"[/\\:\p{Cc}]")
_NAMED = regex.compile(r"(?s)(.+)\.([^.]+)")


def sanitize_filename(name: str) -> str:
    """A file name that stays in its folder, shows its own ending and is at most STEM_BYTES long before it."""
    name = _DROPPED.sub("", unicodedata.normalize("NFC", name))
    name = regex.sub(r"\s", " ", _REPLACED.sub("_", name)).strip().lstrip(".").strip()
    parts = _NAMED.fullmatch(name)
    if parts and len(parts[2].encode()) <= ENDING_BYTES:
        stem, ending = parts[1], f".{parts[2]}"
    else:
        stem, ending = name, ""
    return (stem.encode()[:STEM_BYTES].decode("utf-8", "ignore") or NAMELESS) + ending


def safe_filename(name: Column) -> Column:
    """``sanitize_filename`` of a column; null stays null.  Only names beyond ASCII go through Python."""

    @F.pandas_udf("string")
    def sanitized(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else sanitize_filename(n))

    plain = name.rlike(r"^[\x00-\x7F]*$")
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, r"[/\\\\:\x00-\x1F\x7F]", "_")), r"^\.+", ""))
    shape = r"^(.+)\.([^.]{1,%d})$" % ENDING_BYTES
    whole = F.concat(F.left(F.regexp_extract(bare, shape, 1), F.lit(STEM_BYTES)), F.lit("."), F.regexp_extract(bare, shape, 2))
    ascii_name = F.when(bare == "", NAMELESS).when(bare.rlike(shape), whole).otherwise(F.left(bare, F.lit(STEM_BYTES)))
    return F.when(plain, ascii_name).otherwise(sanitized(F.when(~plain, name)))


def sanitized_part(s: Column) -> Column:
    """Every character but ASCII letters, digits, ``-`` and ``_`` replaced by ``_``; ``unnamed`` if nothing is left."""
    return F.when(s == "", "unnamed").otherwise(F.regexp_replace(s, "[^A-Za-z0-9_-]", "_"))


def body_extension(body: Column) -> Column:
    """The file ending that the first bytes of a body call for."""
    head = F.hex(F.substring(body, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), ".jpg")
        .when(head.startswith("89504E470D0A1A0A"), ".png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), ".gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")
        .when((F.length(head) == 24) & (F.substring(head, 9, 8) == "66747970"), ".mp4")
        .when(head.startswith("1A45DFA3"), ".webm")
        .otherwise(".bin")
    )


def sha1_matches(body: Column, checksum: Column) -> Column:
    """Is the body's SHA-1 the given hexadecimal digest, in either case?"""
    return F.sha1(body) == ascii_lower(checksum)


def decrypted_body(body: Column, passphrase: Column) -> Column:
    """A cached media body: 4 bytes of magic, 16 of initial vector, AES-256-CBC with PKCS7; then 256 bytes of wrapper are dropped."""
    key = F.unhex(F.sha2(passphrase, 256))
    plain = F.try_aes_decrypt(F.substring(body, 5, 1 << 30), key, F.lit("CBC"), F.lit("PKCS"))
    return F.substring(plain, 257, 1 << 30)


def rfc3339(ts: Column) -> Column:
    """A timestamp as text with the offset ``+00:00``; fractions only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", "").when(micros.endswith("000"), F.concat(F.lit("."), F.left(micros, F.lit(3)))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(whole, fraction, F.lit("+00:00"))

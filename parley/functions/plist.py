"""Arrays of integers from binary property lists."""

from __future__ import annotations

import plistlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer arrays are taken for damage.
MAX_ELEMENTS = 256


def int_array(blob: bytes | None) -> list[int] | None:
    """The integers of a binary property list whose root is an array of integers, or None on any anomaly."""
    if not blob or not blob.startswith(b"bplist00"):
        return None
    try:
        root = plistlib.loads(blob, fmt=plistlib.FMT_BINARY)
    except Exception:  # noqa: BLE001  a damaged file raises many kinds
        return None
    if not isinstance(root, list) or len(root) > MAX_ELEMENTS:
        return None
    if any(type(x) is not int or not -(1 << 63) <= x < 1 << 63 for x in root):
        return None
    return root


def int_arrays(blob: Column) -> Column:
    """``int_array`` of a column."""

    @F.pandas_udf("array<bigint>")
    def arrays(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: int_array(None if b is None else bytes(b)))

    return arrays(blob)

"""Rendezvous weights: FNV-1a of the stream and node names, mixed by the SplitMix64 finaliser, compared unsigned."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
M64 = (1 << 64) - 1


def weight(node: str, venue: str, symbol: str) -> int:
    h = FNV_OFFSET
    for b in b"\0".join(x.encode() for x in (node, venue, symbol)):
        h = ((h ^ b) * FNV_PRIME) & M64
    z = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M64
    return z ^ (z >> 31)


@F.pandas_udf(T.LongType())
def _ordered_weight(node: pd.Series, venue: pd.Series, symbol: pd.Series) -> pd.Series:
    w = np.array([weight(*x) for x in zip(node, venue, symbol, strict=True)], dtype=np.uint64)
    return pd.Series((w ^ np.uint64(1 << 63)).view(np.int64))


def ordered_weight(node: Column, venue: Column, symbol: Column) -> Column:
    """The weight with its top bit flipped, so that signed longs order as the unsigned weights do."""
    return _ordered_weight(node, venue, symbol)

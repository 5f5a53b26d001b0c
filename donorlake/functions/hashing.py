"""Seeded draws that depend on keys only, never on partitioning or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *parts: Column | str) -> Column:
    """Hex md5 of ``seed|part|part...``: a shuffle order any engine can repeat."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw(seed: int, *parts: Column | str) -> Column:
    """A uniform integer in ``[0, 2**32)`` for the given keys."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, *parts: Column | str) -> Column:
    """A uniform double in ``[0, 1)`` for the given keys."""
    return draw(seed, *parts) / F.lit(float(2**32))

"""A portable hash generator: the same number from the same key in any engine, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) from the key's parts, by the first 32 bits of an MD5 digest."""
    parts = [F.lit(str(k)) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

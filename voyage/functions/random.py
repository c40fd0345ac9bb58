"""Uniform numbers that a key alone decides, so that draws do not hang on order or partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(*parts: Column | str) -> Column:
    """A number in [0, 1) from the parts, joined by "|"."""
    key = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0

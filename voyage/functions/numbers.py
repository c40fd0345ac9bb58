"""Numbers as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """The value as double; null for anything else than a number."""
    return value.try_cast("double")


def value_text(value: Column, places: int = 2) -> Column:
    """A number rounded and without trailing zeros; any other text as it is, null for null."""
    rounded = F.regexp_replace(F.round(number(value), places).cast(f"decimal(38,{places})").cast("string"), r"\.?0+$", "")
    return F.coalesce(rounded, value)

"""Order without one task for a key: positions, and as-of lookups whose work grows with the rows alone.

Long runs of one key are cut into pieces that windows run over one by one; what a piece leaves to the next is a few rows of its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voyage.sources.tables import written

#: Rows of a part of an ordering, days of a stretch of a history.
PART, STRETCH = 1 << 17, 366
EPOCH = "1970-01-01"


def numbered(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows with position, from 0 on, among the rows of by in the order given; ties fall in any order.

    Parts of a range partitioning are numbered on their own and moved by the rows ahead of them, so no task holds a key.
    """
    parts = max(1, -(-rows.count() // PART))
    ordered = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("_part", F.shiftright("_at", 33)), "ordered")
    same = F.struct(*by) if by else F.lit(0)
    spans = ordered.groupBy(same.alias("_key"), "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    ahead = F.sum("_rows").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("_key", "_part", (F.coalesce(ahead, F.lit(0)) - F.col("_first")).alias("_shift"))  # a row for each key and part that meet
    joined = ordered.withColumn("_key", same).join(spans, ["_key", "_part"])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("position"))


def as_of(
    keys: DataFrame, rows: DataFrame, by: tuple[str, ...], picks: Mapping[str, Column], sums: Mapping[str, Column] | None = None, key_at: str = "date", at: str = "at",
    forward: bool = False, inclusive: bool | None = None, stretch: int = STRETCH,
) -> DataFrame:
    """The different keys (by, key_at), each with the nearest value of every pick at or before its date, and the sums so far.

    picks: columns of rows (by, at, ...), null where a row has nothing to give; of one day the greatest counts. sums: numeric columns that are
    added up. forward: the nearest value after the date, and sums of what comes after. inclusive: whether the date's own rows count; by
    default they do unless forward. Keys without such a value have null, sums 0. Null dates of rows take no part.

    Rows are first brought to one a day, then keys and days pass in one sweep. Histories are cut into stretches of so many days, and each stretch gets
    from those before it one row with their last values and sums, so a row is never met by more than its own stretch.
    """
    sums, inclusive = sums or {}, (not forward) if inclusive is None else inclusive
    names, counts = list(picks), list(sums)
    days = rows.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_day"), *(c.alias(n) for n, c in picks.items()), *(c.alias(n) for n, c in sums.items()))
    days = days.groupBy(*by, "_day").agg(*(F.max(n).alias(n) for n in names), *(F.sum(n).alias(n) for n in counts), *([] if names or counts else [F.count("*").alias("_n")]))
    kinds = dict(days.dtypes)
    marks = keys.select(*by, F.col(key_at).alias("_day")).distinct()
    both = marks.select(*by, "_day", F.lit(True).alias("_asks"), *(F.lit(None).cast(kinds[n]).alias(n) for n in names + counts)).unionByName(days.select(*by, "_day", F.lit(False).alias("_asks"), *names, *counts))
    both = both.withColumn("_stretch", F.floor(F.datediff("_day", F.lit(EPOCH).cast("date")) / stretch) * (-1 if forward else 1))
    first = F.col("_asks").asc() if inclusive else F.col("_asks").desc()
    own = Window.partitionBy(*by, "_stretch").orderBy(F.col("_day").desc() if forward else F.col("_day"), first).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.select(*by, "_day", "_asks", "_stretch", *(F.last(n, ignorenulls=True).over(own).alias(n) for n in names), *(F.coalesce(F.sum(n).over(own), F.lit(0)).alias(n) for n in counts)).where("_asks")

    last = F.min_by if forward else F.max_by
    whole = both.groupBy(*by, "_stretch").agg(*(last(n, F.when(F.col(n).isNotNull(), F.col("_day"))).alias(n) for n in names), *(F.sum(n).alias(n) for n in counts))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*by, "_stretch", *(F.last(n, ignorenulls=True).over(before).alias(f"_c_{n}") for n in names), *(F.sum(n).over(before).alias(f"_c_{n}") for n in counts))
    found = swept.join(carried, [*by, "_stretch"])
    return found.select(*by, F.col("_day").alias(key_at), *(F.coalesce(n, f"_c_{n}").alias(n) for n in names), *((F.col(n) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in counts))

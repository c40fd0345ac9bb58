"""Exact quantiles of many groups at once, of which no task holds one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voyage.sources.tables import written

#: Values that one range may have to be sorted in one piece, cells of a round's histogram, and rows of a table that is broadcast.
FEW, CELLS, SMALL = 1 << 16, 128, 100_000


def exact_quantiles(rows: DataFrame, by: tuple[str, ...], value: str, probabilities: tuple[float, ...], few: int = FEW) -> DataFrame:
    """(by, quantiles): the values at the probabilities, with linear interpolation; null values take no part.

    A probability asks for one or two order statistics. Each is kept as a range of values with the number of values below it, at first the whole
    group. A round takes an approximate histogram of every range that is too large, narrows it to the cells around the place asked for, and counts
    exactly what lies below, on and between the new ends; the part with the place is the next range, always without its ends. Ranges of few
    values are sorted at last. rows is read twice a round; it should be a written table. by must not be null.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(p) * (F.col("inside") - 1)), F.ceil(F.lit(p) * (F.col("inside") - 1))) for p in probabilities)))))
    ranges = written(sizes.select(*by, places.alias("place"), F.lit(0).cast("long").alias("below"), "inside", "lo", "hi"), "ranges")
    joined = lambda df: rows.join(F.broadcast(df) if df.count() <= SMALL else df, list(by))
    while True:
        large = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
        open_ = ranges.where(large)
        if open_.isEmpty():
            break
        spans = open_.select(*by, "lo", "hi").distinct()
        edges = joined(spans).where("v between lo and hi").groupBy(*by, "lo", "hi").agg(F.percentile_approx("v", [k / CELLS for k in range(CELLS + 1)], 50 * CELLS).alias("edges"))
        cell = F.floor((F.col("place") - F.col("below") + 0.5) / F.col("inside") * CELLS).cast("int")
        near = open_.join(written(edges, "edges"), [*by, "lo", "hi"]).withColumn("a", F.get("edges", F.greatest(cell - 1, F.lit(0)))).withColumn("b", F.get("edges", F.least(cell + 2, F.lit(CELLS)))).drop("edges")
        near = written(near, "near")
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        parts = {"low": v < a, "mid": (v > a) & (v < b), "high": v > b}
        counted = joined(near).where("v between lo and hi").groupBy(*by, "place").agg(
            F.count_if(v == a).alias("on_a"), F.count_if((v == b) & (b > a)).alias("on_b"),
            *(f(F.when(c, v)).alias(f"{n}_{k}") for k, c in parts.items() for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))),
        )
        order, at, chosen = ["low", "on_a", "mid", "on_b", "high"], F.col("below"), F.lit(None)
        for k in reversed(order):
            start = at + sum((F.col(x if x[:2] == "on" else f"n_{x}") for x in order[: order.index(k)]), F.lit(0))
            end = F.col(k[-1]) if k[:2] == "on" else None
            piece = F.struct(start.alias("below"), F.col(k if end is not None else f"n_{k}").alias("inside"), (end if end is not None else F.col(f"lo_{k}")).alias("lo"), (end if end is not None else F.col(f"hi_{k}")).alias("hi"))
            chosen = piece if k == "high" else F.when(F.col("place") < start + F.col(k if end is not None else f"n_{k}"), piece).otherwise(chosen)
        narrowed = near.select(*by, "place", "below", "a", "b").join(counted, [*by, "place"]).withColumn("x", chosen).select(*by, "place", "x.*")
        ranges = written(ranges.where(~large).unionByName(narrowed), "ranges")

    some = ranges.where("lo < hi").select(*by, "lo", "hi").distinct()
    lists = joined(some).where("v between lo and hi").groupBy(*by, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    found = ranges.join(lists, [*by, "lo", "hi"], "left").select(*by, "place", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("sorted", (F.col("place") - F.col("below")).cast("int"))).alias("x"))
    at = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("at"))  # a few places of each
    asked = []
    for p in probabilities:
        position = F.lit(p) * (F.col("inside") - 1)
        low, high = F.col("at")[F.floor(position)], F.col("at")[F.ceil(position)]
        asked.append(low + (high - low) * (position - F.floor(position)))
    return at.join(sizes.select(*by, "inside"), list(by)).select(*by, F.array(*asked).alias("quantiles"))

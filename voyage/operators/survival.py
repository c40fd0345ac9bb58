"""Concordance and the survival evaluation over categories and horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voyage.operators.evaluation import km_censoring
from voyage.operators.ordering import numbered
from voyage.sources.tables import written

#: Risks of a block, as a power of 2.
BLOCK = 16


def with_censoring(rows: DataFrame, g: DataFrame, group: str = "group") -> DataFrame:
    """rows (group, time) with g, the curve's value at their time; 1 before its first time."""
    times = rows.select(group, "time").distinct()
    before = Window.partitionBy(group).orderBy("time")
    curve = times.join(g.select(group, "time", "g"), [group, "time"], "full").withColumn("g", F.coalesce(F.last("g", ignorenulls=True).over(before), F.lit(1.0)))
    return rows.join(curve, [group, "time"])


def c_index_ipcw(test: DataFrame, tau: float | None = None, by: tuple[str, ...] = ("group",)) -> DataFrame:
    """(by, c_index, pairs weight) of rows (by, time, event, risk, g), g being the censoring curve at the row's time.

    A row with an event before tau is compared with all rows of a later time, and with censored ones of the same time; its
    pairs weigh 1 / g squared, equal risks count half. Null without pairs, or where g is 0 at an event.

    Rows without a time or a risk take no part; by may be null.

    Pairs are counted, not made: times become ranks, and the pairs of ranks a < b are those that first differ at one binary digit. For each digit,
    rows that share the digits above it meet. Rows of equal place and risk are added up first; the risks of a group are cut into blocks, in which running
    counts of rows with the digit 1 go on from the counts of the blocks of lower risk. So each row with the digit 0 learns how many have a lower or
    an equal risk, and no task holds a group.
    """
    use = F.col("event") & ((F.col("time") < tau) if tau is not None else F.lit(True))
    key, sums = F.struct(*by).alias("key"), ["n", "w", "broken"]
    cells = test.where("time is not null and risk is not null").groupBy(key, "time", (~F.col("event")).alias("free"), "risk").agg(
        F.count("*").alias("n"), F.sum(F.when(use, F.try_divide(F.lit(1.0), F.col("g") * F.col("g")))).alias("w"), F.count_if(use & (F.col("g") <= 0)).alias("broken")
    )
    cells = written(cells, "cells")
    ranks = numbered(cells.select("key", "time", "free").distinct(), ("key",), ("time", "free")).withColumnRenamed("position", "rank")
    places = numbered(cells.select("key", "risk").distinct(), ("key",), ("risk",)).withColumnRenamed("position", "place")
    digits = ranks.groupBy("key").agg(F.greatest(F.ceil(F.log2(F.max("rank") + 1)), F.lit(1)).cast("int").alias("digits"))
    rows = cells.join(ranks, ["key", "time", "free"]).join(places, ["key", "risk"]).join(digits, "key")
    rows = rows.select("key", "rank", "place", *sums, F.explode(F.sequence(F.lit(0), F.col("digits") - 1)).alias("digit"))
    one = F.expr("shiftright(rank, digit) & 1") == 1
    meet = rows.groupBy("key", "digit", F.expr("shiftright(rank, digit + 1)").alias("above"), F.shiftright("place", BLOCK).alias("block"), "place").agg(
        F.sum(F.when(one, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(~one, F.col("w"))).alias("w"), F.sum(F.when(~one, F.col("broken")).otherwise(0)).alias("broken")
    )
    meet = written(meet, "meet")
    own = ["key", "digit", "above"]
    before = lambda by, order: F.coalesce(F.sum("ones").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = meet.groupBy(*own, "block").agg(F.sum("ones").alias("ones"))
    blocks = blocks.select(*own, "block", before(own, "block").alias("ahead"), F.sum("ones").over(Window.partitionBy(*own)).alias("all"))
    counted = meet.withColumn("lower", before([*own, "block"], "place")).join(blocks, [*own, "block"])
    good = F.col("ahead") + F.col("lower") + F.col("ones") / 2
    out = counted.groupBy("key").agg(F.sum(F.col("w") * good).alias("good"), F.sum(F.col("w") * F.col("all")).alias("weight"), F.bool_or((F.col("broken") > 0) & (F.col("all") > 0)).alias("bad"))
    index = F.when(~F.coalesce("bad", F.lit(False)) & (F.col("weight") > 0), F.col("good") / F.col("weight"))
    return test.select(key).distinct().join(out, "key", "left").select("key.*", index.alias("c_index"))


def survival_eval(pred: DataFrame, targets: DataFrame, train: DataFrame, days_a_unit: int = 7, category: str = "category", by: tuple[str, ...] = (), within_training: bool = True) -> DataFrame:
    """(category, week, by, n, brier, c_index) of predictions (patientid, category, week, survival).

    targets and train: (patientid, category, time, event) in days, one row a patient and category; by: further columns of targets, such as the trial, that
    part the scores, while the censoring curve stays that of the category. within_training: test rows behind the last training time of their
    category are left out. Scores of weeks outside the followed times of their part are null.
    """
    g = written(km_censoring(train, category), "curve")
    longest = train.groupBy(category).agg(F.max("time").alias("longest"))  # one row a category
    tested = targets.join(F.broadcast(longest), category).where("time <= longest").drop("longest") if within_training else targets
    rows = pred.join(with_censoring(tested, g, category), ["patientid", category]).withColumn("at", F.col("week") * days_a_unit)
    marks = rows.select(category, F.col("at").alias("time")).distinct()
    here = with_censoring(marks, g, category).select(category, F.col("time").alias("at"), F.col("g").alias("g_at"))
    rows = written(rows.join(F.broadcast(here), [category, "at"]), "scored")  # one row a category and week
    hit = F.when((F.col("time") <= F.col("at")) & F.col("event"), F.try_divide(F.col("survival") ** 2, F.col("g")))
    free = F.when(F.col("time") > F.col("at"), F.try_divide((1 - F.col("survival")) ** 2, F.col("g_at")))
    own = (category, "week", *by)
    brier = rows.groupBy(*own).agg(F.avg(F.coalesce(hit, free, F.lit(0.0))).alias("score"), F.min("time").alias("lo"), F.max("time").alias("hi"), F.first("at").alias("at"), F.count("*").alias("n"))
    brier = brier.select(*own, "n", F.when((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), F.col("score")).alias("brier"))
    index = c_index_ipcw(rows.withColumn("event", F.col("event") & (F.col("time") < F.col("at"))).withColumn("risk", 1 - F.col("survival")), by=own)
    same = lambda df: df.withColumn("own", F.struct(*own))
    return same(brier).join(same(index).select("own", "c_index"), "own").drop("own")

"""Where to cut timelines, and which variables to ask for there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voyage.functions.numbers import number
from voyage.functions.random import u01
from voyage.operators.quantiles import exact_quantiles
from voyage.sources.tables import together, written


def candidate_split_dates(events: DataFrame, days_before: int = 90, days_after: int = 90) -> DataFrame:
    """(patientid, date, lot_date): dates near a line of therapy, each with its nearest one, the earlier of two.

    Death rows go where a patient has any; else the patient's last date goes.
    """
    lots = events.where("event_category = 'lot'").select("patientid", F.col("date").alias("lot_date")).distinct()
    facts = events.groupBy("patientid").agg(F.bool_or(F.col("event_category") == "death").alias("dead"), F.max("date").alias("last"))
    rows = events.select("patientid", "date", "event_category").join(facts.hint("shuffle_hash"), "patientid")  # one row a patient
    kept = rows.where((F.col("dead") & (F.col("event_category") != "death")) | (~F.col("dead") & (F.col("date") < F.col("last"))))
    gap = F.datediff("date", "lot_date")
    near = kept.select("patientid", "date").join(lots.hint("shuffle_hash"), "patientid").where(gap.between(-days_before, days_after))
    best = near.groupBy("patientid", "date").agg(F.min(F.struct(F.abs(gap).alias("gap"), "lot_date")).alias("best"))
    return best.select("patientid", "date", "best.lot_date")


def within_days(splits: DataFrame, rows: DataFrame, before: int, after: int, keys: tuple[str, ...] = ("patientid",), at: str = "at", hint: str = "merge") -> DataFrame:
    """Join splits (keys, date) with rows (keys, at) where at is from before days ahead of the date to after days behind it.

    Both are cut into stretches of as many days, so that the equal keys of the join hold only what is near and a long
    history is not multiplied by all of its splits. Neither side is small, though packed files may look so: none is sent whole through the driver.
    hint: how they are joined; with shuffle_hash a task holds the splits of its keys and the rows pass by unsorted.
    """
    wide = max(1, before + after)
    stretch = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / wide)
    reach = F.explode(F.sequence(stretch(F.date_sub("date", before)), stretch(F.date_add("date", after)))).alias("stretch")
    left = splits.select("*", reach).hint(hint)
    right = rows.withColumn("stretch", stretch(F.col(at)))
    return left.join(right, [*keys, "stretch"]).where(F.datediff(at, "date").between(-before, after)).drop("stretch")


def sample_splits_per_lot(candidates: DataFrame, n: int = 10, seed: str = "1", replace: bool = True) -> DataFrame:
    """(patientid, lot_date, split_idx, split_date): n draws per line of therapy; without replacement, n different dates at most, numbered in order."""
    if not replace:
        own = Window.partitionBy("patientid", "lot_date")
        ranked = candidates.select("patientid", "lot_date", "date").distinct().withColumn("k", F.row_number().over(own.orderBy(u01(F.lit(seed), "patientid", "lot_date", "date"), "date")))
        return ranked.where(F.col("k") <= n).select("patientid", "lot_date", (F.row_number().over(own.orderBy("date")) - 1).alias("split_idx"), F.col("date").alias("split_date"))
    dates = candidates.groupBy("patientid", "lot_date").agg(F.array_sort(F.collect_list("date")).alias("dates"))  # of one window of days
    drawn = dates.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.floor(u01(F.lit(seed), "patientid", "lot_date", "k") * F.size("dates")).cast("int")
    return drawn.select("patientid", "lot_date", F.col("k").alias("split_idx"), F.get("dates", at).alias("split_date"))


def eligible_variables(events: DataFrame, splits: DataFrame, lookback: int = 90, horizon: int = 90, min_previous: int = 1, min_after: int = 1, categories: tuple[str, ...] = ("lab",)) -> DataFrame:
    """(patientid, date, event_name): variables with enough rows before and after each date; dates with none keep a null row."""
    labs = events.where(F.col("event_category").isin(*categories)).select("patientid", F.col("date").alias("at"), "event_name")
    gap = F.datediff("at", "date")
    around = within_days(splits.select("patientid", "date"), labs, lookback, horizon, hint="shuffle_hash")
    counted = around.groupBy("patientid", "date", "event_name").agg(F.count_if(gap <= 0).alias("before"), F.count_if(gap > 0).alias("after"))
    good = counted.where((F.col("before") >= min_previous) & (F.col("after") >= min_after)).select("patientid", "date", "event_name")
    return splits.select("patientid", "date").join(good, ["patientid", "date"], "left")


def variable_statistics(events: DataFrame, candidates: DataFrame, min_n: int = 50) -> DataFrame:
    """How well the last value predicts the next one, per variable, over the values on candidate dates; plus moments and bins."""
    labs = events.where("event_category = 'lab'").select("patientid", "date", "event_name", "event_value")
    dates = candidates.select("patientid", "date")
    rows = labs.join(dates.hint("shuffle_hash"), ["patientid", "date"], "left_semi").select("patientid", "date", "event_name", number(F.col("event_value")).alias("v")).distinct()
    before = F.lag("v").over(Window.partitionBy("patientid", "event_name").orderBy("date", "v"))
    with together(events.sparkSession):
        pairs = written(rows.withColumn("p", before).where("v is not null and p is not null and event_name is not null").select("event_name", "v", "p"), "pairs")
    error = F.avg((F.col("v") - F.col("p")) ** 2)
    base = pairs.groupBy("event_name").agg(
        F.count("*").alias("num_samples"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), (F.max("v") - F.min("v")).alias("range"),
        (1 - error / F.var_pop("v")).alias("r2"), (F.sqrt(error) / F.stddev_samp("v")).alias("nrmse"), (F.avg(F.abs((F.col("v") - F.col("p")) / F.nullif(F.col("v"), F.lit(0.0)))) * 100).alias("mape"),
    ).where(F.col("num_samples") >= min_n)
    base = written(base, "moments")
    inside = pairs.join(F.broadcast(base.select("event_name", "mean", "std")), "event_name").where("abs(v - mean) <= 3 * std")  # one row a variable
    clean = inside.groupBy("event_name").agg(F.avg("v").alias("mean_without_outliers"), F.stddev_pop("v").alias("std_without_outliers"))
    edges = exact_quantiles(pairs, ("event_name",), "v", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)).select("event_name", F.array_distinct("quantiles").alias("bins"))
    n = F.col("num_samples") * F.col("nrmse")
    return base.join(edges, "event_name").join(clean, "event_name", "left").withColumn("score_nrmse_n_samples", n).withColumn("score_log_nrmse_n_samples", F.log2(n))


def forecast_targets(events: DataFrame, splits: DataFrame, variables: DataFrame, stats: DataFrame, horizon: int = 90, stop_at_next_lot: bool = True, sigma_clip: bool = True) -> DataFrame:
    """Values of each split's variables within the horizon and, if so asked, before the next line of therapy and clipped to three deviations."""
    lots = events.where("event_category = 'lot'").groupBy("patientid").agg(F.collect_set("date").alias("lots"))  # of one patient
    keys = splits.select("patientid", "date").distinct()
    ends = keys.join(lots, "patientid", "left").select("patientid", "date", F.array_min(F.filter("lots", lambda lot: lot > F.col("date"))).alias("next_lot"))
    asked = ends.join(variables.where("event_name is not null"), ["patientid", "date"])
    labs = events.where("event_category = 'lab'").select("patientid", "event_name", F.col("date").alias("target_date"), "event_value")
    gap = F.datediff("target_date", "date")
    rows = within_days(asked, labs, 0, horizon, ("patientid", "event_name"), "target_date", "shuffle_hash").withColumn("v", number(F.col("event_value")))
    before = F.col("next_lot").isNull() | (F.col("target_date") < F.col("next_lot")) if stop_at_next_lot else F.lit(True)
    rows = rows.where((gap > 0) & F.col("v").isNotNull() & before)
    three = stats.select("event_name", (F.col("mean") - 3 * F.col("std")).alias("low"), (F.col("mean") + 3 * F.col("std")).alias("high"))
    return rows.join(F.broadcast(three), "event_name", "left").select("patientid", "date", "event_name", "target_date", (F.greatest(F.least("v", "high"), "low") if sigma_clip else F.col("v")).alias("event_value"))


def sample_variables(eligible: DataFrame, stats: DataFrame, n_min: int = 3, n_max: int = 3, score: str = "score_log_nrmse_n_samples", seed: str = "2", taken: DataFrame | None = None) -> DataFrame:
    """(patientid, date, event_name): variables of each date, drawn without replacement with odds in proportion to the score.

    n_min of them, or a number drawn from n_min up to below n_max. Variables without statistics or with a score of 0 or less are not drawn,
    nor those an earlier draw (patientid, date, event_name) has taken; a date with a null score in its pool has no sample.
    """
    pool = eligible.where("event_name is not null").join(F.broadcast(stats.select("event_name", F.col(score).alias("w"))), "event_name")  # one row a variable
    pool = pool if taken is None else pool.join(taken, ["patientid", "date", "event_name"], "left_anti")
    own = Window.partitionBy("patientid", "date")
    wait = -F.ln(F.greatest(u01(F.lit(seed), "patientid", "date", "event_name"), F.lit(1e-12))) / F.col("w")
    n = F.lit(n_min) + F.floor(u01(F.lit(seed), F.lit("n"), "patientid", "date") * max(0, n_max - n_min))
    drawn = pool.withColumn("holes", F.count_if(F.col("w").isNull()).over(own)).where("holes = 0 and w > 0").withColumn("k", F.row_number().over(own.orderBy(wait, "event_name")))
    return drawn.where(F.col("k") <= n).select("patientid", "date", "event_name")


def retry_empty_splits(targets: DataFrame, sampled: DataFrame) -> DataFrame:
    """(patientid, lot_date, split_idx, split_date, replaced): sampled dates without targets take another one of their line.

    sampled: (patientid, lot_date, split_idx, split_date); targets: (patientid, date, ...). The other sampled dates of the line are tried in
    order, the first with targets wins; without one the row keeps its date.
    """
    full = targets.select("patientid", F.col("date").alias("split_date"), F.lit(True).alias("full")).distinct()
    rows = sampled.join(full, ["patientid", "split_date"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    other = F.min(F.when(F.col("full"), F.col("split_date"))).over(Window.partitionBy("patientid", "lot_date"))
    use = F.when(F.col("full"), F.col("split_date")).otherwise(F.coalesce(other, "split_date"))
    return rows.select("patientid", "lot_date", "split_idx", use.alias("split_date"), (use != F.col("split_date")).alias("replaced"))


def override_splits(dates: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """(patientid, date, event_name): every given date with every given variable."""
    return dates.select("patientid", "date").distinct().withColumn("event_name", F.explode(F.array(*map(F.lit, variables))))

"""Baselines and scores of forecasts and of survival predictions.

Forecast rows have the key (patientid, date, event_name, target_date), where date is the split. Every score is one
groupBy over joined rows; nothing loops over variables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voyage.functions.numbers import number
from voyage.operators.ordering import as_of
from voyage.sources.tables import together, written

KEY = ("patientid", "date", "event_name", "target_date")
#: Centre and spread that decide the bounds, by mode.
BOUNDS = {"raw": ("mean", "std"), "clean": ("mean_without_outliers", "std_without_outliers"), "zscore": ("mean", "std")}


def copy_forward(events: DataFrame, targets: DataFrame) -> DataFrame:
    """The target rows' keys with the last value up to the split (of one day the largest); null where there is none."""
    series = ["patientid", "event_name"]
    labs = events.where("event_category = 'lab'").join(targets.select(*series).distinct().hint("shuffle_hash"), series, "left_semi")
    labs = labs.select(*series, F.col("date").alias("at"), number(F.col("event_value")).alias("v")).where("v is not null")
    last = as_of(targets, labs, ("patientid", "event_name"), {"v": F.col("v")})
    return targets.select(*KEY).distinct().join(last, ["patientid", "date", "event_name"], "left").select(*KEY, F.col("v").alias("event_value"))


def fill_with_copy_forward(pred: DataFrame, last: DataFrame) -> DataFrame:
    """All keys of last (key, event_value) with the prediction, else the one before it in the series, else last's value; and whether it was filled."""
    so_far = Window.partitionBy("patientid", "date", "event_name").orderBy("target_date")
    rows = last.join(pred.select(*KEY, F.col("event_value").alias("p")), list(KEY), "left")
    return rows.select(*KEY, F.coalesce(F.last("p", ignorenulls=True).over(so_far), "event_value").alias("event_value"), F.col("p").isNull().alias("filled"))


def cap_outliers(rows: DataFrame, stats: DataFrame, mode: str = "clean", value: str = "event_value") -> DataFrame:
    """The value within three deviations, and capped (-1, 0 or 1); zscore caps by the raw moments and scales by the clean ones.

    Variables without statistics stay as they are.
    """
    centre, spread = BOUNDS[mode]
    own = stats.select("event_name", (F.col(centre) - 3 * F.col(spread)).alias("low"), (F.col(centre) + 3 * F.col(spread)).alias("high"), F.col("mean_without_outliers").alias("m"), F.col("std_without_outliers").alias("s"))
    side = F.when(F.col(value) < F.col("low"), -1).when(F.col(value) > F.col("high"), 1).otherwise(0)
    held: Column = F.when(F.col(value).isNotNull(), F.greatest(F.least(value, "high"), "low"))
    if mode == "zscore":
        held = F.coalesce((held - F.col("m")) / F.nullif("s", F.lit(0.0)), held)
    return rows.join(F.broadcast(own), "event_name", "left").withColumn("capped", side).withColumn(value, held).select(*rows.columns, "capped")  # one row a variable


def _errors(pred: DataFrame, target: DataFrame, last: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    rows = target.select(*KEY, *more, F.col("event_value").alias("y"))
    rows = rows.join(pred.select(*KEY, F.col("event_value").alias("p")), list(KEY)).join(last.select(*KEY, F.col("event_value").alias("c")), list(KEY))
    return rows.withColumn("e", F.abs(F.col("y") - F.col("p"))).withColumn("f", F.abs(F.col("y") - F.col("c")))


def forecast_eval(pred: DataFrame, target: DataFrame, last: DataFrame, stats: DataFrame, by: tuple[str, ...] = ("event_name",)) -> DataFrame:
    """Per variable (or by, of columns of target): absolute and relative errors, the same over those of copying forward, and how much was scored.

    pred and last have one row a key. Predictions and targets are capped by the clean moments. A relative error to 0 and a
    quotient by 0 are null. Targets with a column imputed count only where it is 0.

    Tables bucketed by patient are joined and counted where they lie: splits and patients are counted by where they begin in their rows' order, so only sums a date move.
    """
    own = target.where("imputed = 0") if "imputed" in target.columns else target
    rows = _errors(*(cap_outliers(x, stats) for x in (pred, own, last)), tuple(c for c in by if c not in KEY))
    size = F.nullif(F.abs("y"), F.lit(0.0))
    ahead = F.lag("date").over(Window.partitionBy(*by, "patientid").orderBy("date"))
    rows = rows.withColumn("ahead", ahead)
    out = rows.groupBy(*by).agg(
        F.avg("e").alias("mae"), F.avg(F.col("e") / size).alias("mape"), F.avg("f").alias("cf_mae"), F.avg(F.col("f") / size).alias("cf_mape"),
        F.count("*").alias("n_samples"), F.count_if(F.col("ahead").isNull() | (F.col("ahead") != F.col("date"))).alias("n_splits"), F.count_if(F.col("ahead").isNull()).alias("n_patients"), F.count_distinct("target_date").alias("n_dates"),
    )
    out = out.withColumn("nmae", F.try_divide("mae", "cf_mae")).withColumn("nmape", F.try_divide("mape", "cf_mape")).drop("cf_mae", "cf_mape")
    with together(out.sparkSession):
        return written(out, "scores")  # one row a variable


def regression_eval(pred: DataFrame, target: DataFrame, last: DataFrame) -> DataFrame:
    """One row: errors over all rows, and their quotients by those of copying forward."""
    rows = _errors(pred, target, last)
    out = rows.agg(F.avg("e").alias("mae"), F.avg(F.col("e") ** 2).alias("mse"), F.avg("f").alias("cf_mae"), F.avg(F.col("f") ** 2).alias("cf_mse"), F.count("*").alias("n"))
    with together(out.sparkSession):
        out = written(out, "scores")  # one row
    return out.select("n", "mae", "mse", F.sqrt("mse").alias("rmse"), F.try_divide("mae", "cf_mae").alias("mae_ratio"), F.try_divide("mse", "cf_mse").alias("mse_ratio"), F.sqrt(F.try_divide("mse", "cf_mse")).alias("rmse_ratio"))


def _halves(*columns: Column) -> tuple[Column, Column]:
    """The two 64-bit halves of the columns' MD5 hash as decimals."""
    text = F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns)))
    return tuple(F.conv(F.substring(text, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))


def evaluation_fingerprint(targets: DataFrame) -> DataFrame:
    """One row that two runs over the same targets share, in whatever order: counts, and 128-bit sums over the different ids and over all rows.

    A sum is written as the sums of the two halves of the hashes; repeated rows count as often as they are there. Values count to six digits.
    """
    ids = targets.select("patientid").distinct().select(*(x.alias(n) for x, n in zip(_halves(F.col("patientid")), ("a", "b"), strict=True)))
    row = _halves(*(F.col(c) for c in KEY), F.format_string("%.6f", F.col("event_value").cast("double")))
    total = lambda a, b: F.concat_ws("-", F.coalesce(F.sum(a), F.lit(0)).cast("string"), F.coalesce(F.sum(b), F.lit(0)).cast("string"))
    counts = targets.agg(
        F.count_distinct("patientid").alias("n_patients"), F.count_distinct("event_name").alias("n_events"), F.count_distinct("target_date").alias("n_dates"),
        F.count("*").alias("n_rows"), F.count_distinct(F.round("event_value", 6)).alias("n_values"), total(*row).alias("rows"),
    )
    return counts.crossJoin(ids.agg(total(F.col("a"), F.col("b")).alias("ids")))  # one row each


def store_run(targets: DataFrame, path: str) -> None:
    """The fingerprint of a run's targets and, apart from it, the list of their ids."""
    evaluation_fingerprint(targets).write.mode("overwrite").json(f"{path}/fingerprint")
    targets.select("patientid").distinct().write.mode("overwrite").parquet(f"{path}/ids")


def fingerprint_differences(path: str, targets: DataFrame) -> DataFrame:
    """(field, stored, now, same): each field of a stored run's fingerprint beside that of the targets."""
    def fields(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.col(c).cast("string") for c in df.columns)))).alias("field", name))

    now = evaluation_fingerprint(targets)
    stored = targets.sparkSession.read.schema(now.schema).json(f"{path}/fingerprint")
    return fields(stored, "stored").join(fields(now, "now"), "field").withColumn("same", F.col("stored") == F.col("now"))


def ids_apart(path: str, targets: DataFrame) -> DataFrame:
    """(patientid, only_in): ids that the stored run has and the targets lack ("stored"), or the other way round ("now")."""
    stored = targets.sparkSession.read.parquet(f"{path}/ids").withColumn("s", F.lit(True))
    both = stored.join(targets.select("patientid").distinct().withColumn("n", F.lit(True)), "patientid", "full")
    return both.where("s is null or n is null").select("patientid", F.when(F.col("s").isNull(), "now").otherwise("stored").alias("only_in"))


def align_week_start(series: DataFrame, by: tuple[str, ...] = ("patientid", "event_name")) -> DataFrame:
    """Dates moved back so that each series begins on a Monday; offset is the number of days."""
    first = series.groupBy(*by).agg(F.weekday(F.min("date")).alias("offset"))
    return series.join(first, list(by)).withColumn("date", F.date_sub("date", F.col("offset"))).select(*series.columns, "offset")


def restore_dates(series: DataFrame) -> DataFrame:
    """What align_week_start has been given."""
    return series.withColumn("date", F.date_add("date", F.col("offset"))).drop("offset")


def km_censoring(survival: DataFrame, group: str = "group") -> DataFrame:
    """(group, time, g): Kaplan-Meier of the censoring times of rows (group, time, event); at one time events come first.

    Windows run over the different times of a group, not over its rows.
    """
    counts = survival.groupBy(group, "time").agg(F.count_if("event").alias("d"), F.count_if(~F.col("event")).alias("c"))
    later = Window.partitionBy(group).orderBy(F.desc("time"))
    so_far = Window.partitionBy(group).orderBy("time")
    factor = 1 - F.try_divide("c", F.nullif(F.col("at_risk") - F.col("d"), F.lit(0)))
    steps = counts.withColumn("at_risk", F.sum(F.col("c") + F.col("d")).over(later)).withColumn("x", F.coalesce(factor, F.lit(1.0)))
    g = F.when(F.min("x").over(so_far) <= 0, 0.0).otherwise(F.exp(F.sum(F.when(F.col("x") > 0, F.ln("x"))).over(so_far)))
    return steps.select(group, "time", g.alias("g"))


def brier_ipcw(test: DataFrame, g: DataFrame, at: int, group: str = "group") -> DataFrame:
    """(group, brier, n): weighted Brier score at a time, of rows (group, time, event, survival) and the censoring curve g.

    A curve is 1 before its first time. Null where a weight would divide by 0 for every row, or the time is not followed.
    """
    asked = test.select(group, "time").union(test.select(group, F.lit(at).cast(test.schema["time"].dataType))).distinct()
    before = Window.partitionBy(group).orderBy("time")
    curve = asked.join(g, [group, "time"], "full").withColumn("g", F.coalesce(F.last("g", ignorenulls=True).over(before), F.lit(1.0)))
    here = curve.where(F.col("time") == at).select(group, F.col("g").alias("g_at"))
    rows = test.join(curve, [group, "time"]).join(F.broadcast(here), group)  # one row a group of the evaluation
    hit = F.when((F.col("time") <= at) & F.col("event"), F.try_divide(F.col("survival") ** 2, "g"))
    free = F.when(F.col("time") > at, F.try_divide((1 - F.col("survival")) ** 2, "g_at"))
    out = rows.groupBy(group).agg(F.avg(F.coalesce(hit, free, F.lit(0.0))).alias("score"), F.min("time").alias("lo"), F.max("time").alias("hi"), F.count("*").alias("n"))
    return out.select(group, F.when((F.lit(at) >= F.col("lo")) & (F.lit(at) < F.col("hi")), F.col("score")).alias("brier"), "n")

"""From model responses to predictions: averages and majorities over copies, snapping to what was asked, probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_trajectories(parsed: DataFrame, by: tuple[str, ...] = ("patientid", "date", "event_name")) -> DataFrame:
    """(by, event_value, n_copies, n_failed): the mean over copies; copies whose value is null failed and are counted alone."""
    return parsed.groupBy(*by).agg(F.avg("event_value").alias("event_value"), F.count("event_value").alias("n_copies"), F.count_if(F.col("event_value").isNull()).alias("n_failed"))


def majority_response(responses: DataFrame, fields: tuple[str, ...] = ("censoring", "occurred", "target_name"), key: str = "patientid") -> DataFrame:
    """(key, fields, percent): the most frequent response of each key and its share in percent, two decimals; of equal ones the least."""
    counts = responses.groupBy(key, *fields).agg(F.count("*").alias("n"))
    own = Window.partitionBy(key)
    ranked = counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(own), 2)).withColumn("k", F.row_number().over(own.orderBy(F.desc("n"), *fields)))
    return ranked.where("k = 1").select(key, *fields, "percent")


def majority_by_field(responses: DataFrame, fields: tuple[str, ...], key: str = "patientid") -> DataFrame:
    """(key, fields): the most frequent value of each field by itself."""
    return responses.groupBy(key).agg(*(F.mode(f, deterministic=True).alias(f) for f in fields))


def nan_mean_copies(responses: DataFrame, key: str = "patientid") -> DataFrame:
    """(key, values): element-wise means over copies (key, n_targets, values array).

    Each copy is cut or padded to n_targets and its holes filled forward, then backward. A key without any value takes the
    mean of all values.
    """
    n = F.col("n_targets")
    fitted = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get("values", k))
    forward = F.aggregate(fitted, F.array().cast("array<double>"), lambda out, v: F.array_append(out, F.coalesce(v, F.get(out, F.size(out) - 1))))
    back = F.reverse(F.aggregate(F.reverse(forward), F.array().cast("array<double>"), lambda out, v: F.array_append(out, F.coalesce(v, F.get(out, F.size(out) - 1)))))
    each = responses.where(n > 0).select(key, "n_targets", F.posexplode(back).alias("place", "v"))
    overall = each.agg(F.avg("v").alias("overall"))
    means = each.groupBy(key, "n_targets", "place").agg(F.avg("v").alias("v")).crossJoin(F.broadcast(overall))  # one row
    ordered = F.array_sort(F.collect_list(F.struct("place", F.coalesce("v", "overall").alias("v"))))
    return means.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def snap_to_target_dates(pred: DataFrame, targets: DataFrame, most_weeks: int = 156) -> DataFrame:
    """pred (patientid, split_date, event_name, week, event_value) with the nearest of the series' target dates, the earlier of two."""
    key = ["patientid", "split_date", "event_name"]
    dates = targets.groupBy(*key).agg(F.collect_set("target_date").alias("dates"))  # of one series
    at = F.expr("date_add(split_date, cast(round(7 * week) as int))")
    rows = pred.withColumn("week", F.least("week", F.lit(float(most_weeks)))).withColumn("at", at).join(dates, key)
    near = F.array_min(F.transform("dates", lambda d: F.struct(F.abs(F.datediff(d, "at")).alias("gap"), d.alias("date"))))
    return rows.select(*key, near["date"].alias("target_date"), "event_value")


def snap_to_target_names(pred: DataFrame, targets: DataFrame) -> DataFrame:
    """pred (patientid, said, ...) with event_name: the patient's allowed name of the least edit distance, of equal ones the first."""
    names = targets.groupBy("patientid").agg(F.collect_set("event_name").alias("names"))  # of one patient
    best = F.array_min(F.transform("names", lambda n: F.struct(F.levenshtein(n, F.col("said")).alias("d"), n.alias("event_name"))))
    return pred.join(names, "patientid").select(*pred.columns, best["event_name"].alias("event_name"))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / F.nullif(F.size(values), F.lit(0))


def class_probabilities(rows: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Log-probabilities (arrays occurred, not_occurred, censored) as softmax of their means, the likeliest class, and the parts of an id.

    Ids read {patient}_lot_{i}_var_{category}_week_{w}.
    """
    score = {c: mean_of(F.col(c)) for c in ("occurred", "not_occurred", "censored")}
    top = F.greatest(*score.values())
    total = sum((F.exp(s - top) for s in score.values()), F.lit(0.0))
    p = {c: F.exp(s - top) / total for c, s in score.items()}
    part = lambda k: F.regexp_extract(id_col, r"^(.*)_lot_(\d+)_var_(.*)_week_(\d+)$", k)
    best = F.when(score["occurred"] >= F.greatest(score["not_occurred"], score["censored"]), "occurred").when(score["not_occurred"] >= score["censored"], "not_occurred").otherwise("censored")
    return rows.select(
        id_col, part(1).alias("patientid"), part(2).cast("int").alias("lot"), part(3).alias("category"), part(4).cast("int").alias("week"),
        p["occurred"].alias("probability_occurrence"), p["not_occurred"].alias("probability_no_occurrence"), p["censored"].alias("probability_censored"), best.alias("class"),
    )


def landmark_from_step_function(steps: DataFrame, landmarks: tuple[int, ...], days_a_unit: int = 1) -> DataFrame:
    """(patientid, landmark, survival, occurred) of curves (patientid, steps array<struct<t, s>>): the value of the last step not after the landmark, 1 before the first."""
    grid = steps.withColumn("landmark", F.explode(F.array(*map(F.lit, landmarks))))
    passed = F.filter("steps", lambda x: x["t"] <= F.col("landmark") * days_a_unit)
    value = F.coalesce(F.array_max(F.transform(passed, lambda x: F.struct(x["t"].alias("t"), x["s"].alias("s"))))["s"], F.lit(1.0))
    return grid.select("patientid", "landmark", value.alias("survival"), (1 - value >= 0.5).alias("occurred"))


def majority_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """test (patientid, category, week) with the most frequent occurred among uncensored training rows of its category and week, as probability 0 or 1."""
    modes = train.where("censored is null").groupBy("category", "week").agg((2 * F.count_if("occurred") > F.count("*")).alias("occurred"))
    return test.select("patientid", "split_date", "category", "week").join(modes, ["category", "week"], "left").withColumn("probability_occurrence", F.col("occurred").cast("double"))


def align_event_predictions(pred: DataFrame, keys: DataFrame) -> DataFrame:
    """All keys (sample_id) with their prediction (sample_id, censored, occurred); id parts as columns, a missing occurred takes the most frequent one."""
    common = pred.agg(F.mode("occurred", deterministic=True).alias("common"))
    rows = keys.select("sample_id").distinct().join(pred.select("sample_id", F.col("censored").alias("predicted_censored"), "occurred"), "sample_id", "left").crossJoin(F.broadcast(common))  # one row
    part = lambda k: F.regexp_extract("sample_id", r"_var_(.*)_week_(\d+)$", k)
    return rows.select("sample_id", part(1).alias("category"), part(2).cast("int").alias("week"), "predicted_censored", F.coalesce("occurred", "common").alias("occurred"))

"""Times to events after a split, for survival labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voyage.functions.random import u01
from voyage.operators.ordering import as_of


def landmark_times(events: DataFrame, splits: DataFrame, categories: tuple[str, ...] = ("death", "progression", "lot")) -> DataFrame:
    """(patientid, date, category, true_time, true_censoring): weeks from the split to the category's first later event.

    An event counts before the next line of therapy alone; else the time ends, censored, with that line or, without one,
    with the last visit. Lines of therapy are not censored by themselves. Nothing later: time 0, censored.
    """
    keys = splits.select("patientid", "date").distinct()
    rows = events.select("patientid", F.col("date").alias("at"), "event_category")
    is_ = lambda c: F.when(F.col("event_category") == c, F.col("at"))
    first = as_of(keys, rows, ("patientid",), {"next_lot": is_("lot")} | {f"first_{c}": is_(c) for c in categories}, forward=True)
    first = first.join(rows.groupBy("patientid").agg(F.max("at").alias("last")), "patientid", "left").withColumn("last", F.when(F.col("last") > F.col("date"), F.col("last")))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"first_{c}").alias("hit")) for c in categories)))
    grid = first.select("patientid", "date", "last", "next_lot", cells.alias("x")).select("*", "x.*")
    seen = F.col("hit").isNotNull() & ((F.col("category") == "lot") | F.col("next_lot").isNull() | (F.col("hit") < F.col("next_lot")))
    end = F.when(seen, F.col("hit")).otherwise(F.coalesce("next_lot", "last", "date"))
    return grid.select("patientid", "date", "category", (F.datediff(end, "date") / 7).alias("true_time"), (~seen).alias("true_censoring"))


#: Names that tasks give their categories.
CATEGORY_NAMES = {"death": "death", "progression": "next progression", "lot": "start of next line of therapy", "metastasis": "next metastasis"}


def event_tasks(
    events: DataFrame, splits: DataFrame, categories: tuple[str, ...] = ("death", "progression", "lot"), weeks: tuple[int, ...] | None = None, max_weeks: int = 104,
    cutoff: str = "2100-01-01", progression_includes_death: bool = True, seed: str = "5",
) -> DataFrame:
    """(patientid, split_date, category, variable_name, week, end_date, occurred, censored): one task for each split, category and week.

    Without weeks one is drawn from 1 to max_weeks. The window ends after so many weeks, but not before the first later row.
    A hit in the window counts unless a line of therapy starts before it; without a hit the window is censored by a line of
    therapy, by nothing if the patient died or the data go on, else by their end ("end"), and by the cut-off if it lies behind that. Where no
    progression but a death follows, death stands for progression.
    """
    keys = splits.select("patientid", "split_date").distinct()
    rows = events.select("patientid", F.col("date").alias("at"), "event_category", "event_name")
    last = rows.groupBy("patientid").agg(F.max("at").alias("last"))
    first = lambda condition: F.when(condition, F.col("at"))
    names = tuple(dict.fromkeys((*categories, "death", "lot")))
    picks = {"next_any": F.col("at"), "died": first(F.col("event_name") == "death")} | {f"first_{c}": first(F.col("event_category") == c) for c in names}
    later = as_of(keys, rows, ("patientid",), picks, key_at="split_date", forward=True)
    drawn = F.lit(1) + F.floor(u01(F.lit(seed), "patientid", "split_date", "category") * max_weeks)
    grid = keys.withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    grid = grid.withColumn("week", F.explode(F.array(*map(F.lit, weeks))) if weeks else drawn.cast("int"))
    grid = grid.join(later, ["patientid", "split_date"], "left").join(last, "patientid", "left")
    hit = F.coalesce(*(F.when(F.col("category") == c, F.col(f"first_{c}")) for c in categories))
    if progression_includes_death:
        hit = F.when(F.col("category") == "progression", F.coalesce(hit, F.col("first_death"))).otherwise(hit)
    end = F.greatest(F.date_add("split_date", F.col("week") * 7), F.col("next_any"))
    grid = grid.withColumn("end_date", end).withColumn("hit", F.when(hit <= end, hit)).withColumn("lot", F.when(F.col("first_lot") <= end, F.col("first_lot")))
    early = F.col("hit").isNotNull() & ~F.coalesce(F.col("hit") > F.col("lot"), F.lit(False))
    why = F.when(early, None).when(F.col("lot").isNotNull(), "lot").when(F.col("died") <= F.col("end_date"), None).when(F.col("end_date") <= F.col("last"), None).otherwise("end")
    late = ~early & (F.col("end_date") > F.lit(cutoff).cast("date"))
    name = F.coalesce(*(F.when(F.col("category") == c, CATEGORY_NAMES.get(c, c)) for c in categories))
    return grid.withColumn("why", why).select(
        "patientid", "split_date", "category", name.alias("variable_name"), "week", "end_date", early.alias("occurred"), F.when(F.col("why").isNull() & late, "data_cutoff").otherwise(F.col("why")).alias("censored")
    )


def landmark_grid(events: DataFrame, splits: DataFrame, weeks: tuple[int, ...] = (8, 26, 52, 104), categories: tuple[str, ...] = ("death", "progression", "lot", "metastasis"), cutoff: str = "2100-01-01") -> DataFrame:
    """event_tasks on a fixed grid, with true_time (weeks) and true_censoring of each category."""
    tasks = event_tasks(events, splits, categories, weeks, cutoff=cutoff)
    times = landmark_times(events, splits.withColumnRenamed("split_date", "date"), categories).withColumnRenamed("date", "split_date")
    return tasks.join(times, ["patientid", "split_date", "category"])


def landmark_labels_from_survival(survival: DataFrame, weeks: tuple[int, ...], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """(patientid, category, week, occurred, censored) of a survival table in days; columns: category to its time and its censoring flag.

    A horizon behind the time has occurred, or is censored if the time is; one before it has neither.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("category"), F.col(t).cast("double").alias("time"), F.col(f).cast("boolean").alias("cut")) for c, (t, f) in columns.items()))
    rows = survival.select("patientid", F.explode(cells).alias("x")).select("patientid", "x.*").where("time is not null and cut is not null")
    rows = rows.withColumn("week", F.explode(F.array(*map(F.lit, weeks))))
    passed = F.col("week") * 7 >= F.col("time")
    return rows.select("patientid", "category", "week", (passed & ~F.col("cut")).alias("occurred"), F.when(passed & F.col("cut"), "end").alias("censored"))

"""Loading and preparing cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voyage.functions.random import u01


def clean_dates(events: DataFrame, cutoff: str) -> DataFrame:
    """Dates as DATE, rows without one left out; a date after the cut-off fails the job that reads the row."""
    late = F.concat(F.lit("date after the cut-off: "), F.col("date").cast("string"))
    checked = F.when(F.col("date") > F.lit(cutoff).cast("date"), F.raise_error(late)).otherwise(F.col("date"))
    return events.withColumn("date", F.to_date("date")).where("date is not null").withColumn("date", checked.cast("date"))


def disambiguate_names(events: DataFrame, replacements: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Descriptive names that more than one (name, category) pair shares get " - name"; then literal replacements by category."""
    pairs = events.select("event_name", "event_category", "event_descriptive_name").distinct()
    shared = pairs.groupBy("event_descriptive_name").agg(F.count("*").alias("n")).where("n > 1").select("event_descriptive_name", F.lit(True).alias("shared"))
    named = events.join(shared, "event_descriptive_name", "left")
    name = F.when(F.col("shared"), F.concat_ws(" - ", "event_descriptive_name", "event_name")).otherwise(F.col("event_descriptive_name"))
    for category, rules in replacements.items():
        put = name
        for old, new in rules:
            put = F.replace(put, F.lit(old), F.lit(new))
        name = F.when(F.col("event_category") == category, put).otherwise(name)
    return named.withColumn("event_descriptive_name", name).select(*events.columns)


def assign_patient_splits(constant: DataFrame, share: float = 0.1, cap: int = 500, seed: str = "768921") -> DataFrame:
    """(patientid, data_split): floor(share * n) patients, at most cap, for validation, as many for test, the rest for training.

    The lowest hashes are drawn by a top-k, so no global sort takes place; the drawn ids number 2 * cap at most.
    """
    patients = constant.select("patientid").distinct()
    n = min(int(share * patients.count()), cap)
    lowest = patients.select("patientid", u01(F.lit(seed), "patientid").alias("u")).orderBy("u", "patientid").limit(2 * n)
    ids = [r[0] for r in lowest.collect()]
    drawn = patients.sparkSession.createDataFrame([(p, "validation" if k < n else "test") for k, p in enumerate(ids)], "patientid string, data_split string")
    return patients.join(F.broadcast(drawn), "patientid", "left").select("patientid", F.coalesce("data_split", F.lit("train")).alias("data_split"))


def patient_timeline(events: DataFrame, molecular: DataFrame) -> DataFrame:
    """Events and molecular rows, named alike and tagged by source, without repeated rows.

    The source tells the two sides apart, so each drops its own repeats: where rows lie in buckets by patient, without a shuffle.
    """
    genetic = molecular.select(
        "patientid", "date", F.col("biomarker_category").alias("event_category"), F.col("biomarker_event").alias("event_name"),
        F.col("biomarker_descriptive_name").alias("event_descriptive_name"), F.col("biomarker_value").alias("event_value"), F.lit("genetic").alias("source"),
    )
    return events.distinct().withColumn("source", F.lit("events")).unionByName(genetic.distinct())


def null_dates(events: DataFrame) -> DataFrame:
    """One row: how many rows clean_dates leaves out for want of a date, and how many it keeps."""
    date = F.to_date("date")
    return events.agg(F.count_if(date.isNull()).alias("n_dropped"), F.count_if(date.isNotNull()).alias("n_kept"))


def unique_events(events: DataFrame) -> DataFrame:
    """(event_category, event_name, event_descriptive_name, n): the different triples; fails, when read, if a descriptive name of disambiguate_names stands for two of them."""
    triples = events.groupBy("event_category", "event_name", "event_descriptive_name").agg(F.count("*").alias("n"))
    shared = triples.groupBy("event_descriptive_name").agg(F.count("*").alias("triples"))
    checked = F.when(F.col("triples") > 1, F.raise_error(F.concat(F.lit("one name for several events: "), "event_descriptive_name"))).otherwise(F.col("n"))
    return triples.join(shared, "event_descriptive_name").select("event_category", "event_name", "event_descriptive_name", checked.cast("long").alias("n"))


def given_splits(constant: DataFrame, mapping: DataFrame, override: str | None = None) -> DataFrame:
    """(patientid, data_split) from a mapping (patientid, data_split), or override for all; fails, when read, for a patient without a split or a split of another name."""
    patients = constant.select("patientid").distinct()
    if override is not None:
        return patients.withColumn("data_split", F.lit(override))
    rows = patients.join(mapping.select("patientid", "data_split").distinct(), "patientid", "left")
    wrong = ~F.coalesce(F.col("data_split").isin("train", "validation", "test"), F.lit(False))
    return rows.withColumn("data_split", F.when(wrong, F.raise_error(F.concat(F.lit("no split for patient "), "patientid"))).otherwise(F.col("data_split")).cast("string"))


def split_counts(splits: DataFrame) -> DataFrame:
    """(data_split, n, n_patients): rows and patients of each split; both agree where each patient has one split."""
    return splits.groupBy("data_split").agg(F.count("*").alias("n"), F.count_distinct("patientid").alias("n_patients"))


def from_meds(
    codes: DataFrame, data: DataFrame, split: DataFrame, prefer_text: bool = True, no_value: str = "present", categories: dict[str, str] | None = None, category: str = "other", most_constants: int = 1000,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, constant, constant_description, duplicates) of codes (code, description), data (subject_id, time, code, numeric_value, text_value), split (subject_id, split).

    Rows without a time become the patient's constants: a first pass takes their codes, sorted, a second one makes a column of each, and the split is one
    more. A patient with two values of one has the least. More than most_constants codes fail, since a table has so many columns. The other rows are events, each with its
    code's description, and no_value where it has none. duplicates: how often a (patient, date, name, value) comes again. Fails, when read, for a code without a description.
    """
    number, text = F.col("numeric_value").cast("string"), F.col("text_value")
    value = F.coalesce(text, number) if prefer_text else F.coalesce(number, text)
    rows = data.select(F.col("subject_id").cast("string").alias("patientid"), F.col("time").alias("date"), F.col("code").alias("event_name"), value.alias("event_value"))
    told = codes.groupBy(F.col("code").alias("event_name")).agg(F.min("description").alias("event_descriptive_name"))
    described = F.when(F.col("event_descriptive_name").isNull(), F.raise_error(F.concat(F.lit("no description of "), "event_name"))).otherwise(F.col("event_descriptive_name")).cast("string").alias("event_descriptive_name")

    untimed = rows.where("date is null")
    names = [r[0] for r in untimed.select("event_name").distinct().orderBy("event_name").limit(most_constants + 1).collect()]  # bounded by most_constants
    if len(names) > most_constants:
        raise ValueError(f"more than {most_constants} codes without a time: they can't be columns")
    held = untimed.groupBy("patientid").agg(F.count("*").alias("n"), *(F.min(F.when(F.col("event_name") == c, F.col("event_value"))).alias(c) for c in names)).drop("n")
    constant = held.join(split.select(F.col("subject_id").cast("string").alias("patientid"), "split"), "patientid", "left")
    shown = data.sparkSession.createDataFrame([(c,) for c in ["patientid", *names, "split"]], "event_name string").join(told, "event_name", "left")
    missing = F.when(F.col("event_name").isin("patientid", "split"), F.lit("No description available")).otherwise(described)
    description = shown.select(F.col("event_name").alias("variable"), missing.alias("comment"))

    named = rows.where("date is not null").join(told, "event_name", "left")
    kind = F.lit(None).cast("string")
    for code, c in (categories or {}).items():
        kind = F.when(F.col("event_name") == code, c).otherwise(kind)
    events = named.select("patientid", "date", F.coalesce(kind, F.lit(category)).alias("event_category"), "event_name", described, F.coalesce("event_value", F.lit(no_value)).alias("event_value"))
    again = events.groupBy("patientid", "date", "event_name", "event_value").agg(F.count("*").alias("n")).where("n > 1")
    return events, constant, description, again

"""Queries of sources, sinks and imports, with their DuckDB statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voyage.operators import ingest, splits
from voyage.plans import fixtures, texts
from voyage.plans.evaluations import _rounded
from voyage.plans.fixtures import CONSTANT, constant, duck, events, molecular
from voyage.plans.journeys import CANDIDATES, NUMBERS, STATS, U, WITH
from voyage.sources import files
from voyage.sources.tables import shared_folder


def _exported(spark, d):
    """Two cohorts, by gender, as the files that load_cohorts reads."""
    base = f"{shared_folder(spark)}/cohorts-{uuid.uuid4().hex}"
    people = constant(spark, d)
    described = spark.createDataFrame([("race", "race of patient"), ("gender", "gender of patient")], "variable string, comment string")
    for cohort, gender in (("one", "M"), ("two", "F")):
        own = people.where(F.col("gender") == gender)
        held = own.select("patientid")
        rows = {"events": events(spark, d).join(held, "patientid"), "molecular": molecular(spark, d).join(held, "patientid"), "constant": own.drop("indication"), "constant_description": described}
        for part, df in rows.items():
            files.write_csv(df.select(F.lit(0).alias("Unnamed: 0"), "*"), base + "/" + cohort + files.PARTS[part])
    return base


def d01_load_cohorts(spark, d):
    rows = files.load_cohorts(spark, _exported(spark, d))["events"]
    return rows.select("patientid", "date", "event_category", "event_name", "event_descriptive_name", "event_value", "indication")


def d01_load_constants(spark, d):
    return files.load_cohorts(spark, _exported(spark, d))["constant"].select("patientid", "birthyear", "race", "gender", "ethnicity", "indication")


def d02_null_dates(spark, d):
    return ingest.null_dates(events(spark, d).withColumn("date", F.when(F.col("event_value") == "17", None).otherwise(F.col("date"))))


def d03_unique_events(spark, d):
    return ingest.unique_events(events(spark, d))


def d04_given_splits(spark, d):
    return ingest.split_counts(ingest.given_splits(constant(spark, d), ingest.assign_patient_splits(constant(spark, d))))


def _meds(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    data = rows.select(F.col("user_id").alias("subject_id"), F.when(F.col("event_type") != "signup", F.to_date("ts")).alias("time"), F.col("event_type").alias("code"), F.col("value").alias("numeric_value"), F.when(F.col("event_type") == "error", F.lit("bad")).alias("text_value"))
    codes = rows.select(F.col("event_type").alias("code"), F.upper("event_type").alias("description")).distinct()
    split = rows.select(F.col("user_id").alias("subject_id"), F.when(F.col("user_id") % 5 == 0, "test").otherwise("train").alias("split")).distinct()
    return ingest.from_meds(codes, data, split, categories={"purchase": "drug"}, category="web")


def d06_from_meds(spark, d):
    return _meds(spark, d)[0].groupBy("patientid", "date", "event_category", "event_name", "event_descriptive_name").agg(F.count("*").alias("n"), F.count_if(F.col("event_value") == "bad").alias("n_text"))


def d10_train_statistics(spark, d):
    train = ingest.assign_patient_splits(constant(spark, d)).where("data_split = 'train'")
    own = events(spark, d).join(train, "patientid", "left_semi"), fixtures.candidates(spark, d).join(train, "patientid", "left_semi")
    out = splits.variable_statistics(*own)
    return _rounded(out.select("event_name", "num_samples", *NUMBERS, "score_nrmse_n_samples", "score_log_nrmse_n_samples", F.array_join(F.transform("bins", lambda b: F.round(b, 2).cast("string")), " ").alias("bins")))


def d45_write_samples(spark, d):
    path = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    split = ingest.assign_patient_splits(constant(spark, d))
    rows = texts.samples(spark, d).join(split.hint("shuffle_hash"), "patientid").withColumn("indication", F.lit("one"))  # texts are neither moved nor sorted
    files.write_samples(rows, path, ("patientid", "split_date", "tokens_input", "tokens_target"))
    back = files.read_samples(spark, path, "instruction string, meta struct<tokens_input: long>, indication string, data_split string")
    return back.groupBy("indication", "data_split").agg(F.count("*").alias("n"), F.sum(F.length("instruction")).alias("n_characters"), F.sum("meta.tokens_input").alias("tokens_input"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "d" and k[1:3].isdigit()}
_TRAIN = f""", rk AS (SELECT patientid, row_number() OVER (ORDER BY {U.format(key="'768921|' || patientid")}, patientid) AS k, least(CAST(floor(0.1 * count(*) OVER ()) AS INT), 500) AS n FROM con),
spl AS (SELECT patientid, CASE WHEN k <= n THEN 'validation' WHEN k <= 2 * n THEN 'test' ELSE 'train' END AS data_split FROM rk)"""
ORACLE = {
    "d01_load_cohorts": f"{WITH} SELECT patientid, date, event_category, event_name, event_descriptive_name, event_value, CASE gender WHEN 'M' THEN 'one' ELSE 'two' END AS indication FROM ev JOIN con USING (patientid)",
    "d01_load_constants": f"WITH con AS ({duck(CONSTANT)}) SELECT patientid, birthyear, race, gender, ethnicity, CASE gender WHEN 'M' THEN 'one' ELSE 'two' END AS indication FROM con",
    "d02_null_dates": f"{WITH} SELECT count(*) FILTER (event_value = '17') AS n_dropped, count(*) FILTER (event_value <> '17') AS n_kept FROM ev",
    "d03_unique_events": f"{WITH} SELECT event_category, event_name, event_descriptive_name, count(*) AS n FROM ev GROUP BY ALL",
    "d04_given_splits": f"{WITH}{_TRAIN} SELECT data_split, count(*) AS n, count(DISTINCT patientid) AS n_patients FROM spl GROUP BY 1",
    "d06_from_meds": """SELECT CAST(user_id AS VARCHAR) AS patientid, CAST(ts AS DATE) AS date, CASE event_type WHEN 'purchase' THEN 'drug' ELSE 'web' END AS event_category, event_type AS event_name, upper(event_type) AS event_descriptive_name,
        count(*) AS n, count(*) FILTER (event_type = 'error') AS n_text FROM events WHERE event_type <> 'signup' GROUP BY ALL""",
    "d10_train_statistics": f"""{WITH}{_TRAIN}, ev0 AS (SELECT ev.* FROM ev SEMI JOIN (SELECT patientid FROM spl WHERE data_split = 'train') USING (patientid)){CANDIDATES.replace("FROM ev", "FROM ev0")}{STATS.replace("FROM ev ", "FROM ev0 ")},
        q AS (SELECT event_name, list_distinct(quantile_cont(v, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS b FROM pairs GROUP BY 1)
        SELECT event_name, num_samples, {", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS)}, round(num_samples * nrmse, 6) AS score_nrmse_n_samples, round(log2(num_samples * nrmse), 6) AS score_log_nrmse_n_samples,
        array_to_string([CAST(round(x, 2) AS VARCHAR) FOR x IN list_sort(b)], ' ') AS bins FROM stat JOIN q USING (event_name)""",
    "d45_write_samples": f"{texts.FULL}{texts._SAMPLES}{_TRAIN} SELECT 'one' AS indication, data_split, count(*) AS n, CAST(sum(length(instruction)) AS BIGINT) AS n_characters, CAST(sum(tokens_input) AS BIGINT) AS tokens_input FROM sa JOIN spl USING (patientid) GROUP BY 2",
}

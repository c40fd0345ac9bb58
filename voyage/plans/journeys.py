"""Queries of ingest and split operators, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from voyage.functions.numbers import value_text
from voyage.operators import ingest, splits
from voyage.plans import fixtures
from voyage.plans.fixtures import CONSTANT, EVENTS, MOLECULAR, constant, duck, events, molecular

U = "CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0"
WITH = f"WITH ev AS ({duck(EVENTS)}), mol AS ({duck(MOLECULAR)}), con AS ({duck(CONSTANT)})"
CANDIDATES = """, flagged AS (SELECT patientid, date, event_category, max(CASE WHEN event_category = 'death' THEN 1 ELSE 0 END) OVER (PARTITION BY patientid) AS dead, max(date) OVER (PARTITION BY patientid) AS last FROM ev),
kept AS (SELECT DISTINCT patientid, date FROM flagged WHERE (dead = 1 AND event_category <> 'death') OR (dead = 0 AND date < last)),
lots AS (SELECT DISTINCT patientid, date AS lot_date FROM ev WHERE event_category = 'lot'),
cand AS (SELECT patientid, date, lot_date FROM (SELECT *, row_number() OVER (PARTITION BY patientid, date ORDER BY abs(date - lot_date), lot_date) AS k FROM kept JOIN lots USING (patientid) WHERE date - lot_date BETWEEN -90 AND 90) WHERE k = 1)"""
ELIGIBLE = """, counted AS (SELECT c.patientid, c.date, e.event_name FROM cand c JOIN ev e ON e.patientid = c.patientid AND e.event_category = 'lab' AND e.date - c.date BETWEEN -90 AND 90
  GROUP BY ALL HAVING count(*) FILTER (e.date <= c.date) >= 1 AND count(*) FILTER (e.date > c.date) >= 1),
elig AS (SELECT cand.patientid, cand.date, event_name FROM cand LEFT JOIN counted USING (patientid, date))"""
STATS = """, lab AS (SELECT DISTINCT patientid, date, event_name, TRY_CAST(event_value AS DOUBLE) AS v FROM ev WHERE event_category = 'lab'),
pairs AS (SELECT * FROM (SELECT event_name, v, lag(v) OVER (PARTITION BY patientid, event_name ORDER BY date, v) AS p FROM lab JOIN cand USING (patientid, date)) WHERE v IS NOT NULL AND p IS NOT NULL),
base AS (SELECT event_name, count(*) AS num_samples, avg(v) AS mean, stddev_samp(v) AS std, max(v) - min(v) AS range, 1 - avg((v - p) * (v - p)) / var_pop(v) AS r2,
  sqrt(avg((v - p) * (v - p))) / stddev_samp(v) AS nrmse, avg(abs((v - p) / nullif(v, 0))) * 100 AS mape FROM pairs GROUP BY 1 HAVING count(*) >= 50),
stat AS (SELECT base.*, c.m AS mean_without_outliers, c.s AS std_without_outliers FROM base LEFT JOIN (SELECT event_name, avg(v) AS m, stddev_pop(v) AS s FROM pairs JOIN base USING (event_name) WHERE abs(v - mean) <= 3 * std GROUP BY 1) c USING (event_name))"""
RULES = {"lab": [("/", " per "), (".", " ")]}


def d02_clean_dates(spark, d):
    holes = events(spark, d).withColumn("date", F.when(F.col("event_value") == "17", None).otherwise(F.col("date")))
    return ingest.clean_dates(holes, "2030-01-01").groupBy("event_category").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def d03_disambiguate_names(spark, d):
    rows = events(spark, d).withColumn("event_descriptive_name", F.when(F.col("event_category") == "progression", "line of therapy").otherwise(F.col("event_descriptive_name")))
    return ingest.disambiguate_names(rows, RULES).groupBy("event_category", "event_name", "event_descriptive_name").agg(F.count("*").alias("n"))


def d04_assign_patient_splits(spark, d):
    return ingest.assign_patient_splits(constant(spark, d))


def d05_patient_timeline(spark, d):
    return ingest.patient_timeline(events(spark, d), molecular(spark, d))


def d07_candidate_split_dates(spark, d):
    return fixtures.candidates(spark, d)


def d08_sample_splits_per_lot(spark, d):
    return splits.sample_splits_per_lot(fixtures.candidates(spark, d))


def d09_eligible_variables(spark, d):
    return fixtures.eligible(spark, d)


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


NUMBERS = ("mean", "std", "range", "r2", "nrmse", "mape", "mean_without_outliers", "std_without_outliers")


def d10_variable_statistics(spark, d):
    return _rounded(fixtures.statistics(spark, d).select("event_name", "num_samples", *NUMBERS), *NUMBERS)


def d12_forecast_targets(spark, d):
    return _rounded(fixtures.targets(spark, d), "event_value")


def d37_value_format(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", value_text((F.col("l_quantity") / 8).cast("string")).alias("eighth"), value_text(F.col("l_returnflag")).alias("flag"))


QUERIES = {f.__name__: f for f in (d02_clean_dates, d03_disambiguate_names, d04_assign_patient_splits, d05_patient_timeline, d07_candidate_split_dates, d08_sample_splits_per_lot, d09_eligible_variables, d10_variable_statistics, d12_forecast_targets, d37_value_format)}
ORACLE = {
    "d02_clean_dates": f"{WITH} SELECT event_category, count(*) AS n, min(date) AS first, max(date) AS last FROM ev WHERE event_value <> '17' GROUP BY 1",
    "d03_disambiguate_names": f"""{WITH} SELECT event_category, event_name, CASE event_category WHEN 'lab' THEN replace(replace(event_descriptive_name, '/', ' per '), '.', ' ')
        WHEN 'lot' THEN 'line of therapy - line_name' WHEN 'progression' THEN 'line of therapy - progression' ELSE event_descriptive_name END AS event_descriptive_name, count(*) AS n FROM ev GROUP BY ALL""",
    "d04_assign_patient_splits": f"""{WITH}, r AS (SELECT patientid, row_number() OVER (ORDER BY {U.format(key="'768921|' || patientid")}, patientid) AS k, least(CAST(floor(0.1 * count(*) OVER ()) AS INT), 500) AS n FROM con)
        SELECT patientid, CASE WHEN k <= n THEN 'validation' WHEN k <= 2 * n THEN 'test' ELSE 'train' END AS data_split FROM r""",
    "d05_patient_timeline": f"{WITH} SELECT DISTINCT *, 'events' AS source FROM ev UNION SELECT patientid, date, biomarker_category, biomarker_event, biomarker_descriptive_name, biomarker_value, 'genetic' FROM mol",
    "d07_candidate_split_dates": f"{WITH}{CANDIDATES} SELECT * FROM cand",
    "d08_sample_splits_per_lot": f"""{WITH}{CANDIDATES}, g AS (SELECT patientid, lot_date, list(date ORDER BY date) AS dates FROM cand GROUP BY ALL)
        SELECT patientid, lot_date, CAST(k AS INT) AS split_idx, dates[1 + CAST(floor({U.format(key="'1|' || patientid || '|' || CAST(lot_date AS VARCHAR) || '|' || CAST(k AS VARCHAR)")} * len(dates)) AS INT)] AS split_date FROM g, range(10) t(k)""",
    "d09_eligible_variables": f"{WITH}{CANDIDATES}{ELIGIBLE} SELECT * FROM elig",
    "d10_variable_statistics": f"{WITH}{CANDIDATES}{STATS} SELECT event_name, num_samples, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)} FROM stat",
    "d12_forecast_targets": f"""{WITH}{CANDIDATES}{ELIGIBLE}{STATS}, ends AS (SELECT c.patientid, c.date, min(l.lot_date) FILTER (l.lot_date > c.date) AS next_lot FROM cand c LEFT JOIN lots l USING (patientid) GROUP BY ALL)
        SELECT x.patientid, x.date, x.event_name, e.date AS target_date, round(greatest(least(TRY_CAST(e.event_value AS DOUBLE), mean + 3 * std), mean - 3 * std), 6) AS event_value
        FROM elig x JOIN ends USING (patientid, date) JOIN ev e ON e.patientid = x.patientid AND e.event_name = x.event_name AND e.event_category = 'lab' LEFT JOIN stat s ON s.event_name = x.event_name
        WHERE e.date - x.date BETWEEN 1 AND 90 AND (next_lot IS NULL OR e.date < next_lot)""",
    "d37_value_format": "SELECT l_orderkey, l_linenumber, regexp_replace(CAST(CAST(round(l_quantity / 8, 2) AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', '') AS eighth, l_returnflag AS flag FROM lineitem",
}

"""Queries of the small table operators, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from voyage.operators import rows as r
from voyage.plans import fixtures, texts
from voyage.plans.fixtures import constant, events, molecular
from voyage.plans.journeys import CANDIDATES, U, WITH
from voyage.plans.texts import BASE


def p03_of_patient(spark, d):
    return r.of_patient(texts.timeline(spark, d), "C1").drop("event_descriptive_name")


def p10_shaped(spark, d):
    return r.shaped(events(spark, d).where("event_category <> 'lab'"), {"event_name": "string", "patientid": "string", "meta_data": "string", "date": "date"})


def p12_without_words(spark, d):
    return r.without_words(events(spark, d), "event_descriptive_name", ("SMALL", "line of")).groupBy("event_descriptive_name").agg(F.count("*").alias("n"))


def p13_with_content(spark, d):
    return r.with_content(spark.read.parquet(f"{d}/documents.parquet"), "text").select("doc_id")


def p14_blanked(spark, d):
    held = r.assert_blank(r.blanked(constant(spark, d), ("race", "birthyear")), ("race", "birthyear"))
    return held.groupBy("gender").agg(F.count("*").alias("n"), F.count("race").alias("n_race"), F.count("birthyear").alias("n_birthyear"))


def j07_compared(spark, d):
    return r.compared(events(spark, d).where("event_category = 'lot'"), events(spark, d).where("event_category = 'progression'"), ("patientid", "date"))


def j16_in_order_of(spark, d):
    lots = events(spark, d).where("event_category = 'lot'").groupBy("patientid").agg(F.count("*").cast("string").alias("n_lots"))
    keys = constant(spark, d).select("patientid", F.substring("patientid", 2, 9).cast("int").alias("place"))
    return r.in_order_of(lots, keys, "patientid", "place")


def j17_labelled(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("patientid"), F.size("embedding").cast("string").alias("width"))
    return r.labelled(constant(spark, d).select("patientid", "gender"), vectors)


def a17_wide(spark, d):
    return r.wide(events(spark, d).where("event_category = 'lab'"), ("patientid", "date"), ("type_small", "type_large"))


def w02_week_gaps(spark, d):
    return r.week_gaps(events(spark, d)).withColumn("weeks", F.round("weeks", 6))


def w07_last_of(spark, d):
    return r.last_of(molecular(spark, d).select("patientid", "biomarker_event", "date", "biomarker_value"), ("patientid", "biomarker_event"), ("date", "biomarker_value"))


def w08_repeated_keys(spark, d):
    return r.repeated_keys(events(spark, d).where("event_category = 'lab'").select("patientid", "date", "event_name", "event_value"), ("patientid", "date", "event_name"))


def w09_latest_of(spark, d):
    side = lambda c: events(spark, d).where(F.col("event_category") == c).select("patientid", "date", F.col("event_value").alias("value"))
    return r.latest_of(side("lot"), side("progression"), ("patientid",))


def o05_draw(spark, d):
    return r.draw(constant(spark, d).select("patientid"), 100, "11", "patientid")


def o06_fraction(spark, d):
    return r.fraction(events(spark, d), 0.25, "12", "patientid").groupBy("patientid").agg(F.count("*").alias("n"))


def o08_one_category(spark, d):
    return r.one_category(fixtures.candidates(spark, d).withColumnRenamed("date", "split_date"), ("death", "lot", "progression"), 3, "13")


def u04_dated_once(spark, d):
    held = events(spark, d).select("patientid", "event_category", F.when(F.col("event_category") != "lot", F.col("date")).alias("date"))
    return r.dated_once(held, ("patientid", "event_category")).groupBy("patientid", "event_category").agg(F.count("*").alias("n"))


def u05_common_ids(spark, d):
    side = lambda c: events(spark, d).where(F.col("event_category") == c)
    return r.common_ids(constant(spark, d), side("lot"), side("progression"), side("death"))


def u06_same_sets(spark, d):
    lots = events(spark, d).where("event_category = 'lot'")
    one, two = r.same_sets(lots, lots.dropDuplicates(["patientid"]), ("patientid",)), r.same_sets(lots, constant(spark, d), ("patientid",))
    return one.withColumn("pair", F.lit("lots")).unionByName(two.withColumn("pair", F.lit("all")))


def u07_replicated(spark, d):
    return r.replicated(constant(spark, d).select("patientid"), 3)


def f14_age_at(spark, d):
    first = events(spark, d).groupBy("patientid").agg(F.min("date").alias("date")).join(constant(spark, d), "patientid")
    return first.select("patientid", r.age_at(F.col("date"), F.make_date("birthyear", F.lit(1), F.lit(1))).alias("age"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "pjawouf" and k[1:3].isdigit()}
ORACLE = {
    "p03_of_patient": f"{BASE} SELECT patientid, date, event_category, event_name, event_value, source FROM tl WHERE patientid = 'C1'",
    "p10_shaped": f"{WITH} SELECT event_name, patientid, CAST(NULL AS VARCHAR) AS meta_data, date FROM ev WHERE event_category <> 'lab'",
    "p12_without_words": f"{WITH} SELECT event_descriptive_name, count(*) AS n FROM ev WHERE NOT regexp_matches(event_descriptive_name, '(?i)small|line of') GROUP BY 1",
    "p13_with_content": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\x09-\x0D\x20]')",
    "p14_blanked": f"{WITH} SELECT gender, count(*) AS n, CAST(0 AS BIGINT) AS n_race, CAST(0 AS BIGINT) AS n_birthyear FROM con GROUP BY 1",
    "j07_compared": f"""{WITH}, a AS (SELECT DISTINCT patientid, date FROM ev WHERE event_category = 'lot'), b AS (SELECT DISTINCT patientid, date FROM ev WHERE event_category = 'progression')
        SELECT coalesce(a.patientid, b.patientid) AS patientid, coalesce(a.date, b.date) AS date, CASE WHEN a.patientid IS NULL THEN 'right_only' WHEN b.patientid IS NULL THEN 'left_only' ELSE 'both' END AS found FROM a FULL JOIN b ON a.patientid = b.patientid AND a.date = b.date""",
    "j16_in_order_of": f"{WITH} SELECT con.patientid, CAST(substr(con.patientid, 2) AS INT) AS place, n_lots FROM con LEFT JOIN (SELECT patientid, CAST(count(*) AS VARCHAR) AS n_lots FROM ev WHERE event_category = 'lot' GROUP BY 1) l USING (patientid)",
    "j17_labelled": f"{WITH} SELECT con.patientid, gender, CAST(len(embedding) AS VARCHAR) AS width FROM con LEFT JOIN embeddings ON con.patientid = 'C' || vec_id",
    "a17_wide": f"{WITH} SELECT patientid, date, min(TRY_CAST(event_value AS DOUBLE)) FILTER (event_name = 'type_small') AS type_small, min(TRY_CAST(event_value AS DOUBLE)) FILTER (event_name = 'type_large') AS type_large FROM ev WHERE event_category = 'lab' GROUP BY 1, 2",
    "w02_week_gaps": f"{WITH} SELECT patientid, date, round(coalesce((date - lag(date) OVER (PARTITION BY patientid ORDER BY date)) / 7, 0), 6) AS weeks FROM (SELECT DISTINCT patientid, date FROM ev)",
    "w07_last_of": f"{WITH} SELECT patientid, biomarker_event, date, biomarker_value FROM (SELECT *, row_number() OVER (PARTITION BY patientid, biomarker_event ORDER BY date DESC, biomarker_value DESC) AS k FROM mol) WHERE k = 1",
    "w08_repeated_keys": f"{WITH} SELECT patientid, date, event_name, event_value FROM (SELECT *, count(*) OVER (PARTITION BY patientid, date, event_name) AS n FROM ev WHERE event_category = 'lab') WHERE n > 1",
    "w09_latest_of": f"{WITH} SELECT patientid, date, event_value AS value FROM (SELECT *, row_number() OVER (PARTITION BY patientid ORDER BY date DESC, event_category DESC, event_value DESC) AS k FROM ev WHERE event_category IN ('lot', 'progression')) WHERE k = 1",
    "o05_draw": f"{WITH} SELECT patientid FROM con ORDER BY {U.format(key="'11|' || patientid")}, patientid LIMIT 100",
    "o06_fraction": f"{WITH} SELECT patientid, count(*) AS n FROM ev WHERE {U.format(key="'12|' || patientid")} < 0.25 GROUP BY 1",
    "o08_one_category": f"""{WITH}{CANDIDATES} SELECT DISTINCT patientid, date AS split_date, ['death', 'lot', 'progression'][1 + CAST(floor({U.format(key="'13|' || patientid || '|' || CAST(date AS VARCHAR) || '|' || CAST(k AS VARCHAR)")} * 3) AS INT)] AS category FROM cand, range(1, 4) t(k)""",
    "u04_dated_once": f"{WITH} SELECT patientid, event_category, CASE WHEN event_category = 'lot' THEN count(*) ELSE count(DISTINCT date) END AS n FROM ev GROUP BY 1, 2",
    "u05_common_ids": f"{WITH} SELECT patientid FROM ev GROUP BY 1 HAVING bool_or(event_category = 'lot') AND bool_or(event_category = 'progression') AND bool_or(event_category = 'death')",
    "u06_same_sets": f"{WITH} SELECT 'lots' AS pair, count(*) = 0 AS same FROM (SELECT patientid FROM ev WHERE event_category = 'lot' EXCEPT SELECT patientid FROM (SELECT patientid, min(date) FROM ev WHERE event_category = 'lot' GROUP BY 1)) UNION ALL SELECT 'all', (SELECT count(DISTINCT patientid) FROM ev WHERE event_category = 'lot') = (SELECT count(*) FROM con)",
    "u07_replicated": f"{WITH} SELECT patientid, CAST(k AS INT) AS copy FROM con, range(3) t(k)",
    "f14_age_at": f"{WITH} SELECT patientid, CAST(floor((min(date) - make_date(birthyear, 1, 1)) / 365) AS INT) AS age FROM ev JOIN con USING (patientid) GROUP BY patientid, birthyear",
}

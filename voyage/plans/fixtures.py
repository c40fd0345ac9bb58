"""Customers as patients: event timelines made of the driver's tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voyage.operators import evaluation, splits
from voyage.sources.tables import once

_ID = "concat('C', CAST(o_custkey AS STRING))"

EVENTS = f"""
SELECT {_ID} AS patientid, CAST(o_orderdate AS DATE) AS date, 'lot' AS event_category, 'line_name' AS event_name,
  'line of therapy' AS event_descriptive_name, o_orderstatus AS event_value FROM {{orders}} WHERE o_orderpriority = '1-URGENT'
UNION ALL
SELECT {_ID}, CAST(o_orderdate AS DATE), 'progression', 'progression', 'progression', 'yes' FROM {{orders}} WHERE o_orderpriority = '2-HIGH'
UNION ALL
SELECT {_ID}, CAST(l_shipdate AS DATE), 'lab', concat('type_', lower(p_type)), concat(lower(p_type), '/quantity'), CAST(CAST(l_quantity AS INT) AS STRING)
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey
UNION ALL
SELECT {_ID}, max(CAST(o_orderdate AS DATE)), 'death', 'death', 'death', 'yes' FROM {{orders}} WHERE o_custkey % 4 = 0 GROUP BY o_custkey
"""

MOLECULAR = f"""
SELECT {_ID} AS patientid, CAST(l_shipdate AS DATE) AS date, 'genetic' AS biomarker_category, concat('nation_', CAST(s_nationkey AS STRING)) AS biomarker_event,
  CASE WHEN l_returnflag = 'R' THEN 'present' ELSE l_returnflag END AS biomarker_value, concat('nation ', CAST(s_nationkey AS STRING)) AS biomarker_descriptive_name
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey WHERE l_linenumber = 1
"""

CONSTANT = """
SELECT concat('C', CAST(c_custkey AS STRING)) AS patientid, CAST(1940 + c_custkey % 50 AS INT) AS birthyear, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
  c_mktsegment AS race, n_name AS ethnicity, concat('enhanced_', r_name) AS indication
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, made once an application and bucketed by patient."""
    return once(spark, "events", sf_dir, lambda: frame(spark, sf_dir, EVENTS), by="patientid")


def molecular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "molecular", sf_dir, lambda: frame(spark, sf_dir, MOLECULAR), by="patientid")


def constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, CONSTANT)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "candidates", sf_dir, lambda: splits.candidate_split_dates(events(spark, sf_dir)), by="patientid")


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "eligible", sf_dir, lambda: splits.eligible_variables(events(spark, sf_dir), candidates(spark, sf_dir)), by="patientid")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "statistics", sf_dir, lambda: splits.variable_statistics(events(spark, sf_dir), candidates(spark, sf_dir)))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return splits.forecast_targets(events(spark, sf_dir), candidates(spark, sf_dir), eligible(spark, sf_dir), statistics(spark, sf_dir))

    return once(spark, "targets", sf_dir, build, by="patientid")


def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "last_values", sf_dir, lambda: evaluation.copy_forward(events(spark, sf_dir), targets(spark, sf_dir)), by="patientid")

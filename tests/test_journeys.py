"""Golden timelines of the ingest and split operators, and their queries against DuckDB."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voyage.functions.numbers import value_text
from voyage.operators import ingest, splits
from voyage.plans import catalog

SMALL = "/root/testdata/sf0.001"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def events(spark):
    rows = [("a", 0, "lot", "line_name", "x"), ("a", 10, "lab", "hb", "5.0"), ("a", 20, "lab", "hb", "7"), ("a", 20, "lot", "line_name", "y"), ("a", 40, "lab", "hb", "n/a"), ("a", 50, "death", "death", "yes"), ("b", 0, "lot", "line_name", "x"), ("b", 5, "lab", "hb", "6")]
    return spark.createDataFrame([(p, day(n), c, e, e, v) for p, n, c, e, v in rows], "patientid string, date date, event_category string, event_name string, event_descriptive_name string, event_value string")


def test_candidates_take_the_nearest_line_and_drop_death_or_the_last_date(events):
    got = {tuple(r) for r in splits.candidate_split_dates(events, 15, 15).collect()}
    assert got == {("a", day(0), day(0)), ("a", day(10), day(0)), ("a", day(20), day(20)), ("b", day(0), day(0))}


def test_dates_without_a_variable_keep_a_null_row(events):
    at = events.select("patientid", "date").where("date in (date '2020-01-01', date '2020-01-11')").distinct()
    got = {tuple(r) for r in splits.eligible_variables(events, at, 30, 30).collect()}
    assert got == {("a", day(0), None), ("a", day(10), "hb"), ("b", day(0), None)}


def test_late_dates_fail_and_missing_ones_go(events):
    holes = events.union(events.limit(1).withColumn("date", F.lit(None).cast("date")))
    assert ingest.clean_dates(holes, "2024-01-01").count() == events.count()
    with pytest.raises(Exception, match="after the cut-off"):
        ingest.clean_dates(events, "2020-01-15").collect()


def test_value_text(spark):
    values = ["100.00", "1.239", "0.50", "abc", None, "1e3", "-2.0"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(value_text(F.col("v")))
    assert [r[0] for r in df.collect()] == ["100", "1.24", "0.5", "abc", None, "1000", "-2"]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)[:10] if isinstance(v, dt.datetime) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SMALL}/{t}'")
    out = catalog.QUERIES[name](spark, SMALL)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert plain(out.collect(), out.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

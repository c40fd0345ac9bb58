"""Weekly series, predictions, survival scores and files on tables written by hand."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voyage.operators import ingest, predictions, series, splits, survival
from voyage.sources import files

DAY = dt.date(2020, 1, 6)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_weekly_series(spark):
    labs = spark.createDataFrame([("p", day(-28), "y", "4"), ("p", day(-7), "y", "7"), ("p", day(14), "y", "9"), ("p", day(-14), "c", "2"), ("p", day(7), "c", "99"), ("p", day(-7), "y", "8")], "patientid string, date date, event_name string, event_value string")
    keys = spark.createDataFrame([("p", DAY, "y"), ("q", DAY, "y")], "patientid string, split_date date, event_name string")
    stats = spark.createDataFrame([("c", 5.0), ("d", 3.5)], "event_name string, mean_without_outliers double")
    rows = series.weekly_series(labs, keys, stats, ("c", "d", "body_weight"), lookback_weeks=5, horizon_days=23).orderBy("week").collect()
    assert [r.week for r in rows] == list(range(-5, 4)) and {r.patientid for r in rows} == {"p"}
    assert [r.event_value for r in rows] == [4.0, 4.0, 5.0, 6.0, 7.0, 7.0, 7.0, 9.0, 9.0]
    assert [r.imputed for r in rows] == [1, 0, 1, 1, 0, 1, 1, 0, 1]
    assert {(r.c, r.d, r.body_weight) for r in rows} == {(2.0, 3.5, 0.0)}
    checks = series.series_checks(series.weekly_series(labs, keys, stats, ("c",), 5, 23), labs, ("c",), 5, 23).first().asDict()
    assert checks.pop("n_series") == 1 and {k for k, v in checks.items() if v} == {"input_values"}  # of one day's values the least counts


def test_weeks_are_made_without_a_joined_grid(spark):
    labs = spark.createDataFrame([("p", day(-28), "y", "4")], "patientid string, date date, event_name string, event_value string")
    keys = spark.createDataFrame([("p", DAY, "y")], "patientid string, split_date date, event_name string")
    stats = spark.createDataFrame([("c", 5.0)], "event_name string, mean_without_outliers double")
    out = series.weekly_series(labs, keys, stats, ("c",))
    assert out.count() == 39 and "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_stacked_series_meet_once(spark):
    rows = spark.createDataFrame([("p", DAY, v, day(n), float(n)) for v, n in (("y", -7), ("y", 0), ("z", 0))], "patientid string, split_date date, event_name string, date date, event_value double")
    later = spark.createDataFrame([("p", DAY, "y", day(n), n + 0.5) for n in (0, 7, 14)], rows.schema)
    out = series.stack_training_series(rows, later, rows.select("patientid", "split_date"), last_n=2)
    got = {(r.item_id, r.timestamp, r.target, r.is_validation) for r in out.collect()}
    assert got == {(f"p_split_{DAY}_var_y", day(n), v, held) for n, v, held in ((-7, -7.0, False), (0, 0.0, False), (7, 7.5, True), (14, 14.5, True))}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_realign_and_features(spark):
    history = spark.createDataFrame([("p", day(40), day(33), "lab", "718_7", "5", "events"), ("p", day(40), day(30), "lab", "718_7", "6", "events"), ("p", day(40), day(39), "genetic", "g", "present", "genetic")], "patientid string, split_date date, date date, event_category string, event_name string, event_value string, source string")
    targets = spark.createDataFrame([("p", day(40), "718_7", day(128))], "patientid string, split_date date, event_name string, target_date date")
    moved = series.realign_split(history, targets).first()
    assert (moved.split_date, moved.split_date_changed, moved.horizon_days) == (day(33), True, 95)
    constant = spark.createDataFrame([("p", 1950, "M", "x")], "patientid string, birthyear int, gender string, indication string")
    got = series.static_features(history, constant).first()
    assert (got.age, got.hemoglobin, got.platelets, got.therapy_name, got.therapy_line_number, got.nr_genetic_events) == (70, 5.0, -1.0, "unknown", -1.0, 1)


def test_copies(spark):
    rows = spark.createDataFrame([("a", 3, [None, 2.0]), ("a", 3, [4.0, None, 6.0, 9.0]), ("b", 2, [None]), ("c", 1, [1.0])], "patientid string, n_targets int, values array<double>")
    got = {r.patientid: [round(v, 6) for v in r["values"]] for r in predictions.nan_mean_copies(rows).collect()}
    assert got == {"a": [3.0, 3.0, 4.0], "b": [round(21 / 7, 6)] * 2, "c": [1.0]}
    votes = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("a", 2, False), ("b", 5, True)], "patientid string, x int, y boolean")
    got = {r.patientid: (r.x, r.y, r.percent) for r in predictions.majority_response(votes, ("x", "y")).collect()}
    assert got == {"a": (1, True, 66.67), "b": (5, True, 100.0)}


def test_c_index_counts_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice("gh"), rng.choice([5, 10, 15, 20, 25, 30]), rng.random() < 0.6, rng.choice([0.1, 0.2, 0.5, 0.9]), rng.choice([0.5, 0.8, 1.0])) for _ in range(120)]
    got = {r.group: r.c_index for r in survival.c_index_ipcw(spark.createDataFrame(rows, "group string, time int, event boolean, risk double, g double"), tau=28).collect()}
    for group in "gh":
        good = total = 0.0
        own = [r for r in rows if r[0] == group]
        for i, j in itertools.permutations(own, 2):
            if i[2] and i[1] < 28 and (j[1] > i[1] or (j[1] == i[1] and not j[2])):
                total += i[4] ** -2
                good += i[4] ** -2 * (1.0 if j[3] < i[3] else 0.5 if j[3] == i[3] else 0.0)
        assert got[group] == pytest.approx(good / total)
    none = spark.createDataFrame([("g", 5, False, 0.1, 1.0)], "group string, time int, event boolean, risk double, g double")
    assert survival.c_index_ipcw(none).first().c_index is None


def test_retry_and_override(spark):
    sampled = spark.createDataFrame([("p", day(0), 0, day(1)), ("p", day(0), 1, day(2)), ("p", day(50), 0, day(60))], "patientid string, lot_date date, split_idx int, split_date date")
    targets = spark.createDataFrame([("p", day(2))], "patientid string, date date")
    got = {(r.lot_date, r.split_idx): (r.split_date, r.replaced) for r in splits.retry_empty_splits(targets, sampled).collect()}
    assert got == {(day(0), 0): (day(2), True), (day(0), 1): (day(2), False), (day(50), 0): (day(60), False)}


def test_cohort_files(spark, tmp_path):
    base = str(tmp_path)
    for cohort in ("lung", "skin"):
        (tmp_path / f"{cohort}_master_events.csv").write_text(f',patientid,date,event_category,event_name,event_value,extra\n0,{cohort}1,2020-01-02,lab,hb,"1,5\n2",x\n1,{cohort}2,,lab,hb,,y\n')
        (tmp_path / f"{cohort}_master_constant.csv").write_text(f"Unnamed: 0,patientid,birthyear\n0,{cohort}1,1950\n")
        (tmp_path / f"{cohort}_master_constant_descriptions.csv").write_text("variable,comment\nbirthyear,year\n")
    assert sorted(files.discover_cohorts(spark, base)) == ["lung", "skin"]
    tables = files.load_cohorts(spark, base)
    rows = {r.patientid: r for r in tables["events"].collect()}
    assert rows["lung1"].date == dt.date(2020, 1, 2) and rows["lung1"].event_value == "1,5\n2" and rows["lung1"].extra == "x" and rows["skin2"].indication == "skin"
    assert rows["lung2"].date is None and rows["lung2"].event_descriptive_name is None and not [c for c in tables["events"].columns if c.startswith("_c") or "Unnamed" in c]
    assert tables["molecular"].count() == 0 and {r.birthyear for r in tables["constant"].collect()} == {1950}
    with pytest.raises(ValueError, match="constant"):
        files.load_cohort(spark, {"events": f"{base}/lung_master_events.csv"})


def test_samples_splits_and_representations(spark, tmp_path):
    rows = spark.createDataFrame([("i", "a", 7, "one", "train"), ("j", "b", 8, "two", "test")], "instruction string, answer string, n int, indication string, data_split string")
    path = f"{tmp_path}/samples"
    files.write_samples(rows, path, ("n",))
    files.write_samples(rows.withColumn("instruction", F.lit("new")), path, ("n",), resume=True)  # both cohorts are there already
    assert {(r.instruction, r.meta.n, r.indication) for r in files.read_samples(spark, path).collect()} == {("i", 7, "one"), ("j", 8, "two")}
    (tmp_path / "map.json").write_text('{"p": "train", "q": "test"}')
    mapping = files.read_split_map(spark, f"{tmp_path}/map.json")
    people = spark.createDataFrame([("p",), ("q",)], "patientid string")
    assert {tuple(r) for r in ingest.given_splits(people, mapping).collect()} == {("p", "train"), ("q", "test")}
    with pytest.raises(Exception, match="no split for patient"):
        ingest.given_splits(people, mapping.where("patientid = 'p'")).collect()
    np.savez(tmp_path / "r.npz", ids=np.array(["p", "q"]), values=np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert {(r.patientid, tuple(r["values"])) for r in files.read_representations(spark, f"{tmp_path}/r.npz").collect()} == {("p", (1.0, 2.0)), ("q", (3.0, 4.0))}
    (tmp_path / "r.csv").write_text("id,a,b\np,1,2\n")
    assert list(files.read_representations(spark, f"{tmp_path}/r.csv").first()["values"]) == [1.0, 2.0]

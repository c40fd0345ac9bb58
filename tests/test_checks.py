"""Checks, fingerprints, round trips, imports and files: what they accept and what they must find."""

import csv
import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voyage.operators import evaluation, ingest, parsing, rows, series, survival, text
from voyage.sources import files

DAY = dt.date(2020, 1, 6)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of two kilobytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("2000", "0"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_is_read_in_splits(spark, tmp_path, small_splits, end):
    """Quotes, breaks and commas in values, over the bounds of splits, as DuckDB's reader has them."""
    rng = random.Random(1)
    value = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", " ", "é", "word "]) for _ in range(rng.randrange(0, 30)))
    want = [(str(k), value() + "x", value() + "y") for k in range(1200)] + [("last", "z" * 9000 + "\n" * 3000 + "z", "")]
    path = tmp_path / "quoted.csv"
    with path.open("w", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["", "id", "said", "more"])
        out.writerows([k, *r] for k, r in enumerate(want))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
    got = files.read_csv(spark, str(path))
    assert got.columns == ["id", "said", "more"]
    got = sorted((r.id, r.said, r.more or "") for r in got.collect())
    assert got == sorted(want)
    theirs = duckdb.sql(f"select id, said, coalesce(more, '') from read_csv('{path}', all_varchar = true, header = true, quote = '\"', escape = '\"', max_line_size = 20000000, parallel = false)").fetchall()
    assert got == sorted(theirs)


def test_csv_of_several_headers_and_broken_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,x\n1,2\n\n3,\"4\n5\"\n")
    (tmp_path / "b.csv").write_text('"x","the\nid",id\n7,8,9\n')
    (tmp_path / "empty.csv").write_text("id,x\n")
    got = {(r.id, r.x, r["the\nid"]) for r in files.read_csv(spark, [f"{tmp_path}/{n}.csv" for n in ("a", "b", "empty")]).collect()}
    assert got == {("1", "2", None), ("3", "4\n5", None), ("9", "7", "8")}
    (tmp_path / "odd.csv").write_text('id,x\n1,"2\n3,4\n')
    with pytest.raises(Exception, match="unbalanced quotes"):
        files.read_csv(spark, f"{tmp_path}/odd.csv").collect()


def test_batches_count_once_they_are_in_the_manifest(spark, tmp_path):
    frame = lambda data: spark.createDataFrame(data, "instruction string, answer string, n int, indication string, data_split string")
    one, two = [("i", "a", 1, "lung", "train"), ("j", "b", 2, "lung", "test")], [("k", "c", 3, "lung", "train"), ("l", "d", 4, "skin", "train")]
    path = f"{tmp_path}/samples"
    said = lambda: sorted((r.instruction, r.meta.n, r.batch) for r in files.read_samples(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        said()
    spark.range(3).selectExpr("'half' AS instruction", "'x' AS answer", "named_struct('n', 9) AS meta", "'lung' AS indication", "'train' AS data_split").write.partitionBy("indication", "data_split").json(f"{path}/batch=one")  # a lost driver's
    with pytest.raises(FileNotFoundError):
        said()
    for _ in range(2):
        files.write_samples(frame(one), path, ("n",), batch="one", resume=True)
    assert said() == [("i", 1, "one"), ("j", 2, "one")]
    files.write_samples(frame(two), path, ("n",), batch="two", resume=True)
    assert said() == [("i", 1, "one"), ("j", 2, "one"), ("l", 4, "two")]
    assert {tuple(r) for r in files.finished(spark, path).collect()} == {("one", '{"data_split": "train", "indication": "lung"}', 1), ("one", '{"data_split": "test", "indication": "lung"}', 1), ("two", '{"data_split": "train", "indication": "skin"}', 1)}
    files.write_samples(frame(two), path, ("n",), batch="new")
    assert said() == [("k", 3, "new"), ("l", 4, "new")]
    files.write_samples(frame([]), path, ("n",), batch="none", resume=True)
    assert said() == [("k", 3, "new"), ("l", 4, "new")]


def test_split_map_comes_back(spark, tmp_path):
    people = spark.createDataFrame([(f"p{k}", ("train", "test")[k % 2]) for k in range(50)] + [('q"u', "validation")], "patientid string, data_split string")
    files.write_split_map(people, f"{tmp_path}/map")
    assert sorted(files.read_split_map(spark, f"{tmp_path}/map").collect()) == sorted(people.collect())
    (tmp_path / "map.json").write_text('{\n  "p": "train",\n  "q": "test"\n}')
    assert sorted(tuple(r) for r in files.read_split_map(spark, f"{tmp_path}/map.json").collect()) == [("p", "train"), ("q", "test")]


@pytest.mark.parametrize(("n", "gone", "fails"), [(100_000, 49, False), (100_000, 50, True), (40_000, 41, True), (10_000, 9, False), (10_000, 10, True), (100, 0, False), (100, 1, True)])
def test_either_limit_of_missing_predictions_fails(spark, n, gone, fails):
    keys = spark.range(n).select(F.concat(F.lit("p"), F.col("id") % 100).alias("patientid"), F.lit("y").alias("event_name"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), "id")
    pred = keys.where(F.col("id") >= gone).withColumn("event_value", F.lit(1.0))
    out = series.complete_predictions(pred, keys.drop("id"))
    if fails:
        with pytest.raises(Exception, match="too many predictions"):
            out.collect()
    else:
        assert out.where("missing").count() == gone


def test_realignment_looks_at_the_variable_within_the_look_back(spark):
    split = day(400)
    history = [("p", split, split - dt.timedelta(days=n), "lab", v, "events") for v, n in (("on", 14), ("on", 7), ("off", 10), ("old", 183), ("old", 7))]
    history += [("p", split, split - dt.timedelta(days=3), "lab", "other", "events"), ("p", split, split - dt.timedelta(days=1), "genetic", "gene", "genetic")]
    rows_ = spark.createDataFrame(history, "patientid string, split_date date, date date, event_category string, event_name string, source string")
    targets = spark.createDataFrame([("p", split, v, split + dt.timedelta(days=n)) for v, n in (("on", 88), ("off", 40), ("off", 84), ("old", 7), ("none", 7))], "patientid string, split_date date, event_name string, target_date date")
    got = {r.event_name: (r.split_date, r.split_date_changed, r.horizon_days) for r in series.realign_split(rows_, targets).collect()}
    last = split - dt.timedelta(days=3)
    assert got == {"on": (split, False, 84), "off": (last, True, 87), "old": (split, False, 84), "none": (split, False, 84)}


def test_series_checks_find_each_breach(spark):
    labs = spark.createDataFrame([("p", day(-28), "y", "4"), ("p", day(-7), "y", "7"), ("p", day(14), "y", "9"), ("p", day(-14), "c", "2")], "patientid string, date date, event_name string, event_value string")
    keys = spark.createDataFrame([("p", DAY, "y")], "patientid string, split_date date, event_name string")
    stats = spark.createDataFrame([("c", 5.0)], "event_name string, mean_without_outliers double")
    good = series.weekly_series(labs, keys, stats, ("c",), 5, 23)
    found = lambda s, l=labs: {k for k, v in series.series_checks(s, l, ("c",), 5, 23).first().asDict().items() if v and k != "n_series"}
    assert found(good) == set()
    assert found(good.where("week <> -5")) == {"input_length", "input_begin"}
    assert found(good.where("week <> 0")) == {"input_length", "input_end"}
    assert found(good.where("week <> -2")) == {"input_length", "input_steps"}
    assert found(good.where("week <> 1")) == {"target_length", "target_begin"}
    assert found(good.where("week <> 3")) == {"target_length", "target_end"}
    assert found(good.withColumn("event_value", F.when(F.col("week") != -3, F.col("event_value")))) == {"input_holes"}
    assert found(good.withColumn("event_value", F.when(F.col("week").between(-1, 0), 99.0).otherwise(F.col("event_value")))) == {"input_values"}
    assert found(good.withColumn("event_value", F.when(F.col("week") > 1, 99.0).otherwise(F.col("event_value")))) == {"target_values"}
    assert found(good.withColumn("c", F.when(F.col("week") == 2, 1.0).otherwise(F.col("c")))) == {"frozen"}
    off = labs.union(spark.createDataFrame([("p", day(-10), "y", "7"), ("p", day(11), "y", "5")], labs.schema))
    assert found(good, off) == {"input_dates", "target_dates", "target_values"}


def test_series_checks_send_no_rows_through_the_driver(spark, tmp_path):
    """Packed files of long series look small; a join that takes them for small holds all their rows in the driver."""
    labs = spark.range(2000).selectExpr("concat('p', id % 20) AS patientid", "date_add(date'2020-01-06', cast(id % 97 AS int) - 60) AS date", "concat('v', id % 3) AS event_name", "cast(id % 7 AS string) AS event_value")
    keys = labs.select("patientid", F.lit(DAY).alias("split_date"), "event_name").distinct()
    weekly = series.weekly_series(labs, keys, spark.createDataFrame([("v0", 5.0)], "event_name string, mean_without_outliers double"), ("v0",))
    for name, df in (("weekly", weekly), ("labs", labs)):
        df.write.parquet(str(tmp_path / name))
    out = series.series_checks(spark.read.parquet(str(tmp_path / "weekly")), spark.read.parquet(str(tmp_path / "labs")), ("v0",))
    assert 0 < out.first().n_series <= 60
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_features_as_of_equal_those_of_the_history(spark):
    rng = random.Random(6)
    names = [("lab", "718_7", "events"), ("lab", "26515_7", "events"), ("lot", "line_name", "events"), ("lot", "line_number", "events"), ("diagnosis", "d", "events"), ("genetic", "g", "genetic")]
    timeline = [(f"p{rng.randrange(4)}", day(rng.randrange(0, 1200)), *(names[rng.randrange(6)]), str(rng.randrange(90))) for _ in range(300)]
    timeline = spark.createDataFrame(sorted(set(timeline)), "patientid string, date date, event_category string, event_name string, source string, event_value string")
    splits = spark.createDataFrame([(f"p{p}", day(n)) for p in range(4) for n in range(100, 1300, 90)], "patientid string, split_date date")
    constant = spark.createDataFrame([(f"p{p}", 1950 + p, "M", "x") for p in range(4)], "patientid string, birthyear int, gender string, indication string")
    want = series.static_features(text.history_of(timeline, splits), constant)
    got = series.static_features_at(timeline, splits, constant).select(want.columns)
    assert want.count() > 40 and sorted(map(str, got.join(want.select("patientid", "split_date"), ["patientid", "split_date"], "left_semi").select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_fingerprints_tell_order_free_what_differs(spark, tmp_path):
    data = [(f"p{k % 7}", DAY, "y", day(k), float(k)) for k in range(40)]
    frame = lambda x: spark.createDataFrame(x, "patientid string, date date, event_name string, target_date date, event_value double")
    evaluation.store_run(frame(data), f"{tmp_path}/run")
    differ = lambda x: {r.field for r in evaluation.fingerprint_differences(f"{tmp_path}/run", frame(x)).collect() if not r.same}
    assert differ(data[::-1]) == set()
    assert differ([*data[:-1], (*data[-1][:4], 0.5)]) == {"rows"}
    assert differ([*data[:-2], data[-1], data[-1]]) == {"rows", "n_dates", "n_values"}
    swapped = [("q" if r[0] == "p3" else r[0], *r[1:]) for r in data]
    assert differ(swapped) == {"rows", "ids"}
    assert {tuple(r) for r in evaluation.ids_apart(f"{tmp_path}/run", frame(swapped)).collect()} == {("p3", "stored"), ("q", "now")}


def test_round_trip_finds_damage_and_skips_what_it_is_told(spark):
    schema = "patientid string, split_date date, date date, event_name string, event_descriptive_name string, event_value string, source string"
    wrote = [("p", DAY, day(-k), n, d, v, s) for k, (n, d, v, s) in enumerate([("hb", "Hemoglobin", "5", "events"), ("HB", "Hemoglobin", "Yes", "events"), ("g", "Gene X", "present", "genetic"), ("w", "Body Weight", "70", "events")])]
    read = [(*r[:3], r[3].lower(), *r[4:]) for r in wrote]
    read[0] = (*read[0][:5], "6", "events")
    read[2] = (*read[2][:5], "absent", "genetic")
    read[3] = (*read[3][:5], "71", "events")
    check = lambda **o: sorted((r.event_name, r.event_value, r.side) for r in parsing.round_trip_check(spark.createDataFrame(wrote, schema), spark.createDataFrame(read, schema), **o).collect())
    hb, gene, weight = [("hb", "5", "first"), ("hb", "6", "second")], [("g", "absent", "second"), ("g", "present", "first")], [("w", "70", "first"), ("w", "71", "second")]
    assert check(share=1.0) == sorted(hb + gene + weight)
    assert check(share=1.0, skip_genetic=True, skip=("WEIGHT",)) == hb
    assert check(share=0.0) == []
    answers = spark.createDataFrame([("p", "death", False, True), ("q", "lot", True, False)], "patientid string, target_name string, censored boolean, occurred boolean")
    other = spark.createDataFrame([("p", "death", False, False)], answers.schema)
    assert {tuple(r) for r in parsing.answers_apart(answers, other, ("patientid",), share=1.0).collect()} == {("p", "occurred", "true", "false"), ("q", "target_name", "lot", None), ("q", "censored", "true", None), ("q", "occurred", "false", None)}


def test_meds_constants_become_columns(spark):
    codes = spark.createDataFrame([("SEX", "sex of patient"), ("EYES", "colour of eyes"), ("HB", "hemoglobin")], "code string, description string")
    schema = "subject_id int, time date, code string, numeric_value double, text_value string"
    data = [(1, None, "SEX", None, "F"), (1, None, "EYES", 3.0, None), (2, None, "SEX", None, "M"), (2, None, "SEX", None, "F"), (3, DAY, "HB", 5.0, None), (3, DAY, "HB", 5.0, None), (3, DAY, "HB", None, None), (4, None, "EYES", None, None)]
    split = spark.createDataFrame([(1, "train"), (2, "test")], "subject_id int, split string")
    events, constant, described, again = ingest.from_meds(codes, spark.createDataFrame(data, schema), split)
    assert constant.columns == ["patientid", "EYES", "SEX", "split"]
    assert {tuple(r) for r in constant.collect()} == {("1", "3.0", "F", "train"), ("2", None, "F", "test"), ("4", None, None, None)}
    assert {tuple(r) for r in described.collect()} == {("patientid", "No description available"), ("EYES", "colour of eyes"), ("SEX", "sex of patient"), ("split", "No description available")}
    assert sorted(r.event_value for r in events.collect()) == ["5.0", "5.0", "present"] and again.first().n == 2
    with pytest.raises(ValueError, match="more than 1 codes"):
        ingest.from_meds(codes, spark.createDataFrame(data, schema), split, most_constants=1)
    with pytest.raises(Exception, match="no description of HB"):
        ingest.from_meds(codes.where("code <> 'HB'"), spark.createDataFrame(data, schema), split)[0].collect()


def test_scores_by_trial(spark):
    people = [(f"t{k % 2}_p{k}", "death", 50 + 10 * k, k % 3 > 0, ("t0", "t1")[k % 2]) for k in range(20)]
    targets = spark.createDataFrame(people, "patientid string, category string, time int, event boolean, trial_id string")
    pred = targets.select("patientid", "category", F.lit(20).alias("week"), (F.col("time") / 300).alias("survival"))
    train = targets.select(F.concat(F.lit("x"), "patientid").alias("patientid"), "category", (F.col("time") - 40).alias("time"), "event")
    out = {r.trial_id: r for r in survival.survival_eval(pred, targets, train, by=("trial_id",), within_training=False).collect()}
    assert {k: r.n for k, r in out.items()} == {"t0": 10, "t1": 10} and all(r.c_index == 1.0 and r.brier is not None for r in out.values())
    held = survival.survival_eval(pred, targets, train, by=("trial_id",)).collect()
    assert sum(r.n for r in held) == sum(p[2] <= 200 for p in people)


def test_log_probabilities_maps_and_white_space(spark):
    frame = spark.createDataFrame([(1, [0.1, 0.2, 0.3], 1), (2, [0.1], 1), (3, [0.1], 2), (4, None, 0)], "k int, p array<double>, n int")
    got = {r.k: r.x for r in frame.select("k", parsing.completion_logprobs(F.col("p"), F.col("n")).alias("x")).collect()}
    assert got == {1: [0.2, 0.3], 2: [], 3: None, 4: None}
    targets = spark.createDataFrame([("p", DAY, "hb", "Hemoglobin", day(14)), ("p", DAY, "hb", "Hemoglobin", day(7)), ("p", DAY, "w", None, day(10))], "patientid string, split_date date, event_name string, event_descriptive_name string, target_date date")
    meta = text.forecast_meta(targets).first()
    assert meta.weeks == {"hb": [1.0, 2.0], "w": [10 / 7]} and meta.names == {"hb": "Hemoglobin", "w": "w"}
    both = text.forecast_meta(targets).select(text.merged_maps(F.col("names"), F.create_map(F.lit("w"), F.lit("weight"))).alias("a"), text.merged_maps(F.lit(None).cast("map<string,string>"), F.col("names")).alias("b")).first()
    assert both.a == {"hb": "Hemoglobin", "w": "weight"} and both.b == meta.names
    blank = spark.createDataFrame([(1, " \t\n\r\x0b\x0c"), (2, "\ta"), (3, ""), (4, None)], "k int, t string")
    assert [r.k for r in rows.with_content(blank, "t").collect()] == [2]


@pytest.mark.parametrize(("kind", "wide"), [("<f4", 24), ("<f8", 1), ("<i2", 7), (">f8", 33)])
def test_arrays_are_read_by_rows(spark, tmp_path, small_splits, kind, wide):
    """Rows that splits cut, of types and widths that do not divide the header."""
    rng = np.random.default_rng(1)
    values, ids = (rng.normal(size=(700, wide)) * 100).astype(kind), np.array([f"pé{k}" for k in range(700)])
    np.save(tmp_path / "values.npy", values)
    np.save(tmp_path / "ids.npy", ids)
    got = {r.patientid: r["values"] for r in files.read_representations(spark, f"{tmp_path}/values.npy", f"{tmp_path}/ids.npy").collect()}
    assert got == {i: v.astype(float).tolist() for i, v in zip(ids.tolist(), values, strict=True)}
    np.save(tmp_path / "turned.npy", np.asfortranarray(values[:, : min(wide, 5)]))
    if wide > 1:
        with pytest.raises(ValueError, match="one after the other"):
            files.read_npy(spark, f"{tmp_path}/turned.npy")


def test_lines_without_quotes_stay_where_they_are_read(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.csv").write_text("id,x\r\n" + "".join(f"{n}{k},{k}\r\n" for k in range(9)))
    out = files.csv_records(spark, str(tmp_path))
    got = sorted((r.file[-5:], r.record, r.text) for r in out.collect())
    assert got == sorted((f"{n}.csv", k + 1, f"{n}{k},{k}" if k >= 0 else "id,x") for n in "ab" for k in range(-1, 9))
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not [line for line in final.splitlines() if "Sort [" in line and " at#" in line]


def test_survival_rows_are_worked_out_once(spark):
    from voyage.plans import evaluations

    assert "Join" not in evaluations._survival(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_targets_and_their_csv_lines_are_not_moved(spark):
    """Behind the events nothing that grows with the rows is shuffled, whatever is too large to be sent to all tasks."""
    from voyage.plans import checks, fixtures
    from voyage.sources.tables import forget

    d, limit = "/root/testdata/sf0.01", "spark.sql.autoBroadcastJoinThreshold"
    before, stages = spark.conf.get(limit), spark.sparkContext._jsc.sc().statusStore()
    forget(spark, "candidates", "eligible", "statistics", "targets")
    fixtures.events(spark, d).count()
    tracker, moved = spark.sparkContext.statusTracker(), 0
    spark.conf.set(limit, "-1")
    spark.sparkContext.setJobGroup("csv", "targets and their lines")
    try:
        assert checks.s07_csv_glob(spark, d).count() > 0
    finally:
        spark.conf.set(limit, before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for job in tracker.getJobIdsForGroup("csv"):
        for stage in tracker.getJobInfo(job).stageIds:
            data = stages.lastStageAttempt(stage)
            moved += 0 if data.status().toString() == "SKIPPED" else data.shuffleWriteRecords()
    assert 0 < moved < fixtures.targets(spark, d).count()

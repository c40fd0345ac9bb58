"""Golden rows of caps, censoring curves, scores, landmarks and week starts."""

import datetime as dt

from voyage.operators import evaluation, landmarks


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_caps_hold_three_deviations_and_leave_unknown_variables(spark):
    rows = spark.createDataFrame([("hb", 0.0), ("hb", 10.0), ("hb", 20.0), ("hb", None), ("x", 99.0)], "event_name string, event_value double")
    stats = spark.createDataFrame([("hb", 10.0, 2.0, 10.0, 1.0)], "event_name string, mean double, std double, mean_without_outliers double, std_without_outliers double")
    got = {mode: sorted(map(tuple, evaluation.cap_outliers(rows, stats, mode).collect()), key=str) for mode in evaluation.BOUNDS}
    assert got["raw"] == sorted([("hb", 4.0, -1), ("hb", 10.0, 0), ("hb", 16.0, 1), ("hb", None, 0), ("x", 99.0, 0)], key=str)
    assert got["clean"] == sorted([("hb", 7.0, -1), ("hb", 10.0, 0), ("hb", 13.0, 1), ("hb", None, 0), ("x", 99.0, 0)], key=str)
    assert got["zscore"] == sorted([("hb", -6.0, -1), ("hb", 0.0, 0), ("hb", 6.0, 1), ("hb", None, 0), ("x", 99.0, 0)], key=str)


def test_censoring_curve_and_brier_score(spark):
    rows = spark.createDataFrame([("a", 1, True, 0.5), ("a", 2, False, 0.5), ("a", 2, True, 0.5), ("a", 3, False, 0.5)], "group string, time int, event boolean, survival double")
    g = evaluation.km_censoring(rows)
    assert {(r["time"], round(r["g"], 9)) for r in g.collect()} == {(1, 1.0), (2, 0.5), (3, 0.0)}
    got = evaluation.brier_ipcw(rows, g, 2).collect()[0]
    assert (round(got["brier"], 9), got["n"]) == (0.3125, 4)
    assert evaluation.brier_ipcw(rows, g, 9).collect()[0]["brier"] is None


def test_week_starts_and_back(spark):
    rows = spark.createDataFrame([("a", "hb", day(0)), ("a", "hb", day(9))], "patientid string, event_name string, date date")
    moved = evaluation.align_week_start(rows)
    assert {r["date"] for r in moved.collect()} == {day(-2), day(7)}
    assert {r["date"] for r in evaluation.restore_dates(moved).collect()} == {day(0), day(9)}


def test_landmark_times(spark):
    rows = [("a", 0, "lot"), ("a", 7, "progression"), ("a", 14, "lot"), ("a", 21, "death")]
    events = spark.createDataFrame([(p, day(n), c) for p, n, c in rows], "patientid string, date date, event_category string")
    at = spark.createDataFrame([("a", day(0)), ("a", day(21)), ("a", day(14))], "patientid string, date date")
    got = {(r["date"], r["category"], r["true_time"], r["true_censoring"]) for r in landmarks.landmark_times(events, at).collect()}
    assert got == {
        (day(0), "progression", 1.0, False), (day(0), "lot", 2.0, False), (day(0), "death", 2.0, True), (day(14), "death", 1.0, False), (day(14), "lot", 1.0, True), (day(14), "progression", 1.0, True),
        (day(21), "death", 0.0, True), (day(21), "lot", 0.0, True), (day(21), "progression", 0.0, True),
    }


def test_scaled_labs_need_no_targets(spark):
    from voyage.plans import evaluations
    from voyage.sources import tables

    tables.forget(spark)
    assert evaluations.d19_cap_outliers(spark, "/root/testdata/sf0.001").count()
    assert {k[1] for k in tables._made if k[0] == spark.sparkContext.applicationId} == {"events", "candidates", "statistics"}


def test_scores_count_splits_patients_and_dates_without_copies_of_rows(spark):
    rows = [(p, day(s), n, day(s + g), float(g)) for p, s, n, g in [("a", 0, "hb", 1), ("a", 0, "hb", 2), ("a", 9, "hb", 1), ("b", 0, "hb", 1), ("b", 0, "x", 1), ("c", 9, "x", 2)]]
    target = spark.createDataFrame(rows, "patientid string, date date, event_name string, target_date date, event_value double")
    stats = spark.createDataFrame([("hb", 1.0, 9.0)], "event_name string, mean_without_outliers double, std_without_outliers double").selectExpr("*", "mean_without_outliers as mean", "std_without_outliers as std")
    moved = target.selectExpr("patientid", "date", "event_name", "target_date", "event_value + 1 as event_value")
    out = evaluation.forecast_eval(moved, target, moved, stats)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["event_name"]: (r["n_samples"], r["n_splits"], r["n_patients"], r["n_dates"], r["mae"], r["nmae"]) for r in out.collect()}
    assert got == {"hb": (4, 3, 2, 3, 1.0, 1.0), "x": (2, 2, 2, 2, 1.0, 1.0)}

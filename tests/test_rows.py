"""Small table operators on rows written by hand, and properties of timelines, caps and scores."""

import pytest

from voyage.operators import evaluation, ingest, rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("p", 1, "Alpha beta", ["x"]), ("p", 2, None, []), ("q", 1, " ", None), ("q", 1, " ", None), ("r", None, "gamma", ["y"])], "patientid string, date int, text string, list array<string>")


def test_filters(table):
    assert rows.without_words(table, "text", ("BETA", "a+b")).count() == 4
    assert [r.text for r in rows.with_content(table, "text").orderBy("text").collect()] == ["Alpha beta", "gamma"]
    assert rows.with_content(table, "list").count() == 2
    assert rows.shaped(table, {"x": "double", "date": "string"}).dtypes == [("x", "double"), ("date", "string")]
    assert rows.assert_blank(rows.blanked(table, ("text",)), ("text",)).where("text is null").count() == 5
    with pytest.raises(Exception, match="text is not blank"):
        rows.assert_blank(table, ("text",)).collect()


def test_keys(table, spark):
    other = spark.createDataFrame([("p", 1), ("s", 1)], "patientid string, date int")
    assert {tuple(r) for r in rows.compared(table, other, ("patientid",)).collect()} == {("p", "both"), ("q", "left_only"), ("r", "left_only"), ("s", "right_only")}
    assert rows.same_sets(table, table.limit(5), ("patientid",)).first().same and not rows.same_sets(table, other, ("patientid",)).first().same
    assert [r.patientid for r in rows.common_ids(table, other).collect()] == ["p"]
    assert rows.repeated_keys(table, ("patientid", "date")).count() == 2
    assert rows.dated_once(table.unionByName(table.where("date is null")), ("patientid",)).count() == 5
    assert {(r.patientid, r.date) for r in rows.last_of(table, ("patientid",), ("date",)).collect()} == {("p", 2), ("q", 1), ("r", None)}


def test_draws(table):
    one = [tuple(r) for r in rows.draw(table.select("patientid").distinct(), 2, "s", "patientid").collect()]
    assert len(one) == 2 and one == [tuple(r) for r in rows.draw(table.select("patientid").distinct().repartition(3), 2, "s", "patientid").collect()]
    assert rows.fraction(table, 0.0, "s", "patientid").count() == 0 and rows.fraction(table, 1.1, "s", "patientid").count() == 5
    assert rows.replicated(table, 3).count() == 15


def test_caps_are_idempotent(spark):
    stats = spark.createDataFrame([("a", 5.0, 1.0, 5.0, 1.0)], "event_name string, mean double, std double, mean_without_outliers double, std_without_outliers double")
    values = spark.createDataFrame([("a", v) for v in (-9.0, 4.0, 20.0)] + [("a", None), ("b", 99.0)], "event_name string, event_value double")
    once = evaluation.cap_outliers(values, stats, "raw").drop("capped")
    twice = evaluation.cap_outliers(once, stats, "raw")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.drop("capped").collect())) and twice.where("capped <> 0").count() == 0


def test_brier_without_censoring_is_the_plain_score(spark):
    held = [("g", t, True, s) for t, s in ((5, 0.9), (10, 0.2), (20, 0.7), (30, 0.4))]
    df = spark.createDataFrame(held, "group string, time int, event boolean, survival double")
    plain = sum(s * s if t <= 12 else (1 - s) ** 2 for _, t, _, s in held) / 4
    assert evaluation.brier_ipcw(df, evaluation.km_censoring(df), 12).first().brier == pytest.approx(plain)


def test_timeline_drops_repeats_of_a_side(spark):
    ev = spark.createDataFrame([("p", "d", "c", "n", "x", "v")] * 3, "patientid string, date string, event_category string, event_name string, event_descriptive_name string, event_value string")
    mol = spark.createDataFrame([("p", "d", "c", "n", "v", "x")] * 2, "patientid string, date string, biomarker_category string, biomarker_event string, biomarker_value string, biomarker_descriptive_name string")
    assert sorted(r.source for r in ingest.patient_timeline(ev, mol).collect()) == ["events", "genetic"]


def test_one_name_for_several_events_fails(spark):
    ev = spark.createDataFrame([("c", "n", "x"), ("c", "m", "x")], "event_category string, event_name string, event_descriptive_name string")
    with pytest.raises(Exception, match="one name for several events"):
        ingest.unique_events(ev).collect()
    assert ingest.null_dates(spark.createDataFrame([("2020-01-01",), (None,)], "date string")).first() == (1, 1)

"""Timelines and tasks as text, and the way back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voyage.functions import wording as w
from voyage.operators import landmarks, parsing, text

DAY = dt.date(2020, 1, 6)
COLUMNS = "patientid string, split_date date, date date, event_category string, event_name string, event_descriptive_name string, event_value string, source string"


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def rows(spark):
    end = day(40)
    return spark.createDataFrame(
        [
            ("p", end, day(0), "lab", "718_7", "hemoglobin", "11.5", "events"), ("p", end, day(0), "drug", "x", "aspirin", "Given", "events"),
            ("p", end, day(0), "genetic", "b", "gene b", "present", "genetic"), ("p", end, day(0), "genetic", "a", "gene a - - type", "V600E", "genetic"),
            ("p", end, day(10), "genetic", "b", "gene b", "absent", "genetic"), ("p", end, day(24), "lot", "line_name", "line of therapy", "chemo", "events"), ("p", end, day(24), "death", "death", "death", "yes", "events"),
        ], COLUMNS,
    )


WANT = (
    "\nOn the first visit, the patient experienced the following: \n\t<genetic>\n\tgene a -  type is V600E,\n\tgene b,\n\t</genetic>,\n\tdrug aspirin is given,\n\themoglobin is 11.5.\n"
    "\n1.43 weeks later, the patient visited and experienced the following: \n\t<genetic>\n\tgene b is absent,\n\t</genetic>.\n"
    "\n2 weeks later, the patient visited and experienced the following: \n\tdeath,\n\tline of therapy is chemo.\n"
)


def test_timeline_text(rows):
    assert [r.text for r in text.timeline_text(rows).collect()] == [WANT]
    cumulative = text.timeline_text(rows, cumulative=True).first().text
    assert "\n3.43 weeks later" in cumulative
    since = text.timeline_text(rows.withColumn("zero", F.lit(day(-7)).cast("date")), start="zero", first_preamble=False).first().text
    assert since.startswith("\n1 weeks later") and text.timeline_text(rows.limit(0)).count() == 0


def test_summary_meets_the_history_once(rows):
    asked = rows.select("patientid", "split_date", F.lit("718_7").alias("event_name")).distinct()
    out = text.summary_text(rows, asked)
    said = out.first().summary
    assert said.endswith("\nThe most recent line of therapy:\n\tchemo\n\nThe last values of the variables in the input data are:\n\themoglobin was 11.5\n") and "\tgene a - - type is V600E,\n\tgene b is absent,\n" in said
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_round_trip(rows):
    names = rows.select(F.regexp_replace("event_descriptive_name", r"(\s-\s-)+", " - ").alias("event_descriptive_name"), "event_category", "event_name", "source").distinct()
    wrote = text.timeline_text(rows).withColumn("start_date", F.lit(day(0)).cast("date"))
    back = parsing.parse_timeline_text(wrote, names)
    got = {(r.date, r.event_category, r.event_name, r.event_value, r.source) for r in back.collect()}
    assert (day(10), "genetic", "b", "absent", "genetic") in got and (day(24), "death", "death", "death", "events") in got and len(got) == 7
    assert (day(0), "drug", "x", "given", "events") in got and (day(0), "genetic", "b", "present", "genetic") in got


def test_budget_keeps_first_visit_and_newest(rows):
    kept = text.history_within_budget(rows, 0).select("date").distinct().collect()
    assert [r.date for r in kept] == [day(0)]
    assert text.history_within_budget(rows, 10_000).count() == 7
    dates = {r.date for r in text.history_within_budget(rows, 220).collect()}
    assert day(0) in dates and (day(24) in dates or len(dates) == 1)


def test_summary(rows, spark):
    asked = spark.createDataFrame([("p", day(40), "718_7")], "patientid string, split_date date, event_name string")
    said = text.summary_text(rows, asked).first().summary
    assert "\tgene b is absent," in said and "\tchemo\n" in said and said.endswith("\themoglobin was 11.5\n")


def test_event_tasks_censoring(spark):
    def ev(p, n, c):
        return (p, day(n), c, "death" if c == "death" else c)

    events = spark.createDataFrame(
        [
            ev("hit", 0, "lab"), ev("hit", 30, "progression"), ev("hit", 400, "lab"), ev("lot", 0, "lab"), ev("lot", 20, "lot"), ev("lot", 30, "progression"), ev("lot", 400, "lab"),
            ev("dead", 0, "lab"), ev("dead", 30, "death"), ev("end", 0, "lab"), ev("end", 21, "lab"), ev("none", 0, "lab"), ev("free", 0, "lab"), ev("free", 400, "lab"),
        ], "patientid string, date date, event_category string, event_name string",
    )
    splits = events.select("patientid").distinct().withColumn("split_date", F.lit(DAY).cast("date"))
    tasks = landmarks.event_tasks(events, splits, ("progression",), weeks=(8,))
    got = {r.patientid: (r.occurred, r.censored) for r in tasks.collect()}
    assert got == {"hit": (True, None), "lot": (False, "lot"), "dead": (True, None), "end": (False, "end"), "none": (False, "end"), "free": (False, "data_cutoff") if False else (False, None)}
    plain = {r.patientid: (r.occurred, r.censored) for r in landmarks.event_tasks(events, splits, ("progression",), weeks=(8,), progression_includes_death=False).collect()}
    assert plain["dead"] == (False, None)
    cut = {r.patientid: r.censored for r in landmarks.event_tasks(events, splits, ("progression",), weeks=(8,), cutoff="2020-01-31").collect()}
    assert cut["free"] == "data_cutoff" and cut["hit"] is None


def test_answers_and_tasks(spark):
    rows = spark.createDataFrame([("a", "Task 1 is time to event prediction:\nHere is the prediction: the event (death) was not censored and occurred.\nTask 2 is forecasting: x is 4\nTask 3 is nothing known")], "patientid string, answer string")
    got = [(r.task_nr, r.kind) for r in parsing.split_tasks(rows, ("patientid",)).orderBy("task_nr").collect()]
    assert got == [(1, "events"), (2, "forecasting"), (3, None)]
    said = spark.createDataFrame([("the event (next progression) was censored and did not occur.",), ("the event (x) was not censored and occured",), ("no idea",), (None,)], "a string")
    out = [tuple(r) for r in said.select(*parsing.parse_event_answer(F.col("a"))).collect()]
    assert out == [("next progression", True, False), ("x", False, True), (None, None, None), (None, None, None)]


def test_free_text_forms(spark):
    lines = "Task 1: forecast\n3 weeks later\n\thb is 4.\nweek 5: plt: 7\n- wbc (week 6): 8.5\n2 weeks: ldh = 9\nalbumin, 10\nhb 11\nNote: 12 is odd\nweek 7:\nhb = 12"
    rows = spark.createDataFrame([("a", lines)], "patientid string, response string")
    got = {(r.week, r.name, r.value) for r in parsing.parse_free_text_values(rows).collect()}
    assert got == {(3.0, "hb", 4.0), (5.0, "plt", 7.0), (6.0, "wbc", 8.5), (2.0, "ldh", 9.0), (3.0, "albumin", 10.0), (3.0, "hb", 11.0), (7.0, "hb", 12.0)}


def test_tags_rewards_and_masks(spark):
    rows = spark.createDataFrame([("x <prediction>1, 2.5, 3.</prediction>", [1.0, 2.0, 3.0]), ("4</prediction>", [4.0]), ("none", [1.0]), (None, [1.0])], "completion string, target_values array<double>")
    out = parsing.score_completions(rows).collect()
    assert [round(r.reward, 3) for r in out] == [29.75, 30.0, 0.0, 0.0]
    assert [(r.n_open, r.n_close) for r in out[:2]] == [(1, 1), (0, 1)]
    spliced = parsing.splice_truth(spark.createDataFrame([("a <prediction>b</prediction> c", "T"), ("</prediction><prediction>", "T"), ("x", "T")], "response string, target string")).collect()
    assert [r.response for r in spliced] == ["a <prediction>T</prediction> c"]
    ids = spark.createDataFrame([(1, [5, 9, 8, 7, 6]), (2, [5, 5]), (3, []), (4, [9, 8])], "k int, ids array<int>")
    masked = {r.k: (list(r.input_ids), list(r.labels)) for r in parsing.mask_prompt_tokens(ids, (9, 8), most=4).collect()}
    assert masked == {1: ([5, 9, 8, 7], [-100, -100, -100, 7]), 4: ([9, 8], [-100, -100])}


def test_what_stays_of_a_sample_is_worked_out_once(spark, rows):
    key = rows.select("patientid", "split_date").distinct()
    static = key.select("patientid", F.lit("\tgender is male.\n").alias("static"))
    tasks = key.select("patientid", "split_date", F.lit("events").alias("kind"), F.lit("\nWill it?").alias("prompt"), F.lit("\nNo: 0").alias("answer"))
    out = text.instruction_samples(rows, static, key.withColumn("event_name", F.lit("718_7")), tasks)
    assert out.first().tokens_target == 11
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_token_counts_take_letters_of_ascii_alone(spark):
    said = spark.createDataFrame([("a_1 bé,  c\t-- x2\n",)], "t string")
    old = F.size(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), F.lit(0)))
    assert said.select(w.words_and_signs(F.col("t")) == old).first()[0]

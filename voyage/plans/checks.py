"""Queries of checks, imports and files that go out and come back, with their DuckDB statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voyage.functions.random import u01
from voyage.operators import evaluation, ingest, parsing, series, survival, text
from voyage.plans import fixtures, texts
from voyage.plans.evaluations import _HALVES, LAST, SURVIVAL, TARGETS, _rounded, _survival
from voyage.plans.fixtures import constant, events
from voyage.plans.imports import _TRAIN, _meds
from voyage.plans.journeys import WITH
from voyage.plans.models import _TASKS, _WS, SERIES_KEY, labs, sql_u, weekly
from voyage.plans.texts import BASE, FULL, HISTORY, forecast_rows, history, split_dates, timeline
from voyage.sources import files
from voyage.sources.tables import shared_folder


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def s02_quoted_csv(spark, d):
    """Texts with quotes and line breaks, through a CSV file that is read in splits."""
    path = _place(spark, "quoted")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit('"a", '), "text", F.lit('\n"')).alias("said"), "source")
    files.write_csv(docs, path)
    back = files.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("said").alias("said"), "source")


def s03_custom_dataset(spark, d):
    """Tables of one's own by file: no molecular table, columns in another order."""
    base, people = _place(spark, "custom"), constant(spark, d)
    files.write_csv(events(spark, d).select("event_value", "patientid", "date", "event_name", "event_category", "event_descriptive_name"), f"{base}/ev")
    files.write_csv(people.select("birthyear", "patientid", "gender"), f"{base}/people")
    files.write_csv(spark.createDataFrame([("gender", "gender of patient")], "variable string, comment string"), f"{base}/names")
    tables = files.load_cohort(spark, {"events": f"{base}/ev", "constant": f"{base}/people", "constant_description": f"{base}/names"}, "own")
    born = tables["events"].join(tables["constant"], "patientid").where(F.col("event_category") != "lab")
    return born.groupBy("event_category", "gender").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("birthyear").alias("youngest"))


def s07_csv_glob(spark, d):
    """Target files of two splits, united by a pattern, with a declared date."""
    base = _place(spark, "targets")
    rows = fixtures.targets(spark, d).select("patientid", "event_name", "target_date", F.round("event_value", 3).alias("event_value"))
    for name, part in (("one", F.col("event_name") <= "type_m"), ("two", F.col("event_name") > "type_m")):
        files.write_csv(rows.where(part), f"{base}/{name}_targets.csv")
    back = files.read_csv(spark, files.listed(spark, f"{base}/*_targets.csv"), dates=("target_date",))
    return back.groupBy("event_name", F.year("target_date").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("event_value").cast("double")), 2).alias("total"))


def s08_json_lines(spark, d):
    """All .jsonl files of a folder and those below."""
    base = _place(spark, "lines")
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    for role in ("user", "assistant"):
        turns.where(F.col("role") == role).select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value")).write.text(f"{base}/{role}", lineSep="\n")
    fs = files._file_system(spark, base)[1]
    for path in files.listed(spark, f"{base}/*/part-*"):
        where, to = files._file_system(spark, path)[0], files._file_system(spark, path.removesuffix(".txt") + ".jsonl")[0]
        fs.rename(where, to)
    back = files.read_json_lines(spark, base, "conv_id long, turn long, text string")
    return back.select("conv_id", "turn", F.md5("text").alias("said"))


def s09_representations(spark, d):
    """Vectors as columns of a CSV file, back as arrays."""
    path = _place(spark, "vectors")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(f"feature_{k}") for k in range(8)))
    files.write_csv(rows, path)
    back = files.read_representations(spark, path)
    return back.select("patientid", F.size("values").alias("width"), F.round(F.aggregate("values", F.lit(0.0), lambda t, x: t + x), 5).alias("total"))


def s10_split_map(spark, d):
    path = _place(spark, "map")
    files.write_split_map(ingest.assign_patient_splits(constant(spark, d)), path)
    return ingest.given_splits(constant(spark, d), files.read_split_map(spark, path))


def s15_trajectories(spark, d):
    path = _place(spark, "trajectories")
    rows = fixtures.targets(spark, d).select("patientid", "target_date", "event_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))
    files.write_trajectories(rows, path)
    back = files.read_csv(spark, path, dates=("target_date",))
    return back.groupBy("trajectory").agg(F.count("*").alias("n"), F.max("target_date").alias("last"))


def s16_statistics_csv(spark, d):
    path = _place(spark, "statistics")
    files.write_csv(fixtures.statistics(spark, d), path)
    back = files.read_csv(spark, path)
    return back.select("event_name", F.col("num_samples").cast("long").alias("num_samples"), F.round(F.col("mean").cast("double"), 6).alias("mean"), F.json_array_length("bins").alias("n_bins"))


def s17_resumed_samples(spark, d):
    """A batch that is broken off half-way, once while it is written and once before it is in the manifest, then resumed, with a second batch behind it."""
    path = _place(spark, "resumed")
    split = ingest.assign_patient_splits(constant(spark, d)).hint("shuffle_hash")  # texts are neither moved nor sorted
    rows = texts.samples(spark, d).join(split, "patientid").withColumn("indication", F.concat(F.lit("c"), F.pmod(F.substring("patientid", 2, 9).cast("int"), F.lit(3)).cast("string")))
    meta = ("patientid", "split_date", "tokens_input")
    first, second = rows.where("indication = 'c0'"), rows.where("indication <> 'c2'")
    broken = first.withColumn("answer", F.when(F.col("data_split") == "test", F.raise_error(F.lit("lost"))).otherwise(F.col("answer")).cast("string"))
    try:
        files.write_samples(broken, path, meta, batch="one", resume=True)
    except Exception as error:  # what a lost driver leaves behind
        if "lost" not in str(error):
            raise
    first.select("instruction", "answer", F.struct(*meta).alias("meta"), "indication", "data_split").write.partitionBy("indication", "data_split").mode("append").json(f"{path}/batch=one")
    for _ in range(2):
        files.write_samples(first, path, meta, batch="one", resume=True)
        files.write_samples(second, path, meta, batch="two", resume=True)  # c0 is there
    files.write_samples(rows, path, meta, batch="three", resume=True)
    back = files.read_samples(spark, path, "meta struct<tokens_input: long>, batch string, indication string, data_split string")
    return back.groupBy("batch", "indication", "data_split").agg(F.count("*").alias("n"), F.sum("meta.tokens_input").alias("tokens_input"))


def d06_constants_table(spark, d):
    """One column a code, the split, and descriptions, as static_text takes them."""
    _, held, described, _ = _meds(spark, d)
    names = {r["variable"]: r["comment"] for r in described.where("variable not in ('patientid', 'split')").collect()}  # one row a column
    first = held.select("patientid", F.lit("2024-06-01").cast("date").alias("first_date"))
    told = text.static_text(held.withColumn("birthyear", F.lit(2000)), first, tuple(names), names)
    return held.select("patientid", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in names), "split").join(told, "patientid")


def d06_descriptions(spark, d):
    return _meds(spark, d)[2]


def d17b_realign_split(spark, d):
    return series.realign_split(history(spark, d), forecast_rows(spark, d))


def d17c_series_checks(spark, d):
    return series.series_checks(weekly(spark, d), labs(spark, d), ("type_small", "type_medium"))


def d18_static_features_at(spark, d):
    return series.static_features_at(timeline(spark, d), split_dates(spark, d), constant(spark, d), {"small": ("lab", "type_small"), "large": ("lab", "type_large")})


def d25_complete_predictions(spark, d):
    """Predictions of which a few in ten thousand are missing, within both limits."""
    rows = fixtures.last_values(spark, d).groupBy("patientid", "event_name", F.col("target_date").alias("date")).agg(F.max("event_value").alias("event_value"))
    return series.complete_predictions(rows.where(u01(F.lit("drop"), "patientid", "event_name", "date") >= 0.0003), rows)


def d32_survival_eval_by_trial(spark, d):
    """Scores by trial (a third of the patients each), censoring by category over all trials, no row left out for its time."""
    rows = _survival(spark, d).withColumnRenamed("group", "category").withColumn("survival", F.round("survival", 2)).withColumn("trial_id", F.pmod(F.substring("patientid", 2, 9).cast("int"), F.lit(3)))
    train, test = rows.where(u01(F.lit("fold"), "patientid") < 0.5), rows.where(u01(F.lit("fold"), "patientid") >= 0.5)
    pred = test.select("patientid", "category", "survival", F.explode(F.array(F.lit(104), F.lit(208))).alias("week"))
    return _rounded(survival.survival_eval(pred, test.drop("survival"), train, by=("trial_id",), within_training=False))


def _stored(spark, d):
    rows, path = fixtures.targets(spark, d), _place(spark, "run")
    evaluation.store_run(rows, path)
    first = rows.agg(F.min("patientid").alias("patientid"))
    return rows, rows.join(F.broadcast(first), "patientid", "left_anti"), path  # one row


def d33_compare_fingerprints(spark, d):
    """Two runs over the same targets agree; one that lacks a patient does not, and it shows in which fields."""
    rows, less, path = _stored(spark, d)
    again = evaluation.fingerprint_differences(path, rows.repartition(3)).select(F.lit("again").alias("run"), "field", "same")
    return again.unionByName(evaluation.fingerprint_differences(path, less).select(F.lit("less").alias("run"), "field", "same"))


def d33_ids_apart(spark, d):
    _, less, path = _stored(spark, d)
    return evaluation.ids_apart(path, less)


def d51_round_trip_check(spark, d):
    """Histories as text and back, of a fifth of the patients; in the texts of half of them every 17 has become 18."""
    rows = history(spark, d)
    start = rows.groupBy("patientid", "split_date").agg(F.min("date").alias("start_date"))
    said = text.timeline_text(rows).join(start, ["patientid", "split_date"])
    damaged = F.when(u01(F.lit("damage"), "patientid") < 0.5, F.regexp_replace("text", r" is 17(?=[,.\n])", " is 18")).otherwise(F.col("text"))
    names = timeline(spark, d).select("event_descriptive_name", "event_category", "event_name", "source").distinct()
    read = parsing.parse_timeline_text(said.withColumn("text", damaged), names)
    wrote = rows.withColumn("event_value", F.when(F.col("event_category") == "death", "death").otherwise(F.col("event_value")))
    return parsing.round_trip_check(wrote, read, share=0.2, skip=("LARGE",), skip_genetic=True)


def d51_answers_apart(spark, d):
    """Answers to event tasks, read back from text; in a fifth of them what occurred has not."""
    rows = texts.event_rows(spark, d)
    wrote = rows.select("patientid", "split_date", "category", F.col("variable_name").alias("target_name"), F.col("censored").isNotNull().alias("censored"), "occurred")
    hit = u01(F.lit("flip"), "patientid", "split_date", "category") < 0.2
    said = F.when(hit, F.regexp_replace("answer", "(?<!not )occurred", "did not occur")).otherwise(F.col("answer"))
    parts = parsing.parse_event_answer(said)
    read = rows.select("patientid", "split_date", "category", *(c.alias(n) for c, n in zip(parts, ("target_name", "censored", "occurred"), strict=True)))
    return parsing.answers_apart(wrote, read, ("patientid", "split_date", "category"), share=0.5)


def d53_chat_messages(spark, d):
    """A row for each message of each copy."""
    out = parsing.chat_messages(texts.samples(spark, d).select("patientid", "split_date", "instruction", "answer"), "You forecast.", copies=2, extra=" Think first.", seed=7)
    return out.select("patientid", "split_date", "copy", "seed", F.posexplode("messages").alias("place", "m"), "completion").select("patientid", "split_date", "copy", "seed", "place", "m.role", "m.content", "completion")


def d54_mask_prompt_tokens(spark, d):
    """Conversations as code points, the prompt up to the first ". " masked."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    ids = F.transform(F.split("text", ""), lambda x: F.ascii(x))
    out = parsing.mask_prompt_tokens(turns.select("conv_id", "turn", ids.alias("ids")).select("conv_id", "turn", F.filter("ids", lambda x: x > 0).alias("ids")), (46, 32), most=400)
    kept = F.filter("labels", lambda x: x >= 0)
    return out.select("conv_id", "turn", F.size("input_ids").alias("n"), F.size(kept).alias("n_kept"), F.md5(F.array_join("labels", ",")).alias("labels"), F.size("attention_mask").alias("n_attention"))


def f21_completion_logprobs(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    said = F.transform(F.split("text", " "), lambda x: -F.length(x) / 8)
    kept = parsing.completion_logprobs(said, F.lit(3) + F.col("turn"))
    return turns.select("conv_id", "turn", F.size(kept).alias("n"), F.round(F.aggregate(kept, F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


def f23_forecast_meta(spark, d):
    meta = text.forecast_meta(forecast_rows(spark, d))
    both = meta.select("patientid", "split_date", "weeks", text.merged_maps(F.col("names"), F.create_map(F.lit("type_small"), F.lit("renamed"))).alias("names"))
    rows = both.select("patientid", "split_date", "weeks", F.explode("names").alias("event_name", "name"))
    return rows.select("patientid", "split_date", "event_name", "name", F.array_join(F.transform(F.col("weeks")[F.col("event_name")], lambda w: F.round(w, 3).cast("string")), " ").alias("weeks"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "dsf" and k[1:3].isdigit()}

_RULES = {
    "input_length": "a <> 27", "target_length": "b <> 12", "input_begin": "i0 <> split_date - 182", "input_end": "i1 <> split_date", "target_after": "o0 <= split_date", "target_begin": "o0 <> split_date + 7", "target_end": "o1 <> split_date + 84", "overlap": "o0 <= i1",
    "input_steps": "si > 0", "target_steps": "so > 0", "input_dates": "di > 0", "target_dates": "dt > 0", "input_values": "vi > 0", "target_values": "vt > 0", "input_holes": "hi > 0", "target_holes": "ht > 0", "frozen": "fz > 0",
}
_PRINT = f"""(SELECT count(DISTINCT patientid) AS n_patients, count(DISTINCT event_name) AS n_events, count(DISTINCT target_date) AS n_dates, count(*) AS n_rows, count(DISTINCT round(y, 6)) AS n_values,
  (SELECT {_HALVES} FROM (SELECT md5(concat_ws('|', patientid, date, event_name, target_date, format('{{:.6f}}', y))) AS h FROM {{0}})) AS rows, (SELECT {_HALVES} FROM (SELECT DISTINCT md5(patientid) AS h FROM {{0}})) AS ids FROM {{0}})"""
_FIELDS = ("n_patients", "n_events", "n_dates", "n_rows", "n_values", "rows", "ids")
ORACLE = {
    "s02_quoted_csv": "SELECT doc_id, md5('\"a\", ' || text || chr(10) || '\"') AS said, source FROM documents",
    "s03_custom_dataset": f"{WITH} SELECT event_category, gender, count(*) AS n, min(date) AS first, max(birthyear) AS youngest FROM ev JOIN con USING (patientid) WHERE event_category <> 'lab' GROUP BY 1, 2",
    "s07_csv_glob": f"{TARGETS} SELECT event_name, CAST(year(target_date) AS INT) AS year, count(*) AS n, round(sum(round(y, 3)), 2) AS total FROM tgt GROUP BY 1, 2",
    "s08_json_lines": "SELECT conv_id, turn, md5(text) AS said FROM conversations WHERE role IN ('user', 'assistant')",
    "s09_representations": "SELECT CAST(vec_id AS VARCHAR) AS patientid, 8 AS width, round(list_sum([CAST(embedding[k] AS DOUBLE) FOR k IN range(1, 9)]), 5) AS total FROM embeddings",
    "s10_split_map": f"{WITH}{_TRAIN} SELECT patientid, data_split FROM spl",
    "s15_trajectories": f"{TARGETS} SELECT patientid || '_traj_' || copy AS trajectory, count(*) AS n, max(target_date) AS last FROM tgt, range(3) t(copy) GROUP BY 1",
    "s16_statistics_csv": f"""{TARGETS}, q AS (SELECT event_name, len(list_distinct(quantile_cont(v, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS n FROM pairs GROUP BY 1)
        SELECT event_name, num_samples, round(mean, 6) AS mean, CAST(n AS INT) AS n_bins FROM stat JOIN q USING (event_name)""",
    "s17_resumed_samples": f"""{FULL}{texts._SAMPLES}{_TRAIN}, n AS (SELECT 'c' || (CAST(substr(patientid, 2) AS INT) % 3) AS indication, data_split, tokens_input FROM sa JOIN spl USING (patientid))
        SELECT CASE indication WHEN 'c0' THEN 'one' WHEN 'c1' THEN 'two' ELSE 'three' END AS batch, indication, data_split, count(*) AS n, CAST(sum(tokens_input) AS BIGINT) AS tokens_input FROM n GROUP BY 1, 2, 3""",
    "d06_descriptions": "SELECT variable, comment FROM (VALUES ('patientid', 'No description available'), ('split', 'No description available')) t(variable, comment) UNION ALL SELECT DISTINCT event_type, upper(event_type) FROM events WHERE event_type = 'signup'",
    "d06_constants_table": f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS patientid, min(CAST(value AS VARCHAR)) AS v, CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM events WHERE event_type = 'signup' GROUP BY user_id)
        SELECT patientid, round(CAST(v AS DOUBLE), 6) AS signup, split, {texts.quoted(texts.w.CONSTANT)} || chr(9) || 'SIGNUP is ' || coalesce(v, 'nan') || ',' || chr(10) || chr(9) || 'age of patient is 24 years.' || chr(10) AS static FROM c""",
    "d17b_realign_split": f"""{FULL}, k AS (SELECT patientid, split_date, event_name, max(target_date) AS ending FROM ft GROUP BY 1, 2, 3), o AS (SELECT DISTINCT patientid, split_date, event_name FROM his WHERE split_date - date BETWEEN 0 AND 182 AND (split_date - date) % 7 <> 0),
        l AS (SELECT patientid, split_date, max(date) AS last FROM his WHERE source <> 'genetic' GROUP BY 1, 2), m AS (SELECT k.*, o.event_name IS NOT NULL AS off, CASE WHEN o.event_name IS NOT NULL THEN last ELSE k.split_date END AS fresh FROM k LEFT JOIN o USING (patientid, split_date, event_name) LEFT JOIN l USING (patientid, split_date))
        SELECT patientid, event_name, fresh AS split_date, split_date AS old_split_date, off AS split_date_changed, CAST(CASE WHEN off THEN greatest(84, ending - fresh) ELSE 84 END AS INT) AS horizon_days FROM m""",
    "d17c_series_checks": f"""{_WS.replace("ws AS (", "ws AS MATERIALIZED (")}, st AS (SELECT *, date - lag(date) OVER (PARTITION BY {SERIES_KEY}, part ORDER BY date) AS step, last_value(CASE WHEN part = 'input' THEN {{'s': type_small, 'm': type_medium}} END IGNORE NULLS) OVER (PARTITION BY {SERIES_KEY} ORDER BY date ROWS UNBOUNDED PRECEDING) AS held FROM ws),
        p AS (SELECT {SERIES_KEY}, count(*) FILTER (part = 'input') AS a, count(*) FILTER (part = 'target') AS b, min(date) FILTER (part = 'input') AS i0, max(date) FILTER (part = 'input') AS i1, min(date) FILTER (part = 'target') AS o0, max(date) FILTER (part = 'target') AS o1,
          count(*) FILTER (part = 'input' AND step <> 7) AS si, count(*) FILTER (part = 'target' AND step <> 7) AS so, count(*) FILTER (part = 'input' AND event_value IS NULL) AS hi, count(*) FILTER (part = 'target' AND event_value IS NULL) AS ht,
          count(*) FILTER (part = 'target' AND (type_small IS DISTINCT FROM held.s OR type_medium IS DISTINCT FROM held.m)) AS fz FROM st GROUP BY ALL),
        old AS (SELECT p.patientid, p.split_date, p.event_name, e.date, TRY_CAST(e.event_value AS DOUBLE) AS v, CASE WHEN e.date <= p.split_date THEN 'input' ELSE 'target' END AS part FROM p JOIN ev e ON e.patientid = p.patientid AND e.event_name = p.event_name AND e.event_category = 'lab' AND e.date - p.split_date BETWEEN -182 AND 84 WHERE TRY_CAST(e.event_value AS DOUBLE) IS NOT NULL),
        ld AS (SELECT {SERIES_KEY}, count(*) FILTER (part = 'input') AS di, count(*) FILTER (part = 'target') AS dt FROM old ANTI JOIN ws USING (patientid, split_date, event_name, part, date) GROUP BY ALL),
        lv2 AS (SELECT {SERIES_KEY}, count(*) FILTER (part = 'input') AS vi, count(*) FILTER (part = 'target') AS vt FROM old ANTI JOIN (SELECT *, event_value AS v FROM ws) w USING (patientid, split_date, event_name, part, v) GROUP BY ALL)
        SELECT count(*) AS n_series, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _RULES.items())} FROM p LEFT JOIN ld USING (patientid, split_date, event_name) LEFT JOIN lv2 USING (patientid, split_date, event_name)""",
    "d18_static_features_at": f"""{BASE}{HISTORY}, a AS (SELECT patientid, split_date, count(*) FILTER (event_category = 'diagnosis') AS nr_previous_diagnoses, count(*) FILTER (source = 'genetic') AS nr_genetic_events,
        coalesce(TRY_CAST(max((date, event_value)) FILTER (event_name = 'type_small' AND event_category = 'lab')[2] AS DOUBLE), -1) AS small, coalesce(TRY_CAST(max((date, event_value)) FILTER (event_name = 'type_large' AND event_category = 'lab')[2] AS DOUBLE), -1) AS large,
        coalesce(max((date, event_value)) FILTER (event_category = 'lot' AND event_name = 'line_name')[2], 'unknown') AS therapy_name, CAST(-1 AS DOUBLE) AS therapy_line_number FROM his GROUP BY 1, 2)
        SELECT a.*, gender, indication, CAST(year(split_date) - birthyear AS INT) AS age FROM a JOIN con USING (patientid)""",
    "d25_complete_predictions": f"""{TARGETS}{LAST}, r AS (SELECT patientid, event_name, target_date AS date, max(c) AS v FROM cf GROUP BY 1, 2, 3), q AS (SELECT *, CASE WHEN {sql_u("'drop'", "patientid", "event_name", "CAST(date AS VARCHAR)")} >= 0.0003 THEN v END AS p FROM r)
        SELECT patientid, event_name, date, last_value(p IGNORE NULLS) OVER (PARTITION BY patientid, event_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS event_value, p IS NULL AS missing FROM q""",
    "d32_survival_eval_by_trial": f"""{WITH}{SURVIVAL.replace("FROM surv GROUP BY ALL", f"FROM surv WHERE {sql_u(texts.quoted('fold'), 'patientid')} < 0.5 GROUP BY ALL")},
        te AS (SELECT surv.*, CAST(substr(patientid, 2) AS INT) % 3 AS trial_id, round(survival, 2) AS s, week, 7 * week AS due FROM surv, (VALUES (104), (208)) w(week) WHERE {sql_u(texts.quoted("fold"), "patientid")} >= 0.5),
        tg AS (SELECT te.*, coalesce(km.g, 1) AS g FROM te ASOF LEFT JOIN km ON te."group" = km."group" AND te.time >= km.time), r AS (SELECT tg.*, coalesce(km.g, 1) AS g_at FROM tg ASOF LEFT JOIN km ON tg."group" = km."group" AND tg.due >= km.time),
        b AS (SELECT "group", week, trial_id, count(*) AS n, CASE WHEN min(due) >= min(time) AND min(due) < max(time) THEN avg(coalesce(CASE WHEN time <= due AND event THEN s * s / nullif(g, 0) WHEN time > due THEN (1 - s) * (1 - s) / nullif(g_at, 0) END, 0)) END AS brier FROM r GROUP BY 1, 2, 3),
        p AS (SELECT i."group", i.week, i.trial_id, i.g, 1 / nullif(i.g * i.g, 0) AS w, CASE WHEN 1 - j.s < 1 - i.s THEN 1 WHEN 1 - j.s = 1 - i.s THEN 0.5 ELSE 0 END AS good
          FROM r i JOIN r j ON i."group" = j."group" AND i.week = j.week AND i.trial_id = j.trial_id AND i.event AND i.time < i.due AND (j.time > i.time OR j.time = i.time AND NOT (j.event AND j.time < j.due))),
        c AS (SELECT "group", week, trial_id, CASE WHEN min(g) > 0 THEN sum(w * good) / sum(w) END AS c FROM p GROUP BY 1, 2, 3)
        SELECT b."group" AS category, b.week, b.trial_id, n, round(brier, 6) AS brier, round(c, 6) AS c_index FROM b LEFT JOIN c ON c."group" = b."group" AND c.week = b.week AND c.trial_id = b.trial_id""",
    "d33_compare_fingerprints": f"""{TARGETS}, less AS (SELECT * FROM tgt WHERE patientid <> (SELECT min(patientid) FROM tgt)), again AS (SELECT * FROM tgt), pa AS MATERIALIZED {_PRINT.replace("{0}", "tgt")}, pb AS MATERIALIZED {_PRINT.replace("{0}", "again")}, pc AS MATERIALIZED {_PRINT.replace("{0}", "less")}
        {" UNION ALL ".join(f"SELECT '{run}' AS run, '{f}' AS field, pa.{f} = x.{f} AS same FROM pa, {p} AS x" for run, p in (("again", "pb"), ("less", "pc")) for f in _FIELDS)}""",
    "d33_ids_apart": f"{TARGETS} SELECT min(patientid) AS patientid, 'stored' AS only_in FROM tgt",
    "d51_round_trip_check": f"""{BASE}{HISTORY} SELECT patientid, split_date, date, event_name, CAST(17 + k AS VARCHAR) AS event_value, CASE k WHEN 0 THEN 'first' ELSE 'second' END AS side FROM his, range(2) t(k)
        WHERE source = 'events' AND event_value = '17' AND NOT regexp_matches(event_descriptive_name, '(?i)large') AND {sql_u("'damage'", "patientid")} < 0.5 AND {sql_u("'round trip'", "patientid")} < 0.2""",
    "d51_answers_apart": f"""{_TASKS} SELECT patientid, split_date, category, 'occurred' AS field, 'true' AS wrote, 'false' AS read FROM tasks
        WHERE occurred AND {sql_u("'flip'", "patientid", "CAST(split_date AS VARCHAR)", "category")} < 0.2 AND {sql_u("'round trip'", "patientid")} < 0.5""",
    "d53_chat_messages": f"""{FULL}{texts._SAMPLES}, m AS (SELECT patientid, split_date, CAST(copy AS INT) AS copy, CAST(copy + 7 AS INT) AS seed, CAST(place AS INT) AS place, instruction, answer FROM sa, range(2) t(copy), range(2) q(place))
        SELECT patientid, split_date, copy, seed, place, CASE place WHEN 0 THEN 'system' ELSE 'user' END AS role, CASE place WHEN 0 THEN 'You forecast.' ELSE instruction || ' Think first.' END AS content, answer AS completion FROM m""",
    "d54_mask_prompt_tokens": """WITH c AS (SELECT conv_id, turn, [unicode(x) FOR x IN string_split(substr(text, 1, 400), '')] AS ids, strpos(substr(text, 1, 400), '. ') AS pos FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id, turn, CAST(len(ids) AS INT) AS n, CAST(len(ids) - pos - 1 AS INT) AS n_kept, md5(array_to_string([CASE WHEN k <= pos + 1 THEN -100 ELSE ids[k] END FOR k IN range(1, len(ids) + 1)], ',')) AS labels, CAST(len(ids) AS INT) AS n_attention FROM c WHERE pos > 0""",
    "f21_completion_logprobs": """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL), k AS (SELECT conv_id, turn, CASE WHEN len(w) >= 3 + turn THEN [-length(x) / 8 FOR x IN w[4 + turn:]] END AS k FROM w)
        SELECT conv_id, turn, CASE WHEN k IS NULL THEN NULL ELSE CAST(len(k) AS INT) END AS n, CASE WHEN k IS NULL THEN NULL ELSE round(coalesce(list_sum(k), 0), 6) END AS total FROM k""",
    "f23_forecast_meta": f"""{FULL}, m AS (SELECT patientid, split_date, event_name, min(event_descriptive_name) AS name, list_sort(list(DISTINCT (target_date - split_date) / 7)) AS ws FROM ft GROUP BY 1, 2, 3),
        k AS (SELECT DISTINCT patientid, split_date FROM m), a AS (SELECT patientid, split_date, event_name FROM m UNION SELECT patientid, split_date, 'type_small' FROM k)
        SELECT patientid, split_date, event_name, CASE event_name WHEN 'type_small' THEN 'renamed' ELSE name END AS name, array_to_string([CAST(round(x, 3) AS VARCHAR) FOR x IN ws], ' ') AS weeks FROM a LEFT JOIN m USING (patientid, split_date, event_name)""",
}

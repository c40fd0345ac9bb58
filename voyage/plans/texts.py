"""Queries of tasks and texts, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from voyage.functions import wording as w
from voyage.operators import ingest, landmarks, splits, text
from voyage.plans import fixtures
from voyage.plans.evaluations import TARGETS
from voyage.plans.fixtures import constant, events, molecular
from voyage.plans.journeys import CANDIDATES, U, WITH
from voyage.sources.tables import once, together

TIMELINE = """, tl AS (SELECT DISTINCT patientid, date, event_category, event_name, event_descriptive_name, event_value, 'events' AS source FROM ev
  UNION SELECT patientid, date, biomarker_category, biomarker_event, biomarker_descriptive_name, biomarker_value, 'genetic' FROM mol)"""
SPLITS = f""", lists AS (SELECT patientid, lot_date, list(date ORDER BY date) AS dates FROM cand GROUP BY ALL),
sp AS (SELECT DISTINCT patientid, dates[1 + CAST(floor({U.format(key="'1|' || patientid || '|' || CAST(lot_date AS VARCHAR) || '|0'")} * len(dates)) AS INT)] AS split_date FROM lists)"""
HISTORY = ", his AS (SELECT sp.split_date, tl.* FROM sp JOIN tl USING (patientid) WHERE tl.date <= sp.split_date)"
SHOWN = ", shown AS (SELECT DISTINCT event_name, event_descriptive_name FROM ev WHERE event_category = 'lab')"
TASKS_OF = """, ft AS (SELECT tgt.patientid, tgt.date AS split_date, tgt.event_name, event_descriptive_name, tgt.target_date, y AS event_value FROM tgt JOIN shown USING (event_name))"""


def number_text(x: str) -> str:
    return f"regexp_replace(CAST(CAST(round({x}, 2) AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', '')"


def value_text(x: str) -> str:
    return f"coalesce({number_text(f'TRY_CAST({x} AS DOUBLE)')}, {x})"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_timeline(name: str, rows: str, key: str, start: str | None = None, first: bool = True) -> str:
    """CTEs that end in name (key, text); rows has the columns of a timeline."""
    head = f"{quoted(w.DAY)} || {number_text('since / 7')} || {quoted(w.DAY_TEXT)}"
    zero = start or "min(date) OVER (PARTITION BY " + key + ")"
    line = f"""CASE WHEN source = 'genetic' THEN CASE WHEN event_value = 'present' THEN event_descriptive_name ELSE event_descriptive_name || ' is ' || event_value END
      WHEN event_category = 'death' AND event_name = 'death' THEN 'death' ELSE CASE WHEN event_category = 'drug' THEN 'drug ' ELSE '' END || event_descriptive_name || ' is ' || lower(coalesce(event_value, '')) END"""
    return f""", {name}_l AS (SELECT *, {line} AS line FROM {rows}),
{name}_d AS (SELECT {key}, date{", " + start if start else ""}, string_agg(chr(9) || line || ',' || chr(10), '' ORDER BY event_category, event_name, line) FILTER (source = 'genetic') AS g,
  string_agg(chr(9) || line, ',' || chr(10) ORDER BY event_category, event_name, line) FILTER (source <> 'genetic') AS e FROM {name}_l GROUP BY ALL),
{name}_v AS (SELECT *, lag(date) OVER (PARTITION BY {key} ORDER BY date) AS before, date - coalesce(lag(date) OVER (PARTITION BY {key} ORDER BY date), {zero}) AS since FROM {name}_d),
{name} AS (SELECT {key}, string_agg({f"CASE WHEN before IS NULL THEN {quoted(w.FIRST_DAY)} ELSE {head} END" if first else head}
  || CASE WHEN g IS NULL THEN '' ELSE chr(9) || '<genetic>' || chr(10) || g || chr(9) || '</genetic>' || CASE WHEN e IS NULL THEN '' ELSE ',' || chr(10) END END || coalesce(e, '') || '.' || chr(10), '' ORDER BY date) AS text FROM {name}_v GROUP BY {key})"""


def timeline(spark, d):
    return once(spark, "timeline", d, lambda: ingest.patient_timeline(events(spark, d), molecular(spark, d)), by="patientid")


def split_dates(spark, d):
    return once(spark, "splits", d, lambda: splits.sample_splits_per_lot(fixtures.candidates(spark, d), n=1).select("patientid", "split_date").distinct(), by="patientid")


def history(spark, d):
    return text.history_of(timeline(spark, d), split_dates(spark, d))


def forecast_rows(spark, d):
    shown = events(spark, d).where("event_category = 'lab'").select("event_name", "event_descriptive_name").distinct()
    return fixtures.targets(spark, d).withColumnRenamed("date", "split_date").join(shown, "event_name")


def static(spark, d):
    return text.static_text(constant(spark, d), timeline(spark, d).groupBy("patientid").agg(F.min("date").alias("first_date")))


def event_rows(spark, d, **options):
    return text.event_task_text(landmarks.event_tasks(events(spark, d), split_dates(spark, d), **options))


def d15_event_tasks(spark, d):
    return landmarks.event_tasks(events(spark, d), split_dates(spark, d), cutoff="1998-06-01")


def d16_landmark_grid(spark, d):
    out = landmarks.landmark_grid(events(spark, d), split_dates(spark, d), categories=("death", "progression", "lot"))
    return out.withColumn("true_time", F.round("true_time", 6))


def d16b_landmark_labels_from_survival(spark, d):
    rows = events(spark, d).groupBy("patientid").agg(F.datediff(F.max("date"), F.min("date")).alias("os"), (~F.bool_or(F.col("event_category") == "death")).alias("os_cut"), F.datediff(F.min(F.when(F.col("event_category") == "progression", F.col("date"))), F.min("date")).alias("pfs"))
    return landmarks.landmark_labels_from_survival(rows.withColumn("pfs_cut", F.lit(False)), (8, 26, 52, 104), {"death": ("os", "os_cut"), "progression": ("pfs", "pfs_cut")})


def d35_static_text(spark, d):
    return static(spark, d)


def d36_timeline_text(spark, d):
    return text.timeline_text(history(spark, d))


def d38_history_within_budget(spark, d):
    return text.history_within_budget(history(spark, d), 400)


def d39_summary_text(spark, d):
    return text.summary_text(history(spark, d), forecast_rows(spark, d))


def d40_forecast_task(spark, d):
    return text.forecast_task(forecast_rows(spark, d))


def d41_binned_task(spark, d):
    return text.binned_task(forecast_rows(spark, d), fixtures.statistics(spark, d))


def d42_event_task_text(spark, d):
    return event_rows(spark, d).select("patientid", "split_date", "category", "prompt", "answer")


def tasks_of(spark, d):
    forecasts = text.forecast_task(forecast_rows(spark, d)).join(split_dates(spark, d), ["patientid", "split_date"], "left_semi").withColumn("kind", F.lit("forecasting"))
    return forecasts.unionByName(event_rows(spark, d).withColumn("kind", F.lit("events")).select("patientid", "split_date", "prompt", "answer", "kind"))


def samples(spark, d):
    def build():
        return text.instruction_samples(history(spark, d), static(spark, d), forecast_rows(spark, d), tasks_of(spark, d), budget=2000)

    with together(spark):  # histories stay in their patients' buckets
        return once(spark, "samples", d, build, by="patientid")


def sample_keys(spark, d):
    """The keys of samples(), as often as they are there, without a text: splits that have a history, once for each row of the patient's static data."""
    rows = events(spark, d).select("patientid", "date").unionAll(molecular(spark, d).select("patientid", "date"))
    first = rows.groupBy("patientid").agg(F.min("date").alias("first_date"))
    keys = split_dates(spark, d).join(first, "patientid").where("first_date <= split_date")
    return keys.join(constant(spark, d).select("patientid"), "patientid").select("patientid", "split_date")


def d43_instruction_samples(spark, d):
    return samples(spark, d).withColumn("kinds", F.array_join("kinds", ","))


def d44_pretrain_samples(spark, d):
    return text.pretrain_samples(timeline(spark, d), static(spark, d))


def d34_dataset_stats(spark, d):
    return text.dataset_stats(samples(spark, d), 1500).withColumn("mean_tokens", F.round("mean_tokens", 6))


QUERIES = {f.__name__: f for f in (d15_event_tasks, d16_landmark_grid, d16b_landmark_labels_from_survival, d35_static_text, d36_timeline_text, d38_history_within_budget, d39_summary_text, d40_forecast_task, d41_binned_task, d42_event_task_text, d43_instruction_samples, d44_pretrain_samples, d34_dataset_stats)}

_EVENT_FACTS = """, la AS (SELECT patientid, max(date) AS last FROM ev GROUP BY 1),
fa AS (SELECT sp.patientid, sp.split_date, min(e.date) AS next_any, min(e.date) FILTER (event_name = 'death') AS died, min(e.date) FILTER (event_category = 'death') AS f_death,
  min(e.date) FILTER (event_category = 'progression') AS f_prog, min(e.date) FILTER (event_category = 'lot') AS f_lot FROM sp LEFT JOIN ev e ON e.patientid = sp.patientid AND e.date > sp.split_date GROUP BY 1, 2)"""


def sql_tasks(week: str, cutoff: str) -> str:
    return f"""{_EVENT_FACTS}, gr AS (SELECT fa.*, last, category, week FROM fa JOIN la USING (patientid), (VALUES ('death'), ('progression'), ('lot')) c(category), {week}),
g2 AS (SELECT *, greatest(split_date + 7 * week, next_any) AS end_date, CASE category WHEN 'death' THEN f_death WHEN 'lot' THEN f_lot ELSE coalesce(f_prog, f_death) END AS h FROM gr),
g3 AS (SELECT *, CASE WHEN h <= end_date THEN h END AS hit, CASE WHEN f_lot <= end_date THEN f_lot END AS lot FROM g2),
g4 AS (SELECT *, hit IS NOT NULL AND NOT coalesce(hit > lot, false) AS occurred FROM g3),
g5 AS (SELECT *, CASE WHEN occurred THEN NULL WHEN lot IS NOT NULL THEN 'lot' WHEN died <= end_date THEN NULL WHEN end_date <= last THEN NULL ELSE 'end' END AS why FROM g4),
tasks AS (SELECT patientid, split_date, category, CASE category WHEN 'death' THEN 'death' WHEN 'lot' THEN 'start of next line of therapy' ELSE 'next progression' END AS variable_name, CAST(week AS INT) AS week,
  CAST(end_date AS DATE) AS end_date, occurred, CASE WHEN why IS NULL AND NOT occurred AND end_date > DATE '{cutoff}' THEN 'data_cutoff' ELSE why END AS censored FROM g5)"""


_DRAWN = f"LATERAL (SELECT CAST(1 + floor({U.format(key=chr(39) + '5|' + chr(39) + ' || fa.patientid || ' + chr(39) + '|' + chr(39) + ' || CAST(fa.split_date AS VARCHAR) || ' + chr(39) + '|' + chr(39) + ' || c.category')} * 104) AS INT) AS week) q"
_EVENT_TEXT = f""", et AS (SELECT patientid, split_date, category, {quoted(w.EVENT_START)} || {number_text("(end_date - split_date) / 7")} || {quoted(w.EVENT_MID)} || variable_name || {quoted(w.EVENT_END)} AS prompt,
  {quoted(w.ANSWER_START)} || variable_name || {quoted(w.ANSWER_WAS)} || CASE WHEN censored IS NOT NULL THEN 'censored ' ELSE 'not censored ' END || 'and ' || CASE WHEN occurred THEN 'occurred.' ELSE 'did not occur.' END || chr(10) AS answer FROM tasks)"""
BASE = f"{WITH}{CANDIDATES}{TIMELINE}{SPLITS}"
_STATIC = f""", st AS (SELECT patientid, {quoted(w.CONSTANT)} || chr(9) || 'race is ' || race || ',' || chr(10) || chr(9) || 'gender is ' || CASE gender WHEN 'M' THEN 'male' ELSE 'female' END || ',' || chr(10)
  || chr(9) || 'ethnicity is ' || ethnicity || ',' || chr(10) || chr(9) || 'cancer indication of patient is ' || substr(indication, 10) || ',' || chr(10) || chr(9) || 'age of patient is ' || CAST(year(f) - birthyear AS VARCHAR) || ' years.' || chr(10) AS static
  FROM con JOIN (SELECT patientid, min(date) AS f FROM tl GROUP BY 1) USING (patientid))"""
_COUNT = "len(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"
_BUDGET = f""", co AS (SELECT *, {_COUNT.format("event_descriptive_name")} + {_COUNT.format("event_value")} + {_COUNT.format(quoted(" is " + chr(9) + " ," + chr(10)))}
   + ({_COUNT.format(quoted(w.FIRST_DAY))} + {_COUNT.format(quoted(w.DAY_TEXT))} * count(DISTINCT date) OVER k) / count(*) OVER k AS cost, date = min(date) OVER k AS first FROM his0 WINDOW k AS (PARTITION BY patientid, split_date)),
cu AS (SELECT *, round(sum(cost) OVER (PARTITION BY patientid, split_date ORDER BY first DESC, date DESC, event_category, event_name, event_value ROWS UNBOUNDED PRECEDING), 6) AS spent FROM co),
kept_rows AS (SELECT * FROM cu WHERE spent <= room OR first)"""
_LAST = "arg_max({0}, (date, event_value, event_descriptive_name))"
_SUMMARY = f""", ge AS (SELECT patientid, split_date, event_name, max(date) AS date, arg_max(event_value, (date, event_value, event_descriptive_name)) AS v, arg_max(event_descriptive_name, (date, event_value, event_descriptive_name)) AS n, arg_max(event_category, (date, event_value, event_category)) AS c
  FROM his WHERE source = 'genetic' GROUP BY 1, 2, 3),
gs AS (SELECT patientid, split_date, string_agg(chr(9) || CASE WHEN v = 'present' THEN n ELSE n || ' is ' || v END || ',', chr(10) ORDER BY date, c, event_name) AS genes FROM ge GROUP BY 1, 2),
lo AS (SELECT patientid, split_date, arg_max(event_value, (date, event_value)) AS line FROM his WHERE event_category = 'lot' AND event_name = 'line_name' GROUP BY 1, 2),
va AS (SELECT patientid, split_date, event_name, arg_max(event_value, (date, event_value, event_descriptive_name)) AS v, arg_max(event_descriptive_name, (date, event_value, event_descriptive_name)) AS n FROM his SEMI JOIN ft USING (patientid, split_date, event_name) GROUP BY 1, 2, 3),
vs AS (SELECT patientid, split_date, string_agg(chr(9) || n || ' was ' || {value_text("v")} || chr(10), '' ORDER BY event_name) AS vals FROM va GROUP BY 1, 2),
su AS (SELECT k.patientid, k.split_date, {quoted(w.SUMMARY_GENETIC)} || chr(10) || coalesce(genes, 'No genetic data available.') || chr(10) || {quoted(w.SUMMARY_LOT)} || coalesce(chr(9) || line || chr(10), {quoted(w.SUMMARY_NO_LOT)})
  || CASE WHEN a.patientid IS NULL THEN '' ELSE {quoted(w.SUMMARY_LAST)} || coalesce(vals, '') END AS summary
  FROM (SELECT DISTINCT patientid, split_date FROM his) k LEFT JOIN gs USING (patientid, split_date) LEFT JOIN lo USING (patientid, split_date) LEFT JOIN vs USING (patientid, split_date) LEFT JOIN (SELECT DISTINCT patientid, split_date FROM ft) a USING (patientid, split_date))"""
_WEEKS = f"string_agg({number_text('(target_date - split_date) / 7')}, ', ' ORDER BY target_date)"
_FORECAST = f""", fq AS (SELECT patientid, split_date, event_name, min(event_descriptive_name) AS n, {_WEEKS} AS wk FROM (SELECT DISTINCT patientid, split_date, event_name, event_descriptive_name, target_date FROM ft) GROUP BY 1, 2, 3),
fp AS (SELECT patientid, split_date, {quoted(w.FORECAST_START)} || string_agg(chr(10) || chr(9) || n || {quoted(w.FORECAST_TIME)} || wk, '' ORDER BY event_name) AS prompt FROM fq GROUP BY 1, 2),
fr AS (SELECT patientid, split_date, target_date AS date, 'lab' AS event_category, event_name, event_descriptive_name, {number_text("event_value")} AS event_value, 'events' AS source, split_date AS since0 FROM ft)
{sql_timeline("fx", "fr", "patientid, split_date", start="since0", first=False)}, fc AS (SELECT fp.*, text AS answer FROM fp JOIN fx USING (patientid, split_date))"""
FULL = f"{TARGETS}{TIMELINE}{SPLITS}{HISTORY}{SHOWN}{TASKS_OF}"
_ORDER = U.format(key="'3|' || patientid || '|' || CAST(split_date AS VARCHAR) || '|' || kind || '|' || prompt")
_SAMPLES = f"""{_FORECAST}{sql_tasks(_DRAWN, "2100-01-01")}{_EVENT_TEXT}{_STATIC}{_SUMMARY},
ta AS (SELECT patientid, split_date, 'forecasting' AS kind, prompt, answer FROM fc SEMI JOIN sp USING (patientid, split_date) UNION ALL SELECT patientid, split_date, 'events', prompt, answer FROM et),
tn AS (SELECT *, row_number() OVER (PARTITION BY patientid, split_date ORDER BY {_ORDER}, kind, prompt, answer) AS k FROM ta),
cm AS (SELECT patientid, split_date, {quoted(w.TASKS_START)} || string_agg('Task ' || k || ' is ' || CASE kind WHEN 'events' THEN 'time to event prediction:' ELSE 'forecasting:' END || prompt, chr(10) ORDER BY k) AS prompt,
  string_agg('Task ' || k || ' is ' || CASE kind WHEN 'events' THEN 'time to event prediction:' ELSE 'forecasting:' END || answer, chr(10) ORDER BY k) AS answer, list(kind ORDER BY k) AS kinds FROM tn GROUP BY 1, 2),
fi AS (SELECT cm.*, summary, static, greatest(2000 - ({_COUNT.format(quoted(w.PREAMBLE) + " || static || summary || prompt")} + {_COUNT.format("answer")} + 200), 0) AS room FROM cm JOIN su USING (patientid, split_date) JOIN st USING (patientid)),
his0 AS (SELECT his.*, room FROM his JOIN fi USING (patientid, split_date)){_BUDGET}{sql_timeline("tx", "kept_rows", "patientid, split_date")},
sa0 AS (SELECT fi.*, {quoted(w.PREAMBLE)} || static || coalesce(text, '') || summary || prompt AS instruction FROM fi LEFT JOIN tx USING (patientid, split_date)),
sa AS (SELECT patientid, split_date, instruction, answer, kinds, CAST({_COUNT.format("instruction")} AS INT) AS tokens_input, CAST({_COUNT.format("answer")} AS INT) AS tokens_target FROM sa0)"""
_TIMES = """, ti AS (SELECT fa.patientid, fa.split_date, c.category, CASE c.category WHEN 'death' THEN f_death WHEN 'lot' THEN f_lot ELSE f_prog END AS th, f_lot, lt FROM fa
  LEFT JOIN (SELECT sp.patientid, sp.split_date, max(e.date) AS lt FROM sp JOIN ev e ON e.patientid = sp.patientid AND e.date > sp.split_date GROUP BY 1, 2) z USING (patientid, split_date), (VALUES ('death'), ('progression'), ('lot')) c(category)),
tt AS (SELECT *, th IS NOT NULL AND (category = 'lot' OR f_lot IS NULL OR th < f_lot) AS seen FROM ti)"""
ORACLE = {
    "d15_event_tasks": f"{BASE}{sql_tasks(_DRAWN, '1998-06-01')} SELECT * FROM tasks",
    "d16_landmark_grid": f"""{BASE}{sql_tasks("(VALUES (8), (26), (52), (104)) q(week)", "2100-01-01")}{_TIMES} SELECT tasks.*, round((CASE WHEN seen THEN th ELSE coalesce(f_lot, lt, split_date) END - split_date) / 7, 6) AS true_time, NOT seen AS true_censoring
        FROM tasks JOIN tt USING (patientid, split_date, category)""",
    "d16b_landmark_labels_from_survival": f"""{WITH}, b AS (SELECT patientid, max(date) - min(date) AS os, NOT bool_or(event_category = 'death') AS os_cut, min(date) FILTER (event_category = 'progression') - min(date) AS pfs FROM ev GROUP BY 1),
        x AS (SELECT patientid, 'death' AS category, os AS t, os_cut AS cut FROM b UNION ALL SELECT patientid, 'progression', pfs, false FROM b)
        SELECT patientid, category, CAST(week AS INT) AS week, 7 * week >= t AND NOT cut AS occurred, CASE WHEN 7 * week >= t AND cut THEN 'end' END AS censored FROM x, (VALUES (8), (26), (52), (104)) q(week) WHERE t IS NOT NULL""",
    "d35_static_text": f"{WITH}{TIMELINE}{_STATIC} SELECT * FROM st",
    "d36_timeline_text": f"{BASE}{HISTORY}{sql_timeline('tx', 'his', 'patientid, split_date')} SELECT * FROM tx",
    "d38_history_within_budget": f"{BASE}{HISTORY}, his0 AS (SELECT *, 400 AS room FROM his){_BUDGET} SELECT patientid, split_date, date, event_category, event_name, event_descriptive_name, event_value, source FROM kept_rows",
    "d39_summary_text": f"{FULL}{_SUMMARY} SELECT * FROM su",
    "d40_forecast_task": f"{FULL}{_FORECAST} SELECT * FROM fc",
    "d41_binned_task": f"""{FULL}, bn AS (SELECT event_name, [round(x, 2) FOR x IN list_sort(list_distinct(quantile_cont(v, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))] AS b FROM pairs SEMI JOIN base USING (event_name) GROUP BY 1),
        bt AS (SELECT ft.*, b, substr('{text.LETTERS}', 1 + len([e FOR e IN b[2 : len(b) - 1] IF event_value > e]), 1) AS label FROM ft JOIN bn USING (event_name) WHERE len(b) >= 2),
        bq AS (SELECT patientid, split_date, event_name, b, min(event_descriptive_name) AS n, {_WEEKS} AS wk FROM (SELECT DISTINCT patientid, split_date, event_name, event_descriptive_name, target_date, b FROM bt) GROUP BY 1, 2, 3, 4),
        bp AS (SELECT patientid, split_date, {quoted(w.BINS_START)} || string_agg(chr(10) || chr(9) || n || {quoted(w.FORECAST_TIME)} || wk || chr(10) || {quoted(w.BINS_LIST)} || array_to_string(
          [substr('{text.LETTERS}', k + 1, 1) || ': ' || CASE WHEN k = 0 THEN '-inf' ELSE {number_text("b[k + 1]")} END || ' to ' || CASE WHEN k = len(b) - 2 THEN 'inf' ELSE {number_text("b[k + 2]")} END FOR k IN range(0, len(b) - 1)], ', '), '' ORDER BY event_name) AS prompt FROM bq GROUP BY 1, 2),
        br AS (SELECT patientid, split_date, target_date AS date, 'lab' AS event_category, event_name, event_descriptive_name, label AS event_value, 'events' AS source, split_date AS since0 FROM bt){sql_timeline("bx", "br", "patientid, split_date", start="since0", first=False)}
        SELECT bp.*, text AS answer FROM bp JOIN bx USING (patientid, split_date)""",
    "d42_event_task_text": f"{BASE}{sql_tasks(_DRAWN, '2100-01-01')}{_EVENT_TEXT} SELECT * FROM et",
    "d43_instruction_samples": f"{FULL}{_SAMPLES} SELECT * REPLACE (array_to_string(kinds, ',') AS kinds) FROM sa",
    "d44_pretrain_samples": f"{WITH}{TIMELINE}{_STATIC}{sql_timeline('tx', 'tl', 'patientid')} SELECT patientid, {quoted(w.PREAMBLE)} || static || text AS text FROM tx JOIN st USING (patientid)",
    "d34_dataset_stats": f"""{FULL}{_SAMPLES}, c AS (SELECT array_to_string(list_sort(list_distinct(kinds)), '+') AS combination, tokens_input + tokens_target AS t FROM sa)
        SELECT combination, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens, round(avg(t), 6) AS mean_tokens, min(t) AS least_tokens, max(t) AS most_tokens, count(*) FILTER (t > 1500) AS n_over FROM c GROUP BY 1""",
}

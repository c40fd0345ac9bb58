"""Queries of baselines and scores, with their DuckDB statements.

Predictions are what copying forward gives, plus an offset that the key decides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voyage.functions.random import u01
from voyage.operators import evaluation, landmarks, splits
from voyage.plans import fixtures
from voyage.plans.fixtures import constant, events
from voyage.plans.journeys import CANDIDATES, ELIGIBLE, STATS, U, WITH
from voyage.sources.tables import once

TARGETS = f"""{WITH}{CANDIDATES}{ELIGIBLE}{STATS}, ends AS (SELECT c.patientid, c.date, min(l.lot_date) FILTER (l.lot_date > c.date) AS next_lot FROM cand c LEFT JOIN lots l USING (patientid) GROUP BY ALL),
tgt AS (SELECT x.patientid, x.date, x.event_name, e.date AS target_date, greatest(least(TRY_CAST(e.event_value AS DOUBLE), mean + 3 * std), mean - 3 * std) AS y
  FROM elig x JOIN ends USING (patientid, date) JOIN ev e ON e.patientid = x.patientid AND e.event_name = x.event_name AND e.event_category = 'lab' LEFT JOIN stat s ON s.event_name = x.event_name
  WHERE e.date - x.date BETWEEN 1 AND 90 AND (next_lot IS NULL OR e.date < next_lot))"""
LAST = """, cf AS (SELECT * FROM (SELECT k.*, TRY_CAST(e.event_value AS DOUBLE) AS c, row_number() OVER (PARTITION BY k.patientid, k.date, k.event_name, k.target_date ORDER BY e.date DESC, TRY_CAST(e.event_value AS DOUBLE) DESC) AS r
  FROM (SELECT DISTINCT patientid, date, event_name, target_date FROM tgt) k JOIN ev e ON e.patientid = k.patientid AND e.event_name = k.event_name AND e.event_category = 'lab' AND e.date <= k.date) WHERE r = 1)"""
_OFFSET = U.format(key="'pred|' || patientid || '|' || CAST(date AS VARCHAR) || '|' || event_name || '|' || CAST(target_date AS VARCHAR)")
SCORED = f", scored AS (SELECT t.*, c, c + 20 * ({_OFFSET} - 0.5) AS p FROM tgt t JOIN cf USING (patientid, date, event_name, target_date))"
_CAP = "CASE WHEN {0} IS NOT NULL THEN greatest(least({0}, mean_without_outliers + 3 * std_without_outliers), mean_without_outliers - 3 * std_without_outliers) END"
_RISK = U.format(key="'risk|' || patientid")
SURVIVAL = f""", born AS (SELECT patientid, min(date) AS d0, max(date) AS d1, max(date) FILTER (event_category = 'death') AS dead FROM ev GROUP BY 1),
surv AS (SELECT patientid, race AS "group", coalesce(dead, d1) - d0 AS time, dead IS NOT NULL AS event, {_RISK} AS survival FROM born JOIN con USING (patientid)),
counts AS (SELECT "group", time, count(*) FILTER (event) AS d, count(*) FILTER (NOT event) AS c FROM surv GROUP BY ALL),
steps AS (SELECT *, sum(c + d) OVER (PARTITION BY "group" ORDER BY time DESC) AS n FROM counts),
km AS (SELECT "group", time, product(CASE WHEN n > d THEN 1 - c / (n - d) ELSE 1 END) OVER (PARTITION BY "group" ORDER BY time) AS g FROM steps)"""
AT = 1500
_HALVES = "CAST(sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS VARCHAR)"


def _scored(spark, d):
    last = fixtures.last_values(spark, d)
    pred = last.withColumn("event_value", F.col("event_value") + 20 * (u01(F.lit("pred"), *evaluation.KEY) - 0.5))
    return pred, fixtures.targets(spark, d), last, fixtures.statistics(spark, d)


def _survival(spark, d):
    def build():
        own = events(spark, d).groupBy("patientid").agg(F.min("date").alias("d0"), F.max("date").alias("d1"), F.max(F.when(F.col("event_category") == "death", F.col("date"))).alias("dead"))
        rows = own.join(constant(spark, d), "patientid")
        return rows.select("patientid", F.col("race").alias("group"), F.datediff(F.coalesce("dead", "d1"), "d0").alias("time"), F.col("dead").isNotNull().alias("event"), u01(F.lit("risk"), "patientid").alias("survival"))

    return once(spark, "survival", d, build, by="patientid")


def _rounded(df, places=6):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def d11_sample_variables(spark, d):
    return splits.sample_variables(fixtures.eligible(spark, d), fixtures.statistics(spark, d))


def d16_landmark_times(spark, d):
    ev = events(spark, d)
    return _rounded(landmarks.landmark_times(ev, fixtures.candidates(spark, d)))


def d19_cap_outliers(spark, d):
    ev, stats = events(spark, d), fixtures.statistics(spark, d)
    labs = ev.where("event_category = 'lab'").select("event_name", F.col("event_value").try_cast("double").alias("event_value"))
    return _rounded(evaluation.cap_outliers(labs, stats, "zscore").groupBy("event_name", "capped").agg(F.count("*").alias("n"), F.avg("event_value").alias("mean_value")))


def d21_align_week_start(spark, d):
    labs = events(spark, d).where("event_category = 'lab'").select("patientid", "event_name", "date")
    return evaluation.align_week_start(labs)


def d24_copy_forward(spark, d):
    return _rounded(_scored(spark, d)[2])


def d26_fill_with_copy_forward(spark, d):
    pred, _, last, _ = _scored(spark, d)
    return _rounded(evaluation.fill_with_copy_forward(pred.where(u01(F.lit("gap"), *evaluation.KEY) < 0.7), last))


def d28_forecast_eval(spark, d):
    return _rounded(evaluation.forecast_eval(*_scored(spark, d)))


def d28_forecast_eval_by_trial(spark, d):
    """By trial (a third of the patients each) and variable, over targets that are not imputed."""
    pred, target, last, stats = _scored(spark, d)
    trial = F.pmod(F.substring("patientid", 2, 9).cast("int"), F.lit(3)).alias("trial_id")
    held = target.select("*", trial, F.when(F.dayofmonth("target_date") <= 3, 1).otherwise(0).alias("imputed"))
    return _rounded(evaluation.forecast_eval(pred, held, last, stats, ("trial_id", "event_name")))


def d28b_regression_eval(spark, d):
    return _rounded(evaluation.regression_eval(*_scored(spark, d)[:3]))


def d29_km_censoring(spark, d):
    return _rounded(evaluation.km_censoring(_survival(spark, d)))


def d30_brier_ipcw(spark, d):
    rows = _survival(spark, d)
    return _rounded(evaluation.brier_ipcw(rows, evaluation.km_censoring(rows), AT))


def d33_evaluation_fingerprint(spark, d):
    return evaluation.evaluation_fingerprint(fixtures.targets(spark, d))


QUERIES = {f.__name__: f for f in (d11_sample_variables, d16_landmark_times, d19_cap_outliers, d21_align_week_start, d24_copy_forward, d26_fill_with_copy_forward, d28_forecast_eval, d28_forecast_eval_by_trial, d28b_regression_eval, d29_km_censoring, d30_brier_ipcw, d33_evaluation_fingerprint)}
ORACLE = {
    "d11_sample_variables": f"""{WITH}{CANDIDATES}{ELIGIBLE}{STATS}, pool AS (SELECT patientid, date, event_name, log2(num_samples * nrmse) AS w, count(*) FILTER (log2(num_samples * nrmse) IS NULL) OVER (PARTITION BY patientid, date) AS holes FROM elig JOIN stat USING (event_name)),
        r AS (SELECT *, row_number() OVER (PARTITION BY patientid, date ORDER BY -ln(greatest({U.format(key="'2|' || patientid || '|' || CAST(date AS VARCHAR) || '|' || event_name")}, 1e-12)) / w, event_name) AS k FROM pool WHERE holes = 0 AND w > 0)
        SELECT patientid, date, event_name FROM r WHERE k <= 3""",
    "d16_landmark_times": f"""{WITH}{CANDIDATES}, a AS (SELECT c.patientid, c.date, max(e.date) AS last, min(e.date) FILTER (event_category = 'lot') AS next_lot, min(e.date) FILTER (event_category = 'death') AS death,
        min(e.date) FILTER (event_category = 'progression') AS progression FROM cand c LEFT JOIN ev e ON e.patientid = c.patientid AND e.date > c.date GROUP BY 1, 2),
        g AS (SELECT *, 'lot' AS category, next_lot AS hit FROM a UNION ALL SELECT *, 'death', death FROM a UNION ALL SELECT *, 'progression', progression FROM a),
        h AS (SELECT *, hit IS NOT NULL AND (category = 'lot' OR next_lot IS NULL OR hit < next_lot) AS seen FROM g)
        SELECT patientid, date, category, round((CASE WHEN seen THEN hit ELSE coalesce(next_lot, last, date) END - date) / 7, 6) AS true_time, NOT seen AS true_censoring FROM h""",
    "d19_cap_outliers": f"""{WITH}{CANDIDATES}{STATS}, x AS (SELECT event_name, TRY_CAST(event_value AS DOUBLE) AS v, mean - 3 * std AS low, mean + 3 * std AS high, mean_without_outliers AS m, std_without_outliers AS s FROM ev LEFT JOIN stat USING (event_name) WHERE event_category = 'lab')
        SELECT event_name, CASE WHEN v < low THEN -1 WHEN v > high THEN 1 ELSE 0 END AS capped, count(*) AS n, round(avg(coalesce((greatest(least(v, high), low) - m) / nullif(s, 0), v)), 6) AS mean_value FROM x GROUP BY 1, 2""",
    "d21_align_week_start": f"""{WITH}, x AS (SELECT patientid, event_name, date, CAST(isodow(min(date) OVER (PARTITION BY patientid, event_name)) - 1 AS INT) AS "offset" FROM ev WHERE event_category = 'lab')
        SELECT patientid, event_name, date - "offset" AS date, "offset" FROM x""",
    "d24_copy_forward": f"{TARGETS}{LAST} SELECT patientid, date, event_name, target_date, round(c, 6) AS event_value FROM cf",
    "d26_fill_with_copy_forward": f"""{TARGETS}{LAST}, x AS (SELECT patientid, date, event_name, target_date, c, CASE WHEN {_OFFSET.replace("pred|", "gap|")} < 0.7 THEN c + 20 * ({_OFFSET} - 0.5) END AS p FROM cf)
        SELECT patientid, date, event_name, target_date, p IS NULL AS filled, round(coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY patientid, date, event_name ORDER BY target_date ROWS UNBOUNDED PRECEDING), c), 6) AS event_value FROM x""",
    "d28_forecast_eval": f"""{TARGETS}{LAST}{SCORED}, capped AS (SELECT patientid, date, event_name, target_date, {_CAP.format("y")} AS y, {_CAP.format("p")} AS p, {_CAP.format("c")} AS c FROM scored LEFT JOIN stat USING (event_name)),
        m AS (SELECT event_name, avg(abs(y - p)) AS mae, avg(abs(y - p) / nullif(abs(y), 0)) AS mape, avg(abs(y - c)) AS cm, avg(abs(y - c) / nullif(abs(y), 0)) AS cp, count(*) AS n_samples,
        count(DISTINCT (patientid, date)) AS n_splits, count(DISTINCT patientid) AS n_patients, count(DISTINCT target_date) AS n_dates FROM capped GROUP BY 1)
        SELECT event_name, round(mae, 6) AS mae, round(mape, 6) AS mape, n_samples, n_splits, n_patients, n_dates, round(mae / nullif(cm, 0), 6) AS nmae, round(mape / nullif(cp, 0), 6) AS nmape FROM m""",
    "d28_forecast_eval_by_trial": f"""{TARGETS}{LAST}{SCORED}, capped AS (SELECT CAST(substr(patientid, 2) AS INT) % 3 AS trial_id, patientid, date, event_name, target_date, {_CAP.format("y")} AS y, {_CAP.format("p")} AS p, {_CAP.format("c")} AS c FROM scored LEFT JOIN stat USING (event_name) WHERE day(target_date) > 3),
        m AS (SELECT trial_id, event_name, avg(abs(y - p)) AS mae, avg(abs(y - p) / nullif(abs(y), 0)) AS mape, avg(abs(y - c)) AS cm, avg(abs(y - c) / nullif(abs(y), 0)) AS cp, count(*) AS n_samples,
        count(DISTINCT (patientid, date)) AS n_splits, count(DISTINCT patientid) AS n_patients, count(DISTINCT target_date) AS n_dates FROM capped GROUP BY 1, 2)
        SELECT trial_id, event_name, round(mae, 6) AS mae, round(mape, 6) AS mape, n_samples, n_splits, n_patients, n_dates, round(mae / nullif(cm, 0), 6) AS nmae, round(mape / nullif(cp, 0), 6) AS nmape FROM m""",
    "d28b_regression_eval": f"""{TARGETS}{LAST}{SCORED}, m AS (SELECT count(*) AS n, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, avg(abs(y - c)) AS cm, avg((y - c) * (y - c)) AS cs FROM scored)
        SELECT n, round(mae, 6) AS mae, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae / nullif(cm, 0), 6) AS mae_ratio, round(mse / nullif(cs, 0), 6) AS mse_ratio, round(sqrt(mse / nullif(cs, 0)), 6) AS rmse_ratio FROM m""",
    "d29_km_censoring": f'{WITH}{SURVIVAL} SELECT "group", CAST(time AS INT) AS time, round(g, 6) AS g FROM km',
    "d30_brier_ipcw": f"""{WITH}{SURVIVAL}, here AS (SELECT "group", arg_max(g, time) AS g_at FROM km WHERE time <= {AT} GROUP BY 1),
        x AS (SELECT surv.*, km.g, coalesce(here.g_at, 1) AS g_at FROM surv JOIN km USING ("group", time) LEFT JOIN here USING ("group"))
        SELECT "group", CASE WHEN {AT} >= min(time) AND {AT} < max(time) THEN round(avg(coalesce(CASE WHEN time <= {AT} AND event THEN survival * survival / nullif(g, 0) WHEN time > {AT} THEN (1 - survival) * (1 - survival) / nullif(g_at, 0) END, 0)), 6) END AS brier, count(*) AS n FROM x GROUP BY 1""",
    "d33_evaluation_fingerprint": f"""{TARGETS} SELECT count(DISTINCT patientid) AS n_patients, count(DISTINCT event_name) AS n_events, count(DISTINCT target_date) AS n_dates, count(*) AS n_rows, count(DISTINCT round(y, 6)) AS n_values,
        (SELECT {_HALVES} FROM (SELECT md5(concat_ws('|', patientid, date, event_name, target_date, format('{{:.6f}}', y))) AS h FROM tgt)) AS rows, (SELECT {_HALVES} FROM (SELECT DISTINCT md5(patientid) AS h FROM tgt)) AS ids FROM tgt""",
}

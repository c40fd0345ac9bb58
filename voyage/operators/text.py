"""Timelines, static data, summaries and tasks as text.

Every operator takes rows with key columns (patientid, or patientid and split_date) and gives one text a key. Lines meet in
arrays of one visit, visits in arrays of one key; nothing runs row by row in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voyage.functions import wording as w
from voyage.functions.numbers import number, value_text
from voyage.functions.random import u01
from voyage.sources.tables import written

KEY = ("patientid", "split_date")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def event_line() -> Column:
    """A row's line without its tab."""
    name, value = w.single_dash(F.coalesce("event_descriptive_name", "event_name")), w.single_dash(F.coalesce("event_value", F.lit("")))
    genetic = F.when(value == w.GENETIC_SKIP, name).otherwise(F.concat(name, F.lit(" is "), value))
    prefixed = name
    for category, prefix in w.CATEGORY_PREFIX.items():
        prefixed = F.when(F.col("event_category") == category, F.concat(F.lit(f"{prefix} "), name)).otherwise(prefixed)
    plain = F.concat(prefixed, F.lit(" is "), F.lower(value))
    for (category, event), text in w.REPLACED.items():
        plain = F.when((F.col("event_category") == category) & (F.col("event_name") == event), F.lit(text)).otherwise(plain)
    return F.when(F.col("source") == "genetic", genetic).otherwise(plain)


def timeline_text(rows: DataFrame, key: tuple[str, ...] = KEY, start: str | None = None, cumulative: bool = False, first_preamble: bool = True, name: str = "text") -> DataFrame:
    """(key, text): visit by visit, genetic rows in tags first, sorted by category and name; ties by the line.

    start: the column with the date that the first visit counts from; without it the first visit is 0 weeks later.
    """
    line = F.struct("event_category", "event_name", event_line().alias("line"))
    genetic = F.col("source") == "genetic"
    days = rows.groupBy(*key, "date", *([start] if start else [])).agg(
        F.array_sort(F.collect_list(F.when(genetic, line))).alias("genes"), F.array_sort(F.collect_list(F.when(~genetic, line))).alias("others")
    )
    tab = lambda x: F.concat(F.lit("\t"), x["line"])
    genes = F.concat(F.lit(f"\t{w.GENETIC_OPEN}\n"), F.array_join(F.transform("genes", lambda x: F.concat(tab(x), F.lit(",\n"))), ""), F.lit(f"\t{w.GENETIC_CLOSE}"))
    genes = F.when(F.size("genes") == 0, "").otherwise(F.concat(genes, F.when(F.size("others") > 0, ",\n").otherwise("")))
    body = F.concat(genes, F.array_join(F.transform("others", tab), ",\n"), F.lit(w.DAY_END))
    own = Window.partitionBy(*key).orderBy("date")
    first = F.min("date").over(Window.partitionBy(*key))
    before = F.lag("date").over(own)
    zero = F.col(start) if start else first
    since = F.datediff("date", zero) if cumulative else F.datediff("date", F.coalesce(before, zero))
    head = F.concat(F.lit(w.DAY), w.weeks_text(since), F.lit(w.DAY_TEXT))
    if first_preamble:
        head = F.when(before.isNull(), w.FIRST_DAY).otherwise(head)
    visits = days.select(*key, "date", F.concat(head, body).alias("visit"))
    whole = F.array_sort(F.collect_list(F.struct("date", "visit")))
    return visits.groupBy(*key).agg(F.array_join(F.transform(whole, lambda x: x["visit"]), "").alias(name))


def static_text(constant: DataFrame, first_dates: DataFrame, columns: tuple[str, ...] = ("race", "gender", "ethnicity", "indication"), described: dict[str, str] | None = None) -> DataFrame:
    """(patientid, static): one line a column, with its description; the age is that at the first date (patientid, first_date)."""
    described = {"age": "age of patient", "indication": "cancer indication of patient"} | (described or {})
    rows = constant.join(first_dates, "patientid")
    values = {c: F.col(c).cast("string") for c in columns}
    if "indication" in values:
        values["indication"] = F.regexp_extract("indication", r"enhanced_(.*?)(?:enhanced_|$)", 1)
    if "gender" in values:
        values["gender"] = F.when(F.col("gender") == "M", "male").when(F.col("gender") == "F", "female")
    values["age"] = F.concat((F.year("first_date") - F.col("birthyear")).cast("int").cast("string"), F.lit(" years"))
    lines = [F.concat(F.lit(f"\t{described.get(c, c)} is "), F.coalesce(v, F.lit("nan"))) for c, v in values.items()]
    return rows.select("patientid", F.concat(F.lit(w.CONSTANT), F.concat_ws(",\n", *lines), F.lit(".\n")).alias("static"))


def history_of(events: DataFrame, splits: DataFrame) -> DataFrame:
    """The events up to each split, with split_date."""
    keys = splits.select("patientid", "split_date").distinct()
    return keys.join(events, "patientid").where("date <= split_date")


def history_within_budget(history: DataFrame, budget: Column | int, key: tuple[str, ...] = KEY, keep_first_visit: bool = True, tokens: Callable[[Column], Column] = w.words_and_signs) -> DataFrame:
    """The newest rows whose running token counts stay within the budget; the first visit counts first and always stays.

    tokens: counts the tokens of a text column. Rows of one date: by category, name, value.
    """
    own = Window.partitionBy(*key)
    dates = F.size(F.collect_set("date").over(own))
    base = tokens(F.lit(w.FIRST_DAY)) + tokens(F.lit(w.DAY_TEXT)) * dates
    line = tokens(F.lit(" is \t ,\n")) + base / F.count("*").over(own)
    counted = history.withColumn("cost", tokens(F.col("event_descriptive_name")) + tokens(F.col("event_value")) + line)
    counted = counted.withColumn("first", (F.col("date") == F.min("date").over(own)) & F.lit(keep_first_visit))
    order = own.orderBy(F.desc("first"), F.desc("date"), "event_category", "event_name", "event_value").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.round(F.sum("cost").over(order), 6)
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return counted.withColumn("spent", spent).where((F.col("spent") <= limit) | F.col("first")).drop("cost", "first", "spent")


def summary_text(history: DataFrame, variables: DataFrame, key: tuple[str, ...] = KEY, lot_name: str = "line_name", lot_start: str = "LoT start") -> DataFrame:
    """(key, summary): the last value of each genetic event, the latest line of therapy, the last values of the variables (key, event_name).

    Of rows of one day the one with the largest value is the last. A line that has its own start row is shown by its name, else by its value.
    """
    genetic, lot_row = F.col("source") == "genetic", F.col("event_category") == "lot"
    last = F.struct("date", "event_value", "event_descriptive_name")
    each = history.groupBy(*key, "event_name").agg(
        F.max(last).alias("x"), F.max(F.when(genetic, last)).alias("g"), F.max(F.when(genetic, F.struct("date", "event_value", "event_category"))).alias("y"),
        F.max(F.when(lot_row & (F.col("event_name") == lot_name), F.struct("date", "event_value"))).alias("named"),
        F.max(F.when(lot_row & (F.col("event_value") == lot_start), F.struct("date", "event_descriptive_name"))).alias("started"),
    )
    shown = F.when(F.col("g.event_value") == w.GENETIC_SKIP, F.col("g.event_descriptive_name")).otherwise(F.concat("g.event_descriptive_name", F.lit(" is "), "g.event_value"))
    gene = F.struct(F.col("g.date").alias("date"), F.col("y.event_category").alias("c"), F.col("event_name").alias("n"), F.concat(F.lit("\t"), shown, F.lit(",")).alias("line"))
    said = F.struct("event_name", F.coalesce("x.event_descriptive_name", "event_name").alias("shown"), F.col("x.event_value").alias("value"))
    whole = each.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("g").isNotNull(), gene))).alias("genes"), F.max("named").alias("named"), F.max("started").alias("started"), F.array_sort(F.collect_list(said)).alias("said")
    )
    rows = whole.join(variables.groupBy(*key).agg(F.collect_set("event_name").alias("names")), list(key), "left")
    by_start = F.col("started").isNotNull() & (F.col("named").isNull() | (F.col("started.date") >= F.col("named.date")))
    lot = F.when(by_start, F.col("started.event_descriptive_name")).otherwise(F.col("named.event_value"))
    asked = F.filter("said", lambda x: F.array_contains("names", x["event_name"]))
    values = F.array_join(F.transform(asked, lambda x: F.concat(F.lit("\t"), x["shown"], F.lit(" was "), value_text(x["value"]), F.lit("\n"))), "")
    genes = F.when(F.size("genes") > 0, F.array_join(F.transform("genes", lambda x: x["line"]), "\n"))
    text = F.concat(
        F.lit(w.SUMMARY_GENETIC), F.lit("\n"), F.coalesce(genes, F.lit(w.GENETIC_NONE)), F.lit("\n"), F.lit(w.SUMMARY_LOT),
        F.coalesce(F.concat(F.lit("\t"), lot, F.lit("\n")), F.lit(w.SUMMARY_NO_LOT)),
        F.when(F.col("names").isNotNull(), F.concat(F.lit(w.SUMMARY_LAST), F.coalesce(values, F.lit("")))).otherwise(""),
    )
    return rows.select(*key, text.alias("summary"))


def forecast_task(targets: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, prompt, answer) of rows (key, event_name, event_descriptive_name, target_date, event_value): which weeks to forecast, and what came."""
    weeks = F.array_sort(F.collect_set("target_date"))
    asked = targets.groupBy(*key, "event_name").agg(F.min("event_descriptive_name").alias("shown"), weeks.alias("dates"))
    each = F.concat(F.lit("\n\t"), F.coalesce("shown", "event_name"), F.lit(w.FORECAST_TIME), F.array_join(F.transform("dates", lambda d: w.weeks_text(F.datediff(d, "split_date"))), ", "))
    prompts = asked.select(*key, F.struct("event_name", each.alias("line")).alias("x")).groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    prompts = prompts.select(*key, F.concat(F.lit(w.FORECAST_START), F.array_join(F.transform("x", lambda v: v["line"]), "")).alias("prompt"))
    rows = targets.select(*key, F.col("target_date").alias("date"), F.lit("lab").alias("event_category"), "event_name", "event_descriptive_name", value_text(F.col("event_value").cast("string")).alias("event_value"), F.lit("events").alias("source"), F.col("split_date").alias("since"))
    answers = timeline_text(rows, key, start="since", first_preamble=False, name="answer")
    return prompts.join(answers, list(key))


def bin_label(value: Column, bins: Column) -> Column:
    """The letter of the bin of a value: bins are closed above, the outer ones open; null without bins."""
    inner = F.slice(bins, 2, F.greatest(F.size(bins) - 2, F.lit(0)))
    above = F.size(F.filter(inner, lambda edge: value > edge))
    return F.when(F.size(bins) >= 2, F.substring(F.lit(LETTERS), above + 1, F.lit(1)))


def binned_task(targets: DataFrame, stats: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, prompt, answer) with bins in place of values; variables without bins are left out."""
    bins = stats.select("event_name", F.transform("bins", lambda b: F.round(b, 2)).alias("bins")).where("size(bins) >= 2")
    rows = targets.withColumn("v", number(F.col("event_value").cast("string"))).join(F.broadcast(bins), "event_name")  # one row a variable
    asked = rows.groupBy(*key, "event_name", "bins").agg(F.min("event_descriptive_name").alias("shown"), F.array_sort(F.collect_set("target_date")).alias("dates"))
    n = F.size("bins") - 1
    edge = lambda k: value_text(F.get("bins", k).cast("string"))
    span = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.concat(F.substring(F.lit(LETTERS), k + 1, F.lit(1)), F.lit(": "), F.when(k == 0, "-inf").otherwise(edge(k)), F.lit(" to "), F.when(k == n - 1, "inf").otherwise(edge(k + 1))),
    )
    line = F.concat(F.lit("\n\t"), F.coalesce("shown", "event_name"), F.lit(w.FORECAST_TIME), F.array_join(F.transform("dates", lambda d: w.weeks_text(F.datediff(d, "split_date"))), ", "), F.lit("\n" + w.BINS_LIST), F.array_join(span, ", "))
    prompts = asked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("event_name", line.alias("line")))).alias("x"))
    prompts = prompts.select(*key, F.concat(F.lit(w.BINS_START), F.array_join(F.transform("x", lambda v: v["line"]), "")).alias("prompt"))
    said = rows.select(*key, F.col("target_date").alias("date"), F.lit("lab").alias("event_category"), "event_name", "event_descriptive_name", bin_label(F.col("v"), F.col("bins")).alias("event_value"), F.lit("events").alias("source"), F.col("split_date").alias("since"))
    return prompts.join(timeline_text(said, key, start="since", first_preamble=False, name="answer"), list(key))


def event_task_text(tasks: DataFrame) -> DataFrame:
    """tasks (split_date, end_date, variable_name, censored, occurred) with prompt and answer."""
    prompt = F.concat(F.lit(w.EVENT_START), w.weeks_text(F.datediff("end_date", "split_date")), F.lit(w.EVENT_MID), F.col("variable_name"), F.lit(w.EVENT_END))
    answer = F.concat(
        F.lit(w.ANSWER_START), F.col("variable_name"), F.lit(w.ANSWER_WAS), F.when(F.col("censored").isNotNull(), w.CENSORED).otherwise(w.NOT_CENSORED),
        F.lit(w.AND), F.when(F.col("occurred"), w.OCCURRED).otherwise(w.NOT_OCCURRED), F.lit("\n"),
    )
    return tasks.withColumn("prompt", prompt).withColumn("answer", answer)


def combined_tasks(tasks: DataFrame, key: tuple[str, ...] = KEY, seed: str = "3") -> DataFrame:
    """(key, prompt, answer, kinds): the tasks (key, kind, prompt, answer) of each key in an order that the seed decides, numbered."""
    order = F.struct(u01(F.lit(seed), *key, "kind", "prompt").alias("u"), "kind", "prompt", "answer")
    rows = tasks.groupBy(*key).agg(F.array_sort(F.collect_list(order)).alias("x"))
    kinds = F.create_map(*(F.lit(v) for kv in w.TASK_KINDS.items() for v in kv))
    head = lambda x, k: F.concat(F.lit("Task "), (k + 1).cast("string"), F.lit(" is "), kinds[x["kind"]])
    prompt = F.array_join(F.transform("x", lambda x, k: F.concat(head(x, k), x["prompt"])), "\n")
    answer = F.array_join(F.transform("x", lambda x, k: F.concat(head(x, k), x["answer"])), "\n")
    return rows.select(*key, F.concat(F.lit(w.TASKS_START), prompt).alias("prompt"), answer.alias("answer"), F.transform("x", lambda x: x["kind"]).alias("kinds"))


def instruction_samples(history: DataFrame, static: DataFrame, variables: DataFrame, tasks: DataFrame, budget: int = 8192, padding: int = 200, tokens: Callable[[Column], Column] = w.words_and_signs, inference: bool = False) -> DataFrame:
    """(key, instruction, answer, kinds, tokens_input, tokens_target): what is left of the budget goes to the newest history.

    tasks: (key, kind, prompt, answer). For inference the answer is null and costs nothing.
    """
    asked = combined_tasks(tasks)
    summary = summary_text(history, variables)
    fixed = asked.join(summary, list(KEY)).join(static, "patientid")
    cost = tokens(F.concat(F.lit(w.PREAMBLE), "static", "summary", "prompt")) + (F.lit(0) if inference else tokens(F.col("answer"))) + padding
    fixed = written(fixed.withColumn("room", F.greatest(F.lit(budget) - cost, F.lit(0))), "fixed")  # read twice: for the room, and for the texts
    kept = history_within_budget(history.join(fixed.select(*KEY, "room"), list(KEY)), F.col("room"), tokens=tokens)
    texts = timeline_text(kept.drop("room"), name="timeline")
    out = fixed.join(texts, list(KEY), "left").withColumn("instruction", F.concat(F.lit(w.PREAMBLE), "static", F.coalesce("timeline", F.lit("")), "summary", "prompt"))
    answer = F.lit(None).cast("string") if inference else F.col("answer")
    return out.select(*KEY, "instruction", answer.alias("answer"), "kinds", tokens(F.col("instruction")).alias("tokens_input"), tokens(answer).alias("tokens_target"))


def pretrain_samples(timeline: DataFrame, static: DataFrame) -> DataFrame:
    """(patientid, text): preamble, static data and the whole timeline."""
    texts = timeline_text(timeline, ("patientid",), name="timeline")
    return texts.join(static, "patientid").select("patientid", F.concat(F.lit(w.PREAMBLE), "static", "timeline").alias("text"))


def dataset_stats(samples: DataFrame, limit: int = 8192) -> DataFrame:
    """(combination, n, and sum, mean, least and greatest tokens, n over the limit) of samples (kinds, tokens_input, tokens_target)."""
    total = F.col("tokens_input") + F.coalesce("tokens_target", F.lit(0))
    return samples.groupBy(F.array_join(F.array_sort(F.array_distinct("kinds")), "+").alias("combination")).agg(
        F.count("*").alias("n"), F.sum(total).alias("tokens"), F.avg(total).alias("mean_tokens"), F.min(total).alias("least_tokens"), F.max(total).alias("most_tokens"), F.count_if(total > limit).alias("n_over"),
    )


def forecast_meta(targets: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, weeks, names): of each sample the map from variable to its weeks after the split, in order, and the map from variable to its descriptive name."""
    week = F.datediff("target_date", "split_date") / 7
    rows = targets.groupBy(*key, "event_name").agg(F.array_sort(F.collect_set(week)).alias("weeks"), F.min("event_descriptive_name").alias("name"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_name", c))))
    return rows.groupBy(*key).agg(entries("weeks").alias("weeks"), entries(F.coalesce("name", "event_name")).alias("names"))


def merged_maps(first: Column, second: Column) -> Column:
    """The entries of both maps, the second's value where both have a key; a null map counts as empty."""
    first, second = (F.coalesce(m, F.map_filter(o, lambda k, v: F.lit(False))) for m, o in ((first, second), (second, first)))
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)

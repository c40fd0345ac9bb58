"""The way back from text, reasoning samples and chat rows: parsers, scores and token masks, all with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voyage.functions import wording as w
from voyage.functions.random import u01
from voyage.operators.rows import without_words

KEY = ("patientid", "split_date")
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def parse_timeline_text(texts: DataFrame, names: DataFrame, key: tuple[str, ...] = KEY, start: str = "start_date") -> DataFrame:
    """(key, date, event_category, event_name, event_descriptive_name, event_value, source): the rows that timeline_text wrote.

    texts: (key, start date, text). names: (event_descriptive_name, event_category, event_name, source) without repeats; unknown names
    have category and name "unknown". Dates run from the start by the weeks said, rounded to days. Values are in lower case, but for
    genetic ones.
    """
    first, later = w.FIRST_DAY.strip(), w.DAY_TEXT.strip()
    marked = F.regexp_replace(F.replace("text", F.lit(w.FIRST_DAY), F.lit(f"\n0 {later}\n")), rf"\n({NUMBER}) {later} ?\n", "\u0001$1\u0002")
    visits = texts.select(*key, start, F.posexplode(F.split(F.replace(marked, F.lit(first), F.lit("")), "\u0001")).alias("visit", "part")).where("contains(part, '\u0002')")
    weeks = F.split("part", "\u0002")[0].cast("double")
    days = F.sum(F.round(weeks * 7)).over(Window.partitionBy(*key).orderBy("visit").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    dated = visits.withColumn("date", F.date_add(F.col(start), days)).withColumn("body", F.regexp_replace(F.split("part", "\u0002")[1], r"\.\n\z", ""))
    genes = F.regexp_extract("body", rf"(?s){w.GENETIC_OPEN}\n(.*?){w.GENETIC_CLOSE}", 1)
    others = F.regexp_replace("body", rf"(?s)\t{w.GENETIC_OPEN}.*?{w.GENETIC_CLOSE}(,\n)?", "")
    cut = lambda text, source: F.transform(F.filter(F.split(text, r",?\n"), lambda x: F.trim(F.translate(x, "\t", "")) != ""), lambda x: F.struct(F.regexp_replace(x, r"^\t", "").alias("line"), F.lit(source).alias("source")))
    lines = dated.select(*key, "date", F.explode(F.concat(cut(genes, "genetic"), cut(others, "events"))).alias("x")).select(*key, "date", "x.*")
    split = F.regexp_extract("line", r"^(.*?) is (.*)$", 1), F.regexp_extract("line", r"^(.*?) is (.*)$", 2)
    bare = ~F.col("line").rlike(" is ")
    name = F.when(bare, F.col("line")).otherwise(split[0])
    value = F.when(bare, F.when(F.col("source") == "genetic", w.GENETIC_SKIP).otherwise(F.col("line"))).otherwise(split[1])
    for prefix in w.CATEGORY_PREFIX.values():
        name = F.when(F.col("source") == "events", F.regexp_replace(name, f"^{prefix} ", "")).otherwise(name)
    rows = lines.select(*key, "date", name.alias("event_descriptive_name"), value.alias("event_value"), "source")
    known = rows.join(names, ["event_descriptive_name", "source"], "left")
    return known.select(*key, "date", F.coalesce("event_category", F.lit("unknown")).alias("event_category"), F.coalesce("event_name", F.lit("unknown")).alias("event_name"), "event_descriptive_name", "event_value", "source")


def parse_static_text(texts: DataFrame, described: dict[str, str], key: tuple[str, ...] = ("patientid",), text: str = "static") -> DataFrame:
    """(key, one column a variable): the values of static_text's lines, by their descriptions; null where a line is missing."""
    section = F.regexp_extract(text, rf"(?s){w.CONSTANT.strip()}\n(.*?)\.\n", 1)
    value = lambda comment: F.nullif(F.regexp_extract(section, rf"(?m)^\t\Q{comment}\E is (.*?),?$", 1), F.lit(""))
    return texts.select(*key, *(value(comment).alias(name) for name, comment in described.items()))


def parse_event_answer(text: Column) -> tuple[Column, Column, Column]:
    """(target_name, censored, occurred) of an answer; null where it does not say. "not censored" is looked for first."""
    low = F.lower(text)
    name = F.nullif(F.regexp_extract(text, r"the event \((.*?)\)", 1), F.lit(""))
    censored = F.when(low.contains("not censored"), False).when(low.contains("censored"), True)
    occurred = F.when(low.contains("did not occur") | low.contains("not occurred"), False).when(low.rlike("occurr?ed"), True)
    return name, censored, occurred


def split_tasks(texts: DataFrame, key: tuple[str, ...] = KEY, text: str = "answer") -> DataFrame:
    """(key, task_nr, kind, body): one row a "Task n is ..." block; kind null where no task kind follows."""
    marked = F.regexp_replace(text, r"Task (\d+) is ", "\u0001$1\u0002")
    blocks = texts.select(*key, F.explode(F.split(marked, "\u0001")).alias("block")).where("contains(block, '\u0002')")
    nr, said = F.split("block", "\u0002")[0].cast("int"), F.split("block", "\u0002")[1]
    kind, body = F.lit(None).cast("string"), said
    for name, mark in w.TASK_KINDS.items():
        at = F.ltrim(said).startswith(mark.strip())
        kind, body = F.when(at, name).otherwise(kind), F.when(at, F.ltrim(said).substr(F.lit(len(mark.strip()) + 1), F.length(said))).otherwise(body)
    return blocks.select(*key, nr.alias("task_nr"), kind.alias("kind"), F.regexp_replace(body, r"^\[|\]$", "").alias("body"))


def parse_free_text_values(texts: DataFrame, key: tuple[str, ...] = ("patientid",), text: str = "response", skip: tuple[str, ...] = ("task", "note")) -> DataFrame:
    """(key, week, name, value) of answers in free text, line by line; of the forms the first that fits is taken.

    "12 weeks later ..." and "week 12:" head the lines that follow. Forms: "week 3: name is 4", "name (week 3): 4", "3 weeks: name 4", "name is 4",
    "name: 4", "name = 4", "name, 4", "name 4". Lines that begin with a word of skip and rows without a name are left out.
    """
    lines = texts.select(*key, F.posexplode(F.split(text, "\n")).alias("at", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^[\t \-*]+|[.,;]+$", "")))
    head = F.coalesce(*(F.nullif(F.regexp_extract(F.lower("line"), p, 1), F.lit("")) for p in (rf"^({NUMBER}) weeks? later", rf"^week ({NUMBER})\s*:?$", rf"^({NUMBER}) weeks?\s*:?$"))).cast("double")
    own = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("head", head).withColumn("week0", F.last("head", ignorenulls=True).over(own)).where("head is null and line <> ''")
    for word in skip:
        lines = lines.where(~F.lower("line").startswith(word))
    forms = (
        (rf"(?i)^week ({NUMBER})\s*[:,-]\s*(.+?)\s*(?:is|:|=)\s*({NUMBER})$", 1, 2, 3), (rf"(?i)^(.+?)\s*\(week ({NUMBER})\)\s*[:=]\s*({NUMBER})$", 2, 1, 3), (rf"(?i)^({NUMBER}) weeks?\s*[:,]\s*(.+?)\s*(?:is|:|=)?\s*({NUMBER})$", 1, 2, 3),
        (rf"^(.+?) is ({NUMBER})$", 0, 1, 2), (rf"^(.+?)\s*:\s*({NUMBER})$", 0, 1, 2), (rf"^(.+?)\s*=\s*({NUMBER})$", 0, 1, 2), (rf"^(.+?),\s*({NUMBER})$", 0, 1, 2), (rf"^(.+?) ({NUMBER})$", 0, 1, 2),
    )
    found = F.lit(None).cast("struct<week:double,name:string,value:double>")
    for pattern, week, name, value in reversed(forms):
        g = lambda k: F.regexp_extract("line", pattern, k)  # noqa: B023, E731
        one = F.struct((g(week).cast("double") if week else F.col("week0")).alias("week"), F.trim(g(name)).alias("name"), g(value).cast("double").alias("value"))
        found = F.when(F.col("line").rlike(pattern), one).otherwise(found)
    return lines.select(*key, found.alias("x")).select(*key, "x.*").where("name is not null and name <> ''")


def parse_tagged_values(text: Column, tag: str = "prediction", name: str | None = None) -> Column:
    """array<double>: the numbers inside <tag>, before </tag> where it is not opened, or of the whole text; with a name, those of its lines alone."""
    inside = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    before = F.regexp_extract(text, rf"(?s)^(.*?)</{tag}>", 1)
    body = F.when(text.contains(f"<{tag}>") & (inside != ""), inside).when(text.contains(f"</{tag}>"), before).otherwise(text)
    pattern = rf"\Q{name}\E is ([^\n]*)" if name else r"(\S+)"
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.$", "").try_cast("double")), lambda x: x.isNotNull())


def structured_answer(parsed: DataFrame, key: tuple[str, ...] = ("patientid",)) -> DataFrame:
    """(key, answer): parsed rows (key, task_nr, target_name, censored, occurred) as answer text again."""
    said = F.concat(
        F.lit(w.ANSWER_START), F.col("target_name"), F.lit(w.ANSWER_WAS), F.when(F.col("censored"), w.CENSORED).otherwise(w.NOT_CENSORED), F.lit(w.AND),
        F.when(F.col("occurred"), w.OCCURRED).otherwise(w.NOT_OCCURRED), F.lit("\n"),
    )
    whole = F.array_sort(F.collect_list(F.struct("task_nr", F.concat(F.lit("Task "), F.col("task_nr").cast("string"), F.lit(" is "), F.lit(w.TASK_KINDS["events"]), said).alias("line"))))
    return parsed.where("target_name is not null and censored is not null and occurred is not null").groupBy(*key).agg(F.array_join(F.transform(whole, lambda x: x["line"]), "\n").alias("answer"))


def chat_messages(samples: DataFrame, system: str, copies: int = 1, extra: str = "", seed: int = 0) -> DataFrame:
    """samples (instruction, answer, ...) as messages (array of role and content) and completion, copies times with seeds of their own."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    rows = samples.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    kept = [c for c in samples.columns if c not in ("instruction", "answer")]
    return rows.select(*kept, "copy", (F.col("copy") + seed).alias("seed"), F.array(message("system", F.lit(system)), message("user", F.concat("instruction", F.lit(extra)))).alias("messages"), F.col("answer").alias("completion"))


def mask_prompt_tokens(rows: DataFrame, marker: tuple[int, ...], most: int = 8000) -> DataFrame:
    """rows (ids array<int>, ...) with input_ids of most tokens at most, labels (-100 up to and with the first marker) and attention; rows without the marker are dropped."""
    n, ids = len(marker), F.slice("ids", 1, most)
    listed = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ","), F.lit(","))
    ahead = F.substring_index(listed, "," + ",".join(map(str, marker)) + ",", 1)  # no lambda, which would work the ids out anew at every place
    masked = F.size(F.split(ahead, ",")) - 1 + n
    found = rows.where(F.length(ahead) < F.length(listed))
    labels = F.concat(F.array_repeat(F.lit(-100), masked), F.slice(ids, masked + 1, F.greatest(F.size(ids) - masked, F.lit(0))))
    return found.select(*(c for c in rows.columns if c != "ids"), ids.alias("input_ids"), labels.alias("labels"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"))


def distillation_prompt(prompt: Column, target: Column, background: str, instruction: str, closing: str) -> Column:
    """Background, the task, the reference answer and what to write about it."""
    return F.concat(F.lit(f"{background}\n\n"), prompt, F.lit(f"\n\n{instruction}\n\n"), target, F.lit(f"\n\n{closing}"))


def splice_truth(rows: DataFrame, tag: str = "prediction", response: str = "response", target: str = "target") -> DataFrame:
    """rows with the response's text inside the tag replaced by the target; rows without both tags in order are dropped."""
    a, b = F.instr(response, f"<{tag}>"), F.instr(response, f"</{tag}>")
    body = F.concat(F.substr(F.col(response), F.lit(1), a + len(tag) + 1), F.col(target), F.substr(F.col(response), b))
    return rows.where((a > 0) & (b > a)).withColumn(response, body)


def score_completions(rows: DataFrame, most_error: float = 20.0, scale: float = 30.0, tag: str = "prediction", completion: str = "completion", values: str = "target_values") -> DataFrame:
    """rows with reward, scale * (most_error - clipped mean absolute error) / most_error, 0 where the numbers do not fit the target's; and the tag counts, 0 to 9."""
    said = parse_tagged_values(F.col(completion), tag)
    gaps = F.zip_with(said, F.col(values), lambda a, b: F.abs(a - b))
    error = F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(values), F.lit(0))
    reward = F.when(F.size(said) == F.size(values), scale * (most_error - F.least(error, F.lit(most_error))) / most_error)
    count = lambda x: F.least(F.size(F.split(F.col(completion), x, -1)) - 1, F.lit(9))
    return rows.withColumn("reward", F.coalesce(reward, F.lit(0.0))).withColumn("n_open", count(f"<{tag}>")).withColumn("n_close", count(f"</{tag}>"))


def llm_prompt_tables(samples: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target rows with blank values, one prompt a sample): what a model is asked, and what it is held against."""
    rows = targets.select("patientid", "split_date", "event_name", "target_date", F.lit(None).cast("double").alias("event_value"))
    return rows, samples.select("patientid", "split_date", F.col("instruction").alias("prompt"), F.col("answer").alias("target_prompt"))


def rekey_samples(rows: DataFrame, pattern: str = "%s_split_%s", key: tuple[str, ...] = KEY) -> DataFrame:
    """rows with patientid replaced by an id of the sample; the key columns go."""
    return rows.withColumn("sample_id", F.format_string(pattern, *(F.col(c).cast("string") for c in key))).drop(*key).withColumnRenamed("sample_id", "patientid")


def evaluation_text_tables(samples: DataFrame, targets: DataFrame, last: DataFrame) -> DataFrame:
    """samples with their variables, blank target rows and last observed rows as JSON; one row a sample, empty lists where there is nothing."""
    key = list(KEY)
    blank = targets.select(*key, "event_name", F.struct("event_name", F.col("target_date").cast("string").alias("target_date"), F.lit("NA").alias("event_value")).alias("x"))
    blank = blank.groupBy(*key).agg(F.array_sort(F.collect_set("event_name")).alias("variables"), F.to_json(F.array_sort(F.collect_set("x"))).alias("empty_targets"))
    seen = last.select(*key, F.struct("event_name", F.round("event_value", 6).alias("event_value")).alias("x")).groupBy(*key).agg(F.to_json(F.array_sort(F.collect_set("x"))).alias("last_observed"))
    rows = samples.join(blank, key, "left").join(seen, key, "left")
    return rows.select(*samples.columns, F.coalesce("variables", F.array().cast("array<string>")).alias("variables"), F.coalesce("empty_targets", F.lit("[]")).alias("empty_targets"), F.coalesce("last_observed", F.lit("[]")).alias("last_observed"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of the one and not of the other, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def drawn_patients(rows: DataFrame, share: float = 0.01, seed: str = "round trip", key: str = "patientid") -> DataFrame:
    """The rows of a share of the patients; the id decides, so all tables give the same patients."""
    return rows.where(u01(F.lit(seed), key) < share)


def round_trip_check(wrote: DataFrame, read: DataFrame, share: float = 0.01, skip: tuple[str, ...] = (), skip_genetic: bool = False, seed: str = "round trip", key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, date, event_name, event_value, side): rows of a share of the patients that were written and not read back, or the other way round.

    wrote, read: (key, date, event_name, event_descriptive_name, event_value, source). Names and values are compared in lower case, repeats count. skip: words, in any
    case, whose descriptive names are left out; skip_genetic: so are genetic rows. No rows: the way back is right.
    """

    def shown(df: DataFrame) -> DataFrame:
        rows = drawn_patients(df, share, seed)
        rows = rows.where("source is null or source <> 'genetic'") if skip_genetic else rows
        rows = without_words(rows, "event_descriptive_name", skip) if skip else rows
        return rows.select(*key, "date", F.lower("event_name").alias("event_name"), F.lower("event_value").alias("event_value"))

    return symmetric_difference(shown(wrote), shown(read))


def answers_apart(wrote: DataFrame, read: DataFrame, key: tuple[str, ...], share: float = 0.01, seed: str = "round trip", fields: tuple[str, ...] = ("target_name", "censored", "occurred")) -> DataFrame:
    """(key, field, wrote, read): the fields of event answers, one row a key in either table, that differ; a missing row differs in all."""
    side = lambda df, name: drawn_patients(df, share, seed).select(*key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(name))
    both = side(wrote, "a").join(side(read, "b"), list(key), "full")
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col("a")[f].alias("wrote"), F.col("b")[f].alias("read")) for f in fields))
    return both.select(*key, F.explode(cells).alias("x"), (F.col("a").isNull() | F.col("b").isNull()).alias("alone")).select(*key, "x.*", "alone").where("alone or not (wrote <=> read)").drop("alone")


def completion_logprobs(logprobs: Column, prompt_tokens: Column) -> Column:
    """The log-probabilities behind those of the prompt's tokens; none if the answer has none, null if there are fewer than the prompt has tokens."""
    n = F.size(logprobs)
    return F.when(n >= prompt_tokens, F.slice(logprobs, prompt_tokens.cast("int") + 1, F.greatest(n - prompt_tokens.cast("int"), F.lit(0))))

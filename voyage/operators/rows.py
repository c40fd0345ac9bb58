"""Small operators on whole tables: filters, checks of keys, joins that tell where a row comes from, and draws that keys decide."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voyage.functions.random import u01


def of_patient(rows: DataFrame, patient: str, order: tuple[str, ...] = ("date", "event_category", "event_name")) -> DataFrame:
    """One patient's rows, sorted."""
    return rows.where(F.col("patientid") == patient).orderBy(*order)


def shaped(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with exactly these columns (name to type), in this order; missing ones null."""
    return rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def without_words(rows: DataFrame, column: str, words: tuple[str, ...]) -> DataFrame:
    """rows whose text holds none of the words, in any case; null texts stay."""
    pattern = "(?i)" + "|".join(map(re.escape, words))
    return rows.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def with_content(rows: DataFrame, column: str) -> DataFrame:
    """rows whose array has an element, or whose text has more than ASCII white space."""
    kind = dict(rows.dtypes)[column]
    return rows.where(F.size(column) > 0 if kind.startswith("array") else F.col(column).rlike(r"[^\x09-\x0D\x20]"))


def blanked(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """rows with null labels, as predictors may see them."""
    return rows.withColumns({c: F.lit(None).cast(dict(rows.dtypes)[c]) for c in labels})


def assert_blank(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """rows, failing when one with a label that is not null is read."""
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} is not blank"))).cast(dict(rows.dtypes)[c]) for c in labels})


def compared(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, found): both, left_only or right_only, one row a different key."""
    a, b = (df.select(*keys).distinct().withColumn(side, F.lit(True)) for df, side in ((left, "l"), (right, "r")))
    found = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only")
    return a.join(b, list(keys), "full").select(*keys, found.alias("found"))


def same_sets(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: whether both have the same different keys."""
    return compared(left, right, keys).agg((F.count_if(F.col("found") != "both") == 0).alias("same"))


def common_ids(first: DataFrame, *others: DataFrame, key: str = "patientid") -> DataFrame:
    """The different ids that all tables have."""
    out = first.select(key).distinct()
    for df in others:
        out = out.join(df, key, "left_semi")
    return out


def in_order_of(rows: DataFrame, keys: DataFrame, key: str, place: str) -> DataFrame:
    """The rows of the keys' table (key, place) with their place there; keys without a row have nulls, so that both tables match place by place."""
    return keys.select(key, place).join(rows, key, "left")


def labelled(labels: DataFrame, representations: DataFrame, key: str = "patientid") -> DataFrame:
    """All labels with their patient's representation, null where there is none."""
    return labels.join(representations, key, "left")


def last_of(rows: DataFrame, subset: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row for each different subset: the last by the order."""
    own = Window.partitionBy(*subset).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")


def repeated_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """All rows of keys that more than one row has."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")


def dated_once(rows: DataFrame, subset: tuple[str, ...], date: str = "date") -> DataFrame:
    """One row for each different subset and date, but all rows without a date; of equal ones the first by all columns."""
    own = Window.partitionBy(*subset, date).orderBy(*rows.columns)
    return rows.withColumn("_k", F.row_number().over(own)).where(f"_k = 1 or {date} is null").drop("_k")


def latest_of(first: DataFrame, second: DataFrame, keys: tuple[str, ...], date: str = "date") -> DataFrame:
    """(keys, date, value): the most recent row of both tables (keys, date, value); of one day the second table's, then the greatest value."""
    both = first.withColumn("_side", F.lit(1)).unionByName(second.withColumn("_side", F.lit(2)))
    return both.groupBy(*keys).agg(F.max(F.struct(date, "_side", "value")).alias("x")).select(*keys, f"x.{date}", "x.value")


def week_gaps(rows: DataFrame, by: tuple[str, ...] = ("patientid",)) -> DataFrame:
    """(by, date, weeks): the different dates with the weeks since the one before; 0 for the first."""
    dates = rows.select(*by, "date").distinct()
    before = F.lag("date").over(Window.partitionBy(*by).orderBy("date"))
    return dates.select(*by, "date", F.coalesce(F.datediff("date", before) / 7, F.lit(0.0)).alias("weeks"))


def draw(rows: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """n rows, those whose keys draw the least numbers; the same ones at every run."""
    return rows.withColumn("_u", u01(F.lit(seed), *keys)).orderBy("_u", *keys).limit(n).drop("_u")


def fraction(rows: DataFrame, share: float, seed: str, *keys: str) -> DataFrame:
    """About a share of the rows; all rows of equal keys stay or go together."""
    return rows.where(u01(F.lit(seed), *keys) < share)


def one_category(rows: DataFrame, categories: tuple[str, ...], draws: int, seed: str, keys: tuple[str, ...] = ("patientid", "split_date")) -> DataFrame:
    """(keys, category): draws with replacement from the categories for each key, repeats left out."""
    at = F.floor(u01(F.lit(seed), *keys, "draw") * len(categories)).cast("int")
    drawn = rows.select(*keys).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return drawn.select(*keys, F.get(F.array(*map(F.lit, categories)), at).alias("category")).distinct()


def replicated(rows: DataFrame, n: int) -> DataFrame:
    """Each row n times, numbered from 0."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def wide(rows: DataFrame, by: tuple[str, ...], names: tuple[str, ...], name: str = "event_name", value: str = "event_value") -> DataFrame:
    """One column for each name, its least value of the group; the names are given, so the data are read once."""
    return rows.groupBy(*by).agg(*(F.min(F.when(F.col(name) == n, F.col(value).try_cast("double"))).alias(n) for n in names))


def age_at(date: Column, birth: Column) -> Column:
    """Whole years of 365 days."""
    return F.floor(F.datediff(date, birth) / 365).cast("int")

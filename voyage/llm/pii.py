"""Personal data: fixed patterns, then bootstrapped contextual extraction. DataFrame functions only.

Seeds are what the patterns of e-mail, IP, card and telephone find, and values in the shape of keys (SECRET). A lexical pattern is
a label, the sign that sets it apart from a value (=, :, #, an opening quote or bracket) and whether the value is closed again:
`token = "` and `"`. Patterns and all values that stand in them, seeds or not, form a bipartite graph; plain words count
against a pattern. Confidence goes from seeds to patterns and from patterns to values, round by round, as joins and grouped sums: a value
that a good pattern shares with another one speaks for that one too. Patterns of high confidence then mark all their
values, whatever their shape, as identifiers (kind id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voyage.llm.store import written

#: The four kinds as fixed by the contract. Quantifiers are possessive where nothing that follows could use their characters; a run that
#: cannot match from its first character (or from where the last match ended) is not tried again from inside.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = ("email", "ip", "card", "phone", "id")
#: A label, its sign, a value of six characters or more, and what closes it.
IN_CONTEXT = r"""(?<![\p{L}\p{N}_.-])([\p{L}_][\p{L}\p{N}_.-]*+)(\s{0,3}[=:#]\s{0,3}["'(\[<]?|\s{1,3}["'(\[<])([^\s"'()\[\]<>,;]{6,})(["')\]>]?)"""
#: Values that are keys by their shape: 24 hexadecimal digits or more of both sorts, or 20 or more of small and capital letters and digits.
SECRET = r"\A(?:(?=(?:[^0-9]*[0-9]){4})(?=(?:[^a-f]*[a-f]){2})[0-9a-f]{24,}|(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=(?:[^0-9]*[0-9]){3})[A-Za-z0-9_/+]{20,}=*)\z"
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
ROUNDS, SUPPORT, SURE = 3, 3, 0.8
PIECE = 64


def scanned(rows: DataFrame, name: str, source: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with column name: the running combinations of the integers of an array column.

    Arrays are cut into pieces of PIECE, which are scanned on their own, as are their last values; so appending, which copies, stays within a piece,
    and the work grows with the array. source must be a column of a projection of its own.
    """
    none = F.expr("CAST(array() AS array<int>)")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    scan = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, combine(last(acc), x)).otherwise(x))))
    numbers = F.when(F.size(source) > 0, F.sequence(F.lit(0), F.floor((F.size(source) - 1) / PIECE).cast("int"))).otherwise(none)
    cut = rows.withColumn("_pieces", F.transform(F.transform(numbers, lambda k: F.slice(source, k * PIECE + 1, PIECE)), scan))
    cut = cut.withColumn("_before", scan(F.transform("_pieces", last)))
    moved = F.transform(F.arrays_zip(F.col("_pieces").alias("own"), F.concat(F.array(F.lit(None).cast("int")), F.slice("_before", 1, F.greatest(F.size("_before") - 1, F.lit(0)))).alias("ahead")), lambda z: F.transform(z["own"], lambda x: F.when(z["ahead"].isNull(), x).otherwise(combine(z["ahead"], x))))
    return cut.withColumn(name, F.when(F.size("_pieces") > 0, F.flatten(moved)).otherwise(none)).drop("_pieces", "_before")


def with_matches(rows: DataFrame, name: str, pattern: str, when: Column, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with column name, array<struct<start, end, match>>: the leftmost non-overlapping matches in text that keep accepts, in code points; none but where when holds.

    What lies between matches gives their places: split and extract_all walk through the text alike.
    """
    none = F.expr("CAST(array() AS array<struct<step: int, size: int, match: string>>)")
    pairs = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"))
    sized = F.transform(F.filter(pairs, lambda x: x["match"].isNotNull()), lambda x: F.struct((F.length(x["gap"]) + F.length(x["match"])).alias("step"), F.length(x["match"]).alias("size"), x["match"].alias("match")))
    found = rows.withColumn("_found", F.when(when, sized).otherwise(none)).withColumn("_steps", F.col("_found.step"))
    found = scanned(found, "_ends", "_steps", lambda t, x: t + x)
    placed = F.transform(F.arrays_zip(F.col("_found").alias("m"), F.col("_ends").alias("end")), lambda x: F.struct((x["end"] - x["m"]["size"]).alias("start"), x["end"].alias("end"), x["m"]["match"].alias("match")))
    return found.withColumn(name, F.filter(placed, lambda m: keep(m["match"])) if keep else placed).drop("_found", "_steps", "_ends")


def luhn(digits: Column) -> Column:
    """Whether the digits pass: from the right, every second one doubled, less nine above nine."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * (i % 2 + 1))
    return F.aggregate(places, F.lit(0), lambda t, d: t + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def with_base(rows: DataFrame) -> DataFrame:
    """rows with base, array<struct<start, order, end>> of the fixed kinds by start; order is the kind's place in ORDER. And starts and tops, their starts and the greatest end so far."""
    digit = F.col("text").rlike("[0-9]")
    guards = {"email": F.contains("text", F.lit("@")), "ip": digit & F.contains("text", F.lit(".")), "card": digit, "phone": digit & F.contains("text", F.lit("+"))}
    for kind, guard in guards.items():
        rows = with_matches(rows, kind, KINDS[kind], guard, lambda m, kind=kind: holds(kind, m))
    spans = lambda kind: F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(ORDER.index(kind)).alias("order"), m["end"].alias("end")))
    rows = rows.withColumn("base", F.array_sort(F.concat(*map(spans, KINDS)))).drop(*KINDS)
    return scanned(rows.withColumn("starts", F.col("base.start")).withColumn("_own", F.col("base.end")), "tops", "_own", F.greatest).drop("_own")


def overlapped(start: Column, end: Column) -> Column:
    """Whether one of the base spans (columns starts, tops) shares a place with [start, end): of those that begin before the end, by halving, one ends behind the start."""
    bits = F.array(*(F.lit(1 << k) for k in range(26, -1, -1)))
    before = F.aggregate(bits, F.lit(0), lambda n, bit: F.when((n + bit <= F.size("starts")) & (F.get("starts", n + bit - 1) < end), n + bit).otherwise(n))
    return (F.size("starts") > 0) & F.coalesce(F.get("tops", before - 1) > start, F.lit(False))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_values(rows: DataFrame) -> DataFrame:
    """rows with values, array<struct<start, end, value, pattern, based, seed>>: the values that stand in a lexical pattern; based: one that a base span overlaps."""
    rows = with_matches(rows, "_context", IN_CONTEXT, F.col("text").rlike(r"[=:#\"'(\[<]"))

    def one(m: Column) -> Column:
        group = lambda k: F.regexp_extract(m["match"], IN_CONTEXT, k)
        start = m["start"] + F.length(group(1)) + F.length(group(2))
        pattern = F.concat_ws(" ", F.lower(group(1)), F.regexp_replace(group(2), r"\s", ""), group(4))
        return F.struct(start.alias("start"), (start + F.length(group(3))).alias("end"), group(3).alias("value"), pattern.alias("pattern"))

    rows = rows.withColumn("_values", F.transform("_context", one))
    based = F.transform("_values", lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end"), v["value"].alias("value"), v["pattern"].alias("pattern"), overlapped(v["start"], v["end"]).alias("based")))
    seeds = F.transform(based, lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end"), v["value"].alias("value"), v["pattern"].alias("pattern"), v["based"].alias("based"), (v["based"] | v["value"].rlike(SECRET)).alias("seed")))
    return rows.withColumn("values", seeds).drop("_context", "_values")


def confident(graph: DataFrame) -> DataFrame:
    """(pattern) of high confidence from rows (pattern, value, seed).

    A pattern's confidence is its values' summed confidence over their number plus one, so rare patterns count little; a value's is
    that of its best pattern, seeds have 1. SUPPORT different values of confidence SURE or more stand behind a pattern that
    counts.
    """
    edges = written(graph.groupBy("pattern", "value").agg(F.max(F.col("seed").cast("int")).alias("seed")), "edges")
    strength = edges.groupBy("value").agg(F.max("seed").cast("double").alias("c"))
    for k in range(ROUNDS):
        scored = edges.join(strength, "value").groupBy("pattern").agg((F.sum("c") / (F.count("*") + 1)).alias("p"), F.count_if(F.col("c") >= SURE).alias("support"))
        scored = scored.where(F.col("support") >= SUPPORT)
        if k + 1 == ROUNDS:
            return scored.where(F.col("p") >= SURE).select("pattern")
        best = F.greatest(F.max("seed").cast("double"), F.coalesce(F.max("p"), F.lit(0.0)))
        strength = written(edges.join(scored, "pattern", "left").groupBy("value").agg(best.alias("c")), "strength")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and spans (arrays of start, order, end; places in code points, end exclusive).

    base holds the fixed kinds' spans, spans those and what the method adds: values of confident patterns that no base span
    overlaps. Null text: empty. Rows without an id come back with their spans; repeated rows come back repeated. No rows: no
    rows. Other columns are not looked at.
    """
    text, key = F.coalesce(F.col(text_col), F.lit("")), ["row", "check"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("row"), F.hash(text).alias("check"))
    told = written(with_values(with_base(rows)).select("id", *key, "base", "values"), "seeds")
    graph = told.select(*key, F.explode("values").alias("v")).select(*key, "v.*")
    sure = confident(graph.select("pattern", "value", "seed"))
    span = F.struct(F.col("start"), F.lit(ORDER.index("id")).alias("order"), F.col("end"))
    new = graph.where("not based").join(sure, "pattern").groupBy(*key).agg(F.collect_set(span).alias("more"))  # of one text
    return told.join(new, key, "left").select(F.col("id").alias(id_col), "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """All whole documents; n_id counts the spans that the method adds."""
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["order"] == ORDER.index(kind))).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, ORDER), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voyage.llm.store import LOWER, UPPER, written

#: (host, path, verdict); a rule fits its host and all subdomains, the longest that fits wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: The labelled URL table is made of these words, fixed values chosen for this operator: a host is one or two of them, the table has
#: each of them once or more in the shapes that addresses take. SALES marks hosts to block, TOPICS hosts to allow.
SALES = (
    "adult bet bonus bride casino cash cheap cialis click crack credit deal debt diet erotic escort fake free gamble girls hack jackpot keygen loan lottery"
    " lucky mining payday pills poker porn prize promo replica roulette sex slots spam sugar torrent viagra warez webcam win xxx"
).split()
TOPICS = (
    "academy archive art bank bird book botany bridge city climate college council culture data doctor earth farm film forest garden geology health history hotel"
    " island journal kitchen language law library market math medicine museum music nature news ocean paper park people plant poetry press radio recipe river school"
    " science society sport street teacher theatre town train travel union village water weather wiki world"
).split()
#: Syllables of invented names, which say nothing for or against a host.
SYLLABLES = "and ble ed en er ha hat he her ing ion it ly nd nt on or ou re sh st th ti tion wh".split()


def labelled_urls(spark: SparkSession, rows: int = 200) -> DataFrame:
    """(url, blocked, part): a small labelled table; part says which fifth a row is in, words of one fifth are in no other.

    Every second row is to be blocked. Sub-domains, top-level domains, languages and paths are dealt alike to both labels, so that
    only names tell them apart; half of the allowed rows have invented names.
    """
    k, b = F.col("id"), F.col("id") % 2
    n = F.floor(k / 2).cast("int")

    def pick(words: list[str], at: Column) -> Column:
        return F.get(F.array(*map(F.lit, words)), F.pmod(at, F.lit(len(words))).cast("int"))

    def hashed(salt: int) -> Column:
        return F.pmod(F.xxhash64(k, F.lit(salt)), F.lit(1 << 30))

    part = n % 5
    word = lambda words: pick(words, part + 5 * (F.floor(n / 5) % (len(words) // 5)))  # noqa: E731  of the part's own words
    invented = F.concat(*(pick(SYLLABLES, hashed(salt)) for salt in (1, 2, 3)))
    name = F.when(b == 1, F.concat(word(SALES), F.lit("-"), pick([*SALES[::5], "farm", "shop", "now", "online"], hashed(4)))).when(F.floor(n / 5) % 2 == 0, invented).otherwise(word(TOPICS))
    path = F.concat(F.lit("/"), pick(["en", "de", "fr", "es"], hashed(5)), F.lit("/"), (hashed(6) % 10_000).cast("string"), pick(["", "/", ".html"], hashed(7)))
    host = F.concat(pick(["", "www.", "m.", "blog."], hashed(8)), name, pick([".example.com", ".example.org", ".example.net"], hashed(9)))
    url = F.concat(pick(["http://", "https://"], hashed(10)), host, path, pick(["", "?page=2&ref=x", "#top"], hashed(11)))
    return spark.range(rows).select(url.alias("url"), b.cast("int").alias("blocked"), part.alias("part"))


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no "://"."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, whole, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def buckets(host: Column, path: Column, n: int, size: int) -> Column:
    """The distinct hash buckets of the character n-grams of ^host$ and of the path."""
    text = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit(" "))
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.pmod(F.xxhash64(text.substr(i, F.lit(n))), F.lit(size)).cast("int")))


def fit(spark: SparkSession, labelled: DataFrame, n: int = 4, size: int = 4096, steps: int = 150, rate: float = 12.0, decay: float = 0.0003, bias: float = 0.1) -> tuple[float, list[float]]:
    """Intercept and one weight a bucket, from rows (url, blocked) of a small labelled table.

    Gradient descent in the dual: a weight vector is a sum of rows times coefficients, so that each step needs only the
    rows' inner products. The rows meet in one array: the table must stay small, of hundreds of rows.
    """
    host, path = address(F.col("url"))
    rows = labelled.select("url", F.col("blocked").cast("double").alias("y"), buckets(host, path, n, size).alias("b"))
    table = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "b"))).alias("rows"))
    table = table.withColumn("kernel", F.expr(f"transform(rows, r -> transform(rows, s -> {bias}D + size(array_intersect(r.b, s.b)) / sqrt(size(r.b) * size(s.b))))"))
    table = written(table, "kernel")  # else the kernel would be worked out anew within every step
    step = f"""transform(rows, (r, i) -> a[i] * (1 - {rate * decay}D) + {rate}D / size(rows)
        * (r.y - 1 / (1 + exp(-aggregate(sequence(0, size(rows) - 1), 0D, (t, j) -> t + a[j] * kernel[i][j])))))"""
    table = table.withColumn("a", F.expr(f"aggregate(sequence(1, {steps}), transform(rows, r -> 0D), (a, k) -> {step})"))
    parts = table.select(F.posexplode("rows").alias("i", "r"), "a").select("r.b", (F.expr("a[i]") / F.sqrt(F.size("r.b"))).alias("w"), (F.expr("a[i]") * bias).alias("bias"))
    weights = [0.0] * size
    for bucket, w in parts.select(F.explode("b").alias("bucket"), "w").groupBy("bucket").agg(F.sum("w")).collect():  # size numbers at most
        weights[bucket] = w
    return parts.agg(F.sum("bias")).first()[0], weights


def url_filter(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, n: int = 4, size: int = 4096) -> DataFrame:
    """Per row: id, host, path, rule (or null), score (log-odds of block), verdict.

    Null url or one without "://": empty host and path, no rule, verdict by the score of the empty address. Repeated rows
    and rows without an id come back as they are. No rows: no rows. Other columns are not looked at.
    """
    bias, weights = fit(pages.sparkSession, labelled, n, size)
    host, path = address(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    bits = buckets(host, path, n, size)
    table = F.lit(weights)
    rows = rows.select("*", bits.alias("bits"))
    score = F.lit(bias) + F.aggregate("bits", F.lit(0.0), lambda t, b: t + F.get(table, b)) / F.sqrt(F.size("bits"))
    rows = rows.select("*", score.alias("score"))
    return rows.select(id_col, "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page addresses."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), labelled_urls(spark))

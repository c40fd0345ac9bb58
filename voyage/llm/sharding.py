"""Shards of near equal bytes by sampled splitters. DataFrame functions only.

Records are ordered by 60 bits of their text's MD5 hash, then by id, so equal texts lie side by side. A sample, drawn with a chance
in proportion to a record's size, gives quantile splitters that range-partition the records; the exact bytes and rows before each
range then turn running sums within ranges into global ones, and these say where an overfull range is cut into
shards. No task handles a shard, or more than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voyage.llm.store import written

LEAST = -(1 << 63)
RANGES_AT_MOST, DRAWS, CELL = 4096, 32, 52


def splitters(rows: DataFrame, ranges: int, total: int) -> DataFrame:
    """(range, cell, lo1, lo2, hi1, hi2): key ranges [lo, hi) of about equal bytes, each once for every cell (k1 >> CELL) that it meets.

    A sampled row's weight is its size over the step, 1 at least; about ranges * DRAWS rows are drawn, RANGES_AT_MOST * DRAWS at most
    as expected. The first range has no lower, the last no upper end.
    """
    step = max(1.0, total / (ranges * DRAWS))
    chance = F.pmod(F.xxhash64("k1", "id", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(chance * step < F.col("size")).select("k1", "k2", F.greatest(F.lit(1.0), F.col("size") / step).alias("w"))
    drawn = drawn.groupBy("k1", "k2").agg(F.sum("w").alias("w"))
    every = Window.partitionBy(F.lit(0)).orderBy("k1", "k2")
    upto = drawn.withColumn("upto", F.sum("w").over(every)).withColumn("all", F.sum("w").over(Window.partitionBy(F.lit(0))))
    lows = upto.groupBy(F.floor(F.col("upto") * ranges / F.col("all")).alias("q")).agg(F.min(F.struct("k1", "k2")).alias("lo"))
    first = rows.sparkSession.range(1).select(F.struct(F.lit(LEAST).alias("k1"), F.lit(LEAST).alias("k2")).alias("lo"))
    lows = first.union(lows.where("q > 0").select("lo")).distinct()
    ends = lows.select("lo", F.lead("lo").over(Window.partitionBy(F.lit(0)).orderBy("lo")).alias("hi")).withColumn("range", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lo")))
    last = F.coalesce(F.col("hi.k1"), F.lit((1 << 63) - 1))
    cells = F.explode(F.sequence(F.shiftright(F.col("lo.k1"), CELL), F.shiftright(last, CELL))).alias("cell")
    return ends.select("range", cells, F.col("lo.k1").alias("lo1"), F.col("lo.k2").alias("lo2"), F.col("hi.k1").alias("hi1"), F.col("hi.k2").alias("hi2"))


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text plus overhead), text_crc32, shard, slot (gapless from 0 within the shard).

    Shards take near equal bytes. Equal texts share a shard, unless they exceed an eighth of one; then they are cut by
    id. Null text: no bytes. Rows without an id take part and come first among equal texts; repeated rows each take a
    slot. No rows: no rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("own"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("k1"))
    rows = written(rows.withColumn("id", F.coalesce("own", F.lit(LEAST))), "records")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(RANGES_AT_MOST, max(shards, math.ceil(n / 100_000)))
    large = rows.groupBy("k1").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > total / shards / 8).select("k1", F.lit(True).alias("large"))  # fewer than 8 * shards rows
    rows = rows.join(F.broadcast(large), "k1", "left").withColumn("k2", F.when(F.col("large"), F.col("id")).otherwise(F.lit(LEAST)))
    ends = F.broadcast(splitters(rows, ranges, max(1, total)))  # ranges + 4096 rows at most
    above = (F.col("k1") > F.col("lo1")) | ((F.col("k1") == F.col("lo1")) & (F.col("k2") >= F.col("lo2")))
    below = F.col("hi1").isNull() | (F.col("k1") < F.col("hi1")) | ((F.col("k1") == F.col("hi1")) & (F.col("k2") < F.col("hi2")))
    placed = written(rows.withColumn("cell", F.shiftright("k1", CELL)).join(ends, "cell").where(above & below).select("own", "id", "size", "text_crc32", "k1", "large", "range"), "ranges")

    ahead = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    sums = sums.select("range", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_ahead"))
    inside = Window.partitionBy("range").orderBy("k1", "id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(F.broadcast(sums), "range")
    placed = placed.withColumn("start", F.col("bytes_ahead") + F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("n", F.col("rows_ahead") + F.row_number().over(inside) - 1)
    group = Window.partitionBy("range", "k1")
    middle = F.when(F.col("large"), F.col("start") + F.col("size") / 2).otherwise((F.min("start").over(group) + F.max(F.col("start") + F.col("size")).over(group)) / 2)
    placed = written(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(1, total))).cast("int")).select("own", "size", "text_crc32", "shard", "n"), "shards")
    begin = placed.groupBy("shard").agg(F.min("n").alias("first"))  # one row a shard
    return placed.join(F.broadcast(begin), "shard").select(F.col("own").alias(id_col), "size", "text_crc32", "shard", (F.col("n") - F.col("first")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards of near equal bytes."""
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same: the records in their order, with running sums over all; the checksum folds over the bytes.
ORACLE_OP7 = """
WITH table_ AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
bytes AS (SELECT doc_id, [4294967295] || [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM documents),
crc AS (SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32 FROM bytes, table_),
r AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, text_crc32, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents JOIN crc USING (doc_id)),
total AS (SELECT sum(size) AS total FROM r),
large AS (SELECT k FROM r, total GROUP BY k, total HAVING sum(size) > total / 40 / 8),
placed AS (SELECT r.*, large.k IS NOT NULL AS large, row_number() OVER o - 1 AS n, sum(size) OVER (ORDER BY r.k, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM r LEFT JOIN large USING (k) WINDOW o AS (ORDER BY r.k, doc_id)),
middles AS (SELECT *, CASE WHEN large THEN start + size / 2 ELSE (min(start) OVER (PARTITION BY k) + max(start + size) OVER (PARTITION BY k)) / 2 END AS middle FROM placed),
sharded AS (SELECT *, CAST(least(39, floor(middle * 40 / total)) AS INT) AS shard FROM middles, total)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM sharded
"""

"""Exact top-k inner products by norm-bucketed retrieval.

Vectors of similar length share a bucket; large buckets are dealt into blocks of bounded size. A first pass over the
longest vectors' block gives each query a score that its k-th best cannot fall below. That score over the query's length is the
length that a vector needs: queries of similar need share a part, and parts go only to blocks that hold a vector so long. Over a
block's greatest length besides, it is the cosine a vector of the block must reach: above 1 the block is closed to the query; high
cosines prune by the feasible range of the query's greatest coordinate, others by length. What is left is multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voyage.llm.store import spread, written

BLOCK, QUERIES, COORDINATE_FROM = 4096, 4096, 0.7
#: Scaled vectors have to be shorter, so that all their products fit a long.
LONGEST = 2.0**31


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for r, x in enumerate(lists):
        out[r, : len(x)] = x
    return out


def products(ids: np.ndarray, block: np.ndarray, q_ids: np.ndarray, names: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query's name, id, score) with each query's k best of the block that reach its floor and have another id, ties to smaller ids."""
    length = np.sqrt((block**2).sum(axis=1))
    order = np.lexsort((ids, -length))
    ids, block, length = ids[order], block[order], length[order]
    q_length = np.sqrt((queries**2).sum(axis=1))
    small = np.abs(block).max(initial=0) * np.abs(queries).max(initial=0) * block.shape[1] < 2**53
    exact = block if small else block.astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(q_length * length[0] > 0, floor / (q_length * length[0]), np.where(floor > 0, 2.0, -1.0))
        unit = np.where(length[:, None] > 0, block / length[:, None], 0)
    by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    wide = []
    for q in range(len(q_ids)):
        if need[q] > 1 + 1e-9:
            continue
        if need[q] < COORDINATE_FROM:
            wide.append(q)
            continue
        f = int(np.abs(queries[q]).argmax())
        if f not in by_coordinate:
            at = np.argsort(unit[:, f], kind="stable")
            by_coordinate[f] = at, unit[at, f]
        at, value = by_coordinate[f]
        a, b = np.arccos(np.clip(queries[q, f] / q_length[q], -1, 1)), np.arccos(min(1.0, need[q]))
        low, high = np.cos(min(np.pi, a + b)) - 1e-9, np.cos(max(0.0, a - b)) + 1e-9
        near = at[np.searchsorted(value, low) : np.searchsorted(value, high, side="right")]
        yield from _best(ids[near], exact[near] @ queries[q].astype(exact.dtype), int(q_ids[q]), int(names[q]), floor[q], k)
    if wide:
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(q_length[wide] > 0, floor[wide] / q_length[wide], -1.0).min()
        n = int((length >= least * (1 - 1e-9)).sum())
        scores = exact[:n] @ queries[wide].astype(exact.dtype).T
        for c, q in enumerate(wide):
            yield from _best(ids[:n], scores[:, c], int(q_ids[q]), int(names[q]), floor[q], k)


def _best(ids: np.ndarray, scores: np.ndarray, query: int, name: int, floor: float, k: int) -> Iterator[tuple[int, int, int]]:
    keep = np.flatnonzero((scores >= floor) & (ids != query))
    if len(keep) > k:
        edge = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= edge]
    for i in keep[np.lexsort((ids[keep], -scores[keep]))][:k]:
        yield name, int(ids[i]), int(scores[i])


def search(k: int):
    """Over rows (vectors, queries) of packed blocks: (query, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, queries = batch.column("vectors")[r].as_py(), batch.column("queries")[r].as_py()
                width = max(len(x["v"]) for x in block + queries)
                found = list(
                    products(
                        np.array([x["id"] for x in block]), _matrix([x["v"] for x in block], width),
                        np.array([x["id"] for x in queries]), np.array([x["query"] for x in queries]), _matrix([x["v"] for x in queries], width),
                        np.array([-np.inf if x["floor"] is None else x["floor"] for x in queries]), k,
                    )
                )
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], ["query", "vec_id", "score"])

    return run


def top_k_search(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products with all other rows: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x). is_query: a condition on the rows. Ties go to smaller ids; with fewer than k other
    rows, all. Null vectors and vectors with null or non-finite components take no part, nor rows without an id. Shorter
    vectors count as padded with zeros. Rows with the query's id are its own; other repeated rows each count. Different vectors of one
    asking id are queries of their own, each with its k rows. Fails, when read, for a vector whose scaled length is LONGEST or
    more. No rows or no queries: no rows. Other columns are not looked at.
    """
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")
    )
    squares = F.aggregate("v", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double"))
    rows = rows.withColumn("v", F.when(squares < LONGEST**2, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("a scaled vector is too long for exact products, id "), F.col("id").cast("string")))))
    rows = written(rows.withColumn("bucket", F.floor(F.log(F.sqrt(squares) + 1) / F.log(F.lit(1.05)))), "vectors")
    rooms = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("rooms"))  # one row a bucket: a few hundred at most
    numbered = rows.withColumn("place", F.monotonically_increasing_id())  # of a written table: repeated rows fall apart, too
    dealt = numbered.join(F.broadcast(rooms), "bucket").withColumn("room", F.pmod(F.xxhash64("place"), F.col("rooms")))
    blocks = written(dealt.groupBy("bucket", "room").agg(F.collect_list(F.struct("id", "v")).alias("vectors"), F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("longest")), "blocks")
    asked = rows.where("asks").select("id", "v").distinct().select("*", F.sqrt(squares).alias("length"), F.monotonically_increasing_id().alias("query"))
    asked = written(asked, "asked")
    n = spread(asked, QUERIES)

    def against(queries: DataFrame, some: DataFrame) -> DataFrame:
        """Parts of queries of similar need, the length that a vector must have to reach their floor, meet the blocks that are long enough for one of them."""
        need = F.when(F.col("floor").isNotNull() & (F.col("length") > 0), F.col("floor") / F.col("length")).otherwise(F.when(F.col("floor") > 0, float("inf")).otherwise(float("-inf")))
        sorted_ = written(queries.withColumn("need", need).repartitionByRange(n, "need", "id").withColumn("part", F.spark_partition_id()), "parts")
        packed = written(sorted_.groupBy("part").agg(F.collect_list(F.struct("id", "query", "v", "floor")).alias("queries"), F.min("need").alias("need")), "packed")
        parts = packed.select("part", "need")  # one row for QUERIES queries
        grid = some.select("bucket", "room", "longest").join(F.broadcast(parts), F.col("need") <= F.col("longest") * (1 + 1e-9)).select("bucket", "room", "part")
        return grid.join(packed, "part").join(some, ["bucket", "room"]).select("vectors", "queries").mapInArrow(search(k), "query long, vec_id long, score long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    longest = blocks.orderBy(F.desc(F.col("n") > k), F.desc("bucket"), "room").limit(1)
    first = against(asked.withColumn("floor", F.lit(None).cast("double")), longest)
    floors = first.withColumn("rank", F.row_number().over(best)).where(f"rank = {k}").select("query", F.col("score").cast("double").alias("floor"))
    found = against(written(asked.join(floors, "query", "left"), "queries"), blocks)
    out = found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    return out.join(asked.select("query", F.col("id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others."""
    return top_k_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


#: The same: all products.
ORACLE_OP5 = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""

"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered, from 0 (not toxic) to as many as the labels hold, and come from the labels alone. One weight vector serves all
thresholds: P(grade > k) = sigmoid(w.x - cut_k). Features are presences of hashed words and word beginnings. The model is
fitted on a bounded sample of labelled rows (SAMPLE of grade 0, as many of all others together, by id hash) and scored over all
documents where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voyage.llm import hashing
from voyage.llm.store import texts_of, written

BITS, SAMPLE, STEMS = 18, 3000, (4, 5, 6, 7, 8, 10)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and of longer words' first bytes, as many as each of STEMS says; not yet distinct."""
    start, end, first = hashing.word_spans(data, offs, hashing.ALNUM)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    low = hashing.folded(data)
    texts, names = [text], [hashing.digest(low, start, end)]
    for k, size in enumerate(STEMS):
        long = end - start > size
        texts.append(text[long])
        names.append(hashing.digest(low, start[long], start[long] + size, seed=k + 1))
    return np.concatenate(texts), (np.concatenate(names) >> np.uint64(64 - BITS)).astype(np.int64)


def collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, text): y and the text's different buckets."""
    for batch in batches:
        lists: list = []
        for _, data, offs in hashing.pieces(batch.column("text")):
            text, bucket = features(data, offs)
            both = np.unique((text << BITS) | bucket)
            ends = np.searchsorted(both >> BITS, np.arange(len(offs)))
            lists += [both[a:b] & ((1 << BITS) - 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(lists, pa.list_(pa.int32()))], ["y", "x"])


def telling(rows: DataFrame) -> DataFrame:
    """Rows (y, x) with only those buckets that fit() may use, in order: the others never come to the driver."""
    held = written(rows.withColumn("row", F.monotonically_increasing_id()), "features")
    bad = F.when(F.col("y") > 0, 1.0).otherwise(0.0)
    n_all, p = held.agg(F.count("*"), F.avg(bad)).first()
    if not n_all or not 0 < p < 1:
        return held.select("y", "x").limit(0)
    each = held.select("row", "y", F.explode("x").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(bad).alias("hits"))
    used = counts.where((F.col("n") >= 4) & (F.abs(F.col("hits") - F.col("n") * p) >= 3.99 * F.sqrt(F.col("n") * p * (1 - p)))).select("bucket")  # 2 ** BITS at most
    kept = each.join(F.broadcast(used), "bucket").groupBy("row").agg(F.array_sort(F.collect_list("bucket")).alias("kept"))
    return held.select("row", "y").join(kept, "row", "left").select("y", F.coalesce("kept", F.array().cast("array<int>")).alias("x"))


def fit(grade: np.ndarray, rows: list[np.ndarray], steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) of the proportional-odds model, from grades 0, 1, ... and rows of feature numbers.

    Only features that go with toxic grades (above 0) far beyond chance (four standard deviations) get weights. Without rows of
    grade 0 and of others nothing is toxic.
    """
    levels = int(grade.max(initial=0))
    weights, cuts = np.zeros(1 << BITS, np.float32), 30.0 + np.arange(max(1, levels))
    y = (grade > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return weights, cuts
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    flat = np.concatenate(rows).astype(np.int64)
    n, p = np.bincount(flat, minlength=1 << BITS), y.mean()
    hits = np.bincount(flat, weights=y[row], minlength=1 << BITS)
    z = (hits - n * p) / np.sqrt(np.maximum(n, 1) * p * (1 - p))
    used = np.flatnonzero((np.abs(z) >= 4) & (n >= 4))
    if not len(used):
        return weights, cuts
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    keep = place[flat] >= 0
    row, column = row[keep], place[flat[keep]]
    theta = np.concatenate([np.zeros(len(used)), np.arange(levels, dtype=float)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k, i = grade.astype(int), np.arange(len(y))
    for t in range(1, steps + 1):
        s = np.bincount(row, weights=theta[column], minlength=len(y))
        c = theta[-levels:]
        at = 1 / (1 + np.exp(-np.clip(s[None, :] - c[:, None], -40, 40)))
        upper, lower = np.vstack([np.ones_like(s), at]), np.vstack([at, np.zeros_like(s)])
        share = np.maximum(upper[k, i] - lower[k, i], 1e-12)
        slope_up, slope_low = upper[k, i] * (1 - upper[k, i]) / share, lower[k, i] * (1 - lower[k, i]) / share
        by_score = -(slope_up - slope_low) / len(y)
        grad = np.zeros_like(theta)
        grad[:-levels] = np.bincount(column, weights=by_score[row], minlength=len(used)) + decay * theta[:-levels]
        above, below = np.bincount(k, weights=slope_up, minlength=levels + 1), np.bincount(k, weights=slope_low, minlength=levels + 1)
        grad[-levels:] = (above[1:] - below[:-1]) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta[-levels:] = np.maximum.accumulate(theta[-levels:] - 1e-3 * np.arange(levels)) + 1e-3 * np.arange(levels)
    weights[used] = theta[:-levels]
    return weights, theta[-levels:]


def score(weights: np.ndarray, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = []
            for _, data, offs in hashing.pieces(batch.column("text")):
                text, bucket = features(data, offs)
                keep = weights[bucket] != 0
                both = np.unique((text[keep] << BITS) | bucket[keep])
                total.append(np.bincount(both >> BITS, weights=weights[both & ((1 << BITS) - 1)], minlength=len(offs) - 1))
            s = np.concatenate([*total, np.zeros(0)])
            at = 1 / (1 + np.exp(-np.clip(s[None, :] - cuts[:, None], -40, 40)))
            grade = (at >= 0.5).sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at.sum(axis=0)), pa.array(grade.astype(np.int32)), pa.array(at[0] >= 0.5)], ["id", "expected_severity", "grade", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most sample documents of grade 0 and about as many of the others, each grade alike.

    An id with several grades counts with the highest. Null grades and ids, and labels without a document, are left out.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(grade_col).cast("int")).alias("y"))
    levels = marked.agg(F.coalesce(F.max("y"), F.lit(0))).first()[0]
    chosen = marked.where("y <= 0").orderBy(F.xxhash64("id"), "id").limit(sample)
    for k in range(1, levels + 1):
        chosen = chosen.union(marked.where(f"y = {k}").orderBy(F.xxhash64("id"), "id").limit(-(-sample // levels)))
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "id")  # about twice the sample at most
    held = telling(rows.select("y", "text").mapInArrow(collect_features, "y int, x array<int>")).toPandas()
    held["x"] = [np.asarray(x, np.int32) for x in held["x"]]
    order = sorted(range(len(held)), key=lambda i: (held["y"][i], held["x"][i].tobytes()))
    return fit(np.maximum(held["y"].to_numpy(dtype=float)[order], 0), [held["x"][i] for i in order])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> DataFrame:
    """Per row: id, expected_severity (0 to the highest grade), grade (the likelier side of each cut), toxic (grade above 0).

    labels: rows of id and grade. Null, empty and wordless texts get the severity of no features. Rows without an id are left
    out, repeated rows come back repeated. Without labels of grade 0 and above, nothing is toxic. No rows: no rows. Other
    columns are not looked at.
    """
    weights, cuts = train(docs, labels, id_col, text_col, grade_col, sample)
    out = texts_of(docs, id_col, text_col).mapInArrow(score(weights, cuts), "id long, expected_severity double, grade int, toxic boolean")
    return out.withColumnRenamed("id", id_col)


def graded(labels: DataFrame) -> DataFrame:
    """The labels table with a grade: 0 not toxic, 1 toxic, 2 toxic and of good quality; null if toxic is null."""
    grade = F.when(F.col("toxic") > 0, F.when(F.col("quality") > 0, 2).otherwise(1)).when(F.col("toxic").isNotNull(), 0)
    return labels.withColumn("grade", grade)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, with the labels of the labels table."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))

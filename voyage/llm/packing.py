"""Best-two-fit packing of tokenised documents into sequences of bounded length.

How pieces pack depends on how many there are of each length alone, and that table has no more rows than a sequence has
tokens. The plan is made on it: fill a bin greedily, then replace the bin's smallest piece with two unpacked pieces that
fit the gap and its place more tightly; the same bin is repeated as often as the counts allow. Pieces then take their
places by their rank among those of their length, with joins, wherever they lie.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voyage.llm.store import spread, texts_of, written
from voyage.llm.tokens import Encoder

END = 1
RANKS = 50_000
CELL = 10


def plan(counts: dict[int, int], room: int) -> Iterator[tuple[int, list[int]]]:
    """(how often, lengths of the bin's pieces) until nothing is left."""
    left = np.zeros(room + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    while len(there := np.flatnonzero(left)):
        bin_: Counter[int] = Counter()
        gap = room
        for length in there[::-1]:
            if gap < there[0]:
                break
            if (n := min(int(left[length]), gap // int(length))) > 0:
                bin_[int(length)] += n
                gap -= n * int(length)
        if gap and len(bin_):
            smallest = min(bin_)
            bin_[smallest] -= 1
            free = left.copy()
            for length, n in bin_.items():
                free[length] -= n
            a = np.flatnonzero(free[: gap + smallest + 1])
            a = a[a > 0]
            if len(a):
                at = np.searchsorted(a, gap + smallest - a, side="right") - 1
                b = np.where(at >= 0, a[np.maximum(at, 0)], 0)
                alone = (b == a) & (free[a] < 2)
                lower = np.where(at >= 1, a[np.maximum(at - 1, 0)], 0)
                b = np.where(alone, lower, b)
                total = np.where(b > 0, a + b, 0)
                k = int(total.argmax())
                if total[k] > smallest:
                    bin_[int(a[k])] += 1
                    bin_[int(b[k])] += 1
                    smallest = 0
            if smallest:
                bin_[smallest] += 1
        bin_ = +bin_
        times = min(int(left[length]) // n for length, n in bin_.items())
        for length, n in bin_.items():
            left[length] -= times * n
        yield times, sorted(bin_.elements(), reverse=True)


def places(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, sequence, offset): the pieces of that length with ranks in [from, to) go to sequence + rank - from."""
    out, taken, sequence = [], Counter(), 0
    for times, lengths in plan(counts, room):
        offset = 0
        for length in lengths:
            out.append((length, taken[length], taken[length] + times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return out


def cut(path: str, room: int):
    """Rows (id, text): one row (id, piece, start, length, crc) for every room tokens, the end token included."""
    held: list[Encoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Encoder(path))
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, ids in zip(batch.column("id").to_pylist(), held[0].lists(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for piece, a in enumerate(range(0, len(ids), room)):
                    part = ids[a : a + room]
                    rows.append((i, piece, a, len(part), zlib.crc32(part.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, tokenizer: str, room: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    tokenizer is the path of the vocabulary file, there on every executor. A document's ids end with END; only documents
    longer than room are cut. Null text: empty, one token. Rows without an id are left out, repeated rows are each
    packed. No rows: no rows. Other columns are not looked at.
    """
    pieces = written(texts_of(docs, id_col, text_col).mapInArrow(cut(tokenizer, room), "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # room rows at most
    table = docs.sparkSession.createDataFrame(places(counts, room), "length long, from long, to long, sequence long, offset long")

    salts = spread(pieces, RANKS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    cells = F.sequence(F.shiftright("from", CELL), F.shiftright(F.col("to") - 1, CELL))
    placed = ranked.withColumn("cell", F.shiftright("rank", CELL)).join(table.withColumn("cell", F.explode(cells)), ["length", "cell"]).where("rank >= from and rank < to")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("from")).alias("sequence_id"), "offset")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

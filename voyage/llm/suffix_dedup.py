"""Suffix-array dedup: column-wise construction over many documents.

A document's suffixes cannot be inserted one symbol a round over the whole length of the longest document: that would be
as many rounds as it has bytes. Only the first 200 bytes of a suffix matter, though, so documents are first cut into
overlapping segments at content-defined anchors. The anchor of a 200-byte string is its least hashed 40-byte substring;
equal strings have equal anchors at the same place, so they lie in segments of the same anchor, at the same column.
Segments of one anchor that are equal enter the construction once, with their number. Anchors with different segments
go to one partition. There a construction takes whole anchors, SEGMENTS rows or little more, and keeps three sequential files
beside the file of columns, which is written in the order it is read: for the column reached so far the order of all suffixes, the
Burrows-Wheeler transform (the symbol before each suffix, in that order) and the common prefixes of neighbours. Each round
puts one symbol before every segment. It reads the three files once, block by block: a suffix goes behind those with the
same symbol that were read before it, so the files of the next column are filled symbol by symbol; its common prefix with
the one before it is one more than the least common prefix passed since that one. A suffix that has 200 bytes in common with a
neighbour is a repeated string. The files lie in the task's own temporary folder; a task that is lost begins anew.

An anchor with more than SEGMENTS different segments is not held by one task. Its segments are halved by the place that the
anchor has in their windows; what all windows of a half have in common takes the anchor's place. Equal windows are in the
same half and have the same in common, so they meet again. Halves that are equal go on once, with their number; halves that
are still too many are halved again, down to single windows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voyage.llm import hashing
from voyage.llm.store import only, spread, texts_of, written

ANCHOR = 40
ROOM = 1 << 11
#: Rows of one construction; its files take about 740 bytes a row on disk. BLOCK of them are read at a time.
SEGMENTS, BLOCK = 30_000, 1 << 14
ABSENT = 256
#: Bytes of segments that leave a task at a time.
OUT = 4 << 20


def cut(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments (number of the text, start in it, anchor's place in the segment, windows, anchor's hash, segment's hash)."""
    wide = length - ANCHOR + 1
    low = np.uint64((1 << 31) - 1)
    for a, data, offs in hashing.pieces(column):
        n = len(data)
        if n < length:
            continue
        sums = hashing.running(data)
        at = np.arange(n - ANCHOR + 1)
        name = hashing.substring(sums, at, at + ANCHOR)
        rank = (name & ~low) | at.astype(np.uint64)
        whole = -(-len(rank) // wide) * wide
        blocks = np.full(whole + wide, np.iinfo(np.uint64).max, np.uint64)
        blocks[: len(rank)] = rank
        blocks = blocks.reshape(-1, wide)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        start = np.arange(n - length + 1)
        best = (np.minimum(after[start], before[start + wide - 1]) & low).astype(np.int64)
        text = np.searchsorted(offs, start, side="right") - 1
        inside = start + length <= offs[text + 1]
        start, best, text = start[inside], best[inside], text[inside]
        if not len(start):
            continue
        new = np.concatenate(([True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        s, m, windows, text = start[first], best[first], start[last] - start[first] + 1, text[first]
        shift = m - s
        content = hashing.mix(hashing.digest(data, s, s + windows + length - 1) + shift.astype(np.uint64))
        yield a + text, s - offs[text], shift, windows, name[m], content


def describe_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for text, start, shift, windows, anchor, content in cut(batch.column("text"), length):
                place = (start * ROOM + shift) * ROOM + windows
                yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array(place), pa.array(hashing.signed(anchor)), pa.array(hashing.signed(content))], ["row", "place", "anchor", "content"])

    return run


def fetch_segments(length: int):
    """Rows (row, text, held): the bytes of the held segments."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["anchor", "row", "place", "alone", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                row, data = batch.column("row")[k].as_py(), batch.column("text")[k].as_py().encode()
                for x in batch.column("held")[k].as_py():
                    windows, start = x["place"] % ROOM, x["place"] // ROOM // ROOM
                    out.append((x["anchor"], row, x["place"], x["alone"], data[start : start + windows + length - 1]))
                    size += windows + length
                    if size > OUT:
                        yield packed(out)
                        out, size = [], 0
            yield packed(out)

    return run


class Files:
    """The order, transform and common prefixes of one column's suffixes, each mapped from a file that is read from front to back."""

    def __init__(self, folder: str, name: str, n: int):
        kinds = {"order": np.int32, "transform": np.uint16, "common": np.int16}
        self.columns = [np.memmap(os.path.join(folder, f"{name}-{what}"), kind, "w+", shape=(n,)) for what, kind in kinds.items()]

    def blocks(self) -> Iterator[list[np.ndarray]]:
        for at in range(0, len(self.columns[0]), BLOCK):
            yield [np.array(x[at : at + BLOCK]) for x in self.columns]


def insert_column(old: Files, new: Files, counts: np.ndarray, before: np.ndarray, length: int) -> None:
    """One round: the column that old's transform holds is put before all suffixes. counts: how often it has each symbol; before: the column before it."""
    order, transform, common = new.columns
    upto = np.concatenate(([0], np.cumsum(counts)))[:-1]
    least = np.full(ABSENT + 1, -1, np.int64)  # the least common prefix since a symbol's last suffix; -1: none so far
    for own, symbol, shared in old.blocks():
        to = np.argsort(symbol, kind="stable")
        s, at = symbol[to], to
        first = np.concatenate(([True], s[1:] != s[:-1]))
        heads = np.flatnonzero(first)
        front, back = np.minimum.accumulate(shared), np.minimum.accumulate(np.append(np.int16(length), shared[::-1]))[::-1]
        within = np.minimum.reduceat(np.append(shared, 0), at + 1)  # from one suffix of a symbol to its next
        gap = np.concatenate(([0], within[:-1])).astype(np.int64)
        gap[heads] = np.minimum(least[s[heads]], front[at[heads]])
        value = np.where((s == ABSENT) | (gap < 0), 0, np.minimum(gap + 1, length))
        place = upto[s] + np.arange(len(s)) - heads[np.cumsum(first) - 1]
        order[place], transform[place], common[place] = own[at], before[own[at]], value
        upto[s[heads]] += np.diff(np.append(heads, len(s)))
        tails = at[np.append(heads[1:], len(s)) - 1]
        least = np.where(least >= 0, np.minimum(least, front[-1]), -1)
        least[s[heads]] = back[tails + 1]


def repeated_windows(segments: list[bytes], shifts: np.ndarray, length: int) -> np.ndarray:
    """Flags (column, segment): the string of length bytes from that column on is also in another segment at that column."""
    n, left = len(segments), length - ANCHOR
    columns = left + length
    flags = np.zeros((left + 1, n), bool)
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "columns")
        size = np.array([len(x) for x in segments])
        base = np.concatenate(([0], np.cumsum(size)))[:-1]
        joined = np.frombuffer(b"".join(segments), np.uint8)
        with open(path, "wb") as file:
            for c in range(columns - 1, -1, -1):
                at = c - (left - shifts)
                there = np.flatnonzero((at >= 0) & (at < size))
                column = np.full(n, ABSENT, np.uint16)
                column[there] = joined[base[there] + at[there]]
                column.tofile(file)
        old, new = Files(folder, "a", n), Files(folder, "b", n)
        with open(path, "rb") as file:
            column = np.fromfile(file, np.uint16, n)
            old.columns[0][:], old.columns[1][:] = np.arange(n), column
            for c in range(columns - 1, -1, -1):
                before = np.fromfile(file, np.uint16, n) if c else np.full(n, ABSENT, np.uint16)
                insert_column(old, new, np.bincount(column, minlength=ABSENT + 1), before, length)
                old, new, column = new, old, before
                if c <= left:
                    last = -1
                    for own, _, common in old.blocks():
                        here = common >= length
                        flags[c, own] |= here
                        flags[c, own[:-1]] |= here[1:]
                        if last >= 0:
                            flags[c, last] |= here[0]
                        last = own[-1]
    return flags


def construct(length: int):
    """Rows (anchor, row, place, alone, bytes) sorted by anchor: (row, start, end) of the repeated runs of what is alone."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, places, alone = batch.column("row").to_numpy(), batch.column("place").to_numpy(), batch.column("alone").to_numpy(zero_copy_only=False)
        start, shift, windows = places // ROOM // ROOM, places // ROOM % ROOM, places % ROOM
        left = length - ANCHOR
        flags = repeated_windows(batch.column("bytes").to_pylist(), shift, length)
        column = np.arange(left + 1)[:, None] - (left - shift)[None, :]
        flags &= (column >= 0) & (column < windows[None, :]) & alone[None, :]
        padded = np.zeros((left + 3, len(rows)), bool)
        padded[1:-1] = flags
        k, first = np.nonzero((padded[1:] & ~padded[:-1]).T)
        _, last = np.nonzero((padded[:-1] & ~padded[1:]).T)
        begin = start[k] + first - (left - shift[k])
        end = start[k] + last - 1 - (left - shift[k]) + length
        return pa.RecordBatch.from_arrays([pa.array(rows[k]), pa.array(begin), pa.array(end)], ["row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= SEGMENTS:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                anchor = whole.column("anchor").to_numpy()
                upto = int(np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))[-1])  # the last anchor may go on
                if upto:
                    yield found(whole.slice(0, upto))
                held = [whole.slice(upto)]
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def halve(length: int):
    """Rows (row, place, alone, lo, hi, bytes), the anchor at lo to hi in the windows: the same of each half, with its key and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                row, place, lo, hi = (part.column(c).to_numpy() for c in ("row", "place", "lo", "hi"))
                alone = part.column("alone").to_numpy(zero_copy_only=False)
                held = part.column("bytes").to_pylist()
                data = b"".join(held)
                each = np.frombuffer(data, np.uint8)
                base = np.concatenate(([0], np.cumsum([len(x) for x in held])))[:-1]
                start, shift, windows = place // ROOM // ROOM, place // ROOM % ROOM, place % ROOM
                middle = (lo + hi + 1) // 2
                for a, b in ((lo, middle - 1), (middle, hi)):
                    first, last = np.maximum(a, shift - windows + 1), np.minimum(b, shift)
                    x = np.flatnonzero(first <= last)
                    a, b, first, last, anchor = a[x], b[x], first[x], last[x], (base + shift)[x]
                    key = hashing.mix(hashing.digest(each, anchor - a, anchor + length - b) + (a * ROOM + b).astype(np.uint64))
                    u, v = anchor - last, anchor - first + length
                    content = hashing.mix(hashing.digest(each, u, v) + last.astype(np.uint64))
                    at = ((start[x] + shift[x] - last) * ROOM + last) * ROOM + last - first + 1
                    cuts = pa.array([data[i:j] for i, j in zip(u.tolist(), v.tolist(), strict=True)], pa.binary())
                    columns = [pa.array(hashing.signed(key)), pa.array(hashing.signed(content)), pa.array(row[x]), pa.array(at), pa.array(alone[x]), pa.array(a), pa.array(b), cuts]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "row", "place", "alone", "lo", "hi", "bytes"])

    return run


def members(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of the groups (anchor, content, n) of more than one row; rows of groups above SEGMENTS do not move."""
    key = ["anchor", "content"]
    large = F.broadcast(groups.where(F.col("n") > SEGMENTS).select(key))
    small = groups.where((F.col("n") > 1) & (F.col("n") <= SEGMENTS)).select(key)
    return rows.join(large, key, "left_semi").unionByName(rows.join(large, key, "left_anti").join(small, key, "left_semi"))


def covered(rows: DataFrame, length: int) -> DataFrame:
    """(row, start, end) of all windows of the rows."""
    return rows.select("row", F.expr(f"place div {ROOM * ROOM}").alias("start"), F.expr(f"place div {ROOM * ROOM} + place % {ROOM} + {length - 1}").alias("end"))


def halved(rows: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of anchors with too many segments: the spans of equal halves, and the segments for constructions of SEGMENTS at most."""
    equal, small = [], []
    rows = rows.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(length - ANCHOR).cast("long")})
    while True:
        parts = written(rows.mapInArrow(halve(length), "anchor long, content long, row long, place long, alone boolean, lo long, hi long, bytes binary"), "halves")
        groups = written(parts.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "place", "alone", "lo", "hi", "bytes")).alias("x")), "groups")
        equal.append(covered(members(parts.drop("bytes"), groups), length))
        kinds = groups.groupBy("anchor").agg(F.count("*").alias("d"))
        heavy = written(kinds.where(F.col("d") > SEGMENTS).select("anchor"), "heavy")
        first = groups.select("anchor", "x.row", "x.place", (F.col("x.alone") & (F.col("n") == 1)).alias("alone"), "x.lo", "x.hi", "x.bytes")
        light = first.join(F.broadcast(heavy), "anchor", "left_anti").withColumn("id", F.col("anchor"))
        small.append(only(light, kinds.where((F.col("d") > 1) & (F.col("d") <= SEGMENTS)).select(F.col("anchor").alias("id"))).drop("id", "lo", "hi"))
        if heavy.isEmpty():
            return equal, small
        rows = first.join(F.broadcast(heavy), "anchor", "left_semi")


def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, spans): what is left of the text's bytes."""
    for batch in batches:
        sizes, removed, runs, kept = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            out, upto, n, gone = [], 0, 0, 0
            for a, b in sorted((x["start"], x["end"]) for x in spans or ()):
                if a > upto or not n:
                    n += 1
                    out.append(data[upto:a])
                if b > upto:
                    gone += b - max(a, upto)
                    upto = b
            out.append(data[upto:])
            sizes.append(len(data))
            removed.append(gone)
            runs.append(n)
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Remove each byte that a string of length bytes covers which also starts anywhere else in the collection.

    Returns id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) per row. Strings are
    judged on the input; matches never cross texts, overlaps count. Null text: empty. Texts shorter than length stay
    whole. Repeated rows are separate texts that repeat each other. Rows without an id are left out. No rows: no rows.
    Other columns are not looked at.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("row", F.xxhash64("id", "text"))
    segments = written(texts.where(F.octet_length("text") >= length).mapInArrow(describe_segments(length), "row long, place long, anchor long, content long"), "cut")
    crowded = written(segments.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SEGMENTS).select("anchor"), "crowded")  # of so many rows each: few
    alike = Window.partitionBy("anchor", "content")
    marked = written(
        segments.join(F.broadcast(crowded), "anchor", "left_anti").repartition("anchor")
        .select("*", F.count("*").over(alike).alias("n"), F.row_number().over(alike.orderBy("row", "place")).alias("k"), (F.min("content").over(_by("anchor")) < F.max("content").over(_by("anchor"))).alias("open"))
        .where("n > 1 or open"),
        "segments",
    )
    equal = covered(marked.where("n > 1"), length)
    entered = marked.where("open and k = 1").select("anchor", "row", "place", (F.col("n") == 1).alias("alone"))
    heavy = None
    if not crowded.isEmpty():
        rows = segments.join(F.broadcast(crowded), "anchor", "left_semi")
        groups = written(rows.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("x")), "groups")
        equal = equal.union(covered(members(rows, groups), length))
        kinds = written(groups.groupBy("anchor").agg(F.count("*").alias("d")).where("d > 1"), "kinds")
        entered = entered.union(groups.join(F.broadcast(kinds), "anchor", "left_semi").select("anchor", "x.row", "x.place", F.col("n") == 1))
        heavy = F.broadcast(kinds.where(F.col("d") > SEGMENTS).select("anchor"))
    held = entered.groupBy("row").agg(F.collect_list(F.struct("anchor", "place", "alone")).alias("held"))  # of one text
    opened = written(texts.select("row", "text").join(held, "row").mapInArrow(fetch_segments(length), "anchor long, row long, place long, alone boolean, bytes binary"), "opened")
    if heavy is not None and not kinds.where(F.col("d") > SEGMENTS).isEmpty():
        spans, small = halved(opened.join(heavy, "anchor", "left_semi"), length)
        opened = opened.join(heavy, "anchor", "left_anti")
        for x in small:
            opened = opened.unionByName(x)
        for x in spans:
            equal = equal.union(x)
    found = opened.repartition(spread(opened, SEGMENTS), "anchor").sortWithinPartitions("anchor").mapInArrow(construct(length), "row long, start long, end long")
    spans = written(equal.union(found).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")  # of one text
    out = texts.join(spans, "row", "left").select("id", "text", "spans").mapInArrow(take_out, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def _by(name: str):
    return Window.partitionBy(name)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeats of 200 bytes over all documents."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same: strings of 200 bytes by digests of digests, on one row a byte.
ORACLE_OP3 = """
WITH b AS (
  SELECT doc_id, unnest(x) AS byte, generate_subscripts(x, 1) AS p, len(x) AS n FROM (SELECT doc_id, regexp_extract_all(lower(hex(encode(coalesce(text, '')))), '..') AS x FROM documents)
), h2 AS (SELECT doc_id, p, n, byte, byte || lead(byte, 1, '') OVER w AS s FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
h8 AS (SELECT doc_id, p, n, byte, s || lead(s, 2, '') OVER w || lead(s, 4, '') OVER w || lead(s, 6, '') OVER w AS s FROM h2 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
h40 AS (SELECT doc_id, p, n, byte, md5(s || lead(s, 8, '') OVER w || lead(s, 16, '') OVER w || lead(s, 24, '') OVER w || lead(s, 32, '') OVER w) AS s FROM h8 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
h200 AS (SELECT doc_id, p, n, byte, CASE WHEN p + 199 <= n THEN md5(s || lead(s, 40) OVER w || lead(s, 80) OVER w || lead(s, 120) OVER w || lead(s, 160) OVER w) END AS s FROM h40 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT s FROM h200 WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
marked AS (SELECT doc_id, p, byte, max(CASE WHEN twice.s IS NOT NULL THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM h200 LEFT JOIN twice USING (s)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM marked),
out AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM runs GROUP BY 1)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN out USING (doc_id)
"""

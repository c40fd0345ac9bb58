"""Periodic runs of words, found on harmonic grids with common extensions from a difference cover.

For each period q the grid holds every q-th word. A run of at least two periods holds a grid word and the one a period on, so the
common extensions of those two, to the right and to the left, give the run. Extensions compare the few words up to the first place
where both sides lie on the cover, a set of residues whose differences are all residues. Only suffixes that begin on the cover are
sorted; there a table of minima over their common prefixes gives the rest. Documents are worked out one by one, inside tasks that
Spark deals; grids go in pieces, so memory grows with a document's words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A perfect difference set modulo 31, every residue but 0 is one difference of its members.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)
GRID = 1 << 20
FEW = 4
RUN = "array<struct<start: long, length: long, period: long>>"

_PLACE = np.full(MODULUS, -1, np.int64)
_PLACE[list(COVER)] = np.arange(len(COVER))
_ON = (_PLACE >= 0)[(np.arange(MODULUS)[:, None] + np.arange(MODULUS)) % MODULUS]  # [residue, step]
#: Steps until both of two residues are on the cover.
_STEPS = (_ON[:, None, :] & _ON[None, :, :]).argmax(axis=2)


class Extensions:
    """Longest common prefixes of suffixes of words (ids from 1 on)."""

    def __init__(self, words: np.ndarray):
        self.words, self.ranks = words, []

    def _sort(self) -> None:
        """Rank the suffixes on the cover: by their first MODULUS words, then doubling over blocks of those."""
        n, wide = len(self.words), len(COVER)
        padded = np.zeros(n + 2 * MODULUS, ">u4")
        padded[:n] = self.words
        starts = (np.arange(-(-n // MODULUS))[:, None] * MODULUS + np.array(COVER)).ravel()
        windows = np.lib.stride_tricks.sliding_window_view(padded, MODULUS)
        blocks = np.ascontiguousarray(windows[np.minimum(starts, n)]).view(f"V{4 * MODULUS}").ravel()
        rank = np.unique(blocks, return_inverse=True)[1].astype(np.int64) + 1
        self.ranks, step = [rank], wide
        while step < len(rank) and rank.max() < len(rank):
            behind = np.zeros(len(rank), np.int64)
            behind[:-step] = rank[step:]
            rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)[1] + 1
            self.ranks.append(rank)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.at = np.empty(len(rank), np.int64)
        self.at[order] = np.arange(len(rank))
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(len(order) - 1, np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):  # blocks that neighbours share
            same = (a < len(rank)) & (b < len(rank))
            same[same] = self.ranks[level][a[same]] == self.ranks[level][b[same]]
            common += same << level
            a, b = a + (same * wide << level), b + (same * wide << level)
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Blocks that suffixes on the cover share."""
        if not self.ranks:
            self._sort()
        slot = lambda p: self.at[p // MODULUS * len(COVER) + _PLACE[p % MODULUS]]
        a, b = slot(i), slot(j)
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            mine = level == k
            out[mine] = np.minimum(self.least[k][a[mine]], self.least[k][b[mine] - (1 << int(k))])
        return out

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree one after the other, most at most."""
        out, live = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        while len(live):
            step = out[live]
            live = live[self.words[i[live] + step] == self.words[j[live] + step]]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j share, i < j."""
        left = len(self.words) - j
        steps = np.minimum(_STEPS[i % MODULUS, j % MODULUS], left)
        out = self._compared(i, j, steps)
        on = np.flatnonzero((out == steps) & (steps < left))
        if len(on):
            out[on] = np.minimum(out[on] + MODULUS * self._sampled(i[on] + out[on], j[on] + out[on]), left[on])
            out[on] += self._compared(i[on] + out[on], j[on] + out[on], left[on] - out[on])
        return out


def grids(n: int, least: int, powers: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, period) of all grids whose run could be long enough, in pieces of about GRID."""
    q = np.arange(1, n // powers + 1)
    counts = np.maximum(0, (n - np.maximum(least, powers * q) + 2 * q - 1) // q)  # a run's first grid word lies before n - shortest + period
    upto, a = np.concatenate([[0], np.cumsum(counts)]), 0
    while a < len(q):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + GRID, side="right")) - 1)
        period = np.repeat(q[a:b], counts[a:b])
        yield (np.arange(len(period)) - np.repeat(upto[a:b] - upto[a], counts[a:b])) * period, period
        a = b


def runs(words: np.ndarray, least: int = 24, powers: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of max(least, powers * period) words and more, by start and period; powers is 2 at least."""
    n, found = len(words), {}
    if n < max(least, powers):
        return []
    ahead, back = Extensions(words), Extensions(words[::-1])
    for i, q in grids(n, least, powers):
        shortest = np.maximum(least, powers * q)
        need = shortest - 2 * q + 1  # what the first grid word of a run shares with the one a period on, at least
        inside = i + q + need <= n
        i, q, shortest, need = (x[inside] for x in (i, q, shortest, need))
        for k in range(min(FEW, int(need.min(initial=FEW)))):
            same = words[i + k] == words[i + q + k]
            i, q, shortest, need = (x[same] for x in (i, q, shortest, need))
        if not len(i):
            continue
        right = ahead.of(i, i + q)
        enough = right >= need
        i, q, shortest, right = (x[enough] for x in (i, q, shortest, right))
        left, inner = np.zeros(len(i), np.int64), i > 0
        left[inner] = back.of(n - i[inner] - q[inner], n - i[inner])
        hit = (left < q) & (q + left + right >= shortest)  # the run's first grid word
        for start, length, period in zip((i - left)[hit].tolist(), (q + left + right)[hit].tolist(), q[hit].tolist(), strict=True):
            found[start, length] = min(period, found.get((start, length), period))
    return sorted((s, m, q) for (s, m), q in found.items())


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties to the least start, then period."""
    top = None
    for s, m, q in sorted(found, key=lambda r: (r[0], r[2])):
        if top is None or m * top[2] > top[1] * q:
            top = s, m, q
    return top


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, m, q in found:
        gone[s + q] += 1
        gone[s + m] -= 1
    return b" ".join(w for w, c in zip(words, np.cumsum(gone).tolist(), strict=False) if not c)


def detect(least: int, powers: int):
    """Over rows (id, text): id, n_words, runs, best, collapsed."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run := pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("best", run), ("collapsed", pa.string())])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, rows = batch.slice(a, 500), []
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words, ids = (text or "").encode().split(), {}
                    found = runs(np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64, len(words)), least, powers)
                    rows.append((key, len(words), [named(r) for r in found], named(best(found)), collapse(words, found).decode()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(5)], schema=schema)

    return run_


def periodic_runs(docs: DataFrame, least: int = 24, powers: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, runs (start, length, period; by start, then period), best (the run of greatest length / period), collapsed.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch whose words recur after its period, the least one, and that no
    neighbouring word extends, of at least max(least, powers * period) words; powers: 2 at least. collapsed: the words, without
    those that any run holds after its first period, joined by one space. Null and empty texts have no words, no runs, a null best and
    an empty collapsed. Ids ride along, null and repeated ones too. No rows: no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(detect(least, powers), f"id long, n_words long, runs {RUN}, best struct<start: long, length: long, period: long>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with repeats: in documents whose checksum ends in 0, each word from a = g % n on is the word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))  # split once, not for every word
    rows = rows.select("*", F.size("words").cast("long").alias("n")).select("*", F.pmod("g", F.nullif("n", F.lit(0))).alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    turned = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.element_at("words", (1 + F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))).otherwise(w))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", turned)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 24 words and three periods at least, over all documents with planted repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = periodic_runs(planted(docs))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same: repeats of eight words at a distance are chained to stretches of equal words at that distance; a run has 16 or more.
ORACLE_OP13 = r"""
WITH table_ AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
crc AS (SELECT doc_id, xor(list_reduce([4294967295] || [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..')], lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM documents, table_),
split AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents JOIN crc USING (doc_id)),
shape AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) ELSE 0 END AS a FROM split),
turned AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[CASE WHEN i >= a THEN 1 + a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE 1 + i END] FOR i IN range(n)] ELSE w END AS w FROM shape),
eights AS MATERIALIZED (SELECT doc_id, unnest(range(n - 7)) AS i, unnest([array_to_string(w[1 + k : 8 + k], ' ') FOR k IN range(n - 7)]) AS e FROM turned WHERE n >= 24),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM eights a JOIN eights b ON a.doc_id = b.doc_id AND a.e = b.e AND a.i < b.i),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs) GROUP BY doc_id, q, isle),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
ratios AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DECIMAL(38, 18)) / period DESC, start, period) AS place FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS all_, list({'a': start + period, 'b': start + length}) AS gone FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, array_to_string([x.w FOR x IN [{'w': w[1 + i], 'i': i} FOR i IN range(n)] IF gone IS NULL OR len([1 FOR r IN gone IF x.i >= r.a AND x.i < r.b]) = 0], ' ') AS text FROM turned LEFT JOIN listed USING (doc_id))
SELECT kept.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(all_, '')) AS runs_sha256, sha256(kept.text) AS collapsed_sha256
FROM kept LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM ratios WHERE place = 1) r USING (doc_id)
"""

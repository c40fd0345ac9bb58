"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton reads a document's words one by one and keeps the length of the longest match that ends there. Items are
dealt into blocks of bounded size; each block's automaton goes to the tasks, and documents are streamed past it. Stretches
in which no two neighbouring words are neighbours in any item cannot hold a match and are skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voyage.llm import hashing
from voyage.llm.store import texts_of

#: An automaton takes about a hundred times the bytes of its block, in each worker.
BLOCK_BYTES = 1 << 20
_built: dict[str, tuple] = {}


class Automaton:
    """Generalised suffix automaton over word hashes; windows maps (state, length) to the items whose window it is."""

    def __init__(self, items: list[tuple[int, list[int]]], n: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.windows: dict[tuple[int, int], set[int]] = {}
        for item, words in items:
            span = min(n, len(words))
            for end, state, length in self.stream(words) if span else ():
                if length >= span:
                    self.windows.setdefault((self.of_length(state, span), span), set()).add(item)
        self.spans = sorted({s for _, s in self.windows})

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest match that ends there)."""
        state = length = 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            yield k, state, length

    def of_length(self, state: int, length: int) -> int:
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def found(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, one past the last, items) of every window that occurs."""
        for k, state, length in self.stream(words):
            for span in self.spans:
                if length < span:
                    break
                if items := self.windows.get((self.of_length(state, span), span)):
                    yield k + 1 - span, k + 1, items


def word_lists(texts: list[str]) -> list[list[int]]:
    out = []
    for _, data, offs in hashing.pieces(pa.array(texts, pa.string())):
        words, first = hashing.text_words(data, offs, hashing.ALNUM)
        out += [words[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def scan(items: Broadcast, n: int, all_rows: bool, limit: float):
    """Rows (id, text): words, hit words, spans of words, items, and the text without its hit spans.

    The automaton of the items (id, text) is built once in each worker and kept until it gets other ones.
    """
    name = uuid.uuid4().hex

    def prepare():
        lists = list(zip([i for i, _ in items.value], word_lists([t for _, t in items.value]), strict=True))
        automaton = Automaton(lists, n)
        least = min((min(n, len(w)) for _, w in lists if w), default=0)
        pairs = [hashing.grams(np.array(w, np.uint64), 2 if least > 1 else 1) for _, w in lists]
        return automaton, least, np.unique(np.concatenate([*pairs, np.zeros(0, np.uint64)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = prepare()
        automaton, least, known = _built[name]
        for batch in batches:
            out = []
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for a, data, offs in hashing.pieces(texts):
                start, end, first = hashing.word_spans(data, offs, hashing.ALNUM)
                words = hashing.digest(hashing.folded(data), start, end)
                stretches: dict[int, list[tuple[int, int]]] = {}
                width = 2 if least > 1 else 1
                if len(known) and len(words) >= width:
                    pairs = hashing.grams(words, width)
                    hit = known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs
                    if width == 2:  # pairs across texts do not count
                        edge = first[1:-1]
                        edge = edge[(edge > 0) & (edge < len(words))] - 1
                        hit[edge] = False
                        cuts = np.zeros(0, np.int64)
                    else:
                        cuts = first
                    flips = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    for x, y in zip(flips[::2].tolist(), (flips[1::2] + width - 1).tolist(), strict=True):
                        if y - x >= least:
                            inner = [x, *(c for c in np.unique(cuts[(cuts > x) & (cuts < y)]).tolist()), y] if len(cuts) else [x, y]
                            for u, v in zip(inner[:-1], inner[1:], strict=True):
                                d = int(np.searchsorted(first, u, side="right")) - 1
                                stretches.setdefault(d, []).append((u, v))
                for d in range(len(offs) - 1) if all_rows else sorted(stretches):
                    spans, found = [], set()
                    for u, v in stretches.get(d, ()):
                        for x, y, who in automaton.found(words[u:v].tolist()):
                            found |= who
                            if spans and u + x <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], u + y)
                                while len(spans) > 1 and u + x <= spans[-2][1]:
                                    last = spans.pop()
                                    spans[-1][1] = max(spans[-1][1], last[1])
                                spans[-1][0] = min(spans[-1][0], u + x)
                            else:
                                spans.append([u + x, u + y])
                    if not spans and not all_rows:
                        continue
                    n_hit, n_words = sum(y - x for x, y in spans), int(first[d + 1] - first[d])
                    kept, upto = [], int(offs[d])
                    for x, y in spans:
                        kept.append(data[upto : start[x]].tobytes())
                        upto = int(end[y - 1])
                    kept.append(data[upto : offs[d + 1]].tobytes())
                    out.append((ids[a + d], n_words, n_hit, [(int(x - first[d]), int(y - first[d])) for x, y in spans], sorted(found), b"".join(kept).decode(), n_hit > limit * n_words))
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pairs, pa.list_(pa.int64()), pa.string(), pa.bool_())
            names = ["id", "n_words", "n_hit", "spans", "items", "clean_text", "rejected"]
            columns = [[x[k] for x in out] for k in range(7)]
            columns[3] = [[{"start": u, "end": v} for u, v in s] for s in columns[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


SCHEMA = "id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<long>, clean_text string, rejected boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_hit, spans of hit words, items, clean_text (hit spans removed), rejected (coverage exceeded).

    Words are runs of letters, digits and non-ASCII, A-Z as a-z. A window is n consecutive words of an item, or a whole
    shorter item; a document's word inside any occurrence of a window is hit. Null, empty and wordless texts and items
    hit nothing. Rows without an id (item id) are left out, repeated rows come back repeated. Benchmarks of more than
    BLOCK_BYTES are read in blocks of about that size, one pass over the documents each; hits of all blocks are joined.
    No rows: no rows. Other columns are not looked at.
    """
    texts = texts_of(docs, id_col, text_col)
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    context = docs.sparkSession.sparkContext
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = 1 + total // BLOCK_BYTES
    if blocks == 1:
        held = [(r.i, r.t) for r in items.collect()]  # BLOCK_BYTES at most
        return texts.mapInArrow(scan(context.broadcast(held), n, True, coverage), SCHEMA).withColumnRenamed("id", id_col)
    parts = []
    rows = texts.withColumn("row", F.xxhash64("id", "text"))
    for b in range(blocks):
        held = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]
        parts.append(rows.select(F.col("row").alias("id"), "text").mapInArrow(scan(context.broadcast(held), n, False, coverage), SCHEMA))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    every = found.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # of one text
    joined = rows.join(every.withColumnRenamed("id", "row"), "row", "left").select("id", "text", "spans", "items")
    return joined.mapInArrow(merge(coverage), SCHEMA).withColumnRenamed("id", id_col)


def merge(limit: float):
    """Rows (id, text, spans, items) with the spans of all blocks: the same columns as of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for i, text, spans, items in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans", "items")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                start, end, _ = hashing.word_spans(data, np.array([0, len(data)]), hashing.ALNUM)
                merged: list[list[int]] = []
                for x, y in sorted((s["start"], s["end"]) for s in spans or ()):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                kept, upto = [], 0
                for x, y in merged:
                    kept.append(data[upto : start[x]].tobytes())
                    upto = int(end[y - 1])
                n_hit = sum(y - x for x, y in merged)
                row = (i, len(start), n_hit, [{"start": x, "end": y} for x, y in merged], sorted(items or ()), b"".join([*kept, data[upto:].tobytes()]).decode(), n_hit > limit * len(start))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "n_words", "n_hit", "spans", "items", "clean_text", "rejected"])

    return run


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_OP9 = r"""
WITH word AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM item WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM word, lengths WHERE len(w) >= n)
), found AS (SELECT id, item_id, k, n FROM grams JOIN windows USING (n, g)),
hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(generate_series(k, k + n - 1)) AS p FROM found) GROUP BY id),
who AS (SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY id)
SELECT word.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word LEFT JOIN hit ON hit.id = word.id LEFT JOIN who ON who.id = word.id
"""

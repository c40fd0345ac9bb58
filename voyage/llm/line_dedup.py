"""Line dedup by a deletion-neighbourhood join.

A line is its words (A-Z as a-z, white space ends words). Edits are of whole words: one insertion, deletion or exchange.
Equal lines are told by two independent hashes of the words, 128 bits.
A line of n words has n deletion variants and itself. Lines one exchange apart share the variant that drops the exchanged
word, at the same place; lines one insertion apart share the longer one's variant and the shorter one's whole. So
variants with their places and lengths are keys, and each key needs only its earliest line: nothing is joined pair by
pair. Of two lines at most one edit apart, the first or the last half of the words is untouched, so only lines that share
a half with another line are given variants. The pairs found are then verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voyage.llm import hashing
from voyage.llm.store import only, texts_of, written

P = (1 << 31) - 1
#: Two bases modulo P, so that hashes have 62 bits.
BASES = (1_287_463_519, 902_117_843)
NEWLINE = hashing.byte_class([(0x0A, 0x0A)], inside=False)
_ramps: dict[tuple[int, bool], np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P, of uint64 numbers."""
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    return np.where(x >= P, x - np.uint64(P), x)


def _ramp(base: int, n: int, down: bool = False) -> np.ndarray:
    """The powers of the base, or of its inverse, up to n."""
    key = (base, down)
    if len(_ramps.get(key, ())) <= n:
        step, out = pow(base, -1 if down else 1, P), np.ones(1, np.uint64)
        while len(out) <= max(n, 1 << 16):
            out = np.concatenate([out, _mod(out * np.uint64(pow(step, len(out), P)))])
        _ramps[key] = out
    return _ramps[key]


class Sums:
    """Running polynomial sums of word hashes, for the hash of any run of words, or of one without one of its words."""

    def __init__(self, words: np.ndarray):
        self.sums = []
        for base, part in zip(BASES, (words & np.uint64(P), words >> np.uint64(33)), strict=True):
            out = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(_mod(_mod(part) * _ramp(base, len(words))[: len(words)]), out=out[1:])
            self.sums.append(_mod(out))

    def _close(self, parts: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        return hashing.mix(((parts[0] << np.uint64(31)) | parts[1]) + n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words [a, b)."""
        parts = [_mod(_mod(s[b] + np.uint64(P) - s[a]) * _ramp(base, len(s), True)[a]) for base, s in zip(BASES, self.sums, strict=True)]
        return self._close(parts, b - a)

    def without(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Hashes of the words [a, b) but for word k."""
        parts = []
        for base, s in zip(BASES, self.sums, strict=True):
            after = _mod(_mod(s[b] + np.uint64(P) - s[k + 1]) * np.uint64(pow(base, -1, P)))
            parts.append(_mod(_mod(s[k] + np.uint64(P) - s[a] + after) * _ramp(base, len(s), True)[a]))
        return self._close(parts, b - a - 1)


def lines_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece: number of its first text, then of each line with words its text, its number there and its first word; last, all word hashes."""
    for a, data, offs in hashing.pieces(column):
        words_at, _, _ = hashing.word_spans(data, offs, hashing.SPACED)
        words, _ = hashing.text_words(data, offs, hashing.SPACED)
        breaks = np.flatnonzero(data == 0x0A)
        text = np.searchsorted(offs, words_at, side="right") - 1
        ends = np.searchsorted(breaks, words_at)  # line breaks before the word, in all texts of the piece
        line = ends - np.searchsorted(breaks, offs)[text]
        new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (line[1:] != line[:-1])))) if len(words) else np.zeros(0, np.int64)
        yield a, text[new], line[new], np.append(new, len(words)), words


def describe_lines(per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            for a, text, line, first, words in lines_of(batch.column("text")):
                n, s, e = np.diff(first), first[:-1], first[1:]
                each = words.view(np.uint8)
                whole, check = (hashing.digest(each, 8 * s, 8 * e, seed) for seed in (2, 3))
                sums, halves = Sums(words), []
                for side, q in ((0, n // 2), (1, n // 2), (0, (n - 1) // 2), (1, (n - 1) // 2)):
                    h = sums.run(s, s + q) if side == 0 else sums.run(e - q, e)
                    halves.append(hashing.mix(h + np.uint64(side + 1)))
                halves = np.stack(halves, axis=1) if len(n) else np.zeros((0, 4), np.uint64)
                many = n >= per_edit
                take = np.stack([many, many, many & (n % 2 == 0), many & (n % 2 == 0)], axis=1)
                ends = np.concatenate(([0], np.cumsum(take.sum(axis=1)))).astype(np.int32)
                columns = [ids[a + text], rows[a + text], line.astype(np.int32), hashing.signed(whole), hashing.signed(check)]
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashing.signed(halves[take])))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), flat], ["id", "row", "line", "whole", "check", "halves"])

    return run


def emit_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (whole, words): keys of the whole and of every deletion variant; role 0: exchange, 1: whole, 2: shorter by one."""
    for batch in batches:
        names = batch.column("whole").to_numpy()
        for d, data, offs in hashing.pieces(batch.column("words"), hashing.PIECE >> 2):
            words, first = hashing.text_words(data, offs, hashing.SPACED)
            s, e = first[:-1], first[1:]
            n, own = e - s, names[d : d + len(offs) - 1]
            sums, k = Sums(words), np.arange(len(words))
            line = np.repeat(np.arange(len(n)), n)
            cut = sums.without(s[line], e[line], k)
            same = hashing.mix(cut + hashing.mix((k - s[line] + (n[line] << 32) + 5).astype(np.uint64)))
            keys = np.concatenate([same, sums.run(s, e), cut])
            roles = np.repeat(np.array([0, 1, 2], np.int8), [len(words), len(n), len(words)])
            wholes = np.concatenate([own[line], own, own[line]])
            yield pa.RecordBatch.from_arrays([pa.array(wholes), pa.array(hashing.signed(keys)), pa.array(roles)], ["whole", "key", "role"])


def one_edit_apart(a: list[str], b: list[str]) -> bool:
    """Whether at most one word is inserted, deleted or exchanged between a and b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACE = str.maketrans("\t\n\v\f\r", "     ")


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("words").to_pylist(), batch.column("earlier_words").to_pylist(), strict=True)
        keep = [one_edit_apart(*([w for w in x.translate(_FOLD).translate(_SPACE).split(" ") if w] for x in p)) for p in pairs]
        yield batch.select(["whole"]).filter(pa.array(keep, pa.bool_()))


def removed_lines(texts: DataFrame, per_edit: int) -> DataFrame:
    """(id, row, line) of every line that an earlier line repeats; earlier: by smaller id, then line number."""
    lines = written(texts.mapInArrow(describe_lines(per_edit), "id long, row long, line int, whole long, check long, halves array<long>"), "lines")
    place = F.struct("id", "line", "row")
    firsts = written(lines.groupBy("whole", "check").agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")

    openings = lines.where("size(halves) > 0").select("id", "row", "line", "whole", F.explode("halves").alias("half"))
    wide = openings.groupBy("half").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("lo < hi").select("half")
    suspects = openings.join(wide, "half").groupBy("whole").agg(F.min(place).alias("first"))
    held = written(suspects.select("whole", "first.row", "first.line").groupBy("row").agg(F.collect_list(F.struct("line", "whole")).alias("held")), "held")  # of one document
    words = F.transform("held", lambda x: F.struct(x["line"].alias("line"), x["whole"].alias("whole"), F.get("all", x["line"]).alias("words")))
    own = texts.withColumnRenamed("id", "own").withColumnRenamed("row", "id")
    texts_held = only(own, held.select(F.col("row").alias("id"))).join(held.withColumnRenamed("row", "id"), "id").withColumn("all", F.split("text", "\n", -1))
    texts_held = texts_held.select(F.col("own").alias("id"), F.col("id").alias("row"), F.inline(words))
    known = written(texts_held.where("words is not null"), "suspects")

    variants = written(known.select("whole", "words").dropDuplicates(["whole"]).mapInArrow(emit_variants, "whole long, key long, role byte"), "variants")
    wide = variants.groupBy("key").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("lo < hi").select("key")
    at = F.struct("id", "line", "row", "whole")
    places = known.groupBy("whole").agg(F.min(place).alias("x")).select("whole", "x.id", "x.line", "x.row")
    shared = written(variants.join(wide, "key").join(places, "whole").select("key", "role", "whole", at.alias("own")), "shared")
    best = shared.groupBy("key").agg(F.min(F.when(F.col("role") < 2, F.col("own"))).alias("upper"), F.min(F.when(F.col("role") == 2, F.col("own"))).alias("lower"))
    met = shared.join(best, "key").select("whole", "own", F.when(F.col("role") == 1, F.col("lower")).otherwise(F.col("upper")).alias("earlier"))
    before = (F.col("earlier.id") < F.col("own.id")) | ((F.col("earlier.id") == F.col("own.id")) & (F.struct("earlier.line", "earlier.row") < F.struct("own.line", "own.row")))
    pairs = met.where(F.col("earlier").isNotNull() & before).groupBy("whole").agg(F.min("earlier").alias("earlier"))
    both = pairs.select("whole", F.col("earlier.whole").alias("earlier")).join(known.select("whole", "words").dropDuplicates(["whole"]), "whole")
    both = both.join(known.select(F.col("whole").alias("earlier"), F.col("words").alias("earlier_words")).dropDuplicates(["earlier"]), "earlier")
    near = both.select("whole", "words", "earlier_words").mapInArrow(verify, "whole long").distinct()

    told = firsts.join(near.withColumn("near", F.lit(True)), "whole", "left").where("n > 1 or near").select("whole", "check", "first", "near")
    later = F.col("near") | (F.struct("id", "line", "row") > F.col("first"))
    return lines.select("id", "row", "line", "whole", "check").join(told, ["whole", "check"]).where(later).select("id", "row", "line")


def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, gone): the text without its lines of the numbers in gone, how many lines it had and how many went."""
    for batch in batches:
        kept, n, removed = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            n.append(text.count("\n") + 1)
            out = set(gone or ())
            removed.append(len(out))
            kept.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in out) if out else text)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.string()), pa.array(n, pa.int32()), pa.array(removed, pa.int32())], ["id", "kept_text", "n_lines", "n_removed"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_edit: int = 8) -> DataFrame:
    """Remove every line that is equal to an earlier one or within the edit bound of it.

    The bound is relative: one word edit to per_edit words, one at most; so two lines are near if they are one word edit
    apart and both have per_edit words, and shorter lines only repeat each other when equal. Returns id, kept_text, n_lines,
    n_removed per row. Earliest is the smallest id, then the smallest line number; a line counts as earlier even if it was
    itself removed. Lines are told apart by "\\n". Lines without words always stay. Null text: one empty line. Repeated rows
    (same id, same text) count as one document and stay alike; different texts under one id are documents of their own, and
    of equal lines at one place the text with the smaller hash counts as earlier. Rows without an id are left out. No rows: no
    rows. Other columns are not looked at.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("row", F.xxhash64("id", "text"))
    gone = removed_lines(texts, per_edit).groupBy("id", "row").agg(F.collect_set("line").alias("gone"))  # lines of one document
    out = texts.join(gone, ["id", "row"], "left").select("id", "text", "gone").mapInArrow(take_out, "id long, kept_text string, n_lines int, n_removed int")
    return out.withColumnRenamed("id", id_col)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All lines of all documents; the digest stands for the text that stays."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same: lines as word lists, near ones joined by their lists without one word.
ORACLE_OP2 = r"""
WITH line AS (
  SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents
), worded AS (
  SELECT id, k, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM line
), kept AS (SELECT id, k, w, array_to_string(w, ' ') AS s FROM worded WHERE len(w) > 0),
firsts AS (SELECT s, any_value(w) AS w, min((id, k)) AS first FROM kept GROUP BY s),
whole AS (SELECT s, w, len(w) AS n, first FROM firsts WHERE len(w) >= 8),
part AS (SELECT s, n, first, i, array_to_string(w[: i - 1] || w[i + 1 :], ' ') AS v FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM whole)),
near AS (
  SELECT DISTINCT x.s FROM part x JOIN part y ON x.v = y.v AND x.i = y.i AND x.n = y.n AND y.first < x.first
  UNION SELECT DISTINCT x.s FROM part x JOIN whole y ON x.v = y.s AND y.first < x.first
  UNION SELECT DISTINCT y.s FROM part x JOIN whole y ON x.v = y.s AND x.first < y.first
), gone AS (
  SELECT id, list(k) AS ks FROM kept JOIN firsts USING (s) LEFT JOIN near ON near.s = kept.s WHERE near.s IS NOT NULL OR (id, k) > first GROUP BY id
)
SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INT) AS n_lines, CAST(coalesce(len(ks), 0) AS INT) AS n_removed,
  sha256(CASE WHEN ks IS NULL THEN coalesce(text, '') ELSE array_to_string([x FOR x, i IN string_split(coalesce(text, ''), chr(10)) IF NOT list_contains(ks, i - 1)], chr(10)) END) AS kept_sha256
FROM documents LEFT JOIN gone ON gone.id = doc_id
"""

"""N-gram Jaccard join over a token-group matrix.

Documents are sets of hashed word n-grams. Copies of a set meet first, so what follows works on different sets only.

1. Signatures. Sets of similar size fall into so many hash ranges that some ranges agree exactly in any two sets that
   link (a pair that links differs in few tokens, and each differing token spoils one range). Equal ranges give equal
   keys; a set with so many empty ranges that they could be all that agrees has keys for these too. So two sets without
   a common key cannot link. Frequent n-grams alone never make a key.
2. Groups. Each set is verified against the smallest set it shares a key with, its lead, in groups of GROUP.
3. Rounds. A key whose sets are not yet all connected, and that has GROUP sets or fewer, is one group: its sets are verified against
   each other. If all but GROUP sets of a key are connected, those few meet the rest, group by group. Other keys are not
   compared pair by pair. All sets of such a key are verified against its smallest one, the pivot, and what
   a set has or lacks against the pivot is its difference. Two sets that link, and are not both linked to the pivot, have
   part of their differences in common, the more the larger these are: in the order from rare to frequent, the first
   tokens of both differences, all but that part, share a token. These are the keys of the next round, told apart by the
   sizes of the two differences. The pivot has no
   difference and drops out, and edits of a common original, each in another place, fall apart at once.

Token-group matrix: for the groups above, the matrix holds the token union of each. A query set whose tokens overlap a
group's union in less than the threshold's share of its own size cannot link with any member. Unions are rows of bits, one
for each hashed token: what a query has set and a row has not is missing for certain. Only groups that pass are opened,
and their members verified on all tokens.

Rows grow with the number of sets and their keys: no task holds more than a group, nothing is joined pair by pair, and links
within what is already connected are not looked for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voyage.llm import hashing
from voyage.llm.components import components
from voyage.llm.store import TABLES, only, remove, texts_of, without, written

GROUP = 64
#: Classes of sizes of differences in the number of tokens by which linked sets can differ.
CLASSES = 4
BITS, MOST_BITS = 1 << 11, 1 << 17
SLICE = 256  # bytes of the rows that are opened to bits at a time
#: Texts that are described, or rows of the matrix that are opened, at a time; keys of differences that a task holds at a time.
TEXTS, KEYS = 1 << 10, 1 << 17


def token_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted hashed n-gram set of each text: all words as one n-gram if there are fewer than n."""
    for _, data, offs in hashing.pieces(column):
        words, first = hashing.text_words(data, offs, hashing.SPACED)
        shingles = hashing.grams(words, n)
        for d in range(len(offs) - 1):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= n:
                yield np.unique(shingles[a : b - n + 1])
            elif b > a:
                yield hashing.grams(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def size_class(size: int, num: int, den: int) -> tuple[int, int, int]:
    """(class, least size, size of the next class's least) of a set size; classes grow by 1.6."""
    k, low = 0, 1
    while True:
        high = int(low * 1.6) + 1
        if size < high:
            return k, low, high
        k, low = k + 1, high


def signatures(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys, at least one of which is equal in any two different sets of Jaccard similarity num/den or more."""
    size = len(tokens)
    k, low, high = size_class(size, num, den)
    classes = [(k, high)]
    if k and (low - 1) * den >= num * size:  # a set of the class before can link with this one
        classes.append((k - 1, low))
    out = []
    for c, above in classes:
        differing = (above - 1) * (den - num) // num  # at most, as the union is at most den/num times the smaller set
        if not differing:
            continue
        spare = 3 + differing // 5  # ranges that agree in any linked pair, at least; more than are empty in nearly all sets
        parts = differing + spare
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        used = part[starts]
        sums = np.add.reduceat(hashing.mix(tokens), starts)
        salt = np.uint64((c << 40) + 1)
        out.append(hashing.mix(sums ^ hashing.mix(used + salt)))
        if parts - len(used) >= spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), used)
            out.append(hashing.mix(hashing.mix(empty + salt) + np.uint64(7)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def describe_sets(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, TEXTS) for whole in batches for a in range(0, whole.num_rows, TEXTS)):
            size, f1, f2, keys, bits, ends = [], [], [], [], [], [0]
            for tokens in token_sets(batch.column("text"), n):
                size.append(len(tokens))
                f1.append(np.add.reduce(hashing.mix(tokens)))
                f2.append(np.add.reduce(hashing.mix(tokens ^ np.uint64(0xA0761D6478BD642F))))
                keys.append(signatures(tokens, num, den) if len(tokens) else tokens)
                bits.append(token_bits(tokens))
                ends.append(ends[-1] + len(keys[-1]))
            flat = pa.array(hashing.signed(np.concatenate([*keys, np.zeros(0, np.uint64)])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(size, pa.int64()), pa.array(hashing.signed(np.array(f1, np.uint64))), pa.array(hashing.signed(np.array(f2, np.uint64))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(bits, pa.binary()),
                ],
                ["id", "n_shingles", "set_key", "set_check", "keys", "bits"],
            )

    return run


def token_bits(tokens: np.ndarray) -> bytes:
    """A set's row of the matrix: four bits a token or more, from BITS to MOST_BITS, as a power of two."""
    wide = min(MOST_BITS, max(BITS, 1 << (4 * len(tokens)).bit_length()))
    row = np.zeros(wide, bool)
    row[(hashing.mix(tokens) >> np.uint64(65 - wide.bit_length())).astype(np.int64)] = True
    return np.packbits(row).tobytes()


def narrowed(row: bytes, wide: int) -> np.ndarray:
    """The row, packed, at a smaller width: neighbouring bits fall together."""
    packed = np.frombuffer(row, np.uint8)
    return packed if 8 * len(packed) == wide else np.packbits(np.unpackbits(packed).reshape(wide, -1).max(axis=1))


def qualifying(num: int, den: int):
    """Over rows (tile, side, id, size, bits) sorted by tile: the rows that the bound leaves a partner on the other side; 2 is on both."""

    def pick(ids: list[int], sides: list[int], sizes: list[int], bits: list[bytes]) -> np.ndarray:
        side, size = np.array(sides), np.array(sizes)
        keep = np.zeros(len(ids), bool)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return keep
        wide = 8 * min(map(len, bits))
        rows = np.stack([narrowed(b, wide) for b in bits])
        union = np.bitwise_or.reduce(rows[right], axis=0)
        missing = np.bitwise_count(rows[left] & ~union).sum(axis=1, dtype=np.int64)
        left = left[den * (size[left] - missing) >= num * size[left]]
        both = np.zeros((len(left), len(right)))
        for a in range(0, wide // 8, SLICE):  # the rows stay packed but for a slice of columns
            both += np.unpackbits(rows[left, a : a + SLICE], axis=1).astype(np.float32) @ np.unpackbits(rows[right, a : a + SLICE], axis=1).astype(np.float32).T
        set_ = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        x, y = size[left][:, None], size[right][None, :]
        common = np.minimum(x - set_[left][:, None] + both, y - set_[right][None, :] + both)
        open_ = (den * common >= num * (x + y - common)) & (np.array(ids)[left][:, None] != np.array(ids)[right][None, :])
        keep[left[open_.any(axis=1)]] = True
        keep[right[open_.any(axis=0)]] = True
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> list[tuple]:
            keep = pick(*([r[k] for r in held] for k in (2, 1, 3, 4)))
            return [r for r, k in zip(held, keep, strict=True) if k]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["tile", "side", "id"])

        for batch in (whole.slice(a, TEXTS) for whole in batches for a in range(0, whole.num_rows, TEXTS)):
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "id", "size", "bits")), strict=True):
                if held and row[0] != held[0][0]:
                    found += close()
                    held.clear()
                held.append(row)
            yield out(found)
        if held:
            yield out(close())

    return run


def matched(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links between sets of two groups, a spanning part of them: right's row of the matrix is opened set by set."""
    union = np.unique(np.concatenate([t for _, t in right]))
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x]
        return x

    for i, q in left:
        overlap = union[np.minimum(np.searchsorted(union, q), len(union) - 1)] == q
        if den * int(overlap.sum()) < num * len(q):
            continue
        seen = q[overlap]  # only these tokens can be common with a member
        for j, t in right:
            if i == j or root(i) == root(j) or num * len(q) > den * len(t) or num * len(t) > den * len(q):
                continue
            same = int((t[np.minimum(np.searchsorted(t, seen), len(t) - 1)] == seen).sum())
            if den * same >= num * (len(q) + len(t) - same):
                top[root(max(i, j))] = root(min(i, j))
                yield i, j


def open_groups(n: int, num: int, den: int):
    """Over rows (tile, side, id, text) sorted by tile: verified links between side 0 and side 1 of each tile; 2 is on both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sides = None, ([], [])

        def close() -> list[tuple[int, int]]:
            return list(matched(sides[0], sides[1], num, den)) if sides[0] and sides[1] else []

        for batch in batches:
            found = []
            for tile, side, i, tokens in zip(batch.column("tile").to_pylist(), batch.column("side").to_pylist(), batch.column("id").to_pylist(), token_sets(batch.column("text"), n), strict=True):
                if tile != current:
                    found += close()
                    current, sides = tile, ([], [])
                for k in (0, 1) if side == 2 else (side,):
                    sides[k].append((i, tokens))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
        found = close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def links_of_tiles(tiles: DataFrame, rows: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Bound the overlap of tiles (tile, side, id) with the matrix rows (id, size, bits); verify what is open on the texts themselves."""
    sorted_ = tiles.join(rows, "id").select("tile", "side", "id", "size", "bits").repartition("tile").sortWithinPartitions("tile", "side", "id")
    tiles = written(sorted_.mapInArrow(qualifying(num, den), "tile long, side int, id long"), "tiles")
    rows = tiles.join(only(texts, tiles), "id").select("tile", "side", "id", "text")
    return written(rows.repartition("tile").sortWithinPartitions("tile", "side", "id").mapInArrow(open_groups(n, num, den), "a long, b long"), "links")


def common_tokens(n: int):
    """Over rows (pivot, side, id, text) sorted by pivot and side, the pivot first: (pivot, tokens, counts) of the tokens that two or more of the differences share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, base, held = None, np.zeros(0, np.uint64), []

        def close() -> list[tuple[int, list, list]]:
            if not held:
                return []
            tokens, n_ = np.unique(np.concatenate(held), return_counts=True)
            return [(pivot, hashing.signed(tokens[n_ > 1]).tolist(), n_[n_ > 1].tolist())]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["pivot", "tokens", "counts"])

        for batch in batches:
            found = []
            for p, side, tokens in zip(batch.column("pivot").to_pylist(), batch.column("side").to_pylist(), token_sets(batch.column("text"), n), strict=True):
                if p != pivot:
                    found += close()
                    pivot, base, held = p, np.zeros(0, np.uint64), []
                if side == 0:
                    base = tokens
                else:
                    held.append(np.setxor1d(base, tokens, assume_unique=True))
            yield out(found)
        yield out(close())

    return run


def edges_to(top: int, edges: list[int], base: int, num: int, den: int) -> list[int]:
    """The least sizes of the classes of differences from a pivot of base tokens, continued beyond top.

    A class is a CLASSES-th as wide as what sets of its size, or of the pivot's, can differ by: so a set far larger than the pivot has no more classes to meet than others.
    """
    while edges[-1] <= top:
        edges.append(edges[-1] + max(1, (den - num) * max(base, edges[-1]) // num // CLASSES))
    return edges


def differences(n: int, num: int, den: int):
    """Over rows (tile, side, pivot, id, text, tokens, counts) sorted by tile and side, the pivot first: of each other set a row (pivot, id, linked) without a key, and one a key.

    Keys: for each class of sizes that the difference of a set that links can have, the first tokens of this set's difference, rare ones
    first: all but as many as both have in common at least. So two sets that link share a key of their two classes. Batches hold about KEYS keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, bases, known, often = None, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            each = np.array([len(r[3]) + 1 for r in rows], np.int64)
            heads = np.cumsum(each) - each
            keys, head = np.zeros(each.sum(), np.int64), np.zeros(each.sum(), bool)
            head[heads] = True
            keys[~head] = hashing.signed(np.concatenate([*(r[3] for r in rows), np.zeros(0, np.uint64)]))
            linked = np.zeros(len(keys), bool)
            linked[heads] = [r[2] for r in rows]
            pivots, ids = (np.repeat(np.array([r[k] for r in rows], np.int64), each) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(pivots), pa.array(ids), pa.array(linked), pa.array(keys, mask=head)], ["pivot", "id", "linked", "key"])

        for batch in batches:
            held = 0
            names = ("tile", "side", "pivot", "id", "tokens", "counts")
            for (t, side, pivot, i, tokens, counts), own in zip(zip(*(batch.column(c).to_pylist() for c in names), strict=True), token_sets(batch.column("text"), n), strict=True):
                if t != tile:
                    tile, bases = t, []
                if side == 0:
                    bases.append((own, [0]))  # more than one if the pivot's id has more than one text
                    known, often = np.array(tokens or [], np.int64).view(np.uint64), np.array(counts or [], np.int64)
                    continue
                most = (den - num) * len(own) // num  # tokens by which a set that links can differ from this one
                for base, edges in bases:
                    apart = np.setxor1d(base, own, assume_unique=True)
                    n_apart = len(apart)
                    same = (len(base) + len(own) - n_apart) // 2
                    rank = np.zeros(n_apart, np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, apart), len(known) - 1)
                        rank = np.where(known[at] == apart, often[at], 0)
                    apart = hashing.mix(apart)[np.lexsort((hashing.mix(apart), rank))]
                    edges_to(n_apart + most, edges, len(base), num, den)
                    own_class, low, high = (bisect_right(edges, max(0, x)) - 1 for x in (n_apart, n_apart - most, n_apart + most))
                    found = [np.zeros(0, np.uint64)]
                    for other in range(low, high + 1):
                        common = max(1, -((most - n_apart - max(1, edges[other])) // 2))  # of the two differences, at least
                        label = np.array([pivot, len(base), min(own_class, other), max(own_class, other)], np.int64).view(np.uint64)
                        found.append(hashing.mix(apart[: max(0, n_apart - common + 1)] ^ hashing.grams(hashing.mix(label), 4)))
                    rows.append((pivot, i, den * same >= num * (len(base) + len(own) - same), np.concatenate(found)))
                    held += len(rows[-1][3])
                    if held >= KEYS:
                        yield out()
                        rows.clear()
                        held = 0
            yield out()
            rows.clear()

    return run


def unsettled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows (key, id) of keys whose sets are not all connected, with the key's number of sets, its smallest one, and whether the set is outside the largest connected part.

    Nodes that joined (node, component) lacks are alone.
    """
    placed = rows.join(joined.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    keys = parts.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("pivot"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    stray = F.col("component") != F.col("main.component")
    return placed.join(keys, "key").select("key", "id", "n", "pivot", stray.alias("stray"), (F.col("n") - F.col("main.n")).alias("strays"))


def merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """joined (node, component) with what the links (a, b) bring together; only components that they change are followed."""
    of = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    ends = written(ends.where("a <> b").distinct(), "ends")
    if ends.isEmpty():
        return joined
    tops = components(ends).withColumnRenamed("component", "top")
    moved = joined.join(tops.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = tops.join(joined, "node", "left_anti").select("node", F.col("top").alias("component"))
    return written(moved.unionByName(fresh), "joined")


def links_of_keys(rows: DataFrame, matrix: DataFrame, texts: DataFrame, n: int, num: int, den: int, first: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """One round over what unsettled() gives: verified links (a, b), and the rows (key, id) of the next round or None.

    In the first round, large keys that share sets have one pivot together, so that each set is opened against one.
    """
    few = rows.where(F.col("n") <= GROUP)
    kin = few.groupBy("pivot").agg(F.count_distinct("id").alias("kin"))
    own = F.when(F.col("kin") <= GROUP, F.xxhash64("pivot")).otherwise(F.xxhash64("pivot", "key"))  # all keys of a smallest set in one group, if they fit
    small = few.join(kin, "pivot").select(own.alias("tile"), F.lit(2).alias("side"), "id")
    lone = rows.where((F.col("n") > GROUP) & (F.col("strays") <= GROUP))  # few strays meet the rest in its groups
    rooms = F.ceil((F.col("n") - F.col("strays")) / GROUP)
    room = F.when(F.col("stray"), F.sequence(F.lit(0).cast("long"), rooms - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), rooms)))
    beside = lone.select("key", "stray", "id", F.explode(room).alias("room")).select(F.xxhash64("key", "room").alias("tile"), F.when(F.col("stray"), 2).otherwise(1).alias("side"), "id")
    found = links_of_tiles(small.unionByName(beside).distinct(), matrix, texts, n, num, den)
    crowded = (F.col("n") > GROUP) & (F.col("strays") > GROUP)
    large = written(rows.where(crowded).select("pivot", "id").distinct(), "large")
    if large.isEmpty():
        return found, None
    others = large.where("id <> pivot")
    if first:
        others = components(others.select(F.col("pivot").alias("a"), F.col("id").alias("b"))).where("node <> component").select(F.col("component").alias("pivot"), F.col("node").alias("id"))
    rooms = others.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).alias("rooms"))
    tiles = written(others.join(rooms, "pivot").select("pivot", F.pmod(F.xxhash64("id"), "rooms").alias("room"), "id"), "tiles")
    heads = tiles.select("pivot", "room").distinct().withColumn("id", F.col("pivot"))
    sides = tiles.withColumn("side", F.lit(1)).unionByName(heads.withColumn("side", F.lit(0)))
    dealt = written(sides.join(only(texts, sides), "id").select("pivot", "room", "side", "id", "text"), "dealt")
    sample = dealt.where("room = 0").repartition("pivot").sortWithinPartitions("pivot", "side")
    often = sample.mapInArrow(common_tokens(n), "pivot long, tokens array<long>, counts array<long>").where("pivot is not null")
    none = F.lit(None).cast("array<long>")
    told = dealt.where("side = 0").join(often, "pivot", "left").unionByName(dealt.where("side = 1").withColumns({"tokens": none, "counts": none}))
    told = told.select(F.xxhash64("pivot", "room").alias("tile"), "side", "pivot", "id", "text", "tokens", "counts").repartition("tile").sortWithinPartitions("tile", "pivot", "side")
    apart = written(told.mapInArrow(differences(n, num, den), "pivot long, id long, linked boolean, key long"), "apart")
    links = found.union(apart.where("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    keyed = apart.where("key is not null").select("key", "id")
    wide = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return links, written(keyed.join(wide, "key"), "next")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: id, n_shingles (size of its n-gram set), component_id (smallest id that links reach, itself included).

    Two documents link when den * intersection >= num * union of their sets of distinct word n-grams (A-Z as a-z, words
    end at white space). Null, empty and wordless texts: no n-grams, no links. Repeated rows come back repeated, copies
    of a set link at any size. Two texts under one id are both looked at, and what links with either links with the id.
    Rows without an id are left out. No rows: no rows. Other columns are not looked at.
    """
    if not 0 < 65 * den <= 100 * num <= 100 * den:
        raise ValueError("the similarity must be from 0.65 to 1: size classes grow by 1.6")
    texts = texts_of(docs, id_col, text_col)
    keys = written(texts.mapInArrow(describe_sets(n, num, den), "id long, n_shingles long, set_key long, set_check long, keys array<long>, bits binary"), "keys")
    keys_path = TABLES[-1]
    told = written(keys.drop("keys"), "sets")
    matrix = told.where("n_shingles > 0").select("id", F.col("n_shingles").alias("size"), "bits")
    name = ["set_key", "set_check", "n_shingles"]
    sets = told.where("n_shingles > 0").groupBy(*name).agg(F.min("id").alias("set_id"))
    members = written(told.select("id", *name).join(sets, name, "left"), "members")

    copies = members.where("id <> set_id").select("id", "set_key")
    own = without(keys.where("size(keys) > 0").select("id", "set_key", "keys"), copies, "id", "set_key")
    keyed = own.select("id", F.explode("keys").alias("key"))
    wide = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    met = written(keyed.join(wide, "key"), "met")
    remove(docs.sparkSession, [keys_path])
    shared = met.join(met.groupBy("key").agg(F.min("id").alias("lead")), "key")

    leads = shared.where("id <> lead").groupBy("id").agg(F.min("lead").alias("lead"))
    rooms = leads.groupBy("lead").agg(F.ceil(F.count("*") / GROUP).alias("rooms"))
    dealt = leads.join(rooms, "lead").withColumn("room", F.pmod(F.xxhash64("id"), F.col("rooms")))
    pair = F.array(F.struct(F.lit(1).alias("side"), F.col("id").alias("id")), F.struct(F.lit(0).alias("side"), F.col("lead").alias("id")))
    tiles = dealt.select(F.xxhash64("lead", "room").alias("tile"), F.explode(pair).alias("x")).select("tile", "x.side", "x.id").distinct()
    links = links_of_tiles(tiles, matrix, texts, n, num, den)

    split = members.groupBy("id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a < b").select("id", "a")  # ids of two texts
    links = links.union(split.join(members.where("set_id is not null").select("id", F.col("set_id").alias("b")), "id").select("a", "b"))
    joined = components(links)
    rows, first = met, True
    while rows is not None:
        rows = written(unsettled(rows.select("key", "id").distinct(), joined), "unsettled")
        if rows.isEmpty():
            break
        found, rows = links_of_keys(rows, matrix, texts, n, num, den, first)
        first = False
        joined = merged(joined, found)
    return members.join(joined.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "set_id", "id").alias("component_id")
    )


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Three-word n-grams at 0.9 over all documents."""
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


#: The same by shingle lists: pairs that share a shingle are counted, and links are followed by least labels.
ORACLE_OP1 = r"""
WITH RECURSIVE word AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[k : k + 2], ' ') FOR k IN generate_series(1, greatest(1, len(w) - 2))]) END AS s FROM word
), same AS (SELECT list_sort(s) AS s, min(id) AS set_id FROM sets WHERE len(s) > 0 GROUP BY 1),
member AS (SELECT id, len(sets.s) AS n, set_id FROM sets LEFT JOIN same ON list_sort(sets.s) = same.s),
token AS (SELECT set_id AS id, len(s) AS n, unnest(s) AS t FROM same),
pairs AS (
  SELECT x.id AS a, y.id AS b FROM token x JOIN token y ON x.t = y.t AND x.id < y.id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), edge AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, top) AS (SELECT id, id FROM (SELECT DISTINCT a AS id FROM edge) UNION SELECT edge.b, reach.top FROM reach JOIN edge ON edge.a = reach.id WHERE reach.top < edge.b),
least_ AS (SELECT id, min(top) AS component FROM reach GROUP BY id)
SELECT member.id AS doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, set_id, member.id) AS component_id FROM member LEFT JOIN least_ ON least_.id = member.set_id
"""

"""Merkle manifest of a table, and the proofs of all its rows by octopus multiproofs.

A row's leaf is a hash of its columns. Leaves of one source, in the order of their ids, are the leaves of a tree of ARITY; the trees'
tops, in the order of their sources, are those of one more. Rows are numbered by a range partitioning and the counts of its
parts, so no task holds a source. Chunks of ARITY ** DEPTH leaves are dealt to leaf partitions of about LEAVES rows. A leaf partition
works out which nodes it can't derive from its leaves (the least union of coordinates, over all its paths), gets those once by a
join, derives what its paths share, and expands each row's proof from that.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voyage.llm.store import IDS, LOWER, UPPER, spread, written

ARITY, DEPTH, LEAVES, CHAR = 16, 2, 8192, 64
#: Name of the tree over the trees' tops; names of the others are "" (no source) or begin with "s".
TOP = "top"
NODE = "tree string, width long, level int, idx long, digest string"


def row_hash(*columns: Column) -> Column:
    """SHA-256 of the columns: each "-" if null, else its UTF-8 byte count, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with position (from 0, within their tree, by order) and width (rows of their tree).

    rows must be a written table; order must be total, and begin with the tree.
    """
    ordered = rows.repartitionByRange(spread(rows, LEAVES), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("part", F.shiftright("at", 33)), name)
    spans = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    ahead = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select("tree", "part", "first", ahead.alias("ahead"), F.sum("rows").over(tree).alias("width")), f"{name}-spans")
    spans = F.broadcast(spans) if spans.count() <= IDS else spans  # a row for each tree and part that meet
    return ordered.join(spans, ["tree", "part"]).withColumn("position", F.col("at") - F.col("first") + F.col("ahead")).drop("at", "part", "first", "ahead")


def height(width: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while width > 1:
        width, levels = -(-width // ARITY), levels + 1
    return levels


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def runs_above(nodes: list[str]) -> list[str]:
    """The nodes' digests, joined for each run of ARITY."""
    return ["".join(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]


def chunks(table: pa.Table) -> Iterator[tuple[str, int, int, int, int]]:
    """(tree, width, chunk, first row, end) of a table sorted by tree and position."""
    trees, at, widths = (table.column(c).to_pylist() for c in ("tree", "position", "width"))
    start = 0
    for k in range(1, len(trees) + 1):
        if k == len(trees) or trees[k] != trees[start] or at[k] // ARITY**DEPTH != at[start] // ARITY**DEPTH:
            yield trees[start], widths[start], at[start] // ARITY**DEPTH, start, k
            start = k


def apexes(table: pa.Table) -> pa.Table:
    """The top of each chunk: the node of level DEPTH, or its tree's top if that is lower."""
    table = table.sort_by([("tree", "ascending"), ("position", "ascending")])
    leaves, out = table.column("leaf").to_pylist(), []
    for tree, width, chunk, a, b in chunks(table):
        nodes, level = leaves[a:b], min(DEPTH, height(width))
        for _ in range(level):
            nodes = [digest(run) for run in runs_above(nodes)]
        out.append((tree, width, level, chunk, nodes[0]))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["tree", "width", "level", "idx", "digest"])


def climbed(nodes: DataFrame, level: int, name: str) -> list[DataFrame]:
    """The levels above nodes of one level, of all trees that have them."""
    out = []
    while True:
        nodes = nodes.where(F.col("width") > ARITY**level)
        if nodes.isEmpty():
            return out
        run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        level += 1
        above = nodes.groupBy("tree", "width", F.floor(F.col("idx") / ARITY).cast("long").alias("up")).agg(F.sha2(F.concat_ws("", run), 256).alias("digest"))
        nodes = written(above.select("tree", "width", F.lit(level).alias("level"), F.col("up").alias("idx"), "digest"), name)
        out.append(nodes)


def octopus(known: set[int], width: int, level: int) -> Iterator[tuple[int, int]]:
    """The least set of coordinates (level, index) that must be fetched to derive all paths from the known nodes of a level to the top."""
    while width > 1:
        above = {k // ARITY for k in known}
        for p in sorted(above):
            yield from ((level, k) for k in range(p * ARITY, min(p * ARITY + ARITY, width)) if k not in known)
        known, width, level = above, -(-width // ARITY), level + 1


def missing(trees: int):
    """Over the chunks of a leaf partition (bucket, tree, width, chunk, rank): the coordinates that it lacks."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        held: dict[tuple[str, int], set[int]] = {}
        for r in rows:
            held.setdefault((r["tree"], r["width"]), set()).add(r["chunk"])
        out = [(tree, *c) for (tree, width), known in held.items() for c in octopus(known, -(-width // ARITY ** min(DEPTH, height(width))), min(DEPTH, height(width)))]
        out += [(TOP, *c) for c in octopus({r["rank"] for r in rows}, trees, 0)]
        out += [(tree, -1, rank) for tree, rank in {(r["tree"], r["rank"]) for r in rows}]
        n = len(out)
        return pa.Table.from_arrays([pa.array([rows[0]["bucket"]] * n, pa.int64()), *(pa.array([x[c] for x in out], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64())))], ["bucket", "tree", "level", "idx"])

    return run


def expanded(trees: int):
    """Over a leaf partition and the nodes that it has fetched: each row's tops, proof and folded root."""

    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        nodes, rank = {}, {}
        for r in fetched.to_pylist():
            if r["level"] < 0:
                rank[r["tree"]] = r["idx"]
            else:
                nodes[r["tree"], r["level"], r["idx"]] = r["digest"]
        leaves = leaves.sort_by([("tree", "ascending"), ("position", "ascending")])
        own, tampered, at = (leaves.column(c).to_pylist() for c in ("leaf", "tampered", "position"))
        joined: dict[tuple[str, int, int], str] = {}  # runs by the coordinates of the node above

        def derive(tree: str, known: set[int], width: int, level: int) -> str:
            """All nodes above the known ones; the top."""
            while width > 1:
                known = {k // ARITY for k in known}
                for p in known:
                    joined[tree, level + 1, p] = "".join(nodes[tree, level, k] for k in range(p * ARITY, min(p * ARITY + ARITY, width)))
                    nodes[tree, level + 1, p] = digest(joined[tree, level + 1, p])
                width, level = -(-width // ARITY), level + 1
            return nodes[tree, level, 0]

        held: dict[tuple[str, int], set[int]] = {}
        for tree, width, chunk, a, b in chunks(leaves):
            held.setdefault((tree, width), set()).add(chunk)
            inside, level = own[a:b], min(DEPTH, height(width))
            for up in range(1, level + 1):
                first = at[a] // ARITY**up
                for k, text in enumerate(runs := runs_above(inside)):
                    joined[tree, up, first + k] = text
                inside = [digest(text) for text in runs]
            nodes[tree, level, chunk] = inside[0]
        tops = {tree: derive(tree, known, -(-width // ARITY ** min(DEPTH, height(width))), min(DEPTH, height(width))) for (tree, width), known in held.items()}
        nodes |= {(TOP, 0, rank[tree]): top for tree, top in tops.items()}
        root = derive(TOP, {rank[tree] for tree in tops}, trees, 0)
        found = []
        for tree, width, _, a, b in chunks(leaves):
            shared = path(joined, tree, at[a] // ARITY**DEPTH, DEPTH, height(width)) + path(joined, TOP, rank[tree], 0, height(trees))
            for k in range(a, b):
                steps = path(joined, tree, at[k], 0, min(DEPTH, height(width))) + shared
                fold = tampered[k] or own[k]
                for before, after in steps:
                    fold = digest(before + fold + after)
                found.append((tops[tree], root, digest("".join(x for step in steps for x in step)), fold))
        columns = [pa.array([x[c] for x in found], pa.string()) for c in range(4)]
        return pa.Table.from_arrays([leaves.column("id"), leaves.column("leaf"), *columns], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return run


def path(joined: dict[tuple[str, int, int], str], tree: str, idx: int, level: int, top: int) -> list[tuple[str, str]]:
    """The siblings before and after the path from a node up to level top."""
    out = []
    while level < top:
        text, k = joined[tree, level + 1, idx // ARITY], CHAR * (idx % ARITY)
        out.append((text[:k], text[k + CHAR :]))
        idx, level = idx // ARITY, level + 1
    return out


def merkle_manifest(rows: DataFrame, leaf: Column, tampered: Column, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    leaf: the row's hash, 64 lowercase hexadecimal digits, never null. tampered: the hash of what is held against the manifest, null
    where that is the row itself. proof_sha256 covers the proof's digests, level by level, left to right; folded_root is what tampered (or leaf) and
    the proof give; verified tells whether that is the root. Sources: any number, null is one and comes first. Null ids come first in
    their source, rows of one id follow their leaves; equal rows lie side by side and each has a leaf. No rows: no rows.
    One row: its leaf is subroot and root, its proof is empty. Other columns are not looked at.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    kept = rows.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), tampered.alias("tampered"))
    kept = written(kept.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    placed = numbered(kept, "ordered", "tree", "id", "leaf", "tie")
    placed = placed.withColumn("chunk", F.floor(F.col("position") / ARITY**DEPTH).cast("long"))
    placed = written(placed.withColumn("bucket", F.pmod(F.xxhash64("tree", "chunk"), F.lit(spread(kept, LEAVES)))).drop("tie"), "placed")

    low = written(placed.groupBy("bucket").applyInArrow(apexes, NODE), "apexes")
    nodes = [low, *climbed(low, DEPTH, "nodes")]
    tops = nodes[0].where(F.col("width") <= F.pow(F.lit(float(ARITY)), F.col("level")))
    for upper in nodes[1:]:
        tops = tops.union(upper.where(F.col("width") <= F.pow(F.lit(float(ARITY)), F.col("level"))))
    tops = written(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("source"), "digest"), "subroots")
    ranked = written(numbered(tops, "sources", "tree", "source"), "ranks")
    low = ranked.select("tree", "width", F.lit(0).alias("level"), F.col("position").alias("idx"), "digest")
    nodes += [low, *climbed(low, 0, "tops")]
    known = nodes[0]
    for more in nodes[1:]:
        known = known.union(more)

    n = ranked.count()
    held = placed.select("bucket", "tree", "width", "chunk").distinct().join(ranked.select(F.col("source").alias("tree"), F.col("position").alias("rank")), "tree")
    lacking = written(held.groupBy("bucket").applyInArrow(missing(n), "bucket long, tree string, level int, idx long"), "missing")
    fetched = lacking.join(known.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"], "left")
    out = placed.groupBy("bucket").cogroup(fetched.groupBy("bucket")).applyInArrow(expanded(n), "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumnRenamed("id", id_col).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document a leaf; where 5 divides the checksum of the id, the text held against it has its A-Z lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle_manifest(docs, row_hash(*first, F.col("text")), F.when(hit, row_hash(*first, F.translate("text", UPPER, LOWER))))


def _oracle(levels: int = 6) -> str:
    """The same: trees level by level, for sources of up to 16 ** levels rows and as many sources."""
    item = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(item, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        "table_ AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))",
        "crc AS (SELECT doc_id, xor(list_reduce([4294967295] || [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..')], lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), table_)",
        f"p0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS w, row_number() OVER () AS row FROM (SELECT doc_id, coalesce('s' || source, '') AS tree, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS fold FROM documents LEFT JOIN crc USING (doc_id)))",
        "n0 AS (SELECT tree, i, w, leaf AS h FROM p0)",
    ]

    def climb(rows: str, nodes: str, first: int) -> tuple[str, str]:
        """Levels of a forest: nodes (tree, i, w, h), and the paths of rows (row, tree, i, w, proof, fold)."""
        for k in range(first, first + levels):
            ctes.append(f"n{k + 1} AS MATERIALIZED (SELECT tree, i // 16 AS i, (w + 15) // 16 AS w, CASE WHEN max(w) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {nodes} AS n GROUP BY tree, n.i // 16, w)")
            ctes.append(f"p{k + 1} AS MATERIALIZED (SELECT row, r.tree, r.i // 16 AS i, (r.w + 15) // 16 AS w, max(proof) || coalesce(string_agg(CASE WHEN n.i <> r.i THEN h END, '' ORDER BY n.i), '') AS proof, CASE WHEN r.w > 1 THEN sha256(string_agg(CASE WHEN n.i = r.i THEN fold ELSE h END, '' ORDER BY n.i)) ELSE max(fold) END AS fold FROM {rows} AS r JOIN {nodes} AS n ON n.tree = r.tree AND n.i // 16 = r.i // 16 GROUP BY row, r.tree, r.i, r.w)")
            rows, nodes = f"p{k + 1}", f"n{k + 1}"
        return rows, nodes

    ctes.append("q0 AS (SELECT row, tree, i, w, '' AS proof, fold FROM p0)")
    rows, subroots = climb("q0", "n0", 0)
    ctes.append(f"sources AS MATERIALIZED (SELECT tree AS source, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS w FROM {subroots})")
    ctes.append(f"s0 AS (SELECT row, 'top' AS tree, s.i, s.w, proof, fold FROM {rows} AS r JOIN sources s ON s.source = r.tree)")
    ctes.append("t0 AS (SELECT 'top' AS tree, i, w, h FROM sources)")
    rows, root = climb("s0", "t0", 10)
    return f"WITH {', '.join(ctes)} SELECT p0.doc_id, leaf, s.h AS subroot, t.h AS root, sha256(r.proof) AS proof_sha256, r.fold AS folded_root, r.fold = t.h AS verified FROM p0 JOIN {rows} AS r USING (row) JOIN sources s ON s.source = p0.tree, {root} AS t"


ORACLE_OP11 = _oracle()

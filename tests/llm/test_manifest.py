"""Merkle manifests against a plain version: nulls, repeated rows, one row, no rows, trees of many heights."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from voyage.llm import merkle
from voyage.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, bucket int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """The root, and for each node the siblings of its path as (before, after), level by level."""
    paths, where = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for leaf_ in where[a + k]:
                    paths[leaf_].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            held.append([x for k in range(len(run)) for x in where[a + k]])
        nodes, where = above, held
    return nodes[0], paths


def manifest(rows):
    """Per row (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted."""
    if not rows:
        return []
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1])), k) for k, r in enumerate(rows) if r[3] == s) for s in sources}
    trees = {s: tree([x[0][2] for x in of[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for s, top in zip(sources, tops, strict=True):
        for ((_, _, own), k), path in zip(of[s], trees[s][1], strict=True):
            row = rows[k]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            fold = leaf(row, row[1].translate(low) if row[1] is not None else None) if hit else own
            for before, after in path + top:
                fold = sha(before + fold + after)
            out.append((row[0], own, trees[s][0], root, sha("".join(b + a for b, a in path + top)), fold, fold == root))
    return sorted(out, key=str)


def rows_of(counts):
    rows = []
    for source, n in counts:
        rows += [(len(rows) + k, f"Text {k} É", "en" if k % 3 else None, source, k, "clash", 1) for k in range(n)]
    return rows


def op11(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_merkle_manifest"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("leaves", [8192, 200])
def test_heights_nulls_and_repeats(spark, tmp_path, monkeypatch, leaves):
    """Trees of one leaf up to one of four levels; an id given twice with one text and with two; null ids, texts and sources; a long text."""
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    rows = rows_of([("a", 1), ("B", 16), ("b", 17), ("é", 300), ("", 3), (None, 40), *((f"s{k}", 1) for k in range(20)), ("deep", 4200)])
    rows += [rows[5], rows[5], (rows[6][0], "OTHER", "de", "B", 1, "", 2), (None, None, None, "B", None, None, None), (None, "X", None, None, 4, None, None), (10**6, "A" * 300_000, "en", "a", 5, None, None)]
    want = manifest(rows)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)
    assert op11(spark, tmp_path, rows) == want


@pytest.mark.parametrize("counts", [[], [("only", 1)], [("only", 16)], [(None, 2), ("x", 1)]])
def test_small_tables(spark, tmp_path, counts):
    rows = rows_of(counts)
    got = op11(spark, tmp_path, rows)
    assert got == manifest(rows)
    if counts == [("only", 1)]:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_any_columns_and_tampering(spark):
    """A row whose leaf alone is exchanged fails, all others hold."""
    rows = spark.createDataFrame([(k, "x", k * k) for k in range(50)], "key long, kind string, value long")
    own = merkle.row_hash(F.col("key"), F.col("value"))
    out = merkle.merkle_manifest(rows, own, F.when(F.col("key") == 7, merkle.row_hash(F.col("key"), F.lit(0))), "kind", "key").collect()
    assert {r.key for r in out if not r.verified} == {7} and len({r.root for r in out}) == 1


def test_octopus_takes_no_node_twice_and_none_that_it_can_derive():
    for known, width in (({0}, 1), ({3, 4, 40}, 300), (set(range(16)), 16), (set(range(0, 5000, 7)), 5000)):
        got = list(merkle.octopus(set(known), width, 0))
        assert len(got) == len(set(got))
        have = {(0, k) for k in known} | set(got)
        level, w, at = 0, width, set(known)
        while w > 1:
            for p in {k // 16 for k in at}:
                children = {(level, k) for k in range(p * 16, min(p * 16 + 16, w))}
                assert children <= have
                assert (level + 1, p) not in got
                have.add((level + 1, p))
            at, w, level = {k // 16 for k in at}, -(-w // 16), level + 1

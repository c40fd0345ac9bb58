"""Periodic runs against a plain search over all periods."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voyage.llm import periodic_runs as op
from voyage.llm.queries import QUERIES


def plain(words, least=24, powers=3):
    found = {}
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, powers * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, m, q) for (s, m), q in found.items())


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = plain(words)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    listed, kept = "".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_cover():
    assert {(a - b) % op.MODULUS for a in op.COVER for b in op.COVER} == set(range(op.MODULUS))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=40), st.integers(1, 12)), max_size=6), st.sampled_from([(24, 3), (2, 2), (6, 2), (9, 3), (30, 5)]), st.sampled_from([5, 1 << 20]))
def test_runs(parts, limits, grid):
    words = [x for block, times in parts for x in block * times][:600]
    before, op.GRID = op.GRID, grid
    try:
        assert op.runs(np.array(words, np.int64), *limits) == plain(words, *limits)
    finally:
        op.GRID = before


def test_extensions_over_several_blocks():
    rng = np.random.default_rng(3)
    words = np.tile(rng.integers(1, 4, 700), 3)
    words[[650, 1500]] = 9
    i, j = rng.integers(0, 1400, 500), rng.integers(0, 700, 500)
    i, j = np.minimum(i, i + j), np.minimum(i + j + 1, len(words) - 1)
    i, j = i[i < j], j[i < j]
    got = op.Extensions(words).of(i, j)
    for a, b, g in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        k = 0
        while b + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        assert g == k


def test_long_texts_of_one_word_and_of_a_long_period():
    assert op.runs(np.ones(100_000, np.int64)) == [(0, 100_000, 1)]
    assert op.runs(np.tile(np.arange(1, 9_001), 3)) == [(0, 27_000, 9_000)]


@pytest.mark.parametrize("empty", [False, True])
def test_query(spark, tmp_path, empty):
    rows = [(k, " ".join(f"w{(k * i * i) % 37}" for i in range(k % 120))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a b " * 30), (1004, "x " * 24), (1005, "x " * 23), (1006, "a b c d\n" * 9 + "z " + "p q " * 20), (1006, "a b " * 40), (1007, "v " * 20_000), (None, "é è " * 50), (None, None)]
    rows = [] if empty else rows
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, runs string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [contract(i, t) if i is not None else contract("", t)[1:] for i, t in rows]
    got = {tuple(r) for r in out.collect() if r.doc_id is not None}
    assert got == {w for w in want if len(w) == 8}
    assert empty or sum(w[1] > 0 for w in want if len(w) == 8) > 20
    assert out.where("doc_id is null").count() == (0 if empty else 2)


def test_operator(spark):
    frame = spark.createDataFrame([(1, "s " + "a b c " * 10 + "t"), (2, "no repeat here")], "doc_id long, text string")
    out = {r.doc_id: r for r in op.periodic_runs(frame).collect()}
    assert [tuple(x) for x in out[1].runs] == [(1, 30, 3)] and tuple(out[1].best) == (1, 30, 3) and out[1].collapsed == "s a b c t"
    assert out[2].runs == [] and out[2].best is None and out[2].collapsed == "no repeat here"

"""Cases in which an operator once did less than the whole job."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from voyage.llm import suffix_dedup as suffixes
from voyage.llm.decontamination import decontaminate
from voyage.llm.line_dedup import line_dedup
from voyage.llm.ngram_jaccard import ngram_jaccard_join
from voyage.llm.pii import listed, personal_data, scanned


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_decontamination_window_over_earlier_spans(spark, monkeypatch, block):
    """Short items that occur twice and more inside a window of a longer one."""
    monkeypatch.setattr("voyage.llm.decontamination.BLOCK_BYTES", block)
    items = [(1, "alpha beta"), (2, "zeta"), (3, "alpha beta c d alpha beta g zeta i j k zeta"), (4, "p alpha beta q zeta r zeta")]
    docs = [(1, items[2][1]), (2, "x " + items[2][1] + " y"), (3, "o " + items[3][1] + " o alpha o beta o zeta"), (4, "b c d alpha beta g zeta i j k zeta"), (5, "none of it"), (6, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), r.n_hit > 0) for r in out}
    assert got == brute.windows(docs, items)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in out}[2] == [(1, 13)]
    assert {r.doc_id: r.clean_text for r in out}[2] == "x  y"


@pytest.mark.parametrize("most", [5, 1])
def test_suffix_dedup_holds_no_whole_hot_anchor(spark, monkeypatch, most):
    """Phrases shorter and longer than the strings, in more different surroundings than one construction may hold."""
    rng = random.Random(11)

    def some(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    docs = []
    for phrase in (some(60), some(120), some(185), some(260)):
        near, after = some(90), some(90)
        for k in range(24):
            left, right = some(230 + k), some(230 + k)
            docs.append(left[: -(k % 5) * 20 or None] + (near[-(k % 5) * 20 :] if k % 5 else "") + phrase + after[: (k % 7) * 15] + right)
    docs = list(enumerate([*docs, *docs[:3], docs[40] + docs[41], None, ""]))
    whole = suffixes.construct

    def bounded(length):
        inner = whole(length)

        def run(batches):
            batches = list(batches)
            sizes = Counter(x for b in batches for x in b.column("anchor").to_pylist())
            assert max(sizes.values(), default=0) <= most, "one task holds a whole hot anchor"
            yield from inner(iter(batches))

        return run

    monkeypatch.setattr(suffixes, "SEGMENTS", most)
    monkeypatch.setattr(suffixes, "construct", bounded)
    monkeypatch.setattr(suffixes, "spread", lambda df, rows: 4)
    out = suffixes.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = {tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute.repeats(docs)


def thue_morse(n):
    return [bin(k).count("1") % 2 for k in range(n)]


@pytest.mark.parametrize("group", [64, 12])
def test_jaccard_families_larger_than_a_group(spark, monkeypatch, group):
    """Copies of one original, with and without it, edited in many places, some of them alike; and two texts under one id."""
    monkeypatch.setattr("voyage.llm.ngram_jaccard.GROUP", group)
    rng = random.Random(5)
    rows = []
    for original in (True, False):
        base = [f"w{rng.randrange(400)}" for _ in range(90)]
        rows += [" ".join(base)] if original else []
        shared = [(rng.randrange(90), f"s{k}") for k in range(4)]
        for _ in range(45):
            c = list(base)
            for at, word in rng.sample(shared, rng.choice([0, 1, 2])):
                c[at] = word
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                c[rng.randrange(90)] = f"x{rng.randrange(500)}"
            rows.append(" ".join(c))
    rows = list(enumerate([*rows, *rows[:5], None, "", "one two"]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in ngram_jaccard_join(frame, n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute.jaccard(rows, 3, 90, 100)
    twice = [(1, rows[0][1]), (1, "a b c d e f"), (2, "a b c d e f"), (3, rows[0][1]), (4, "x y z")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_jaccard_join(spark.createDataFrame(twice, "doc_id long, text string"), n=3, num=90, den=100).collect()}
    assert {k[0]: v for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_structured_texts_do_not_fall_together(spark):
    """Words and lines whose polynomial hashes modulo a power of two are equal."""
    bits = thue_morse(1024)
    words = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    frame = spark.createDataFrame([(1, words[0]), (2, words[1])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_jaccard_join(frame, n=3, num=90, den=100).collect()} == {1: 1, 2: 2}
    lines = [" ".join(("left", "right")[b ^ k] for b in bits[:512]) for k in (0, 1)]
    out = line_dedup(spark.createDataFrame([(1, lines[0]), (2, lines[1])], "doc_id long, text string")).collect()
    assert [r.n_removed for r in out] == [0, 0]
    items = spark.createDataFrame([(1, words[0])], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate(frame, items).collect()} == {1: 1, 2: 0}
    halves = ["".join("ab"[b ^ k] for b in bits[:256]) for k in (0, 1)]
    rows = [(1, "x" * 60 + halves[0]), (2, "y" * 60 + halves[1])]
    got = {tuple(r) for r in suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute.repeats(rows)


def test_personal_data_work_grows_with_the_matches(spark):
    """Many thousand matches in one text, each in its place."""
    texts = {n: " ".join(f"mail: user{k}@host{k % 7}.org {k % 200}.1.2.3" for k in range(n)) for n in (3000, 12000)}
    out = {r.doc_id: r.s for r in personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    for n, text in texts.items():
        want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"user\d+@host\d\.org", text)] + [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"\d+\.1\.2\.3", text)]
        assert sorted(out[n].split(",")) == sorted(want)


def test_scans_over_several_pieces(spark):
    rng = random.Random(8)
    lists = [[rng.randrange(-50, 50) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 1000)] + [[]]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, x array<int>")
    sums = {r.k: r.s for r in scanned(frame, "s", "x", lambda t, x: t + x).collect()}
    tops = {r.k: r.s for r in scanned(frame, "s", "x", F.greatest).collect()}
    for k, x in enumerate(lists):
        assert sums[k] == list(itertools.accumulate(x)) and tops[k] == list(itertools.accumulate(x, max))


def test_top_k_refuses_what_a_long_cannot_hold(spark):
    """Scores of such vectors were wrong without an error once."""
    from voyage.llm.topk_search import top_k_search

    schema = "vec_id long, embedding array<double>"
    good = top_k_search(spark.createDataFrame([(0, [1e5, 2.0]), (1, [1e5, -3.0])], schema), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in good] == [(1, 102400000 * 102400000 - 2048 * 3072)]
    for huge in (1e17, 1e30):
        with pytest.raises(Exception, match="too long for exact products"):
            top_k_search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [huge, 3.0])], schema), F.col("vec_id") == 0).collect()


def test_top_k_with_an_id_given_twice(spark):
    from voyage.llm.topk_search import top_k_search

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 5.0])]
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, scale=1).collect())
    assert out == [(0, 1, 1, 3), (0, 1, 2, 5), (0, 2, 1, 1), (0, 2, 2, 1)]

"""The pipeline's stages and run() against plain versions, on small tables with nulls, repeated rows and clashing columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm import brute
from tokenizers import Tokenizer

import corpus_pipeline
from voyage.llm.toxicity import graded, toxicity

COLUMNS = "doc_id long, text string, lang string, n_chars int, new_text string, toxic int, id long"


def tables():
    rng = random.Random(3)

    def words(n):
        return " ".join(rng.choice("abcdefgh") + rng.choice("klmnopé") + rng.choice("rstuvw") for _ in range(n))

    passage, common = words(12), words(11)
    items = [(1, passage), (2, "alpha beta"), (3, "alpha beta c d alpha beta g h i j k"), (4, None), (5, "")]
    texts, labels = [None, "", " \n\t", "one", common, "alpha beta", f"alpha beta {words(1)}"], []
    base = [words(rng.choice([6, 30, 60])) for _ in range(12)]
    for t in base:
        texts += [t, t + " " + words(1), "\n".join([words(9), common, words(10)]), words(20) + " " + passage + ", " + words(15)]
    texts += ["x " + items[2][1] + " y\n" + words(30), words(5) + " " + passage, base[1], words(5000)]
    for k in range(120):
        bad = ["IDIOT", "moron", "scum"] * 3 if k % 4 == 0 else []
        labels.append((len(texts), k % 3 % 2, int(bool(bad))))
        texts.append(" ".join([words(15), *bad]))
    docs = [(i, t, "en", len(t or ""), "other", 1, -i) for i, t in enumerate(texts)]
    return [*docs, docs[9], docs[9], docs[0]], labels, items


def spans(text, found):
    """(words, hit words, text without the runs of hit words)."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
    w = [text[a:b].translate(brute.UP) for a, b in at]
    hit = {p for s in {len(k) for k in found} for k in range(len(w) - s + 1) if tuple(w[k : k + s]) in found for p in range(k, k + s)}
    out, upto = "", 0
    for p in sorted(hit):
        if p - 1 not in hit:
            out += text[upto : at[p][0]]
        upto = at[p][1]
    return len(w), len(hit), out + text[upto:]


def plain(name, rows, items, bad):
    """Rows by a stage's plain version; toxic ids are the fitted model's."""
    if name == "toxicity":
        return [r for r in rows if r[0] not in bad]
    texts = sorted({(r[0], r[1] or "") for r in rows})
    if name == "n-gram Jaccard join":
        stay = {i for i, _, top in brute.jaccard(texts, 5, 80, 100) if i == top}
        return [r for r in rows if r[0] in stay]
    new = {}
    if name == "line dedup":
        gone = brute.near_lines(texts)
        for i, t in texts:
            kept = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
            if kept == t or re.search(r"[^\x20\x09-\x0D]", kept):
                new[i] = kept
    else:
        found = set()
        for _, t in items:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.UP))
            found |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
        for i, t in texts:
            n, hit, clean = spans(t, found)
            if hit <= 0.5 * n:
                new[i] = clean
    return [(r[0], new[r[0]], r[2], len(new[r[0]]), *r[4:]) for r in rows if r[0] in new]


def pieces(rows):
    t, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(r[0], k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    return sorted(out)


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs, labels, items = tables()
    folder = str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame(docs, COLUMNS)
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    read = spark.read.parquet(f"{folder}/documents.parquet")
    bad = {r.doc_id for r in toxicity(read, graded(spark.read.parquet(f"{folder}/labels.parquet"))).where("toxic").collect()}
    assert bad
    return folder, docs, items, bad


def test_stages_and_run(spark, made):
    folder, rows, items, bad = made
    whole = corpus_pipeline.run(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = plain(name, rows, items, bad)
        got = stage(spark, spark.createDataFrame(rows, COLUMNS), folder)
        assert got.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        assert order(got.collect()) == order(want), name
        assert 0 < len(want) <= len(rows)
        rows = want
    packed = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, COLUMNS), folder).collect()
    assert sorted(tuple(r)[:5] for r in packed) == pieces(rows)
    assert sorted(tuple(r)[:5] for r in whole.collect()) == pieces(rows)  # its tables are still there


def test_two_runs_in_one_session(spark, made):
    first, second = corpus_pipeline.run(spark, made[0]), corpus_pipeline.run(spark, made[0])
    assert order(first.collect()) == order(second.collect())


def test_stages_of_nothing(spark, made):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], COLUMNS), made[0]).count() == 0

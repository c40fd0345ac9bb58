"""Each operator against its plain version, on small documents with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from voyage.llm.decontamination import decontaminate
from voyage.llm.line_dedup import line_dedup
from voyage.llm.ngram_jaccard import ngram_jaccard_join
from voyage.llm.packing import pack, plan
from voyage.llm.pii import KINDS, listed, personal_data
from voyage.llm.sharding import shard_by_bytes
from voyage.llm.suffix_dedup import suffix_dedup
from voyage.llm.topk_search import top_k_search
from voyage.llm.toxicity import graded, toxicity
from voyage.llm.url_filter import labelled_urls, url_filter

WORDS = "the of and re tion er ing Éan été straße niño on at it is to for was as les".split()


def texts():
    rng = random.Random(7)

    def words(n):
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))

    base = [words(rng.choice([5, 40, 80, 200])) for _ in range(40)]
    out = [None, "", " \n\t", "one", "one two", "one two", "a\x0bb\x0cc d"]
    for t in base:
        out.append(t)
        w = t.split(" ")
        for _ in range(3):
            c = list(w)
            for _ in range(rng.choice([1, 1, 2, 8])):
                c[rng.randrange(len(c))] = rng.choice(WORDS)
            out.append(" ".join(c))
        out.append("\n".join([words(12), t[:300], rng.choice(base)[:260], words(9)]))
    out += [base[0]] * 30 + [words(9000), "x" * 700, "ab" * 400]
    return out


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows, with columns that clash with what operators return."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, component_id string, n_words int, shard int").repartition(5)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def got(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_ngram_jaccard_join(docs, nothing, rows, n, num):
    assert got(ngram_jaccard_join(docs, n=n, num=num, den=100)) == brute.jaccard(rows, n, num, 100)
    assert ngram_jaccard_join(nothing).count() == 0


def test_line_dedup(docs, nothing, rows):
    gone = brute.near_lines(rows)
    want = set()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if (i, k) not in gone]
        want.add((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got(line_dedup(docs)) == want
    assert line_dedup(nothing).count() == 0


def test_suffix_dedup(docs, nothing, rows):
    out = suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert got(out) == brute.repeats(rows)
    assert suffix_dedup(nothing).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://COM/x", "http://a.com", "https://www.Example.com/en/1?q#f", "http://b.example.com/en/2", "http://x.net/es/", "http://xnet/es/", "http://u.net/fr/a://b/c", "ftp://h#/x", "a\nb://H.net/fr/1"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_filter(pages, labelled_urls(spark)).collect()}
    assert len(out) == len(urls)
    assert [(out[k].host, out[k].path) for k in range(len(urls))] == [("", ""), ("", ""), ("", ""), ("com", "/x"), ("a.com", ""), ("www.example.com", "/en/1"), ("b.example.com", "/en/2"), ("x.net", "/es/"), ("xnet", "/es/"), ("u.net", "/fr/a://b/c"), ("h", ""), ("h.net", "/fr/1")]
    assert [out[k].rule for k in range(len(urls))] == [None, None, None, "com/", None, "www.example.com/en/", "example.com/en/", "net/es/", None, "net/fr/", None, "net/fr/"]
    assert [out[k].verdict for k in (3, 5, 6, 7, 9)] == ["allow", "allow", "block", "block", "block"]
    assert url_filter(pages.limit(0), labelled_urls(spark)).count() == 0


def test_url_filter_on_held_out_words(spark):
    """Addresses of one part, whose first words the model has not seen."""
    labelled = labelled_urls(spark)
    held = labelled.where("part = 2").withColumn("page_id", F.col("blocked"))
    out = [(r.page_id == 1, r.verdict == "block") for r in url_filter(held, labelled.where("part <> 2"), rules=()).collect()]
    assert len(out) == 40 and sum(a == b for a, b in out) >= 34


def test_top_k_search(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)) * rng.choice([0.01, 1, 5], size=(400, 1)))]
    vectors += [(400, None), (500, [1.0, None]), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (800, [0.0] * 8), (801, vectors[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    good = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, v in good:
        if i % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i))[:10]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert got(top_k_search(df, F.col("vec_id") % 100 == 0)) == want
    assert top_k_search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert got(top_k_search(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0)) == {(0, 1, 1, sum(a * b for a, b in zip(good[0][1], good[1][1])))}


def test_personal_data(spark, docs, rows):
    cases = ["mail a.b@c-d.org, x@y and q@w.e.r", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5 007.08.09.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 12345678901234567890", "+1 (582) 555-9616 +12 +1234567890123456", "é+44 20 7946 0958 ü 8.8.8.8@x.y", "@" * 50 + "1" * 5000, "1 " * 3000]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate([*cases, None, ""])], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    out = personal_data(both)
    for r in out.select("doc_id", "base", F.sha2(listed(F.col("base")), 256).alias("sha")).collect():
        text = dict([*rows, *((1000 + k, t) for k, t in enumerate([*cases, None, ""]))])[r.doc_id]
        want = brute.personal(text)
        assert ([sum(s["order"] == n for s in r.base) for n in range(len(KINDS))], r.sha) == (list(want[:4]), want[4]), text[:80]
    assert personal_data(both.limit(0)).count() == 0


def test_context_finds_what_patterns_miss(spark):
    seen = [f"call agent {k} contact-id: user{k}77@mail.example.org now" for k in range(30)]
    docs = spark.createDataFrame([*enumerate(seen), (100, "and contact-id: KX-44521-ZZ today"), (101, "the room KX-44521-AA is free")], "doc_id long, text string")
    spans = {r.doc_id: r.s for r in personal_data(docs).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    assert spans[100] == "id:16:27"
    assert spans[101] == ""


def test_identifiers_of_unseen_shape(spark):
    """Planted values in the places of known keys are found, plain words after the same signs and stop words are not."""
    rng = random.Random(9)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [f'and the token = "{key()}" or so' for _ in range(30)] + [f"the {key()} of the {k} said: nothing here" for k in range(20)]
    odd = ["KX-99-ÄÖ-1", "hunter22", "9F:77:AA", "plain-looking"]
    rows += [f'éé token = "{x}" there' for x in odd] + ["he said: something else", "the 123456789 words", 'remark = "ordinary words"', None, "", 'token = "' + "a1" * 5000 + '"', "label" * 4000 + " = x"]
    docs = spark.createDataFrame([*enumerate(rows), (None, rows[30])], "doc_id long, text string")
    spans = {r.doc_id: r.s for r in personal_data(docs).select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    found = [spans[50 + k] == f"id:12:{12 + len(x)}" for k, x in enumerate(odd)]
    assert sum(found) >= 0.9 * len(odd) and all(spans[k].startswith("id:") for k in range(30))
    assert all("id:" not in spans[k] for k in [*range(30, 50), *range(54, 59)])
    assert spans[59] == "id:9:10009" and spans[60] == "" and len(spans) == len(rows) + 1


def test_shards(docs, nothing, rows):
    out = shard_by_bytes(docs, shards=6).collect()
    text = dict(rows)
    assert len(out) == len(rows)
    sizes, slots = {}, {}
    for r in out:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 6 + max(r.size for r in out)
    assert shard_by_bytes(nothing).count() == 0


def test_toxicity(spark, nothing):
    """Held-out documents of three grades, which share their words but not their number."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.choice([20, 200]))]
        grade = (0, 0, 1, 2)[i % 4]
        for bad in ([], ["IDIOT", "moron"], ["IDIOT", "moron", "scum", "filth"])[grade]:
            words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), "x", 7))
        if i < 600:
            labels.append((i, grade))
    docs = spark.createDataFrame([*rows, (1000, None, "x", 7), (1001, "", "x", 7)], "doc_id long, text string, grade string, y int")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (0, 0), (1, None)], "doc_id long, grade int")
    out = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    held_out = [(out[i].grade, (0, 0, 1, 2)[i % 4]) for i in range(600, 900)]
    assert sum(a == b for a, b in held_out) >= 290
    means = [np.mean([out[i].expected_severity for i in range(600, 900) if (0, 0, 1, 2)[i % 4] == g]) for g in (0, 1, 2)]
    assert means[0] < 0.3 < 0.7 < means[1] < 1.3 < 1.7 < means[2]
    assert not out[1000].toxic and not out[1001].toxic and len(out) == 902
    assert not any(r.toxic for r in toxicity(docs, marks.limit(0)).collect())
    assert toxicity(nothing, marks).count() == 0
    two = graded(spark.createDataFrame([(1, 1, 1), (2, 0, 1), (3, 1, 0), (4, 0, None), (5, None, 1)], "doc_id long, quality int, toxic int"))
    assert [r.grade for r in two.orderBy("doc_id").collect()] == [2, 1, 0, None, 1]


@pytest.mark.parametrize("block", [8 << 20, 500])
def test_decontamination(spark, docs, nothing, rows, monkeypatch, block):
    monkeypatch.setattr("voyage.llm.decontamination.BLOCK_BYTES", block)
    items = [(0, None), (1, ""), (2, rows[8][1]), (3, "one two"), (4, rows[30][1][5:120].upper()), (5, rows[31][1]), (11, rows[8][1][-90:])]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    out = set()
    for r in decontaminate(docs, benchmark).collect():
        out.add((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), r.n_hit > 0))
    assert out == brute.windows(rows, items)
    assert decontaminate(nothing, benchmark).count() == 0
    assert all(r.n_hit == 0 and r.clean_text is not None for r in decontaminate(docs, benchmark.limit(0)).collect())


def test_packing(docs, nothing, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    odd = ["it's we're '' 's !'s <|endoftext|> x", "ΣΑΣ İstanbul e\u0301 漢字 ½ ² 12\u00a03", "\u2028\x85 tab"]
    more = docs.sparkSession.createDataFrame([(2000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    every = dict(rows) | {2000 + k: t for k, t in enumerate(odd)}
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = set()
    for i, x in every.items():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    out = pack(docs.select("doc_id", "text").union(more), path("word_bpe_49k.json")).collect()
    assert {tuple(r)[:5] for r in out} == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        assert sorted(x) == [(sum(n for _, n in sorted(x)[:k]), n) for k, (_, n) in enumerate(sorted(x))]
        assert sum(n for _, n in x) <= 4096
    assert len(bins) == -(-sum(r.length for r in out) // 4096)
    assert pack(nothing, path("word_bpe_49k.json")).count() == 0


def test_best_two_fit_replaces_the_smallest():
    assert list(plan({6: 1, 3: 1, 2: 2}, 10)) == [(1, [6, 2, 2]), (1, [3])]
    assert sum(n * len(x) for n, x in plan({k: k % 7 for k in range(1, 50)}, 50)) == sum(k % 7 for k in range(1, 50))


def test_repeated_rows_and_missing_ids(docs, spark):
    twice = docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame([(None, "x y z")], "doc_id long, text string"))
    n = docs.count()
    assert ngram_jaccard_join(twice).count() == 2 * n
    assert line_dedup(twice).count() == 2 * n
    assert all(r.n_removed == r.n_bytes for r in suffix_dedup(twice).collect() if r.n_bytes >= 200)
    assert shard_by_bytes(twice).count() == 2 * n + 1

"""The registered queries over whole small tables, with their contracts' columns, against plain versions."""

import hashlib
import random
import zlib

import pytest
from tests.llm import brute

from voyage.llm.queries import QUERIES

HOSTS = ["example.com", "www.example.com", "b.EXAMPLE.com", "com", "x.net", "net", "xnet", "casino-win.example.org", "a.org"]
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def tables():
    rng = random.Random(2)

    def words(n):
        return " ".join(rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("rstué") for _ in range(n))

    base = [words(n) for n in (3, 30, 60, 100, 200)]
    texts = [None, "", " ", "one two", *base, *base]
    for t in base:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "zzz"
        texts += [" ".join(w), "\n".join([words(9), t[:260], words(11)]), words(9) + "\n" + t]
    texts += ["mail a.b@c-d.org 1.2.3.4 +44 20 7946 0958 4111 1111 1111 1111", "x" * 700, "IDIOT moron " + base[1]]
    items = [(1, base[2][:80]), (2, "one two"), (3, None), (11, " ".join(base[3].split(" ")[5:40]))]
    urls = [None, "", "no scheme", *(f"http://{h}{p}" for h in HOSTS for p in ("", "/en/1", "/es/?q", "/fr/a#b", "?x/y", "/de"))]
    vectors = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(0, 500, 7)] + [(300, [0.5] * 4), (301, None), (302, [1.0, None]), (303, [float("inf")] * 4)]
    return list(enumerate(texts)), items, list(enumerate(urls)), vectors


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, items, urls, vectors = tables()
    frames = {
        "documents": spark.createDataFrame([(i, t, "en", "s", 3, 9) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, id int"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
        "pages": spark.createDataFrame([(i, u, "<p>") for i, u in urls], "page_id long, url string, host string"),
        "embeddings": spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, rank int"),
        "labels": spark.createDataFrame([(i, i % 2, int("IDIOT" in (t or ""))) for i, t in docs], "doc_id long, quality int, toxic int"),
    }
    for name, df in frames.items():
        df.repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return folder, docs, items, urls, spark.read.parquet(f"{folder}/embeddings.parquet").collect()


def run(spark, made, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, made[0]).select(*columns).collect()]


def test_sets_lines_and_repeats(spark, made):
    docs = made[1]
    assert set(run(spark, made, "op1_ngram_jaccard_join", "doc_id", "n_shingles", "component_id")) == brute.jaccard(docs, 3, 90, 100)
    gone = brute.near_lines(docs)
    kept = {i: [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone] for i, t in docs}
    want = {(i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept[i]), hashlib.sha256("\n".join(kept[i]).encode()).hexdigest()) for i, t in docs}
    assert set(run(spark, made, "op2_line_dedup", "doc_id", "n_lines", "n_removed", "kept_sha256")) == want
    assert set(run(spark, made, "op3_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute.repeats(docs)
    assert set(run(spark, made, "op9_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute.windows(docs, made[2])


def test_addresses(spark, made):
    out = {r[0]: r[1:] for r in run(spark, made, "op4_url_filter", "page_id", "host", "path", "rule", "verdict")}
    assert len(out) == len(made[3])
    for i, url in made[3]:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:cut].translate(brute.UP), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = max(((len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        assert out[i][:3] == (host, path, fit and fit[1]), url
        assert out[i][3] == fit[2] if fit else out[i][3] in ("allow", "block")


def test_top_ten(spark, made):
    import math

    good = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in made[4] if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = set()
    for i, v in good:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i)[:10]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert set(run(spark, made, "op5_topk_search", "query_id", "rank", "vec_id", "score")) == want


def test_personal_data_and_shards(spark, made):
    text = dict(made[1])
    out = run(spark, made, "op6_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert {r[0]: r[1:] for r in out} == {i: brute.personal(t) for i, t in made[1]}
    rows = run(spark, made, "op7_sharding", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(r[0] for r in rows) == sorted(text)
    assert all(r[1] == len((text[r[0]] or "").encode()) + 16 and r[2] == zlib.crc32((text[r[0]] or "").encode()) and r[3] == "bytes" and r[6] is None for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r[4], []).append(r[5])
    assert all(0 <= s < 40 and sorted(x) == list(range(len(x))) for s, x in slots.items())


def test_severity_and_packing(spark, made):
    out = run(spark, made, "op8_toxicity", "doc_id", "expected_severity", "grade", "toxic")
    assert sorted(r[0] for r in out) == [i for i, _ in made[1]] and all((r[2] > 0) == r[3] and 0 <= r[1] <= 2 for r in out)
    rows = run(spark, made, "op10_best_fit_packing", "doc_id", "piece", "start", "length", "sequence_id", "offset")
    bins = {}
    for r in rows:
        bins.setdefault(r[4], []).append((r[5], r[3]))
    assert {r[0] for r in rows} == {i for i, _ in made[1]}
    assert all(sorted(x)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False)) for x in bins.values())
    assert len(bins) == -(-sum(r[3] for r in rows) // 4096)

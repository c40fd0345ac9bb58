"""As-of lookups, positions, exact quantiles and concordance against plain versions, with pieces small enough to be many."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voyage.operators import ordering, quantiles, survival


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("stretch", [7, 10_000])
def test_as_of(spark, forward, inclusive, stretch):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, "x"]), day(rng.randrange(-40, 60)), rng.choice(["lab", "lot"]), rng.choice([None, 1, 2, 5])) for _ in range(160)] + [("a", "x", None, "lab", 9)]
    keys = [(p, k, day(n)) for p in "abcd" for k in (None, "x") for n in range(-50, 70, 7)]
    left = spark.createDataFrame(keys + keys[:9], "p string, k string, date date").where("k is not null")
    right = spark.createDataFrame(rows, "p string, k string, at date, kind string, v int").where("k is not null")
    picks = {"v": F.col("v"), "lot": F.when(F.col("kind") == "lot", F.col("at"))}
    out = ordering.as_of(left, right, ("p", "k"), picks, {"n": F.lit(1), "total": F.col("v")}, forward=forward, inclusive=inclusive, stretch=stretch).collect()
    want = set()
    for p, k, d in keys:
        if k is None:
            continue
        own = [r for r in rows if r[0] == p and r[1] == k and r[2] and ((r[2] > d if forward else r[2] < d) or (inclusive and r[2] == d))]
        near = lambda some: sorted({r[2] for r in some}, reverse=not forward)[:1]
        v = max((r[4] for r in own if r[4] is not None and [r[2]] == near([x for x in own if x[4] is not None])), default=None)
        lot = next(iter(near([r for r in own if r[3] == "lot"])), None)
        want.add((p, k, d, v, lot, len(own), sum(r[4] or 0 for r in own)))
    assert len(out) == len(want) and {tuple(r) for r in out} == want


def test_as_of_work_is_linear(spark):
    """A patient of many keys and rows: no step makes more rows than there are keys and rows."""
    keys = spark.range(3000).select(F.lit("a").alias("p"), F.date_add(F.lit("2000-01-01"), F.col("id").cast("int")).alias("date"))
    rows = keys.select("p", F.col("date").alias("at"), F.dayofyear("date").alias("v"))
    out = ordering.as_of(keys, rows, ("p",), {"v": F.col("v")})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert len(joins) == 1 and "_stretch" in joins[0]  # keys meet rows in no join; stretches get what they carry
    assert out.count() == 3000 and out.where("v <> dayofyear(date)").isEmpty()


def test_positions(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PART", 10)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1000), k) for k in range(200)]
    out = ordering.numbered(spark.createDataFrame(rows, "g string, x int, k int"), ("g",), ("x", "k")).collect()
    want = {}
    for g in {r[0] for r in rows}:
        want |= {r: n for n, r in enumerate(sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2])))}
    assert {(r.g, r.x, r.k): r.position for r in out} == want


@pytest.mark.parametrize("few", [3, 40, 1 << 16])
def test_quantiles(spark, few):
    rng = random.Random(7)
    groups = {
        "even": [rng.uniform(-5, 5) for _ in range(900)], "ties": [rng.choice([1.0, 2.0, 2.0, 2.0, 7.0]) for _ in range(700)], "two": [0.0] * 300 + [1.0] * 301,
        "heavy": [10.0 ** rng.uniform(-300, 300) for _ in range(500)], "one": [4.5], "same": [3.0] * 400, "far": [float(k) for k in range(500)] + [1e300, -1e300],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    asked = (0.0, 0.2, 0.37, 0.5, 0.999, 1.0)
    out = {r.g: r.quantiles for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ("g",), "v", asked, few).collect()}
    assert set(out) == set(groups)
    for g, vs in groups.items():
        s = sorted(vs)
        for p, got in zip(asked, out[g], strict=True):
            at = p * (len(s) - 1)
            low = int(at)
            want = s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)
            assert got == pytest.approx(want, rel=1e-12, abs=1e-12), (g, p)


@pytest.mark.parametrize("block", [0, 2, 16])
def test_concordance(spark, monkeypatch, block):
    monkeypatch.setattr(survival, "BLOCK", block)
    monkeypatch.setattr(ordering, "PART", 50)
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(12), rng.random() < 0.5, rng.randrange(8) / 8, rng.choice([0.5, 0.8, 1.0])) for _ in range(300)]
    rows += [("late", 20, True, 0.5, 1.0), ("zero", 1, True, 0.5, 0.0), ("zero", 2, False, 0.1, 1.0), ("order", 1, True, 0.9, 1.0), ("order", 2, True, 0.5, 1.0), ("order", 3, False, 0.1, 1.0)]
    frame = spark.createDataFrame(rows, "group string, time int, event boolean, risk double, g double")
    for tau in (None, 8):
        got = {r.group: r.c_index for r in survival.c_index_ipcw(frame, tau).collect()}
        for g in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == g]
            pairs = [(i, j) for i in own for j in own if i[2] and (tau is None or i[1] < tau) and (j[1] > i[1] or (j[1] == i[1] and not j[2]))]
            if not pairs or any(i[4] == 0 for i, _ in pairs):
                assert got[g] is None
            else:
                weight = sum(i[4] ** -2 for i, _ in pairs)
                good = sum(i[4] ** -2 * (1 if j[3] < i[3] else 0.5 if j[3] == i[3] else 0) for i, j in pairs)
                assert got[g] == pytest.approx(good / weight)
    assert got["order"] == 1.0


def test_buckets_grow_with_the_source(spark, tmp_path, monkeypatch):
    from voyage.sources import tables

    spark.range(1000).write.parquet(str(tmp_path / "rows"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.buckets(spark, str(tmp_path)) == tables.buckets(spark, str(tmp_path / "none")) == n
    monkeypatch.setattr(tables, "BUCKET", 100)
    assert tables.buckets(spark, str(tmp_path)) > n
    kept = tables.once(spark, "grown", str(tmp_path), lambda: spark.range(1000), by="id")
    assert kept.count() == 1000 and len({f.rsplit("_", 1)[-1] for f in kept.inputFiles()}) > n


def test_buckets_meet_without_a_shuffle(spark, tmp_path):
    """Joins by a bucket's column and more move nothing while a table is made, and the session is as before."""
    from voyage.operators import splits
    from voyage.sources import tables

    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    lab = ("'lab' as event_category", "concat('v', id % 3) as event_name", "cast(id as string) as event_value")
    events = tables.once(spark, "met_events", str(tmp_path), lambda: spark.range(600).selectExpr("concat('p', id % 20) as patientid", "date_add(date '2020-01-01', cast(id % 97 as int)) as date", *lab), by="patientid")
    dates = tables.once(spark, "met_dates", str(tmp_path), lambda: events.where("date < '2020-02-01'").select("patientid", "date").distinct(), by="patientid")
    with tables.together(spark):
        found = splits.eligible_variables(events, dates)
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and spark.conf.get(setting) == before
    with pytest.raises(ValueError), tables.together(spark):
        raise ValueError
    assert spark.conf.get(setting) == before
    rows, asked = [tuple(r) for r in events.select("patientid", "date", "event_name").collect()], [tuple(r) for r in dates.collect()]
    expect = set()
    for p, at in asked:
        near = [(n, (d - at).days) for q, d, n in rows if q == p and -90 <= (d - at).days <= 90]
        good = {n for n, g in near if g <= 0} & {n for n, g in near if g > 0}
        expect |= {(p, at, n) for n in good} or {(p, at, None)}
    assert {tuple(r) for r in found.collect()} == expect

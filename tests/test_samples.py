"""The keys of samples without their texts."""

import datetime as dt

from pyspark.sql import functions as F

from voyage.plans import models, texts


def _tables(spark, path):
    """Patients 1 to 12, the first with two rows of static data, the last without any; 5 with one order alone, 6 with genetic rows alone ahead of others."""
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    save([(0, "EUROPE")], "r_regionkey long, r_name string", "region")
    save([(0, "FRANCE", 0)], "n_nationkey long, n_name string, n_regionkey long", "nation")
    save([(c, "BUILDING", 0) for c in (1, *range(1, 12))], "c_custkey long, c_mktsegment string, c_nationkey long", "customer")
    save([(1, 0), (2, 0)], "s_suppkey long, s_nationkey long", "supplier")
    save([(1, "SMALL"), (2, "MEDIUM"), (3, "LARGE")], "p_partkey long, p_type string", "part")
    orders, lines, day = [], [], dt.date(1995, 1, 1)
    for c in range(1, 13):
        for k in range(1 if c == 5 else 14):
            key = 100 * c + k
            orders.append((key, c, day + dt.timedelta(days=20 * k + c), "O" if k % 2 else "F", ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")[(k + c) % 4]))
            lines += [(key, 1 + (k + n) % 3, 1 + n % 2, n, float(1 + (7 * k + n) % 40), "R" if k % 2 else "N", day + dt.timedelta(days=20 * k + c + 5 * n - (300 if c == 6 and n == 1 else 0))) for n in range(1, 4)]
    save(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string", "orders")
    save(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate date", "lineitem")


def test_keys_of_samples_are_those_of_the_samples(spark, tmp_path, monkeypatch):
    """The evaluation tables made all texts of the samples for their keys alone."""
    _tables(spark, tmp_path)
    d = str(tmp_path)
    keys = sorted(tuple(r) for r in texts.sample_keys(spark, d).collect())
    assert len(keys) > 20 and len(set(keys)) < len(keys) and not any(k[0] == "C12" for k in keys)
    assert keys == sorted(tuple(r) for r in texts.samples(spark, d).select("patientid", "split_date").collect())

    def none(*_):
        raise AssertionError("samples were made")

    monkeypatch.setattr(texts, "samples", none)
    assert sorted((r.patientid, r.split_date) for r in models.d60_evaluation_text_tables(spark, d).collect()) == keys


def test_samples_stay_in_their_patients_buckets(spark, tmp_path):
    """Each of the batches of s17 moved and sorted all texts."""
    _tables(spark, tmp_path)
    rows = texts.samples(spark, str(tmp_path))
    people = spark.range(5).select(F.concat(F.lit("C"), "id").alias("patientid")).hint("shuffle_hash")
    plan = rows.join(people, "patientid")._jdf.queryExecution().executedPlan().toString()
    texts_side = plan[plan.index("ShuffledHashJoin") :].split("Exchange")[0]
    assert "FileScan parquet" in texts_side and plan.count("Exchange") == 1 and "Sort" not in plan

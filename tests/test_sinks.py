"""What the files of samples take."""

import glob
import os

from pyspark.sql import functions as F

from voyage.sources import files


def test_samples_are_packed_and_counted_line_by_line(spark, tmp_path):
    """JSON lines lay unpacked, some 50 GB of them at 360 times sf0.1."""
    path = f"{tmp_path}/samples"
    rows = spark.range(3000).select(F.concat(F.lit("of a patient,\n\tvisit by visit "), F.repeat(F.lit("é \"x\"\r\n"), 50), F.col("id")).alias("instruction"), F.lit(None).cast("string").alias("answer"), F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "a").alias("indication"), F.lit("train").alias("data_split"))
    files.write_samples(rows, path, ("n",))
    size = sum(os.path.getsize(f) for f in glob.glob(f"{path}/batch=all/*/*/part-*"))
    assert 0 < size < rows.select(F.sum(F.length("instruction"))).first()[0] / 4
    assert sorted(r.rows for r in files.finished(spark, path).collect()) == [1500, 1500]
    back = files.read_samples(spark, path)
    assert {(r.instruction, r.n, r.indication) for r in back.select("instruction", "meta.n", "indication").collect()} == {(r.instruction, r.n, r.indication) for r in rows.collect()}

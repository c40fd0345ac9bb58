"""Tables that are worked out once and read many times."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of a source's files that one bucket stands for; rows unpack to many times as much.
BUCKET = 8 << 20
_made: dict[tuple[str, ...], str] = {}
_schemas: dict[tuple[str, ...], StructType] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; under a fresh local one where that is unset, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/voyage-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back, which cuts its lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession, source: str) -> int:
    """How many buckets a table of the source gets: as many as shuffles have partitions, and more where the source's files are large, so that a bucket stays small."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = store.getContentSummary(path).getLength() if store.exists(path) else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


@contextmanager
def together(spark: SparkSession) -> Iterator[None]:
    """What is run in here joins bucketed tables where their buckets lie, also by their column and more.

    Else Spark moves both sides of such a join whenever its keys are more than the buckets' column. For tables of very many keys, such as patients: a column of few values would
    leave few tasks, so this is set for single runs only and put back behind them.
    """
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """What build gives, written at the first call of this application for the name and source, read at all later ones.

    With by, rows of one value lie in one bucket, so that joins, groups and windows over it, in tables made here by more columns as well, need no shuffle. The number of buckets grows with the source.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _made:
        df = build()
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if by is None:
            df.write.parquet(path)
            _made[key] = path
        else:
            table, n = f"{name}_{uuid.uuid4().hex}", buckets(spark, source)
            with together(spark):
                df.repartition(n, by).write.bucketBy(n, by).option("path", path).saveAsTable(table)
            _made[key] = table
        _schemas[key] = df.schema
    if by is None:
        return spark.read.schema(_schemas[key]).parquet(_made[key])
    return spark.table(_made[key])


def forget(spark: SparkSession, *names: str) -> None:
    """Later calls of once make their tables anew: all of them, or those of the names given."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId and (not names or k[1] in names)]:
        del _made[key], _schemas[key]

"""Written tables that cut lineage, and small helpers that every operator here shares."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a fresh local one where it is unset, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


#: Paths of the tables written so far by this process, in order; the whole folder can go when the application has ended.
TABLES: list[str] = []
#: Keys that are broadcast at most: 4 MB a long column. Larger sets of ids are joined by a shuffle.
IDS = 500_000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lost executors cost no recomputation beyond this point."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with null texts as empty ones; rows without an id take no part."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def spread(df: DataFrame, target_rows: int) -> int:
    """How many blocks of about target_rows the frame's rows need (a count job)."""
    return max(1, math.ceil(df.count() / target_rows))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no frame still to be read needs."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        TABLES.remove(path)


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with one of the ids (column id): without moving the rows as long as IDS allows, else by a shuffle."""
    ids = ids.select("id").distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= IDS else ids, "id", "left_semi")


def without(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows with none of the keys (columns on): without moving the rows as long as IDS allows, else by a shuffle."""
    keys = keys.select(*on).distinct()
    return rows.join(F.broadcast(keys) if keys.count() <= IDS else keys, list(on), "left_anti")

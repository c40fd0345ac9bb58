"""Cohort files in and out: discovery, typed scans, and the sinks of samples, series and statistics.

Paths go through Spark and its file systems alone, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Files of a cohort behind its name.
PARTS = {
    "events": "_master_events.csv", "molecular": "_master_molecular.csv", "constant": "_master_constant.csv",
    "constant_description": "_master_constant_descriptions.csv", "statistics": "_master_statistics.csv",
}
SPEC = {
    "events": "patientid string, date date, event_category string, event_name string, event_descriptive_name string, event_value string, meta_data string",
    "molecular": "patientid string, date date, biomarker_category string, biomarker_event string, biomarker_value string, biomarker_descriptive_name string, meta_data string",
    "constant": "patientid string, birthyear int, race string, gender string, ethnicity string, indication string",
    "constant_description": "variable string, comment string",
}
NEEDED = ("events", "constant", "constant_description")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern names, sorted."""
    where, files = _file_system(spark, pattern)
    return sorted(s.getPath().toString() for s in files.globStatus(where) or ())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def discover_cohorts(spark: SparkSession, base: str) -> dict[str, dict[str, str]]:
    """The files of each cohort that has an events file in the folder; parts that are not there are left out."""
    found = {p.rstrip("/").rsplit("/", 1)[1]: p for p in listed(spark, f"{base}/*")}
    cohorts = [n.removesuffix(PARTS["events"]) for n in found if n.endswith(PARTS["events"])]
    return {c: {part: found[c + end] for part, end in PARTS.items() if c + end in found} for c in cohorts}


def without_unnamed(df: DataFrame) -> DataFrame:
    """df without the index columns that other tools leave (empty names, _c0, "Unnamed: 0")."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not (c.startswith(("Unnamed", "_c")) or not c.strip())))


def typed(df: DataFrame, schema: str) -> DataFrame:
    """df with the schema's columns cast to its types, missing ones null, and further columns behind them."""
    fields = StructType.fromDDL(schema).fields
    own = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    return df.select(*own, *(F.col(f"`{c}`") for c in df.columns if c not in {f.name for f in fields}))


def csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, record, text): the records of CSV files, numbered from 0 in each file, whichever tasks read them.

    Files are read in splits of lines. A first pass counts lines and quotes of every split. In a split without quotes that begins outside of them each line is a
    record, whose number is its place in the split behind the records ahead of it; these lines stay where they are read. Only the lines of other splits are
    ordered: a pass over them tells how many records each begins, whether it begins inside quotes or not, and another which lines begin a record and which go on with one. Only
    the lines of records that have several are moved to meet. Quotes stand around fields and are doubled inside them; a file with an odd number of them fails.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("quotes", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long"))
    own = Window.partitionBy("file", "split").orderBy("at")
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_file = Window.partitionBy("file").orderBy("split")  # a row for each split
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("sum"), F.count("*").alias("n"), F.min("at").alias("start"))
    splits = splits.withColumn("carry", ahead("sum", of_file)).withColumn("all", F.sum("sum").over(Window.partitionBy("file")))
    splits = splits.withColumn("plain", (F.col("sum") == 0) & (F.pmod("carry", F.lit(2)) == 0))
    quoted = F.broadcast(splits.where("not plain").select("file", "split", "carry"))  # a row a split
    inside = lines.join(quoted, ["file", "split"]).withColumn("inside", F.col("carry") + ahead("quotes", own))
    begins = inside.groupBy("file", "split").agg(F.count_if(F.pmod("inside", F.lit(2)) == 0).alias("begins"))
    numbers = splits.join(begins, ["file", "split"], "left").withColumn("begun", ahead(F.when(F.col("plain"), F.col("n")).otherwise(F.col("begins")), of_file))
    whole = F.when(F.pmod("all", F.lit(2)) == 0, F.col("begun")).otherwise(F.raise_error(F.concat(F.lit("unbalanced quotes in "), "file")))
    numbers = numbers.select("file", "split", "plain", "start", whole.cast("long").alias("begun"))

    known = lines.join(F.broadcast(numbers), ["file", "split"], "left").where(F.coalesce("plain", F.raise_error(F.lit("files are split otherwise than before")).cast("boolean")))
    plain = known.select("file", (F.col("begun") + F.col("at") - F.col("start")).alias("record"), F.col("value").alias("text"))
    rows = inside.join(F.broadcast(numbers.where("not plain").drop("plain", "start")), ["file", "split"])
    rows = rows.withColumn("first", F.pmod("inside", F.lit(2)) == 0).withColumn("last", F.pmod(F.col("inside") + F.col("quotes"), F.lit(2)) == 0)
    rows = rows.withColumn("record", F.col("begun") + F.sum(F.col("first").cast("long")).over(own) - 1)
    single = rows.where("first and last").select("file", "record", F.col("value").alias("text"))
    several = rows.where("not (first and last)").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"]), "\n").alias("text"))
    return plain.unionByName(single).unionByName(several).withColumn("text", F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))


def _first_record(spark: SparkSession, file: str) -> str:
    """The header of a file whose name is a URI, read from its beginning alone; empty for an empty file."""
    java = spark.sparkContext._jvm.java
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(java.net.URI(file))
    reader = java.io.BufferedReader(java.io.InputStreamReader(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where), "UTF-8"))
    text = reader.readLine() or ""
    while text.count('"') % 2 and (more := reader.readLine()) is not None:
        text += "\n" + more
    reader.close()
    return text


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None, dates: Iterable[str] = ()) -> DataFrame:
    """CSV files with headers, quoted line breaks and all, a large file by many tasks; columns are texts but for the schema's and the dates.

    Files of different headers are united by name. Blank lines are left out. Quotes are as csv_records says.
    """
    records = csv_records(spark, paths)
    heads: dict[str, list[str]] = {}
    for file in spark.read.text(paths).inputFiles():
        heads.setdefault(_first_record(spark, file).removeprefix("\ufeff"), []).append(re.sub(":/+", ":/", file))
    out = None
    for head, files_ in heads.items():
        names = [n.strip() or f"_c{k}" for k, n in enumerate(next(csv.reader(io.StringIO(head))))]
        fields = StructType([StructField(f"f{k}", StringType()) for k in range(len(names))])
        body = records.where((F.col("record") > 0) & (F.trim("text") != ""))
        body = body.where(F.regexp_replace("file", ":/+", ":/").isin(*files_)) if len(heads) > 1 else body
        parsed = body.select(F.from_csv("text", fields.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"', "maxCharsPerColumn": "-1"}).alias("x"))
        part = without_unnamed(parsed.select(*(F.col(f"x.f{k}").alias(n) for k, n in enumerate(names))))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    df = out if out is not None else spark.createDataFrame([], schema or "_c0 string")
    df = typed(df, schema) if schema else df
    return df.withColumns({c: F.to_date(c) for c in dates}) if dates else df


def load_cohort(spark: SparkSession, files: dict[str, str], indication: str | None = None) -> dict[str, DataFrame]:
    """The cohort's tables by part, typed; indication, if given, becomes a column of events, molecular and constant.

    Files of a data set of one's own may be given, too: events, constant and constant_description must be there, a missing molecular
    table is empty.
    """
    if missing := [p for p in NEEDED if p not in files]:
        raise ValueError(f"tables are missing: {missing}")
    tables = {part: read_csv(spark, path, SPEC.get(part)) for part, path in files.items()}
    tables.setdefault("molecular", spark.createDataFrame([], SPEC["molecular"]))
    if indication is not None:
        for part in ("events", "molecular", "constant"):
            tables[part] = tables[part].withColumn("indication", F.lit(indication))
    return tables


def load_cohorts(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """All cohorts of a folder, their tables united by part; columns that a cohort lacks are null."""
    out: dict[str, DataFrame] = {}
    for cohort, files in discover_cohorts(spark, base).items():
        for part, df in load_cohort(spark, files, cohort).items():
            df = df if "indication" in df.columns else df.withColumn("indication", F.lit(cohort))
            out[part] = out[part].unionByName(df, allowMissingColumns=True) if part in out else df
    return out


def read_json_lines(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All .jsonl files of a folder and the folders below."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    return (reader.schema(schema) if schema else reader).json(folder)


def _npy_header(spark: SparkSession, path: str) -> tuple[int, str, tuple[int, ...]]:
    """(where the rows begin, type, shape) of an array file, from its first bytes alone."""
    where, store = _file_system(spark, path)
    stream, jvm = store.open(where), spark.sparkContext._jvm
    take = lambda n: bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
    magic = take(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError(f"{path} is no array file")
    wide = 2 if magic[6] == 1 else 4
    size = int.from_bytes(take(wide), "little")
    head = ast.literal_eval(take(size).decode("latin-1"))
    stream.close()
    if head["fortran_order"] or not isinstance(head["descr"], str):
        raise ValueError(f"{path} does not hold its rows one after the other")
    return 8 + wide + size, head["descr"], head["shape"]


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, values array<double>, text) of a .npy file, row by row: values of a table of numbers, text of a list of texts or numbers.

    The header tells where rows begin and how long they are. The file is read as records whose length divides both, in splits as Spark makes them, so tasks
    hold pieces of it alone; a row that two splits share is put together from its two ends.
    """
    offset, kind, shape = _npy_header(spark, path)
    flat = len(shape) == 1
    row = np.dtype(kind).itemsize * math.prod(shape[1:])
    record, piece = math.gcd(offset, row), 1 << 20
    options = {"fixedlengthinputformat.record.length": str(record), "mapreduce.input.fileinputformat.split.maxsize": str(max(record, int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))))}
    held = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=options)

    def decoded(number: int, raw: bytes) -> tuple:
        x = np.frombuffer(raw, kind)
        return (number, None, None, None, str(x[0].decode() if x.dtype.kind == "S" else x[0])) if flat else (number, None, None, x.astype(float).tolist(), None)

    def cut(records: Iterable[tuple[int, bytes]]) -> Iterable[tuple]:
        start, buffer = 0, bytearray()

        def rows(last: bool) -> Iterable[tuple]:
            """Whole rows of the buffer; at the end what is left of one, and at the beginning what another split has begun."""
            nonlocal start, buffer
            at = start - offset
            if at % row and buffer:
                head = min(len(buffer), row - at % row)
                if head < row - at % row and not last:
                    return
                yield at // row, at % row, bytes(buffer[:head]), None, None
                start, buffer = start + head, buffer[head:]
            n = len(buffer) // row
            for k in range(n):
                yield decoded((start - offset) // row + k, bytes(buffer[k * row : (k + 1) * row]))
            start, buffer = start + n * row, buffer[n * row :]
            if last and buffer:
                yield (start - offset) // row, 0, bytes(buffer), None, None

        for position, raw in records:
            if position < offset:
                continue
            if not buffer or position != start + len(buffer):
                yield from rows(True)
                start, buffer = position, bytearray()
            buffer += raw
            if len(buffer) >= piece:
                yield from rows(False)
        yield from rows(True)

    out = spark.createDataFrame(held.mapPartitions(cut), "row long, at long, raw binary, values array<double>, text string")

    def joined(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for part in parts:
            whole = [decoded(number, b"".join(x["raw"] for x in ends)) for number, ends in zip(part["row"], part["ends"], strict=True)]
            yield pd.DataFrame({"row": [x[0] for x in whole], "values": [x[3] for x in whole], "text": [x[4] for x in whole]})

    ends = out.where("raw is not null").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("ends"))
    return out.where("raw is null").select("row", "values", "text").unionByName(ends.mapInPandas(joined, "row long, values array<double>, text string"))


def read_representations(spark: SparkSession, path: str, ids: str | None = None) -> DataFrame:
    """(patientid, values array<double>): of a .npy table and the .npy list of its ids, by rows; of CSV with an id and number columns; or of .npz files with the arrays ids and values, each whole in one task."""
    if path.endswith(".npy"):
        return read_npy(spark, path).select("row", "values").join(read_npy(spark, ids).select("row", F.col("text").alias("patientid")), "row").select("patientid", "values")
    if not path.endswith(".npz"):
        df = read_csv(spark, path)
        first, *rest = df.columns
        return df.select(F.col(f"`{first}`").alias("patientid"), F.array(*(F.col(f"`{c}`").cast("double") for c in rest)).alias("values"))

    def unpack(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    yield pd.DataFrame({"patientid": held["ids"].astype(str), "values": list(held["values"].astype(float))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "patientid string, values array<double>")


def read_split_map(spark: SparkSession, path: str) -> DataFrame:
    """(patientid, data_split) of a JSON object of both, or of a folder of files with one such object a line, as write_split_map leaves them."""
    where, store = _file_system(spark, path)
    text = spark.read.text(path, wholetext=not store.getFileStatus(where).isDirectory())
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("patientid", "data_split"))


def write_split_map(splits: DataFrame, path: str) -> None:
    """The (patientid, data_split) rows as JSON objects, a line each, in a folder of any size; read_split_map reads them."""
    splits.select(F.to_json(F.create_map("patientid", "data_split")).alias("value")).write.mode("overwrite").text(path)


def nested_json(rows: DataFrame, key: tuple[str, ...], name: str, order: Column | str | None = None) -> DataFrame:
    """(key, name): the other columns of a key's rows as a JSON list of objects, dates and numbers as JSON has them."""
    cells = F.struct(*(c for c in rows.columns if c not in key))
    return rows.groupBy(*key).agg(F.to_json(F.array_sort(F.collect_list(cells))).alias(name))


def write_samples(samples: DataFrame, path: str, meta: Iterable[str] = (), by: tuple[str, ...] = ("indication", "data_split"), batch: str = "all", resume: bool = False) -> None:
    """JSON lines of instruction, answer and meta (an object of the columns named), packed by gzip, in folders of the batch, cohort and split.

    A batch is written in full and then put into the manifest by one rename, with the rows of each of its cohorts and splits; readers see only what the manifest
    lists. So a batch that was broken off, by a lost driver too, does not count and its folder is replaced by the next attempt. With resume,
    a batch of the manifest is left alone, and of a new one the cohorts and splits that any earlier batch has are; without, the batch
    replaces all others of the path.
    """
    spark = samples.sparkSession
    known = _manifest(spark, path) if resume else {}
    if batch in known:
        return
    rows = samples.select("instruction", "answer", F.struct(*meta).alias("meta"), *by) if meta else samples
    done = sorted({tuple(part[c] for c in by) for parts in known.values() for part in parts}, key=str)  # cohorts times splits
    if done:
        seen = spark.createDataFrame(done, ", ".join(f"{c} string" for c in by))
        rows = rows.join(F.broadcast(seen), list(by), "left_anti").select(*rows.columns)
    target = f"{path}/batch={batch}"
    rows.write.mode("overwrite").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").partitionBy(*by).json(target)
    lines = StructType([StructField("value", StringType()), *(rows.schema[c] for c in by)])  # one a row, counted as they lie there
    counts = spark.read.schema(lines).text(target).groupBy(*by).agg(F.count("*").alias("rows")) if listed(spark, f"{target}/{by[0]}=*") else None
    parts = [r.asDict() for r in counts.collect()] if counts is not None else []
    if not resume:
        for other in _manifest(spark, path):
            if other != batch:
                _delete(spark, f"{path}/_manifest/{other}.json")
                _delete(spark, f"{path}/batch={other}")
    _put(spark, f"{path}/_manifest/{batch}.json", json.dumps(parts, default=str))


def _manifest(spark: SparkSession, path: str) -> dict[str, list[dict]]:
    """Of each finished batch the cohorts and splits with their rows."""
    found = listed(spark, f"{path}/_manifest/*.json")
    texts = {r.file: r.value for r in spark.read.text(found, wholetext=True).select("value", F.col("_metadata.file_name").alias("file")).collect()} if found else {}
    return {name.removesuffix(".json"): json.loads(text) for name, text in texts.items()}


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there in full or not at all."""
    part, store = _file_system(spark, f"{path}.part")
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    final = _file_system(spark, path)[0]
    store.delete(final, False)
    if not store.rename(part, final):
        raise OSError(f"{path} could not be put in place")


def _delete(spark: SparkSession, path: str) -> None:
    where, store = _file_system(spark, path)
    store.delete(where, True)


def read_samples(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The samples of the batches that the manifest lists, with the columns of their folders."""
    folders = [f"{path}/batch={b}" for b, parts in _manifest(spark, path).items() if parts]
    if not folders:
        raise FileNotFoundError(f"no finished batch in {path}")
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).json(folders)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(batch, part, rows): the manifest; part is a JSON object of the cohort and split."""
    rows = [(b, json.dumps({k: v for k, v in p.items() if k != "rows"}, sort_keys=True), p["rows"]) for b, parts in _manifest(spark, path).items() for p in parts]
    return spark.createDataFrame(rows, "batch string, part string, rows long")


def write_csv(df: DataFrame, path: str, by: tuple[str, ...] = (), overwrite: bool = True) -> None:
    """CSV with headers, one folder for each value of by (cohort and split, or patient); arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    writer = df.select(*flat).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_trajectories(rows: DataFrame, path: str, key: str = "patientid", copy: str = "copy") -> None:
    """Rows of each patient and copy, with the id {patientid}_traj_{copy}."""
    named = rows.withColumn("trajectory", F.concat_ws("_", key, F.lit("traj"), F.col(copy).cast("string"))).drop(copy)
    write_csv(named, path)

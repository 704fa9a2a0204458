"""Tables kept as files of disjoint key ranges, so that a small change rewrites few files.

A generation is a manifest: one row for each Parquet file with its smallest key and its number of rows. A new
generation names the files it keeps and those it wrote; no stored file is changed, so readers of an older
generation are undisturbed and an attempt that breaks off leaves nothing visible.

A file holds the keys from its smallest one up to that of the next file, the first file also those before. So
every key, stored or new, belongs to exactly one file. Changed rows are dealt to their files by bisection in the
list of smallest keys (one entry for each file, which the driver of a read holds anyway). Files that are hit are
read, changed and written again, in stretches of neighbouring files, and the ranges stay disjoint.

Keys are whole numbers, dates, timestamps or strings, in any number, and never null. They compare by a text with
the order of the key tuple.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.snapshots import sync_table
from ..session import staged
from .publish import current_generation, publish_generation

FILE_ROWS = 1_000_000
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def range_key(schema: T.StructType, keys: list[str]) -> Column:
    """A text that orders rows as the tuple of their keys does."""

    def part(name: str) -> Column:
        kind = schema[name].dataType
        value = F.col(f"`{name}`")
        if isinstance(kind, T.StringType):
            # a byte 0 ends the text; within it, 0 and 1 are written with a 1 in front
            return F.concat(F.regexp_replace(value, "([\x00\x01])", "\x01$1"), F.lit("\x00"))
        if isinstance(kind, T.DateType):
            value = F.unix_date(value)
        elif isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)
        elif not isinstance(kind, _WHOLE):
            raise TypeError(f"{name}: no key of type {kind.simpleString()}")
        return F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")

    return F.concat(*map(part, keys))


@dataclass(frozen=True)
class DataFile:
    path: str
    low: str
    rows: int


def _files(spark: SparkSession, generation: str) -> list[DataFile]:
    rows = spark.read.parquet(f"{generation}/files").collect()
    return sorted((DataFile(r.path, r.low, r.rows) for r in rows), key=lambda f: f.low)


def _dealt(rows: DataFrame, keys: list[str], files: list[DataFile]) -> DataFrame:
    """The rows with ``_file``, the number of the file that their key belongs to, written once."""
    lows = [f.low for f in files[1:]]  # all keys before the second file's belong to the first
    schema = T.StructType([*rows.schema.fields, T.StructField("_file", T.IntegerType())])
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(lows, k) for k in batch.column("_key").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(at, pa.int32())], [*columns, "_file"])

    return staged(rows.withColumn("_key", range_key(rows.schema, keys)).mapInArrow(run, schema), "dealt")


def _written(rows: DataFrame, keys: list[str], root: str, file_rows: int) -> list[DataFile]:
    """Write rows (with ``_run``, the stretch of files they belong to) as files of disjoint ranges."""
    spark = rows.sparkSession
    folder = f"{root}/data/{uuid.uuid4().hex}"
    key = range_key(rows.schema, keys)
    ordered = rows.withColumn("_key", key).repartitionByRange("_run", "_key").sortWithinPartitions("_run", "_key")
    ordered.drop("_key").write.option("maxRecordsPerFile", file_rows).partitionBy("_run").parquet(folder)
    stored = spark.read.schema(rows.schema).parquet(folder).select(F.col("_metadata.file_path").alias("path"), key.alias("key"))
    found = stored.groupBy("path").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("rows")).collect()  # a row for each file
    return [DataFile(r.path, r.low, r.rows) for r in found]


def _publish(spark: SparkSession, root: str, generation: str, files: list[DataFile], schema: T.StructType) -> str:
    manifest = spark.createDataFrame([(f.path, f.low, f.rows) for f in files], "path string, low string, rows long")
    empty = spark.createDataFrame([], schema)  # keeps the schema of a table without files
    return publish_generation({"files": manifest, "schema": empty}, root, generation)


def create(rows: DataFrame, keys: list[str], root: str, generation: str, file_rows: int = FILE_ROWS) -> str:
    """The first generation of a table: its rows in files by key range."""
    files = _written(rows.withColumn("_run", F.lit(0)), keys, root, file_rows)
    return _publish(rows.sparkSession, root, generation, files, rows.schema)


def _read(spark: SparkSession, generation: str, files: list[DataFile]) -> DataFrame:
    schema = spark.read.parquet(f"{generation}/schema").schema
    paths = [f.path for f in files]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _current(spark: SparkSession, root: str) -> str:
    generation = current_generation(spark, root)
    if generation is None:
        raise FileNotFoundError(f"nothing published below {root}")
    return generation


def read(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the newest generation."""
    generation = _current(spark, root)
    return _read(spark, generation, _files(spark, generation))


@dataclass(frozen=True)
class Change:
    """What a new generation did: files it kept and wrote, rows it read and wrote."""

    generation: str
    kept: int
    rewritten: int
    written: int
    rows_read: int


def _checked(delta: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    if sorted(delta.columns) != sorted(stored.columns):
        raise ValueError("schema mismatch while publishing")
    delta = staged(delta.select(*[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]), "delta")
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    if not delta.where(missing).isEmpty():
        raise ValueError("a key is null")
    if not delta.groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
        raise ValueError("a key comes twice in one change")
    return delta


def _stretches(hit: list[int]) -> dict[int, int]:
    """For each hit file the number of its stretch of neighbouring hit files."""
    out: dict[int, int] = {}
    for k in sorted(hit):
        out[k] = out[k - 1] if k - 1 in out else k
    return out


def upsert(delta: DataFrame, keys: list[str], root: str, generation: str, file_rows: int = FILE_ROWS) -> Change:
    """A new generation with the rows of ``delta`` inserted, or in place of those with their keys.

    Only files to whose key range a row of ``delta`` belongs are read and written.
    """
    spark = delta.sparkSession
    before = _current(spark, root)
    files = _files(spark, before)
    delta = _checked(delta, _read(spark, before, []), keys)
    dealt = _dealt(delta, keys, files)
    hit = [r["_file"] for r in dealt.select("_file").distinct().collect()]  # files at most
    if not hit:
        _publish(spark, root, generation, files, delta.schema)
        return Change(generation, len(files), 0, 0, 0)
    run = _stretches(hit)
    own = [files[k] for k in hit] if files else []
    # one row for each file that is hit; the driver of a read holds all of them
    runs = F.broadcast(spark.createDataFrame([(k, r, files[k].path if files else "") for k, r in run.items()], "_file int, _run int, _path string"))
    old = _read(spark, before, own)
    old = (old.withColumn("_path", F.col("_metadata.file_path")) if own else old.withColumn("_path", F.lit(""))).join(runs, "_path")
    kept = old.join(delta.select(*keys), keys, "left_anti").select(*delta.columns, "_run")
    new = _written(kept.unionByName(dealt.join(runs, "_file").select(*delta.columns, "_run")), keys, root, file_rows)
    unhit = [f for k, f in enumerate(files) if k not in run]
    _publish(spark, root, generation, [*unhit, *new], delta.schema)
    return Change(generation, len(unhit), len(own), len(new), sum(f.rows for f in own))


def compare(source: DataFrame, keys: list[str], root: str) -> DataFrame:
    """(keys, outcome) of each source row against the newest generation: insert, validated or mismatch.

    Reads only files to whose key range a source row belongs.
    """
    spark = source.sparkSession
    before = _current(spark, root)
    files = _files(spark, before)
    source = _checked(source, _read(spark, before, []), keys)
    hit = [r["_file"] for r in _dealt(source, keys, files).select("_file").distinct().collect()]
    return sync_table(source, _read(spark, before, [files[k] for k in hit] if files else []), keys)


def sync(source: DataFrame, keys: list[str], root: str, generation: str, file_rows: int = FILE_ROWS) -> Change:
    """A new generation with the source's rows that the table lacks; a stored row that differs is an error, nothing is published then.

    Rows that only the table has stay.
    """
    source = staged(source, "source")
    outcomes = staged(compare(source, keys, root), "outcomes")
    different = outcomes.where("outcome = 'mismatch'").select(*keys).first()
    if different is not None:
        raise ValueError("immutable row differs: " + " ".join(str(different[k]) for k in keys))
    missing = source.join(outcomes.where("outcome = 'insert'").select(*keys), keys, "left_semi").select(*source.columns)
    return upsert(missing, keys, root, generation, file_rows)

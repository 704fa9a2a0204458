"""Sizes and SHA-256 digests of files of any size.

The listing is Spark's (``binaryFile`` without its content column reads no file). A file of at most ``WHOLE`` bytes is
hashed as one value. A larger one is read by its task in ranges of ``RANGE`` bytes with a running digest, so memory
does not follow its size and the 2 GiB limit of a value does not apply. Each large file is a task of its own.
Spark's listing leaves out files without bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = 64 << 20
RANGE = 8 << 20


def _placed(path: str) -> tuple[fs.FileSystem, str]:
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), re.sub(r"\A/+", "/", local.group(1))
    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def opened(path: str) -> pa.NativeFile:
    """A file of any file system that pyarrow knows, for reading."""
    system, place = _placed(path)
    return system.open_input_stream(place)


def write_files(rows: DataFrame, folder: str) -> None:
    """Write each row (name, body) of text as a file of its own below a folder, from the tasks that hold the rows.

    Many small files in one folder are listed at once, and no task renames or commits them one by one. A task that runs
    again writes the same files; whoever needs all or nothing adds a marker afterwards.
    """
    _placed(folder)[0].create_dir(_placed(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _placed(folder)
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                with system.open_output_stream(f"{place}/{name.as_py()}") as out:
                    out.write(body.as_py().encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    rows.select(F.col("name").cast("string"), "body").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def streamed_digest(path: str, size: int = RANGE) -> tuple[int, str]:
    """(bytes, SHA-256) of a file that is read in ranges."""
    total, digest = 0, hashlib.sha256()
    with opened(path) as stream:
        while part := stream.read(size):
            digest.update(part)
            total += len(part)
    return total, digest.hexdigest()


def file_digests(spark: SparkSession, pattern: str | list[str], whole: int = WHOLE, size: int = RANGE, only: str = "") -> DataFrame:
    """(path, size, sha256) of the files that match a pattern of paths, folders taken with all below them.

    ``only`` is a regular expression that the path of a file must hold; others are left out before a file is opened.
    A folder of many files is listed at once, a pattern that matches each of them is one listing for each.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).where(F.col("_metadata.file_path").rlike(only))
    small = found.where(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                n, digest = streamed_digest(path, size)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([digest])], ["path", "size", "sha256"])

    large = found.where(F.col("length") > whole).select("path").mapInArrow(run, "path string, size long, sha256 string")
    return small.unionByName(large)


def ordered_digest(parts: DataFrame, by: str, value: str) -> DataFrame:
    """(digest, first, parts) of one row: SHA-256 of the values in the order of ``by``, joined by line ends.

    The values pass one task in order with a running digest; none of them is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n, first = hashlib.sha256(), 0, None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = key if n == 0 else first
                digest.update((("\n" if n else "") + (text or "")).encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([first], pa.string()), pa.array([n])], ["digest", "first", "parts"])

    rows = parts.select(F.col(by).cast("string").alias("by"), F.col(value).alias("value"))
    found = rows.repartition(1).sortWithinPartitions("by").mapInArrow(run, "digest string, first string, parts long")
    nothing = hashlib.sha256().hexdigest()  # without values no task may run at all
    return found.agg(F.coalesce(F.max("digest"), F.lit(nothing)).alias("digest"), F.max("first").alias("first"), F.coalesce(F.max("parts"), F.lit(0)).alias("parts"))

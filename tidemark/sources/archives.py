"""Package archives as rows: one row per member of each tar.gz."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MEMBERS
from ..session import spread

# Archive limits.
MAX_FILES = 10_000
MAX_TOTAL_BYTES = 64 * 1024 * 1024
MAX_FILE_BYTES = 8 * 1024 * 1024
MAX_ARCHIVE_BYTES = 32 * 1024 * 1024
# End of fixed values.


def read_archives(spark: SparkSession, path: str, glob: str = "*.{tgz,tar.gz}", max_archive_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """``(path, length, content)``. A file over the limit keeps its row; its content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    fits = files.where(F.col("length") <= max_archive_bytes).select("path", "length", "content")
    # only the listing is read of the others: the source drops the content of columns that are not asked for
    large = files.where(F.col("length") > max_archive_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return fits.unionByName(large)


def _inflate(data: bytes, limit: int) -> bytes:
    """All gzip members, one after the other, under one limit; anything else behind a member is refused."""
    parts, total = [], 0
    while data:
        inflater = zlib.decompressobj(31)
        part = inflater.decompress(data, limit - total + 1)
        total += len(part)
        if total > limit:
            raise ValueError("archive exceeds total uncompressed size limit")
        if not inflater.eof:
            raise ValueError("truncated gzip stream")
        parts.append(part)
        data = inflater.unused_data
    return b"".join(parts)


def _unpack(data: bytes | None, max_archive: int, max_inflated: int) -> list[tuple]:
    if data is None:
        return [(None, -1, None, None, None, None, None, None, "tarball exceeds configured size limit")]
    digest = hashlib.sha256(data).hexdigest()
    try:
        if len(data) > max_archive:
            raise ValueError("tarball exceeds configured size limit")
        with tarfile.open(fileobj=io.BytesIO(_inflate(data, max_inflated)), mode="r:") as tar:
            rows = []
            for number, m in enumerate(tar):
                flag = "0" if m.type == tarfile.AREGTYPE else m.type.decode("latin-1")
                content = tar.extractfile(m).read() if m.isreg() else None
                rows.append((digest, number, m.name, flag, m.size, m.mode, m.linkname, content, None))
            return rows
    except (ValueError, tarfile.TarError, zlib.error, EOFError) as problem:
        return [(digest, -1, None, None, None, None, None, None, str(problem) or "malformed archive")]


def archive_members(
    archives: DataFrame,
    content: str = "content",
    max_archive_bytes: int = MAX_ARCHIVE_BYTES,
    max_total_bytes: int = MAX_TOTAL_BYTES,
) -> DataFrame:
    """Explode archives to members. An unreadable archive becomes one row with ``archive_error``; so does one without content.

    The unit of work is one archive, whose packed and unpacked sizes are bounded by the limits;
    the tar framing is allowed on top of the member bytes.
    """
    inflated = max_total_bytes + 8 * 1024 * 1024
    names = [field.split()[0] for field in MEMBERS.split(", ")]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame(_unpack(None if data is None else bytes(data), max_archive_bytes, inflated), columns=names)

    return spread(archives.select(F.col(content).alias("content"))).mapInPandas(unpack, MEMBERS)

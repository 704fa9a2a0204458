"""Session helpers: defaults for local runs, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidemark", cpus: str | int = "*", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    if str(cpus).isdigit():
        builder = builder.config(TASKS, str(cpus))
    # Python workers import the package from where the driver has it
    root = str(Path(__file__).resolve().parent.parent)
    known = os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local
    path would be lost with its executor, so an unset value is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = os.path.join(tempfile.gettempdir(), "tidemark-shared")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


#: Folders that ``staged`` has written, in order; whoever knows when they are done with may ``remove`` them.
STAGED: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    The written table survives the loss of any executor and is evaluated once, so a
    non-repeatable column (a partition id, say) has one value for all readers.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


TASKS = "spark.tidemark.tasks"


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out for CPU-heavy row work to as many tasks as the session names in ``spark.tidemark.tasks``.

    A caller whose input is one small file sets it (local sessions do). Unset, as on a cluster, nothing is
    shuffled: the width of a scan is that of its splits (``spark.sql.files.maxPartitionBytes``).
    """
    tasks = df.sparkSession.conf.get(TASKS, None)
    if df.isStreaming or not tasks:
        return df
    return df.repartition(int(tasks))


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows out ahead of row work in Python, which costs more than a shuffle: three tasks for each core.

    A column file of a few MB holds millions of short rows in one split, so the width of a scan says nothing of that work.
    ``spark.tidemark.tasks`` names another number.
    """
    if df.isStreaming:
        return df
    tasks = df.sparkSession.conf.get(TASKS, None) or 3 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(tasks))

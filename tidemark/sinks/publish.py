"""Writers: observation lines, canonical records, catalog tables, and published generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_parts
from ..schemas import OFFICIAL_META, READ_MODEL


def observation_line() -> Column:
    """Normalized JSON line of an observation row: fixed member order, inventory text as it is."""

    def q(name: str) -> Column:
        return F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)

    return F.concat(
        F.lit('{"observation_version":1,"observed_at":'), q("observed_at"),
        F.lit(',"target_id":'), q("target_id"),
        F.lit(',"source_type":'), q("source_type"),
        F.lit(',"sensor":{"name":'), q("sensor_name"),
        F.lit(',"version":'), q("sensor_version"),
        F.lit('},"configuration_profile":'), q("configuration_profile"),
        F.lit(',"inventory":'), F.col("inventory_json"),
        F.lit("}"),
    )


def observation_lines(observations: DataFrame) -> DataFrame:
    return observations.select(observation_line().alias("value"))


def append_observations(observations: DataFrame, path: str) -> None:
    observation_lines(observations).write.mode("append").text(path)


def write_canonical(records: DataFrame, path: str) -> None:
    """Canonical lines in global identity order: range-partitioned, sorted within partitions."""
    (
        records.select("server_identifier", "server_version", "canonical_json")
        .repartitionByRange("server_identifier", "server_version")
        .sortWithinPartitions("server_identifier", "server_version")
        .select(F.col("canonical_json").alias("value"))
        .write.mode("errorifexists")
        .text(path)
    )


def version_id() -> Column:
    """Stable id of a version: digest of its identity triple."""
    return F.sha2(F.concat_ws("\n", "server_identifier", "server_version", "canonical_sha256"), 256)


def child_id(parent: Column, kind: str, position: Column) -> Column:
    return F.sha2(F.concat_ws("\n", parent, F.lit(kind), position.cast("string")), 256)


def catalog_tables(records: DataFrame, record: str = "record") -> dict[str, DataFrame]:
    """Flat tables of nested records: versions and their positioned children."""
    r = F.col(record)
    official = r["original"]["_meta"][OFFICIAL_META]
    base = records.select(
        "canonical_json",
        r["server_identifier"].alias("server_identifier"),
        r["server_version"].alias("server_version"),
        r["canonical_sha256"].alias("canonical_sha256"),
        r.alias("r"),
        official.alias("official"),
    ).withColumn("id", version_id())
    repo = url_parts(F.col("r.repository.url"), derive_repository=True)
    packages = base.select(F.col("id").alias("server_version_id"), F.posexplode("r.packages").alias("position", "p")).withColumn(
        "id", child_id(F.col("server_version_id"), "package", F.col("position"))
    )
    remotes = base.select(F.col("id").alias("server_version_id"), F.posexplode("r.remotes").alias("position", "m"))
    parts = url_parts(F.col("m.url"))
    return {
        "server_versions": base.select(
            "id",
            "server_identifier",
            "server_version",
            F.col("r.description").alias("description"),
            F.col("official.status").alias("registry_status"),
            F.col("official.publishedAt").alias("published_at"),
            F.col("official.updatedAt").alias("updated_at"),
            "canonical_sha256",
            "canonical_json",
        ),
        "repositories": base.filter(F.col("r.repository").isNotNull())
        .withColumn("u", repo)
        .select(
            F.col("id").alias("server_version_id"),
            F.col("r.repository.source").alias("source"),
            F.col("r.repository.url").alias("url"),
            "u.scheme",
            "u.host",
            "u.owner",
            "u.repository_name",
        ),
        "packages": packages.select(
            "id",
            "server_version_id",
            "position",
            F.col("p.registryType").alias("registry_type"),
            F.col("p.identifier").alias("identifier"),
            F.col("p.version").alias("version"),
            F.col("p.transport.type").alias("transport"),
        ),
        "package_arguments": packages.select(
            F.col("id").alias("package_id"), F.posexplode("p.packageArguments").alias("position", "a")
        ).select("package_id", "position", F.col("a.value").alias("argument_value")),
        "package_environment": packages.select(
            F.col("id").alias("package_id"), F.posexplode("p.environmentVariables").alias("position", "e")
        ).select(
            "package_id",
            "position",
            F.col("e.name").alias("name"),
            F.coalesce("e.isRequired", F.lit(False)).alias("required"),
            F.col("e.description").alias("description"),
        ),
        "remotes": remotes.withColumn("u", parts).select(
            child_id(F.col("server_version_id"), "remote", F.col("position")).alias("id"),
            "server_version_id",
            "position",
            F.col("m.url").alias("url"),
            "u.scheme",
            "u.host",
            "u.port",
            F.col("m.type").alias("transport"),
        ),
    }


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace by key; differing column lists are an error.

    One aggregation by key picks the source row where there is one.
    """
    if sorted(target.columns) != sorted(source.columns):
        raise ValueError("schema mismatch while publishing")
    rest = [c for c in target.columns if c not in keys]
    if not rest:
        return target.unionByName(source).distinct()
    both = target.withColumn("_rank", F.lit(0)).unionByName(source.withColumn("_rank", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_rank").alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in target.columns])


def evidence_manifests(runs: DataFrame, bundles: DataFrame) -> DataFrame:
    """Manifest rows of every completed run whose artifact has a bundle."""
    return (
        runs.filter("status = 'completed'")
        .select(F.col("id").alias("analysis_run_id"), "artifact_sha256")
        .join(bundles, "artifact_sha256")
        .select(
            "analysis_run_id",
            F.lit("bundle").alias("storage_kind"),
            "locator",
            "bundle_sha256",
            "inventory_sha256",
            F.lit(False).alias("retained_artifact"),
        )
    )


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish_generation(tables: dict[str, DataFrame], root: str, generation: str, foldered: dict[str, str] | None = None) -> str:
    """Write tables as one generation; it becomes visible when its marker file exists.

    All tables are complete before the marker is created, so readers see all or nothing. An attempt
    that broke off is written again; a generation that is visible is refused. ``foldered`` names the
    column by whose values a table is put into folders.
    """
    spark = next(iter(tables.values())).sparkSession
    marker, fs = _path(spark, f"{root}/{generation}/_COMPLETE")
    if fs.exists(marker):
        raise FileExistsError(f"{root}/{generation} is published")
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if name in (foldered or {}):
            writer = writer.partitionBy(foldered[name])
        writer.parquet(f"{root}/{generation}/{name}")
    fs.create(marker, True).close()
    return f"{root}/{generation}"


def generations(spark: SparkSession, root: str, pattern: str = "*") -> list[str]:
    """Folders of the complete generations, in the order of their names."""
    markers, fs = _path(spark, f"{root}/{pattern}/_COMPLETE")
    return sorted(s.getPath().getParent().toString() for s in (fs.globStatus(markers) or []))


def current_generation(spark: SparkSession, root: str) -> str | None:
    """Newest complete generation (names sort in time)."""
    found = generations(spark, root)
    return found[-1] if found else None


def read_generation(spark: SparkSession, root: str, name: str) -> DataFrame:
    current = current_generation(spark, root)
    if current is None:
        raise FileNotFoundError(f"nothing published below {root}")
    return spark.read.parquet(f"{current}/{name}")


def publish_read_model(history: dict[str, DataFrame], root: str, generation: str) -> str:
    """Publish the summary tables only; detail stays in the history store."""
    return publish_generation({n: df for n, df in history.items() if n in READ_MODEL}, root, generation)


def export_details(findings: DataFrame, files: DataFrame, dependencies: DataFrame, root: str) -> None:
    """Detail rows as JSON lines below the first digest byte of their artifact.

    256 folders hold any number of artifacts; a folder per artifact would be a file per artifact.
    """
    for name, df in (("findings", findings), ("files", files), ("dependencies", dependencies)):
        placed = df.withColumn("sha_prefix", F.substring("artifact_sha256", 1, 2))
        placed.write.mode("overwrite").partitionBy("sha_prefix").json(f"{root}/{name}", ignoreNullFields=False)

"""Registry release documents: npm version documents and Python release documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, text
from ..schemas import NPM_RELEASE, PYPI_RELEASE


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def npm_releases(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Tarball URL and integrity of each npm version document.

    Needs ``expected_name`` and ``expected_version``; ``error`` is NULL for a usable document.
    """
    doc = bodies.withColumn("_doc", F.from_json(body, NPM_RELEASE))
    d = F.col("_doc")
    flat = _filled(d["dist.tarball"]).isNotNull() & _filled(d["dist.integrity"]).isNotNull()

    def either(name: str) -> Column:
        return F.when(flat, _filled(d[f"dist.{name}"])).otherwise(_filled(d["dist"][name]))

    tarball, integrity, shasum = either("tarball"), either("integrity"), either("shasum")
    error = (
        F.when(d.isNull(), "npm metadata must be an object")
        .when(_filled(d["name"]).isNull() | _filled(d["version"]).isNull(), "npm metadata missing name or version")
        .when(
            (d["name"] != F.col("expected_name")) | (d["version"] != F.col("expected_version")),
            "npm metadata identity mismatch",
        )
        .when(tarball.isNull() | integrity.isNull(), "npm metadata missing tarball or integrity")
    )
    return doc.select(
        *bodies.columns,
        d["name"].alias("name"),
        d["version"].alias("version"),
        tarball.alias("tarball_url"),
        integrity.alias("integrity"),
        shasum.alias("shasum"),
        error.alias("error"),
    )


def npm_descriptors(rows: DataFrame) -> DataFrame:
    """Descriptor of a tarball URL; the last path segment must end in ``.tgz``.

    Needs ``name, version, tarball_url, sha256, size``.
    """
    filename = F.regexp_extract("tarball_url", r"(?s)/([^/]*)\z", 1)
    error = F.when(
        ~F.endswith(filename, F.lit(".tgz")), "npm artifact URL must name a .tgz archive"
    ).otherwise(checks.descriptor_error("name", "version", filename, "tarball_url", "sha256", "size"))
    return rows.select("*", filename.alias("filename"), error.alias("error"))


def pypi_files(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per released file of each Python release document."""
    doc = bodies.withColumn("_doc", F.from_json(body, PYPI_RELEASE))
    d = F.col("_doc")
    too_many = F.coalesce(F.size(d["urls"]) > checks.MAX_RELEASE_FILES, F.lit(False))
    same = (
        text.normalize_project_name(d["info"]["name"])
        == text.normalize_project_name(F.col("expected_name"))
    ) & text.versions_equivalent(d["info"]["version"], "expected_version")
    error = (
        F.when(d["info"].isNull() | d["urls"].isNull(), "PyPI release metadata requires info and urls")
        .when(too_many, "PyPI release contains too many files")
        .when(
            _filled(d["info"]["name"]).isNull() | _filled(d["info"]["version"]).isNull(),
            "PyPI release metadata missing name or version",
        )
        .when(~F.coalesce(same, F.lit(False)), "PyPI release metadata identity mismatch")
    )
    doc = doc.withColumn("error", error)
    files = F.when(F.col("error").isNull(), d["urls"])
    return doc.select(*bodies.columns, "error", F.posexplode_outer(files).alias("position", "file")).select(
        *bodies.columns,
        "error",
        "position",
        F.col("file.filename").alias("filename"),
        F.col("file.packagetype").alias("package_type"),
        F.col("file.url").alias("url"),
        F.col("file.size").alias("size"),
        F.col("file.digests.sha256").alias("sha256"),
        F.col("file.yanked").alias("yanked"),
    )


def archive_format(package_type: Column | str, filename: Column | str) -> Column:
    """``zip`` or ``tar_gzip`` for the supported kinds of released file, else NULL."""
    kind, name = text.col(package_type), text.col(filename)
    tar = F.endswith(name, F.lit(".tar.gz")) | F.endswith(name, F.lit(".tgz"))
    return (
        F.when((kind == "bdist_wheel") & F.endswith(name, F.lit(".whl")), "zip")
        .when((kind == "sdist") & tar, "tar_gzip")
        .when((kind == "sdist") & F.endswith(name, F.lit(".zip")), "zip")
    )


def pypi_candidates(files: DataFrame, release: list[str], name: str, version: str) -> DataFrame:
    """Supported files that are not yanked, with their rank order, or one row with the ``error`` of a refused release.

    A release is refused as a whole if it has too many files, a file that is no valid artifact, a file
    twice (name and digest), or no supported file. An ``error`` that the files carry already refuses it too.
    Its verdict folds to a few counts.
    """
    given = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    files = files.withColumn("_given", given).drop("error")
    kept = files.withColumn("archive_format", archive_format("package_type", "filename"))
    usable = ~F.coalesce("yanked", F.lit(False)) & F.col("archive_format").isNotNull()
    problem = checks.descriptor_error(text.normalize_project_name(F.col(name)), version, "filename", "url", "sha256", "size")
    kept = kept.withColumn("_usable", usable).withColumn("_problem", F.when(usable, problem))
    same = kept.groupBy(*release, "filename", "sha256").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("_usable").alias("_n"), F.min("_problem").alias("_problem"), F.min("_given").alias("_given")
    )
    verdict = same.groupBy(*release).agg(
        F.sum("_all").alias("_all"), F.sum("_n").alias("_usable"), F.max("_n").alias("_most"), F.min("_problem").alias("_problem"), F.min("_given").alias("_given")
    )
    error = (
        F.when(F.col("_given").isNotNull(), F.col("_given"))
        .when(F.col("_all") > checks.MAX_RELEASE_FILES, "PyPI release contains too many files")
        .when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when(F.col("_most") > 1, "duplicate PyPI release artifact identity")
        .when(F.col("_usable") == 0, "PyPI release has no supported non-yanked wheel or source distribution")
    )
    verdict = verdict.select(*release, error.alias("error"))
    order = F.when(F.col("archive_format") == "tar_gzip", 0).otherwise(1)
    good = kept.where("_usable").drop("_usable", "_problem", "_given").withColumn("format_order", order)
    good = good.join(verdict.where("error IS NULL"), release)
    return good.unionByName(verdict.where("error IS NOT NULL"), allowMissingColumns=True)


def select_sdist(files: DataFrame, release: list[str], name: str, version: str) -> DataFrame:
    """The one tar.gz source distribution of each release, or why there is none.

    Grouping folds a release to counts and one value of each column, whatever its number of files; where there is
    one file these are its own, and a column that is not asked for is not shuffled.
    """
    usable = (~F.col("yanked")) & (archive_format("package_type", "filename") == "tar_gzip") & (
        F.col("package_type") == "sdist"
    )
    normalized = text.normalize_project_name(F.col(name))
    problem = checks.descriptor_error(normalized, version, "filename", "url", "sha256", "size")
    picked = F.coalesce(usable, F.lit(False))
    return (
        files.groupBy(*release)
        .agg(
            F.count_if(picked).alias("_n"),
            *[F.min(F.when(picked, F.col(c))).alias(f"_{c}") for c in ("filename", "sha256", "size")],
            F.min(F.when(picked, problem)).alias("_problem"),
        )
        .select(
            *release,
            F.when(F.col("_problem").isNotNull(), F.col("_problem"))
            .when(
                F.col("_n") > 1,
                "PyPI release has multiple supported non-yanked tar-gzip source distributions",
            )
            .when(
                F.col("_n") == 0,
                "PyPI release has no supported non-yanked tar-gzip source distribution",
            )
            .alias("error"),
            F.when(F.col("_n") == 1, F.col("_filename")).alias("filename"),
            F.when(F.col("_n") == 1, F.col("_sha256")).alias("sha256"),
            F.when(F.col("_n") == 1, F.col("_size")).alias("size"),
        )
    )

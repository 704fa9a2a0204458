"""Archive analysis: safety, file inventory, manifests, dependencies, findings, run records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.checks import CONFIDENCES, DISPOSITIONS, SEVERITIES
from ..schemas import PACKAGE_MANIFEST
from ..sources import archives
from ..sources.rules import RuleSet
from .detectors import SCANNED_TYPES, line_findings, numbered_lines

# Extension groups in order of precedence, then leading bytes.
EXTENSIONS_FIRST = (
    ("javascript", (".js", ".mjs", ".cjs")),
    ("typescript_declaration", None),
    ("typescript", (".ts",)),
    ("python", (".py", ".pyi")),
    ("source_map", (".map",)),
    ("shell_script", (".sh", ".bash")),
    ("powershell_script", (".ps1", ".psm1")),
    ("native_node_module", (".node",)),
    ("shared_library", (".so", ".dylib", ".dll")),
    ("wasm", (".wasm",)),
    ("nested_archive", (".tgz", ".tar", ".gz", ".zip", ".jar", ".war")),
)
MAGIC = (
    ("elf", ("7F454C46",)),
    ("pe", ("4D5A",)),
    ("mach_o", ("FEEDFACE", "FEEDFACF", "CFFAEDFE", "CAFEBABE")),
    ("wasm", ("0061736D",)),
)
EXTENSIONS_LAST = (("json", ".json"), ("markdown", ".md"), ("text", ".txt"))
DECLARATION_SUFFIX = ".d.ts"
REGULAR = ("0", "\x00")
LINKS = ("1", "2")
DEVICES = ("3", "4", "6")
DEPENDENCY_MAPS = (
    ("dependencies", "runtime", False),
    ("devDependencies", "development", True),
    ("peerDependencies", "peer", False),
    ("optionalDependencies", "optional", False),
)
MAX_SOURCE_BYTES = 128 * 1024
# End of fixed values.

FINDING_COLUMNS = [
    "artifact_sha256",
    "rule_id",
    "category",
    "severity",
    "confidence",
    "disposition",
    "subject_path",
    "line_number",
    "symbol",
    "title",
    "evidence",
    "explanation",
]


def _has_parent_segment(path: Column) -> Column:
    return path.rlike(r"(^|/)\.\.(/|$)")


def member_problem() -> Column:
    """Why a member makes its archive unacceptable; NULL for a safe member."""
    raw = F.translate(F.col("path"), "\\", "/")
    link = F.translate(F.col("linkname"), "\\", "/")
    absolute = r"\A(/|[A-Za-z]:)"
    parent = F.regexp_extract(text.normalize_archive_path(raw), r"(?s)\A(.*)/[^/]*\z", 1)
    resolved = F.when(parent == "", link).otherwise(F.concat(parent, F.lit("/"), link))
    escapes = (link == "") | link.rlike(absolute) | _has_parent_segment(link) | _has_parent_segment(resolved)
    return (
        F.when(F.col("archive_error").isNotNull(), F.col("archive_error"))
        .when(raw.rlike(absolute), "archive contains absolute path entry")
        .when(text.normalize_archive_path(raw) == "", "malformed archive entry with empty path")
        .when(_has_parent_segment(raw), "archive contains parent-traversal path entry")
        .when(F.col("typeflag").isin(*DEVICES), "archive contains device or fifo entry")
        .when(F.col("typeflag").isin(*LINKS) & escapes, "archive link target escapes package root")
    )


def archive_verdicts(
    members: DataFrame,
    max_files: int = archives.MAX_FILES,
    max_file_bytes: int = archives.MAX_FILE_BYTES,
    max_total_bytes: int = archives.MAX_TOTAL_BYTES,
) -> DataFrame:
    """Per archive: member count, largest and total size, and the reason to reject it, if any.

    One bad member rejects the archive; the earliest one gives the reason.
    """
    regular = F.col("typeflag").isin(*REGULAR)
    problem = member_problem()
    folded = members.groupBy("artifact_sha256").agg(
        F.count(F.col("path")).alias("files"),
        F.coalesce(F.max("size"), F.lit(0).cast("bigint")).alias("largest"),
        F.coalesce(F.sum(F.when(regular, F.col("size"))), F.lit(0).cast("bigint")).alias("total_bytes"),
        F.min_by(F.when(problem.isNotNull(), problem), F.when(problem.isNotNull(), F.col("member_index"))).alias("problem"),
    )
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("files") > max_files, "archive file count exceeds configured limit")
        .when(F.col("largest") > max_file_bytes, "archive entry exceeds individual file size limit")
        .when(F.col("total_bytes") > max_total_bytes, "archive exceeds total uncompressed size limit")
    )
    return folded.select("artifact_sha256", "files", "largest", "total_bytes", reason.alias("rejected"))


def safe_members(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Members of accepted archives, paths in normal form."""
    bad = verdicts.filter(F.col("rejected").isNotNull())
    kept = members.join(bad.select("artifact_sha256"), "artifact_sha256", "left_anti")
    return kept.withColumn("path", text.normalize_archive_path("path"))


def file_type(path: Column | str, content: Column | str) -> Column:
    """Type by extension, then by leading bytes, then by the document extensions."""
    p, c = text.col(path), text.col(content)
    ext = text.file_extension(p)
    out = None
    for kind, extensions in EXTENSIONS_FIRST:
        test = F.endswith(p, F.lit(DECLARATION_SUFFIX)) if extensions is None else ext.isin(*extensions)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    head = F.hex(F.substring(c, 1, 4))
    long_enough = F.octet_length(c) >= 4
    for kind, prefixes in MAGIC:
        starts = reduce(lambda a, b: a | b, [F.startswith(head, F.lit(x)) for x in prefixes])
        out = out.when(long_enough & starts, kind)
    for kind, extension in EXTENSIONS_LAST:
        out = out.when(ext == extension, kind)
    return out.otherwise("other")


def file_inventory(members: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per regular member: type, size, digest and flags. No shuffle."""
    native = [t for r in rules.file_types if r["marks_native"] for t in r["file_types"]]
    rows = members.filter(F.col("typeflag").isin(*REGULAR)).withColumn("file_type", file_type("path", "content"))
    minified = F.col("file_type").isin("javascript", "typescript") & text.looks_minified(
        F.col("content").cast("string")
    )
    generated = (F.col("file_type") == "source_map") | F.contains(F.col("path"), F.lit("/dist/"))
    return rows.select(
        "artifact_sha256",
        F.col("path").alias("archive_path"),
        "file_type",
        F.col("size").alias("byte_size"),
        F.sha2("content", 256).alias("sha256"),
        (F.coalesce(F.col("mode"), F.lit(0)).bitwiseAND(0o111) != 0).alias("executable"),
        F.col("file_type").isin(*native).alias("native_binary"),
        generated.alias("generated"),
        minified.alias("minified"),
    )


def _finding(df: DataFrame, **values: Column) -> DataFrame:
    values = {"disposition": F.lit("unreviewed"), "line_number": F.lit(None).cast("int"), "symbol": F.lit(None).cast("string"), **values}
    return df.select("artifact_sha256", *[values[c].alias(c) for c in FINDING_COLUMNS[1:]])


def file_type_findings(inventory: DataFrame, rules: RuleSet) -> DataFrame:
    """A finding per file whose type a rule names (types are unique over rules)."""
    fields = ("rule_id", "category", "severity", "confidence", "title", "explanation")
    by_type = F.create_map(
        *[
            x
            for r in rules.file_types
            for t in r["file_types"]
            for x in (F.lit(t), F.struct(*[F.lit(r[f]).alias(f) for f in fields]))
        ]
    )
    hit = inventory.withColumn("_rule", F.try_element_at(by_type, F.col("file_type"))).filter(
        F.col("_rule").isNotNull()
    )
    return _finding(
        hit,
        **{f: F.col(f"_rule.{f}") for f in fields},
        subject_path=F.col("archive_path"),
        evidence=F.col("file_type"),
    )


def script_findings(members: DataFrame, rules: RuleSet) -> DataFrame:
    """Line findings of script members."""
    files = (
        members.filter(F.col("typeflag").isin(*REGULAR))
        .filter(file_type("path", "content").isin(*SCANNED_TYPES))
        .select("artifact_sha256", F.col("path").alias("subject_path"), F.col("content").cast("string").alias("text"))
    )
    found = line_findings(
        numbered_lines(files, "text", ["artifact_sha256", "subject_path"]), rules, ["artifact_sha256", "subject_path"]
    )
    return found.withColumn("disposition", F.lit("unreviewed")).select(*FINDING_COLUMNS)


def select_manifest(members: DataFrame, registry: str) -> DataFrame:
    """First manifest member of each archive in archive order, as text.

    npm: ``package.json`` in any folder; Python: ``PKG-INFO`` directly below the root folder.
    """
    path = F.col("path")
    wanted = (
        F.endswith(path, F.lit("/package.json"))
        if registry == "npm"
        else path.rlike(r"\A[^/]*/PKG-INFO\z")
    )
    return (
        members.filter(F.col("typeflag").isin(*REGULAR) & wanted)
        .groupBy("artifact_sha256")
        .agg(F.min(F.struct("member_index", "path", "content")).alias("m"))
        .select("artifact_sha256", F.col("m.path").alias("manifest_path"), F.col("m.content").cast("string").alias("manifest"))
    )


def _variant_text(doc: Column, path: str) -> Column:
    """A member's value only when it is a JSON string."""
    v = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(doc, path, "string"))


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def npm_manifests(manifests: DataFrame) -> DataFrame:
    """Fields of each package manifest; members of another type count as absent."""
    doc = manifests.withColumn("_v", F.try_parse_json("manifest")).withColumn(
        "_m", F.from_json("manifest", PACKAGE_MANIFEST)
    )
    v = F.col("_v")
    repository = F.coalesce(_variant_text(v, "$.repository"), _variant_text(v, "$.repository.url"))
    name = F.coalesce(_variant_text(v, "$.name"), F.lit(""))
    bin_text = _variant_text(v, "$.bin")
    bin_map = F.try_variant_get(v, "$.bin", "map<string,variant>")
    string_bins = F.map_filter(bin_map, lambda k, x: F.schema_of_variant(x) == "STRING")
    bins = F.when(bin_text.isNotNull(), F.create_map(name, bin_text)).otherwise(
        F.transform_values(string_bins, lambda k, x: F.variant_get(x, "$", "string"))
    )
    error = F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "package.json must be an object")
    return doc.select(
        "artifact_sha256",
        "manifest_path",
        error.alias("error"),
        name.alias("package_name"),
        F.coalesce(_variant_text(v, "$.version"), F.lit("")).alias("package_version"),
        _filled(_variant_text(v, "$.license")).alias("license"),
        repository.alias("repository"),
        _filled(_variant_text(v, "$.main")).alias("main_entry"),
        _filled(_variant_text(v, "$.module")).alias("module_entry"),
        _filled(_variant_text(v, "$.engines.node")).alias("engines_node"),
        bins.alias("bin_entries"),
        F.try_variant_get(v, "$.scripts", "map<string,variant>").alias("scripts"),
        *[F.try_variant_get(v, f"$.{key}", "map<string,variant>").alias(key) for key, _, _ in DEPENDENCY_MAPS],
    )


def package_bin(bins: Column, package: Column) -> Column:
    """Executable of a package: the entry named like the package, else the only entry."""
    preferred = F.try_element_at(bins, F.regexp_extract(package, r"([^/]*)\z", 1))
    only = F.when(F.size(bins) == 1, F.element_at(F.map_values(bins), 1))
    return F.coalesce(preferred, only)


def lifecycle_findings(manifests: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings of the declared lifecycle scripts whose value is text."""
    life = rules.lifecycle
    severity = F.create_map(*[F.lit(x) for pair in life["severities"].items() for x in pair])
    rows = manifests.select("artifact_sha256", F.explode("scripts").alias("name", "value")).filter(
        F.col("name").isin(*life["severities"]) & (F.schema_of_variant("value") == "STRING")
    )
    return _finding(
        rows,
        rule_id=F.concat(F.lit(life["rule_id_prefix"]), "name"),
        category=F.lit(life["category"]),
        severity=F.element_at(severity, F.col("name")),
        confidence=F.lit(life["confidence"]),
        subject_path=F.lit(life["subject_path"]),
        symbol=F.col("name"),
        title=F.concat(F.lit(life["title_prefix"]), "name"),
        evidence=text.bound_snippet(F.variant_get("value", "$", "string")),
        explanation=F.lit(life["explanation"]),
    )


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """Declared dependencies of the four maps; entries that are not text are left out."""

    def entries_of(key: str, kind: str, development: bool) -> Column:
        def entry(e: Column) -> Column:
            is_text = F.schema_of_variant(e["value"]) == "STRING"
            return F.struct(
                F.lit(kind).alias("dependency_type"),
                e["key"].alias("dependency_name"),
                F.when(is_text, F.variant_get(e["value"], "$", "string")).alias("declared_version"),
                F.lit(development).alias("development"),
            )

        return F.coalesce(F.transform(F.map_entries(key), entry), F.array())

    entries = F.concat(*[entries_of(*m) for m in DEPENDENCY_MAPS])
    return (
        manifests.select("artifact_sha256", F.explode(entries).alias("d"))
        .select("artifact_sha256", "d.*")
        .filter(F.col("declared_version").isNotNull())
        .withColumn("direct", F.lit(True))
    )


def pypi_manifests(manifests: DataFrame) -> DataFrame:
    """Fields of each PKG-INFO text; the first non-empty value of a field wins.

    The text is one bounded archive member, so its lines are handled as an array in place.
    """
    lines = F.split("manifest", "\n", -1)
    pairs = F.transform(
        F.filter(lines, lambda s: F.contains(s, F.lit(":"))),
        lambda s: F.struct(
            F.regexp_extract(s, r"\A([^:]*):", 1).alias("key"),
            F.regexp_extract(s, r"(?s)\A[^:]*:[ \t]*(.*?)\r?\z", 1).alias("value"),
        ),
    )
    doc = manifests.withColumn("_pairs", pairs)

    def first(*keys: str) -> Column:
        hits = F.filter("_pairs", lambda p: p["key"].isin(*keys) & (p["value"] != ""))
        return F.get(hits, F.lit(0))["value"]

    requires = F.transform(F.filter("_pairs", lambda p: p["key"] == "Requires-Dist"), lambda p: p["value"])
    return doc.select(
        "artifact_sha256",
        "manifest_path",
        F.when(first("Name").isNull() | first("Version").isNull(), "PyPI PKG-INFO missing Name or Version").alias("error"),
        first("Name").alias("package_name"),
        first("Version").alias("package_version"),
        first("License").alias("license"),
        F.coalesce(first("Home-page", "Project-URL"), F.lit("")).alias("repository"),
        requires.alias("requires"),
    )


def pypi_dependencies(manifests: DataFrame) -> DataFrame:
    """Requires-Dist rows; the name ends at the first of ``[ (;<>=!~``."""
    rows = manifests.select("artifact_sha256", F.explode("requires").alias("declared_version"))
    name = F.regexp_extract("declared_version", r"\A([^\[ (;<>=!~]*)", 1)
    return rows.select(
        "artifact_sha256",
        F.lit("runtime").alias("dependency_type"),
        name.alias("dependency_name"),
        "declared_version",
        F.lit(False).alias("development"),
        F.lit(True).alias("direct"),
    ).filter(F.col("dependency_name") != "")


def metadata_findings(manifests: DataFrame, rules: RuleSet, registry: str = "npm") -> DataFrame:
    meta = rules.package_metadata
    subject = F.lit(meta["subject_path"]) if registry == "npm" else F.col("manifest_path")
    evidence = F.concat(F.col("package_name"), F.lit("@"), F.col("package_version"))
    return _finding(
        manifests.filter(F.col("error").isNull()),
        **{f: F.lit(meta[f]) for f in ("rule_id", "category", "severity", "confidence", "title", "explanation")},
        subject_path=subject,
        evidence=text.bound_snippet(evidence),
    )


def analyzed(members: DataFrame, registry: str = "npm") -> tuple[DataFrame, DataFrame]:
    """(members, manifests) of the archives whose manifest is there and sound; the runs of the others fail without facts."""
    chosen = select_manifest(members, registry)
    manifests = npm_manifests(chosen) if registry == "npm" else pypi_manifests(chosen)
    sound = manifests.filter(F.col("error").isNull())
    return members.join(sound.select("artifact_sha256"), "artifact_sha256", "left_semi"), sound


def all_findings(members: DataFrame, rules: RuleSet, registry: str = "npm") -> DataFrame:
    """Every finding of the accepted archives of one registry; none of archives without a sound manifest."""
    members, manifests = analyzed(members, registry)
    parts = [
        metadata_findings(manifests, rules, registry),
        file_type_findings(file_inventory(members, rules), rules),
        script_findings(members, rules),
    ]
    if registry == "npm":
        parts.append(lifecycle_findings(manifests, rules))
    return reduce(DataFrame.unionByName, parts)


def archive_summaries(inventory: DataFrame, findings: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Per archive: file, dependency and finding counts, native flag, lifecycle scripts.

    The three fact tables are stacked and folded by archive in one aggregation.
    """
    none = F.lit(None).cast("string")
    rows = (
        inventory.select("artifact_sha256", F.lit("f").alias("k"), "native_binary", none.alias("script"))
        .unionByName(
            dependencies.select("artifact_sha256", F.lit("d").alias("k"), F.lit(False).alias("native_binary"), none.alias("script"))
        )
        .unionByName(
            findings.select(
                "artifact_sha256",
                F.lit("n").alias("k"),
                F.lit(False).alias("native_binary"),
                F.when(F.startswith("rule_id", F.lit("lifecycle:")), F.col("symbol")).alias("script"),
            )
        )
    )
    return rows.groupBy("artifact_sha256").agg(
        F.count_if(F.col("k") == "f").alias("analyzed_file_count"),
        F.count_if(F.col("k") == "d").alias("dependency_count"),
        F.count_if(F.col("k") == "n").alias("finding_count"),
        F.bool_or("native_binary").alias("has_native_code"),
        F.sort_array(F.collect_set("script")).alias("lifecycle_scripts"),
    )


def run_records(resolved: DataFrame, ruleset_version: str) -> DataFrame:
    """Completed or failed run per artifact; the first stage with an error names the failure.

    ``resolved`` carries one nullable error column per stage, named ``<stage>_error``.
    """
    stages = [c for c in resolved.columns if c.endswith("_error")]
    message = F.coalesce(*[F.col(c) for c in stages])
    stage = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c.removesuffix("_error"))) for c in stages])
    keep = [c for c in resolved.columns if c not in stages]
    return resolved.select(
        *keep,
        F.when(message.isNull(), "completed").otherwise("failed").alias("status"),
        F.lit(ruleset_version).alias("ruleset_version"),
        stage.alias("error_stage"),
        text.byte_prefix(message, text.ERROR_MESSAGE_BYTES).alias("error_message"),
    )


def without_known_runs(artifacts: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Artifacts no completed run covers yet; ``runs`` are matched on all ``keys``."""
    done = runs.filter("status = 'completed'").select(*keys).distinct()
    return artifacts.join(done, keys, "left_anti")


def reusable_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Newest completed run per (artifact, analyzer version, ruleset, type)."""
    done = runs.filter((F.col("status") == "completed") & F.col("artifact_sha256").isNotNull())
    return done.groupBy(*keys).agg(F.max("id").alias("run_id"))


def contract_violations(findings: DataFrame) -> DataFrame:
    """Findings that break the stored-result contract."""
    required = ("rule_id", "category", "severity", "confidence", "subject_path", "title", "explanation")
    empty = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) == "" for c in required])
    problem = (
        F.when(empty, "missing field")
        .when(~F.col("severity").isin(*SEVERITIES), "severity")
        .when(~F.col("confidence").isin(*CONFIDENCES), "confidence")
        .when(~F.col("disposition").isin(*DISPOSITIONS), "disposition")
        .when(F.octet_length("evidence") > text.SNIPPET_BYTES + 16, "evidence too long")
        .when(F.col("line_number") < 1, "line number")
    )
    return findings.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def identity_violations(results: DataFrame, packages: DataFrame, ruleset: str) -> DataFrame:
    """Results that speak of another ruleset or package than they were asked for, with the ``problem``.

    ``results``: package_id, package_name, package_version, ruleset_version as the analyzer reported them; ``packages``:
    id, registry_type, identifier, version. Python names compare in their normal form and versions by meaning, all
    others as they are written. A name without a normal form or a missing value is no match.
    """
    asked = packages.select(F.col("id").alias("package_id"), "registry_type", "identifier", "version")
    both = results.join(asked, "package_id", "left")
    python = F.col("registry_type") == "pypi"
    name = text.normalize_project_name("identifier") == text.normalize_project_name("package_name")
    same_name = F.when(python, name).otherwise(F.col("identifier") == F.col("package_name"))
    same_version = F.when(python, text.versions_equivalent("version", "package_version")).otherwise(F.col("version") == F.col("package_version"))
    problem = (
        F.when(F.col("identifier").isNull(), "unknown package")
        .when(~F.coalesce(F.col("ruleset_version") == ruleset, F.lit(False)), "ruleset")
        .when(~F.coalesce(same_name & same_version, F.lit(False)), "package identity")
    )
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(*results.columns, "problem")


def _continues(content: Column, offset: Column) -> Column:
    """True when the byte at a 0-based offset continues a UTF-8 character."""
    return F.hex(F.substring(content, offset + 1, F.lit(1))).between("80", "BF")


def _let(value: Column, body) -> Column:
    """Bind a value once and use it in an expression, so that nested uses do not multiply."""
    return F.transform(F.array(value), body)[0]


def source_window(content: Column, line_number: Column, symbol: Column, evidence: Column, limit: int = MAX_SOURCE_BYTES) -> Column:
    """Window of at most ``limit`` bytes of a valid UTF-8 text, centred on a finding.

    The centre is the symbol (or evidence) inside the finding's line, else the middle of the
    line; both ends are moved to character boundaries. Offsets are bytes, lines count from 1.
    """
    number = F.coalesce(line_number.cast("int"), F.lit(0))
    needle = F.regexp_replace(F.coalesce(F.nullif(symbol, F.lit("")), evidence, F.lit("")), r"\.\.\.\z", "")
    total = F.octet_length(content)

    def first_lines(count: Column) -> Column:
        return F.octet_length(F.call_function("substring_index", content.cast("string"), F.lit("\n"), count))

    line_start = F.when(number > 1, F.least(first_lines(number - 1) + 1, total)).otherwise(0)
    span = F.struct(line_start.alias("start"), first_lines(number).alias("end"))

    def centre(line: Column) -> Column:
        body = F.substring(content, line["start"] + 1, line["end"] - line["start"]).cast("string")
        at = F.when(needle != "", F.position(needle, body)).otherwise(0)
        half = F.floor(F.octet_length(needle) / 2).cast("int")
        hit = line["start"] + F.octet_length(F.substring(body, F.lit(1), at - 1)) + half
        middle = line["start"] + F.floor((line["end"] - line["start"]) / 2).cast("int")
        return F.when(at > 0, hit).otherwise(middle)

    def rough(middle: Column) -> Column:
        first = F.greatest(F.lit(0), middle - limit // 2)
        at_end = first + limit >= total
        return F.struct(
            F.when(total <= limit, 0).when(at_end, total - limit).otherwise(first).alias("begin"),
            F.when((total <= limit) | at_end, total).otherwise(first + limit).alias("end"),
        )

    def stepped(offset: Column, step: int) -> Column:
        """The first of four neighbouring offsets that is a character boundary."""
        return (
            F.when(~_continues(content, offset), offset)
            .when(~_continues(content, offset + step), offset + step)
            .when(~_continues(content, offset + 2 * step), offset + 2 * step)
            .otherwise(offset + 3 * step)
        )

    def exact(w: Column) -> Column:
        return F.struct(
            F.when(w["begin"] > 0, stepped(w["begin"], 1)).otherwise(w["begin"]).alias("begin"),
            F.when(w["end"] < total, stepped(w["end"], -1)).otherwise(w["end"]).alias("end"),
        )

    def described(w: Column) -> Column:
        begin, end = w["begin"], w["end"]
        before, after = begin > 0, end < total
        ahead = F.substring(content, F.lit(1), begin).cast("string")
        return F.struct(
            begin.alias("display_start"),
            end.alias("display_end"),
            (1 + text.newline_count(ahead)).alias("start_line"),
            before.alias("truncated_before"),
            after.alias("truncated_after"),
            (before & (F.hex(F.substring(content, begin, F.lit(1))) != "0A")).alias("starts_mid_line"),
            (after & (F.hex(F.substring(content, end, F.lit(1))) != "0A")).alias("ends_mid_line"),
            F.substring(content, begin + 1, end - begin).cast("string").alias("content"),
        )

    middle = F.when(number < 1, 0).otherwise(_let(span, centre))
    return _let(_let(_let(middle, rough), exact), described)


def finding_sources(
    findings: DataFrame, runs: DataFrame, files: DataFrame, evidence: DataFrame, members: DataFrame, limit: int = MAX_SOURCE_BYTES
) -> DataFrame:
    """Source window of each finding, after its digests have been checked.

    The finding meets its run, its file row and the first artifact evidence of its run, then the
    archive member itself.
    """
    first_evidence = (
        evidence.filter("evidence_type = 'artifact'")
        .groupBy("analysis_run_id")
        .agg(F.min(F.struct("id", "relative_path", "sha256", "byte_size")).alias("ev"))
    )
    joined = (
        findings.join(runs.select(F.col("id").alias("analysis_run_id"), "artifact_sha256"), "analysis_run_id")
        .join(
            files.select(
                "analysis_run_id",
                F.col("archive_path").alias("subject_path"),
                F.col("byte_size").alias("file_size"),
                F.col("sha256").alias("file_sha256"),
            ),
            ["analysis_run_id", "subject_path"],
            "left",
        )
        .join(first_evidence, "analysis_run_id", "left")
        .join(
            members.select("artifact_sha256", F.col("path").alias("subject_path"), "typeflag", "content"),
            ["artifact_sha256", "subject_path"],
            "left",
        )
    )
    digest = r"\A[0-9a-f]{64}\z"
    expected = F.concat(
        F.lit("artifacts/sha256/"), F.substring("artifact_sha256", 1, 2), F.lit("/"), "artifact_sha256", F.lit("/artifact.tgz")
    )
    problem = (
        F.when(
            F.col("artifact_sha256").isNull() | F.col("file_sha256").isNull() | F.col("ev").isNull(),
            "finding source is not backed by a finalized artifact and file record",
        )
        .when(
            ~(F.col("artifact_sha256").rlike(digest) & F.col("file_sha256").rlike(digest)),
            "finding source metadata contains an invalid SHA-256 digest",
        )
        .when(
            (F.col("ev.relative_path") != expected) | (F.col("ev.sha256") != F.col("artifact_sha256")),
            "artifact evidence metadata does not match its digest path",
        )
        .when(
            F.col("content").isNull() | ~F.col("typeflag").isin(*REGULAR),
            "finding source is not a regular archive member",
        )
        .when(F.octet_length("content") != F.col("file_size"), "finding source size does not match the catalog")
        .when(F.sha2("content", 256) != F.col("file_sha256"), "finding source digest does not match the catalog")
        .when(~text.displayable_utf8("content"), "finding source is not displayable UTF-8 text")
    )
    checked = joined.withColumn("error", problem).withColumn(
        "content", F.when(F.col("error").isNull(), F.col("content"))
    )
    window = source_window(F.col("content"), F.col("line_number"), F.col("symbol"), F.col("evidence"), limit)
    return checked.withColumn("window", window).select(
        F.col("id").alias("finding_id"), "analysis_run_id", "subject_path", "line_number", "error",
        F.col("file_sha256").alias("sha256"), F.octet_length("content").alias("byte_size"), "window.*",
    )

"""Archive analysis against small archives built here."""

import io
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import artifacts, detectors
from tidemark.sources import archives
from tidemark.sources.rules import InvalidRules, default_document, default_rules, parse_rules


def targz(files, extra=()):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data, mode in files:
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), mode
            tar.addfile(info, io.BytesIO(data))
        for info in extra:
            tar.addfile(info)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw.getvalue()) + packer.flush()


MANIFEST = b'{"name":"demo","version":"1.0.0","scripts":{"prepare":"tsc","preinstall":"x","test":"t"},"dependencies":{"a":"1"},"devDependencies":{"b":"2"}}'
INDEX = b"import fs from 'node:fs';\nimport {x} from \"node:url\";\n/abc/.exec('s');\nconst d = 'see docs about fetch';\n"
DANGER = b"const cp = require('child_process');\ncp.exec('ls');\n"


def members_of(spark, *packed):
    df = spark.createDataFrame([(bytearray(p),) for p in packed], "content binary")
    return archives.archive_members(df)


@pytest.fixture(scope="module")
def npm(spark):
    packed = targz([("package/package.json", MANIFEST, 0o644), ("package/index.js", INDEX, 0o755), ("package/danger.js", DANGER, 0o644)])
    return members_of(spark, packed).cache()


def test_npm_findings(spark, npm):
    found = {(r.subject_path, r.rule_id, r.line_number) for r in artifacts.all_findings(npm, default_rules()).collect()}
    assert ("package/index.js", "node-builtin:fs", 1) in found
    assert ("package/index.js", "node-builtin:url", 2) in found
    assert ("package/danger.js", "node-builtin:child_process", 1) in found
    assert ("package/danger.js", "risk-api:exec", 2) in found
    assert {i for _, i, _ in found if i.startswith("lifecycle:")} == {"lifecycle:prepare", "lifecycle:preinstall"}
    index = {i for p, i, _ in found if p == "package/index.js"}
    assert not index & {"risk-api:exec", "risk-api:fetch"}
    assert ("package/package.json", "package-metadata", None) in found


def test_inventory_and_dependencies(spark, npm):
    rows = {r.archive_path: r for r in artifacts.file_inventory(npm, default_rules()).collect()}
    assert rows["package/index.js"].executable and not rows["package/danger.js"].executable
    assert not any(r.native_binary for r in rows.values())
    manifests = artifacts.npm_manifests(artifacts.select_manifest(npm, "npm"))
    deps = {(r.dependency_type, r.dependency_name, r.declared_version, r.development) for r in artifacts.npm_dependencies(manifests).collect()}
    assert deps == {("runtime", "a", "1", False), ("development", "b", "2", True)}


def link(name, target, kind=tarfile.SYMTYPE):
    info = tarfile.TarInfo(name)
    info.type, info.linkname = kind, target
    return info


@pytest.mark.parametrize(
    ("name", "extra", "reason"),
    [
        ("package/../x.js", (), "archive contains parent-traversal path entry"),
        ("/etc/x", (), "archive contains absolute path entry"),
        ("C:/x", (), "archive contains absolute path entry"),
        ("package/ok.js", (link("package/l", "../../etc"),), "archive link target escapes package root"),
        ("package/ok.js", (link("package/l", "/etc"),), "archive link target escapes package root"),
        ("package/ok.js", (link("package/f", "", tarfile.FIFOTYPE),), "archive contains device or fifo entry"),
        ("package/ok.js", (link("package/l", "ok.js"),), None),
    ],
)
def test_unsafe_members_reject_the_archive(spark, name, extra, reason):
    members = members_of(spark, targz([("package/package.json", MANIFEST, 0o644), (name, b"x", 0o644)], extra))
    verdicts = artifacts.archive_verdicts(members)
    assert verdicts.first().rejected == reason
    kept = artifacts.safe_members(members, verdicts).count()
    assert (kept == 0) == (reason is not None)


def test_limits_and_unreadable_archives(spark):
    big = targz([("a/b", b"x" * 100, 0o644), ("a/c", b"y" * 100, 0o644)])
    members = members_of(spark, big)
    assert "count" in artifacts.archive_verdicts(members, max_files=1).first().rejected
    assert "individual" in artifacts.archive_verdicts(members, max_file_bytes=99).first().rejected
    assert "total" in artifacts.archive_verdicts(members, max_total_bytes=150).first().rejected
    broken = members_of(spark, b"not gzip", big[:20])
    assert broken.filter("archive_error IS NULL").count() == 0
    assert artifacts.archive_verdicts(broken).filter("rejected IS NULL").count() == 0
    small = spark.createDataFrame([(bytearray(big),)], "content binary")
    assert archives.archive_members(small, max_archive_bytes=10).first().archive_error == "tarball exceeds configured size limit"


def test_source_window_is_centred_and_whole_characters(spark):
    text = "\n".join(["first"] * 6) + "\n" + "é" * 50_000 + "child_process.spawn(" + "é" * 50_000
    data = text.encode()
    df = spark.createDataFrame([(bytearray(data), 7, "spawn", "x")], "c binary, n int, s string, e string")
    w = df.select(artifacts.source_window(*[F.col(c) for c in "cnse"]).alias("w")).first().w
    assert w.start_line == 7 and w.truncated_before and w.truncated_after and w.starts_mid_line and w.ends_mid_line
    assert len(w.content.encode()) <= artifacts.MAX_SOURCE_BYTES and "spawn(" in w.content and "\ufffd" not in w.content
    middle = w.content.encode().index(b"spawn") / len(w.content.encode())
    assert 0.45 < middle < 0.55


WINDOWED = "aü\nbücd€€cd\n€xü".encode()


def plain_window(data, limit, number, symbol):
    start, end = 0, len(data)
    if len(data) > limit:
        centre = 0
        if number:
            lines, at = data.split(b"\n"), 0
            for done in lines[: number - 1]:
                at = min(at + len(done) + 1, len(data))
            line = lines[number - 1] if number <= len(lines) else b""
            hit = line.find(symbol.encode()) if symbol else -1
            centre = at + hit + len(symbol.encode()) // 2 if hit >= 0 else at + len(line) // 2
        start = max(0, centre - limit // 2)
        end = min(len(data), start + limit)
        start = end - limit if end == len(data) else start
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while start < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
    return start, end, data[start:end].decode(), 1 + data.count(b"\n", 0, start)


@pytest.mark.parametrize("limit", [7, 10, 33])
def test_source_windows_against_a_plain_loop(spark, limit):
    cases = [(n, s) for n in (None, 1, 2, 3, 9) for s in ("ü", "cd", "nothing", None)]
    rows = [(i, bytearray(WINDOWED), n, s, None) for i, (n, s) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, c binary, n int, s string, e string").repartition(2)
    window = artifacts.source_window(*[F.col(c) for c in "cnse"], limit=limit)
    got = {r.i: r.w for r in df.select("i", window.alias("w")).collect()}
    for i, (number, symbol) in enumerate(cases):
        w = got[i]
        assert (w.display_start, w.display_end, w.content, w.start_line) == plain_window(WINDOWED, limit, number, symbol), cases[i]


@pytest.mark.parametrize(
    ("line", "rules"),
    [
        ("cp.exec(x)", {"risk-api:exec"}),
        ("a.Child_Process.exec(x)", {"risk-api:exec"}),
        ("xcp.exec(x)", set()),
        ("/re/.exec(x)", set()),
        ("exec(x)", {"risk-api:exec"}),
        ("$exec(x)", set()),
        ("new WebSocket", {"risk-api:WebSocket"}),
        ("see https:// fetch(", {"risk-api:fetch"}),
        ("require( 'x')", set()),
        ("require(\tx)", {"risk-api:nonliteral-require"}),
        ("process.env.X", {"risk-api:process.env"}),
        ("'fs/promises'", {"node-builtin:fs"}),
    ],
)
def test_detectors(spark, line, rules):
    df = spark.createDataFrame([("f", 1, line)], "f string, line_number int, line string")
    assert {r.rule_id for r in detectors.line_findings(df, default_rules(), ["f"]).collect()} == rules


def test_documentation_suppression(spark):
    doc = default_document()
    doc["risk_api_rules"][7]["suppress_documentation_context"] = True
    doc["risk_api_rules"][7]["severity"] = "critical"
    lines = spark.createDataFrame([("f", 1, "x = new Function"), ("f", 2, "SEE new Function")], "f string, line_number int, line string")
    rows = detectors.line_findings(lines, parse_rules(doc), ["f"]).collect()
    assert [(r.line_number, r.severity) for r in rows] == [(1, "critical")]


@pytest.mark.parametrize(
    "spoil",
    [
        lambda d: d.update(schema_version=2),
        lambda d: d["risk_api_rules"][0].update(detector="magic"),
        lambda d: d["risk_api_rules"][0].update(severity="awful"),
        lambda d: d["risk_api_rules"].append(d["risk_api_rules"][0]),
        lambda d: d["node_builtin_rules"].append(d["node_builtin_rules"][0]),
        lambda d: d["file_type_rules"][1].update(file_types=["wasm"]),
        lambda d: d["file_type_rules"][0].pop("marks_native"),
        lambda d: d.pop("lifecycle_rules"),
        lambda d: d["engine_options"].pop("process_call_owners"),
    ],
)
def test_bad_rule_documents(spoil):
    doc = default_document()
    spoil(doc)
    with pytest.raises(InvalidRules):
        parse_rules(doc)


def test_rules_of_a_file(spark, tmp_path):
    import json

    from tidemark.sources import rules

    place = tmp_path / "rules.json"
    place.write_text(json.dumps(default_document()))
    assert rules.load_rules(spark, f"file://{place}") == default_rules()
    for content in (b"{", b"[]", b"\xff", b" " * (rules.MAX_RULE_BYTES + 1)):
        place.write_bytes(content)
        with pytest.raises(InvalidRules):
            rules.load_rules(spark, f"file://{place}")
    (tmp_path / "more.json").write_text("{}")
    with pytest.raises(InvalidRules, match="2 files"):
        rules.load_rules(spark, f"file://{tmp_path}/*.json")


def test_all_problems_of_a_document_are_named():
    from tidemark.sources.rules import rule_problems

    doc = default_document()
    doc["risk_api_rules"][2]["severity"] = "x"
    doc["risk_api_rules"][1]["rule_id"] = "file-type:native"
    doc["lifecycle_rules"] = []
    doc["file_type_rules"][1]["file_types"] = ["wasm", ""]
    del doc["engine_options"], doc["ruleset_version"], doc["node_builtin_defaults"]["category"]
    assert {where for where, _ in rule_problems(doc)} == {
        "ruleset_version", "engine_options", "node_builtin_defaults.category", "risk_api_rules[2].severity",
        "lifecycle_rules", "file_type_rules[0].rule_id", "file_type_rules[1].file_types",
    }
    assert rule_problems(default_document()) == [] and rule_problems(None)


def test_default_rule_ids():
    rules = default_rules()
    assert len(rules.line_rules) == 34 and len(rules.lifecycle["severities"]) == 6 and len(rules.file_types) == 4


def test_pkg_info(spark):
    body = "Name: Demo_PyPI\r\nVersion: 1.0\nRequires-Dist: left[extra]>=1\n"
    df = spark.createDataFrame([("a", "demo/PKG-INFO", body)], "artifact_sha256 string, manifest_path string, manifest string")
    row = artifacts.pypi_manifests(df).first()
    assert (row.package_name, row.package_version, row.error, row.license) == ("Demo_PyPI", "1.0", None, None)
    dep = artifacts.pypi_dependencies(artifacts.pypi_manifests(df)).first()
    assert (dep.dependency_name, dep.declared_version) == ("left", "left[extra]>=1")


def test_only_the_root_pkg_info_counts(spark):
    members = members_of(spark, targz([("a/b/PKG-INFO", b"Name: x\n", 0o644), ("a/PKG-INFO", b"Name: y\n", 0o644)]))
    assert artifacts.select_manifest(members, "pypi").first().manifest == "Name: y\n"


def test_file_types_prefer_extension_over_bytes(spark):
    rows = [("a.js", b"\x7fELF"), ("a", b"\x7fELF"), ("a", b"MZ\0\0"), ("a", b"MZ"), ("a", b"\xca\xfe\xba\xbe"), ("a.d.ts", b""), ("a.json", b"\0asm")]
    df = spark.createDataFrame([(i, p, bytearray(c)) for i, (p, c) in enumerate(rows)], "i int, p string, c binary")
    got = [r[0] for r in df.orderBy("i").select(artifacts.file_type("p", "c")).collect()]
    assert got == ["javascript", "elf", "pe", "other", "mach_o", "typescript_declaration", "wasm"]
    assert df.select(F.count("*")).first()[0] == len(rows)

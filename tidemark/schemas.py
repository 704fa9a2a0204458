"""Schemas (as DDL text) of the stored tables and nested records."""

from __future__ import annotations

# Fixed value: the member of ``_meta`` that holds status and publication times.
OFFICIAL_META = "io.modelcontextprotocol.registry/official"

_TRANSPORT = "struct<type:string>"
_PACKAGE = (
    f"struct<registryType:string,identifier:string,version:string,transport:{_TRANSPORT},"
    "packageArguments:array<struct<type:string,value:string,valueHint:string>>,"
    "environmentVariables:array<struct<name:string,isRequired:boolean,description:string>>>"
)
_REPOSITORY = "struct<source:string,url:string>"
_REMOTES = "array<struct<url:string,type:string>>"
_META = f"struct<`{OFFICIAL_META}`:struct<status:string,publishedAt:string,updatedAt:string>>"

CANONICAL_RECORD = (
    "record_version int, registry string, server_identifier string, server_version string, "
    f"description string, repository {_REPOSITORY}, packages array<{_PACKAGE}>, remotes {_REMOTES}, "
    f"original struct<_meta:{_META}>, observed_at string, canonical_sha256 string"
)
PAGE = (
    "metadata struct<nextCursor:string,cursor:string>"
)
MANIFEST = (
    "bundle_version int, collection_mode string, updated_since string, base_snapshot_sha256 string, "
    "base_snapshot_completed_at string, registry string, registry_base_url string, status string, "
    "started_at string, completed_at string, snapshot_sha256 string, run_id string, "
    "collector struct<name:string,version:string,git_commit:string>, "
    "counts struct<pages:bigint,records_received:bigint,unique_server_versions:bigint>, "
    "artifacts array<struct<path:string,sha256:string,size:bigint>>"
)
PAGE_INDEX = (
    "page_number int, request_url string, effective_response_url string, retrieved_at string, "
    "http_status int, content_type string, response_bytes bigint, sha256 string, "
    "pagination_input string, pagination_output string, redirect_count int, records bigint, path string"
)
NPM_RELEASE = (
    "name string, version string, `dist.tarball` string, `dist.integrity` string, `dist.shasum` string, "
    "dist struct<tarball:string,integrity:string,shasum:string>"
)
PYPI_RELEASE = (
    "info struct<name:string,version:string>, urls array<struct<filename:string,packagetype:string,"
    "url:string,size:bigint,digests:struct<sha256:string>,yanked:boolean>>"
)
PACKAGE_MANIFEST = (
    "name string, version string, license string, repository string, main string, module string, "
    "engines string, bin string, scripts map<string,string>, dependencies map<string,string>, "
    "devDependencies map<string,string>, peerDependencies map<string,string>, "
    "optionalDependencies map<string,string>"
)
MEMBERS = (
    "artifact_sha256 string, member_index int, path string, typeflag string, size bigint, mode int, "
    "linkname string, content binary, archive_error string"
)

# Primary keys of the stored tables.
KEYS = {
    "snapshots": ["id"],
    "server_versions": ["id"],
    "snapshot_server_versions": ["snapshot_id", "server_version_id"],
    "repositories": ["server_version_id"],
    "packages": ["id"],
    "package_arguments": ["package_id", "position"],
    "package_environment": ["package_id", "position"],
    "remotes": ["id"],
}
# Tables of the small read model; everything else is detail that only the history store keeps.
READ_MODEL = (
    "rule_definitions",
    "run_summaries",
    "rule_summaries",
    "evidence_manifests",
    "coverage_summary",
    "analysis_runs",
    "runtime_observation_runs",
    "runtime_observation_tools",
)
DETAIL = (
    "analysis_files",
    "analysis_findings",
    "analysis_dependencies",
    "analysis_evidence",
    "analysis_artifacts",
)

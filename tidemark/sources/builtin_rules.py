"""The built-in rule document, in the layout that ``rules.parse_rules`` reads."""

from __future__ import annotations

# Everything from here on.

VERSION = "1.0.0"
PROCESS_CALL_OWNERS = ['cp', 'child_process', 'childprocess', 'proc', 'process']
DOCUMENTATION_MARKERS = ['http://', 'https://', 'see ', 'docs', 'readme', '*', '//']

PACKAGE_METADATA = {
    "rule_id": "package-metadata",
    "category": "package_metadata",
    "severity": "info",
    "confidence": "high",
    "title": "Package metadata extracted",
    "subject_path": "package/package.json",
    "explanation": "Captured package name, version, bin/main entries, engines, dependencies, repository, license, and lifecycle scripts.",
}

BUILTIN_DEFAULTS = {
    "rule_id_prefix": "node-builtin:",
    "category": "node_builtin_import",
    "confidence": "high",
    "title_prefix": "Node built-in import: ",
    "explanation": "Observed a textual reference to a Node.js built-in module.",
}

# (symbol, tokens, severity)
BUILTINS = [
    ("child_process", ["node:child_process", "child_process"], "high"),
    ("vm", ["node:vm", "vm"], "high"),
    ("module", ["node:module", "module"], "high"),
    ("fs", ["node:fs", "node:fs/promises", "fs/promises", "fs"], "medium"),
    ("http", ["node:http", "http"], "medium"),
    ("https", ["node:https", "https"], "medium"),
    ("net", ["node:net", "net"], "medium"),
    ("worker_threads", ["node:worker_threads", "worker_threads"], "medium"),
    ("dns", ["node:dns", "dns"], "low"),
    ("tls", ["node:tls", "tls"], "low"),
    ("dgram", ["node:dgram", "dgram"], "low"),
    ("os", ["node:os", "os"], "low"),
    ("url", ["node:url", "url"], "low"),
]

API_DEFAULTS = {
    "category": "risk_relevant_api",
    "confidence": "medium",
    "explanation": "Observed a textual reference to a risk-relevant API surface.",
}

# (rule_id, detector, pattern, symbol, severity, title, suppress_documentation_context)
APIS = [
    ("risk-api:spawnSync", "process_call", "spawnSync", "spawnSync", "high", "Process spawnSync call", False),
    ("risk-api:spawn", "process_call", "spawn", "spawn", "high", "Process spawn call", False),
    ("risk-api:execSync", "process_call", "execSync", "execSync", "high", "Process execSync call", False),
    ("risk-api:execFile", "process_call", "execFile", "execFile", "high", "Process execFile call", False),
    ("risk-api:exec", "process_call", "exec", "exec", "high", "Process exec call", False),
    ("risk-api:fork", "process_call", "fork", "fork", "high", "Process fork call", False),
    ("risk-api:eval", "call", "eval", "eval", "high", "eval() call", False),
    ("risk-api:Function", "substring", "new Function", "Function", "high", "new Function(...) construction", False),
    ("risk-api:fetch", "call", "fetch", "fetch", "medium", "fetch() call", True),
    ("risk-api:WebSocket", "websocket_call", "WebSocket", "WebSocket", "medium", "WebSocket usage", True),
    ("risk-api:dynamic-import", "call", "import", "import", "medium", "Dynamic import()", False),
    ("risk-api:nonliteral-require", "nonliteral_require", "require", "require", "medium", "Non-literal require()", False),
    ("risk-api:writeFile", "call", "writeFile", "writeFile", "medium", "writeFile call", False),
    ("risk-api:appendFile", "call", "appendFile", "appendFile", "medium", "appendFile call", False),
    ("risk-api:createWriteStream", "call", "createWriteStream", "createWriteStream", "medium", "createWriteStream call", False),
    ("risk-api:mkdir", "call", "mkdir", "mkdir", "medium", "mkdir call", False),
    ("risk-api:rename", "call", "rename", "rename", "medium", "rename call", False),
    ("risk-api:unlink", "call", "unlink", "unlink", "medium", "unlink call", False),
    ("risk-api:chmod", "call", "chmod", "chmod", "medium", "chmod call", False),
    ("risk-api:chown", "call", "chown", "chown", "medium", "chown call", False),
    ("risk-api:process.env", "substring", "process.env", "process.env", "low", "process.env access", False),
]

LIFECYCLE_DEFAULTS = {
    "rule_id_prefix": "lifecycle:",
    "category": "lifecycle_script",
    "confidence": "high",
    "title_prefix": "npm lifecycle script: ",
    "subject_path": "package/package.json",
    "explanation": "package.json declares an npm lifecycle script. This analyzer never executes lifecycle scripts.",
}

# (name, severity)
LIFECYCLES = [
    ("preinstall", "high"),
    ("install", "high"),
    ("postinstall", "high"),
    ("prepare", "medium"),
    ("prepublish", "medium"),
    ("prepublishOnly", "medium"),
]

# (rule_id, category, file_types, marks_native, severity, confidence, title, explanation)
FILE_TYPES = [
    ("file-type:native", "file_type", ["elf", "pe", "mach_o", "native_node_module", "shared_library", "wasm"], True, "high", "high", "Native or binary content present", "Archive member classified as native/binary content."),
    ("file-type:shell_script", "file_type", ["shell_script"], False, "medium", "high", "Notable file type: shell_script", "Archive member matched a notable file-type rule."),
    ("file-type:powershell_script", "file_type", ["powershell_script"], False, "medium", "high", "Notable file type: powershell_script", "Archive member matched a notable file-type rule."),
    ("file-type:nested_archive", "file_type", ["nested_archive"], False, "medium", "high", "Notable file type: nested_archive", "Archive member matched a notable file-type rule."),
]

# End of fixed values.


def _rows(names: str, table: list[tuple]) -> list[dict]:
    return [dict(zip(names.split(), row)) for row in table]


def document() -> dict:
    return {
        "schema_version": 1,
        "ruleset_version": VERSION,
        "engine_options": {"process_call_owners": list(PROCESS_CALL_OWNERS), "documentation_context_markers": list(DOCUMENTATION_MARKERS)},
        "package_metadata_rule": dict(PACKAGE_METADATA),
        "node_builtin_defaults": dict(BUILTIN_DEFAULTS),
        "node_builtin_rules": _rows("symbol tokens severity", BUILTINS),
        "risk_api_defaults": dict(API_DEFAULTS),
        "risk_api_rules": _rows("rule_id detector pattern symbol severity title suppress_documentation_context", APIS),
        "lifecycle_defaults": dict(LIFECYCLE_DEFAULTS),
        "lifecycle_rules": _rows("name severity", LIFECYCLES),
        "file_type_rules": _rows("rule_id category file_types marks_native severity confidence title explanation", FILE_TYPES),
    }

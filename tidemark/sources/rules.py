"""Rule documents: loading, checking, and the built-in document."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import SEVERITIES
from . import builtin_rules

MAX_RULE_BYTES = 1024 * 1024


class InvalidRules(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    """One line rule: what to look for and the finding it makes."""

    rule_id: str
    detector: str
    patterns: tuple[str, ...]
    symbol: str
    category: str
    severity: str
    confidence: str
    title: str
    explanation: str
    suppress_documentation: bool = False


@dataclass(frozen=True)
class RuleSet:
    version: str
    owners: tuple[str, ...]
    documentation_markers: tuple[str, ...]
    line_rules: tuple[Rule, ...]
    lifecycle: dict
    file_types: tuple[dict, ...]
    package_metadata: dict


# --- the layout of a document ------------------------------------------------------------------

#: kind of value -> (test, what is expected)
KINDS: dict[str, tuple[Callable[[Any], bool], str]] = {
    "text": (lambda v: isinstance(v, str) and v != "", "a text that is not empty"),
    "texts": (lambda v: isinstance(v, list) and bool(v) and all(isinstance(x, str) and x for x in v), "a list of texts, none of them empty"),
    "flag": (lambda v: isinstance(v, bool), "true or false"),
    "severity": (lambda v: v in SEVERITIES, "one of " + ", ".join(SEVERITIES)),
    "detector": (lambda v: isinstance(v, str) and v in _detectors(), "the name of a detector"),
}
_RULE = "rule_id:text category:text severity:severity confidence:text title:text explanation:text"
#: section -> fields as name:kind; a field with ``?`` may be left out and is then false
OBJECTS = {
    "engine_options": "process_call_owners:texts documentation_context_markers:texts",
    "package_metadata_rule": f"{_RULE} subject_path:text",
    "node_builtin_defaults": "rule_id_prefix:text category:text confidence:text title_prefix:text explanation:text",
    "risk_api_defaults": "category:text confidence:text explanation:text",
    "lifecycle_defaults": "rule_id_prefix:text category:text confidence:text title_prefix:text subject_path:text explanation:text",
}
LISTS = {
    "node_builtin_rules": "symbol:text tokens:texts severity:severity",
    "risk_api_rules": "rule_id:text detector:detector pattern:text symbol:text severity:severity title:text suppress_documentation_context?:flag",
    "lifecycle_rules": "name:text severity:severity",
    "file_type_rules": f"{_RULE} file_types:texts marks_native:flag",
}
#: Values that may stand once in all places of a line.
ONCE = [
    ["node_builtin_rules.symbol"],
    ["lifecycle_rules.name"],
    ["file_type_rules.file_types"],
    ["package_metadata_rule.rule_id", "risk_api_rules.rule_id", "file_type_rules.rule_id"],
]


def _detectors() -> dict:
    from ..operators.detectors import DETECTORS  # that module reads this one's types

    return DETECTORS


def _fields(layout: str) -> list[tuple[str, str, bool]]:
    """(name, kind, required)"""
    pairs = (field.split(":") for field in layout.split())
    return [(name.rstrip("?"), kind, not name.endswith("?")) for name, kind in pairs]


def _places(doc: dict) -> Iterator[tuple[str, str, Any]]:
    """(where, layout, value) of every object that a document must have; a list that is none or empty stands for itself."""
    for section, layout in OBJECTS.items():
        yield section, layout, doc.get(section)
    for section, layout in LISTS.items():
        items = doc.get(section)
        if not isinstance(items, list) or not items:
            yield section, layout, items
        else:
            for k, item in enumerate(items):
                yield f"{section}[{k}]", layout, item


def rule_problems(doc: Any) -> list[tuple[str, str]]:
    """(where, what is wrong) for everything that makes a document unusable; empty for a good one."""
    if not isinstance(doc, dict):
        return [("", "the document is no object")]
    found = [] if doc.get("schema_version") == 1 else [("schema_version", "only version 1 is known")]
    if not KINDS["text"][0](doc.get("ruleset_version")):
        found.append(("ruleset_version", KINDS["text"][1]))
    seen: dict[str, list[tuple[str, str]]] = {}
    for where, layout, value in _places(doc):
        if not isinstance(value, dict):
            found.append((where, "a list of rules, not empty" if where in LISTS else "an object"))
            continue
        for name, kind, required in _fields(layout):
            test, expected = KINDS[kind]
            if name not in value and not required:
                continue
            if not test(value.get(name)):
                found.append((f"{where}.{name}", expected))
                continue
            values = value[name] if kind == "texts" else [value[name]]
            seen.setdefault(f"{where.split('[')[0]}.{name}", []).extend((f"{where}.{name}", v) for v in values)
    for group in ONCE:
        first: set = set()
        for where, v in (x for place in group for x in seen.get(place, [])):
            if v in first:
                found.append((where, f"{v} stands twice"))
            first.add(v)
    return found


def parse_rules(doc: str | dict) -> RuleSet:
    """The rules of a document, given as JSON text or read already; raises InvalidRules with all its problems."""
    if isinstance(doc, str):
        if len(doc.encode("utf-8")) > MAX_RULE_BYTES:
            raise InvalidRules(f"more than {MAX_RULE_BYTES} bytes")
        try:
            doc = json.loads(doc)
        except ValueError as problem:
            raise InvalidRules(f"no JSON: {problem}") from problem
    if problems := rule_problems(doc):
        raise InvalidRules("; ".join(f"{where}: {what}" for where, what in problems))

    def picked(section: str) -> dict:
        return {name: doc[section][name] for name, _, _ in _fields(OBJECTS[section])}

    built_in, api, lifecycle = (picked(f"{x}_defaults") for x in ("node_builtin", "risk_api", "lifecycle"))
    quoted = [
        Rule(
            rule_id=built_in["rule_id_prefix"] + r["symbol"],
            detector="quoted",
            patterns=tuple(r["tokens"]),
            symbol=r["symbol"],
            severity=r["severity"],
            title=built_in["title_prefix"] + r["symbol"],
            **{k: built_in[k] for k in ("category", "confidence", "explanation")},
        )
        for r in doc["node_builtin_rules"]
    ]
    named = [
        Rule(
            patterns=(r["pattern"],),
            suppress_documentation=r.get("suppress_documentation_context", False),
            **{k: r[k] for k in ("rule_id", "detector", "symbol", "severity", "title")},
            **api,
        )
        for r in doc["risk_api_rules"]
    ]
    types = [{name: item[name] for name, _, _ in _fields(LISTS["file_type_rules"])} for item in doc["file_type_rules"]]
    return RuleSet(
        version=doc["ruleset_version"],
        owners=tuple(doc["engine_options"]["process_call_owners"]),
        documentation_markers=tuple(doc["engine_options"]["documentation_context_markers"]),
        line_rules=tuple(quoted + named),
        lifecycle={**lifecycle, "severities": {r["name"]: r["severity"] for r in doc["lifecycle_rules"]}},
        file_types=tuple({**t, "file_types": tuple(t["file_types"])} for t in types),
        package_metadata=picked("package_metadata_rule"),
    )


def load_rules(spark: SparkSession, path: str) -> RuleSet:
    """Rules from a document on any file system that Spark reads; the size is checked before the document is read."""
    found = spark.read.format("binaryFile").load(path)
    size = found.agg(F.max("length"), F.count("path")).first()
    if size[1] != 1:
        raise InvalidRules(f"{size[1]} files at {path}")
    if size[0] > MAX_RULE_BYTES:
        raise InvalidRules(f"more than {MAX_RULE_BYTES} bytes")
    try:
        return parse_rules(bytes(found.select("content").first()[0]).decode("utf-8"))
    except UnicodeDecodeError as problem:
        raise InvalidRules(f"no UTF-8: {problem}") from problem


def rule_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """Line rules as a small table (one row per rule of a checked, size-limited document)."""
    rows = [
        (r.rule_id, r.detector, r.symbol, r.category, r.severity, r.confidence, r.title, r.explanation)
        for r in rules.line_rules
    ]
    names = "rule_id string, detector string, symbol string, category string, severity string, confidence string, title string, explanation string"
    return spark.createDataFrame(rows, names)


def default_document() -> dict:
    """The built-in rule document, in the layout that ``parse_rules`` reads."""
    return builtin_rules.document()


def default_rules() -> RuleSet:
    return parse_rules(default_document())

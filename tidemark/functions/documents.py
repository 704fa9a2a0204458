"""Strict JSON documents: canonical bytes, compact form and the three record shapes.

Catalyst's JSON reader keeps the last of two equal keys and respells numbers, so digests and
strict acceptance need the source text. These are Arrow-batched functions over one text column;
Spark partitions the rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from json.decoder import JSONDecoder, scanstring
from json.encoder import encode_basestring

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Record limits.
MAX_IDENTITY_BYTES = 1024
MAX_OBSERVATION_BYTES = 20 * 1024 * 1024
MAX_INVENTORY_BYTES = 16 * 1024 * 1024
MAX_TOOLS = 1024
MAX_TOOL_NAME_BYTES = 1024
MAX_DEPTH = 64
TARGET_KINDS = ("local_package", "remote_endpoint")
RECORD_MEMBERS = ("description", "repository", "packages", "remotes")
MAX_VERSION_BYTES = 255
EPOCH = "1970-01-01T00:00:00Z"
# End of fixed values.


class _Spelled(str):
    """A number kept exactly as written."""


class Rejected(ValueError):
    pass


_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])T(?:[01][0-9]|2[0-3]):[0-5][0-9]:"
_TIME_59 = re.compile(_DATE + r"[0-5][0-9]Z")
_TIME = re.compile(_DATE + r"(?:[0-5][0-9]|60)Z")
_NAME = re.compile(r"(?=.{3,200}\Z)[A-Za-z0-9.-]+/[A-Za-z0-9._-]+")
_VERSION_TEXT = re.compile(r"[^\x00-\x1f\x7f]+")


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Rejected("duplicate object key")
    return out


def _no_constant(name):
    raise Rejected(f"{name} is not JSON")


_CANONICAL = JSONDecoder(
    object_pairs_hook=_unique, parse_float=_Spelled, parse_int=_Spelled, parse_constant=_no_constant
)
_LENIENT = JSONDecoder(parse_float=str, parse_int=str, parse_constant=_no_constant)  # for the ends of values only
_SPACE = " \t\r\n"


def _spell(value) -> str:
    if value is None:
        return "null"
    if value is True:
        return "true"
    if value is False:
        return "false"
    if isinstance(value, _Spelled):
        return str(value)
    if isinstance(value, str):
        return encode_basestring(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_spell, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-8"))
    return "{" + ",".join(encode_basestring(k) + ":" + _spell(value[k]) for k in keys) + "}"


def canonical_text(text: str) -> str | None:
    """Keys sorted by bytes, no whitespace, numbers as written, shortest escapes."""
    try:
        value, end = _CANONICAL.raw_decode(text, len(text) - len(text.lstrip(_SPACE)))
        if text[end:].strip(_SPACE):
            return None
        out = _spell(value)
        out.encode("utf-8")
        return out
    except (ValueError, RecursionError):
        return None


def build_record(text: str, registry: str, official: str) -> dict:
    """Canonical record of one raw list entry.

    The entry itself is kept whole; its digest covers everything but the digest and the time.
    """
    entry, end = _CANONICAL.raw_decode(text, len(text) - len(text.lstrip(_SPACE)))
    if text[end:].strip(_SPACE) or not isinstance(entry, dict):
        raise Rejected("server list entry must be an object")
    server = entry.get("server")
    if not isinstance(server, dict):
        raise Rejected("server list entry is missing server object")
    name, version = server.get("name"), server.get("version")
    if isinstance(name, _Spelled) or isinstance(version, _Spelled) or not (
        isinstance(name, str) and _NAME.fullmatch(name) and isinstance(version, str) and _VERSION_TEXT.fullmatch(version)
    ) or len(version.encode("utf-8")) > MAX_VERSION_BYTES:
        raise Rejected("server record has invalid name or exact version")
    record = {k: server[k] for k in RECORD_MEMBERS if k in server}
    record.update(
        record_version=_Spelled("1"), registry=registry, server_identifier=name, server_version=version, original=entry
    )
    digest = hashlib.sha256(_spell(record).encode("utf-8")).hexdigest()
    meta = entry.get("_meta")
    times = meta.get(official) if isinstance(meta, dict) else None
    times = times if isinstance(times, dict) else {}
    stamps = [times.get(k) for k in ("updatedAt", "publishedAt")]
    good = [t for t in stamps if isinstance(t, str) and not isinstance(t, _Spelled) and _TIME_59.fullmatch(t)]
    observed = good[0] if good else EPOCH
    record.update(observed_at=observed, canonical_sha256=digest)
    return {
        "server_identifier": name,
        "server_version": version,
        "observed_at": observed,
        "canonical_sha256": digest,
        "canonical_json": _spell(record),
    }


_OUTSIDE = re.compile(r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|[ \t\r\n]+', re.S)


def compact_text(text: str) -> str:
    return _OUTSIDE.sub(r"\1", text)


_KEY = re.compile(r'[ \t\r\n]*"([^"\\\x00-\x1f]*+)"[ \t\r\n]*:[ \t\r\n]*')
_NEXT = re.compile(r"[ \t\r\n]*([,}])")


def _members(text: str, start: int):
    """Members of the object at ``start`` as (key, value start, value end); then its end."""
    found, pos = [], start + 1

    def skip(p):
        while p < len(text) and text[p] in _SPACE:
            p += 1
        return p

    pos = skip(pos)
    if text[pos : pos + 1] == "}":
        return found, pos + 1
    while True:
        if member := _KEY.match(text, pos):
            key, pos = member[1], member.end()
        else:  # the scanner says what is wrong
            pos = skip(pos)
            if text[pos : pos + 1] != '"':
                raise Rejected("expected JSON string")
            key, after = scanstring(text, pos + 1, True)
            if after - pos - 2 != len(key):
                raise Rejected("escaped characters are not supported in member names")
            pos = skip(after)
            if text[pos : pos + 1] != ":":
                raise Rejected("expected ':' after member")
            pos = skip(pos + 1)
        _, end = _LENIENT.raw_decode(text, pos)
        found.append((key, pos, end))
        if after := _NEXT.match(text, end):
            if after[1] == "}":
                return found, after.end()
            pos = after.end()
            continue
        raise Rejected("expected ',' or '}'")


def _required(text: str, start: int, names: tuple[str, ...], what: str):
    if text[start : start + 1] != "{":
        raise Rejected(f"{what} must be a JSON object")
    found, end = _members(text, start)
    spans = {}
    for key, begin, stop in found:
        if key in names:
            if key in spans:
                raise Rejected(f"duplicate {key}")
            spans[key] = (begin, stop)
    if len(spans) != len(names):
        raise Rejected(f"{what} is missing required fields")
    return spans, end


def _identity(text: str, span, limit: int = MAX_IDENTITY_BYTES) -> str:
    raw = text[span[0] : span[1]]
    if not raw.startswith('"') or "\\" in raw:
        raise Rejected("identity must be a plain JSON string")
    if len(raw) == 2:
        raise Rejected("identity string must not be empty")
    if len(raw[1:-1].encode("utf-8")) > limit:
        raise Rejected("identity string exceeds configured limit")
    return raw[1:-1]


def _version_one(text: str, span, name: str) -> None:
    raw = text[span[0] : span[1]]
    if not raw.isascii() or not raw.isdigit():
        raise Rejected(f"{name} must be an unsigned integer")
    if int(raw) != 1:
        raise Rejected(f"unsupported {name}")


_NOT_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[^\[\]{}"]+', re.S)


def _bounded_depth(text: str, span) -> None:
    if text.count("[", *span) + text.count("{", *span) <= MAX_DEPTH:
        return
    depth = 0
    for c in _NOT_BRACKETS.sub("", text[span[0] : span[1]]):
        depth += 1 if c in "[{" else -1
        if depth > MAX_DEPTH:
            raise Rejected("JSON nesting exceeds configured limit")


def _body(text: str, limit: int) -> int:
    if not text.isascii() or len(text) > limit:
        if len(text.encode("utf-8")) > limit:  # a lone surrogate is an error
            raise Rejected("document exceeds configured byte limit")
    return len(text) - len(text.lstrip(_SPACE))


def _only(text: str, end: int, what: str) -> None:
    if text[end:].strip(_SPACE):
        raise Rejected(f"unexpected data after {what}")


def _inventory(text: str) -> tuple[str, list[dict]]:
    start = _body(text, MAX_INVENTORY_BYTES)
    spans, end = _required(text, start, ("inventory_version", "server", "tools"), "inventory")
    _only(text, end, "inventory")
    _bounded_depth(text, (start, end))
    _version_one(text, spans["inventory_version"], "inventory_version")
    server, _ = _required(text, spans["server"][0], ("downstream_executable",), "server")
    executable = _identity(text, server["downstream_executable"])
    tools, pos = [], spans["tools"][0]
    if text[pos : pos + 1] != "[":
        raise Rejected("tools must be an array")
    pos += 1
    while True:
        while text[pos] in _SPACE + ",":
            pos += 1
        if text[pos] == "]":
            break
        if len(tools) >= MAX_TOOLS:
            raise Rejected("tool count exceeds configured limit")
        member, end = _required(text, pos, ("name",), "tool definition")
        name = _identity(text, member["name"], MAX_TOOL_NAME_BYTES)
        tools.append({"name": name, "definition": text[pos:end]})
        pos = end
    names = [t["name"].encode("utf-8") for t in tools]
    if names != sorted(names):
        raise Rejected("tools must be sorted by name")
    if len(set(names)) != len(names):
        raise Rejected("duplicate tool name")
    return executable, tools


def parse_observation(text: str) -> dict:
    start = _body(text, MAX_OBSERVATION_BYTES)
    names = (
        "observation_version",
        "observed_at",
        "target_id",
        "source_type",
        "sensor",
        "configuration_profile",
        "inventory",
    )
    spans, end = _required(text, start, names, "observation")
    _only(text, end, "observation")
    _bounded_depth(text, (start, end))
    observed_at = _identity(text, spans["observed_at"])
    if not _TIME.fullmatch(observed_at):
        raise Rejected("observed_at must use YYYY-MM-DDTHH:MM:SSZ")
    sensor, _ = _required(text, spans["sensor"][0], ("name", "version"), "sensor")
    _version_one(text, spans["observation_version"], "observation_version")
    inventory_text = text[slice(*spans["inventory"])]
    executable, tools = _inventory(inventory_text)
    return {
        "observed_at": observed_at,
        "target_id": _identity(text, spans["target_id"]),
        "source_type": _identity(text, spans["source_type"]),
        "sensor_name": _identity(text, sensor["name"]),
        "sensor_version": _identity(text, sensor["version"]),
        "configuration_profile": _identity(text, spans["configuration_profile"]),
        "executable": executable,
        "tools": tools,
        "inventory_json": compact_text(inventory_text),
    }


def parse_inventory(text: str) -> dict:
    executable, tools = _inventory(text)
    return {"executable": executable, "tools": tools}


def parse_target(text: str) -> dict:
    start = _body(text, MAX_OBSERVATION_BYTES)
    spans, end = _required(text, start, ("schema_version", "target_id", "source_type", "kind"), "record")
    _only(text, end, "record")
    _version_one(text, spans["schema_version"], "schema_version")
    kind = text[slice(*spans["kind"])][1:-1]
    if kind not in TARGET_KINDS:
        raise Rejected("kind must be local_package or remote_endpoint")
    return {
        "target_id": _identity(text, spans["target_id"], MAX_OBSERVATION_BYTES),
        "source_type": _identity(text, spans["source_type"], MAX_OBSERVATION_BYTES),
        "kind": kind,
    }


#: Texts that are Python objects at one time, with what they become: Arrow batches are bounded by rows as well.
ROWS_AT_ONCE = 500
_TOOLS = "array<struct<name:string,definition:string>>"
OBSERVATION = (
    "error string, observed_at string, target_id string, source_type string, sensor_name string, "
    f"sensor_version string, configuration_profile string, executable string, tools {_TOOLS}, "
    "inventory_json string"
)
INVENTORY = f"error string, executable string, tools {_TOOLS}"
RECORD = (
    "error string, server_identifier string, server_version string, observed_at string, "
    "canonical_sha256 string, canonical_json string"
)
TARGET = "error string, target_id string, source_type string, kind string"


def _strict(parse, ddl: str):
    """UDF of a parser. A filter on its error must not evaluate it once more below the filter: deterministic ones are copied there."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_type(schema)
    names = schema.names

    def row(text):
        out = dict.fromkeys(names)
        try:
            if text is None:
                raise Rejected("missing text")
            out.update(parse(text))
        except (ValueError, IndexError, RecursionError) as problem:
            out["error"] = str(problem) or type(problem).__name__
        return out

    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for start in range(0, len(texts), ROWS_AT_ONCE):
                yield pa.array([row(text) for text in texts.slice(start, ROWS_AT_ONCE).to_pylist()], arrow)

    return F.arrow_udf(rows, schema).asNondeterministic()


def strict_observation():
    """UDF: text -> struct with ``error`` NULL for an acceptable observation."""
    return _strict(parse_observation, OBSERVATION)


def record_builder(registry: str, official: str):
    """UDF: raw entry text -> identity, digest, time and canonical text, or ``error``."""
    return _strict(lambda text: build_record(text, registry, official), RECORD)


def strict_inventory():
    return _strict(parse_inventory, INVENTORY)


def strict_target():
    return _strict(parse_target, TARGET)


def _text_udf(function):
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore").astype(object)

    return F.pandas_udf(apply, T.StringType())


def item_texts(text: str, member: str) -> list[str] | None:
    """Items of an array member of a JSON object, each exactly as written; None if there is no such array."""
    try:
        start = len(text) - len(text.lstrip(_SPACE))
        spans, _ = _required(text, start, (member,), "document")
        pos, end = spans[member]
        if text[pos] != "[":
            return None
        items, pos = [], pos + 1
        while True:
            while text[pos] in _SPACE or text[pos] == ",":
                pos += 1
            if text[pos] == "]":
                return items
            _, stop = _LENIENT.raw_decode(text, pos)
            items.append(text[pos:stop])
            pos = stop
    except (ValueError, IndexError, RecursionError):
        return None


def item_list(member: str):
    """UDF: JSON object -> the items of one array member as texts. A parser would respell their numbers."""

    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: item_texts(t, member), na_action="ignore").astype(object)

    return F.pandas_udf(apply, T.ArrayType(T.StringType()))


def canonical_json():
    """UDF: JSON text -> canonical JSON text, NULL when the text is not strict JSON."""
    return _text_udf(canonical_text)


def compact_json():
    """Column function: JSON text without the white space outside strings."""
    return lambda c: F.regexp_replace(c, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|[ \t\r\n]+', "$1")

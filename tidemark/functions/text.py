"""String, byte and version expressions. Everything here is a JVM-side column expression."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets, limits and label aliases that results depend on.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SNIPPET_BYTES = 240
MESSAGE_BYTES = 2048
ERROR_MESSAGE_BYTES = 1000
MINIFIED_MIN_BYTES = 4096
MINIFIED_MAX_NEWLINES = 3
MAX_UINT64 = "18446744073709551615"
PRERELEASE_KINDS = {
    0: ("a", "alpha"),
    1: ("b", "beta"),
    2: ("rc", "c", "pre", "preview"),
}
# End of fixed values.


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lower_ascii(value: Column | str) -> Column:
    """Lower-case A-Z only; ``lower`` would also fold other alphabets."""
    return F.translate(col(value), UPPER, LOWER)


def percent_encode(value: Column | str) -> Column:
    """Percent-encode all but RFC 3986 unreserved characters, upper-case hex digits."""
    out = F.url_encode(col(value))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def quote_pattern(literal: str) -> str:
    """Regular expression for a literal text."""
    return re.sub(r"([^A-Za-z0-9_\x80-\U0010ffff])", r"\\\1", literal)


def contains_ascii_ci(value: Column | str, needle: str) -> Column:
    """Substring test that folds A-Z only, like ``(?i)`` without its Unicode flag."""
    return col(value).rlike("(?i)" + quote_pattern(needle))


def startswith_ascii_ci(value: Column | str, needle: str) -> Column:
    return col(value).rlike(r"(?i)\A" + quote_pattern(needle))


def query_terms(query: str) -> list[str]:
    """Split a search text on ASCII non-alphanumerics; other alphabets stay inside a term."""
    return [t for t in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", query) if t]


WORD = r"[\p{L}\p{N}]"


def prefix_count(lowered: Column, term: str) -> Column:
    """Number of words of a lower-cased text that start with ``term``."""
    pattern = rf"(?<!{WORD}){quote_pattern(term)}"
    return F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(pattern))).otherwise(0)


def word_count(lowered: Column) -> Column:
    return F.regexp_count(lowered, F.lit(WORD + "+"))


def tokens(value: Column | str) -> Column:
    """Lower-cased word tokens of a text, as an array without empty entries."""
    parts = F.split(F.lower(F.coalesce(col(value), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def joined_in_order(items: Column, field: str) -> Column:
    """Space-joined ``field`` of an ordered array of structs, nulls left out."""
    return F.array_join(F.transform(items, lambda s: s[field]), " ")


def normalize_project_name(name: Column | str) -> Column:
    """Python package name normal form, NULL for a name that is not allowed."""
    c = col(name)
    valid = c.rlike(r"\A[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?\z") & (F.octet_length(c) <= 512)
    return F.when(valid, lower_ascii(F.regexp_replace(c, r"[-_.]+", "-")))


_VERSION = r"\A[vV]?([0-9]+(?:\.[0-9]+)*)(?:[._-]?([A-Za-z]+)[._-]?([0-9]*))?\z"


def version_identity(version: Column | str) -> Column:
    """``struct(release, kind, serial)`` of a Python version, NULL when it has another form."""
    c = col(version)
    label = lower_ascii(F.regexp_extract(c, _VERSION, 2))
    kind = reduce(
        lambda acc, item: acc.when(label.isin(*item[1]), F.lit(item[0])),
        list(PRERELEASE_KINDS.items())[1:],
        F.when(label.isin(*PRERELEASE_KINDS[0]), F.lit(0)),
    )
    digits = F.regexp_replace(F.regexp_extract(c, _VERSION, 1), r"(?:\.0+)+\z", "")
    top = F.lit(MAX_UINT64).cast("decimal(38,0)")
    release = F.transform(F.split(digits, r"\."), lambda d: d.try_cast("decimal(38,0)"))
    serial_text = F.regexp_extract(c, _VERSION, 3)
    serial = (
        F.when(label == "", F.lit(None).cast("decimal(38,0)"))
        .when(serial_text == "", F.lit(0).cast("decimal(38,0)"))
        .otherwise(serial_text.try_cast("decimal(38,0)"))
    )
    fits = F.forall(release, lambda d: d.isNotNull() & (d <= top)) & (
        (label == "") | (serial.isNotNull() & (serial <= top))
    )
    ok = (
        c.rlike(_VERSION)
        & (F.octet_length(c) <= 512)
        & ((label == "") | kind.isNotNull())
        & fits
    )
    return F.when(
        ok, F.struct(release.alias("release"), kind.alias("kind"), serial.alias("serial"))
    )


def versions_equivalent(left: Column | str, right: Column | str) -> Column:
    a, b = version_identity(left), version_identity(right)
    same = (
        a.isNotNull()
        & b.isNotNull()
        & (a["release"] == b["release"])
        & a["kind"].eqNullSafe(b["kind"])
        & a["serial"].eqNullSafe(b["serial"])
    )
    return (col(left) == col(right)) | F.coalesce(same, F.lit(False))


def file_extension(path: Column | str) -> Column:
    return lower_ascii(F.regexp_extract(col(path), r"(\.[^./]*)\z", 1))


def normalize_archive_path(path: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(path), "\\", "/"), r"\A/+", "")


def newline_count(value: Column | str) -> Column:
    c = col(value)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def looks_minified(value: Column | str) -> Column:
    c = col(value)
    return (F.octet_length(c) > MINIFIED_MIN_BYTES) & (newline_count(c) < MINIFIED_MAX_NEWLINES)


def byte_prefix(value: Column | str, limit: int) -> Column:
    """Longest prefix of at most ``limit`` UTF-8 bytes that ends on a character boundary."""
    c = col(value)
    raw = F.encode(c, "UTF-8")

    def continuation(position: int) -> Column:
        return F.hex(F.substring(raw, position, 1)).between("80", "BF")

    end = (
        F.when(~continuation(limit + 1), F.lit(limit))
        .when(~continuation(limit), F.lit(limit - 1))
        .when(~continuation(limit - 1), F.lit(limit - 2))
        .otherwise(F.lit(limit - 3))
    )
    cut = F.decode(F.substring(raw, F.lit(1), end), "UTF-8")
    return F.when(F.octet_length(c) <= limit, c).otherwise(cut)


def bound_snippet(value: Column | str, limit: int = SNIPPET_BYTES) -> Column:
    c = col(value)
    cut = F.concat(byte_prefix(c, limit), F.lit("..."))
    return F.when(F.octet_length(c) <= limit, c).otherwise(cut)


def bounded_message(value: Column | str, limit: int = MESSAGE_BYTES) -> Column:
    c = col(value)
    cut = F.concat(byte_prefix(c, limit), F.lit("…"))
    return F.when(F.octet_length(c) <= limit, c).otherwise(cut)


def displayable_utf8(content: Column | str) -> Column:
    """True for bytes that are valid UTF-8 and hold no NUL."""
    c = col(content)
    text = c.cast("string")
    return F.is_valid_utf8(text) & ~F.contains(c, F.lit(b"\x00"))


def digest_prefix(digest: Column | str, size: int = 16) -> Column:
    return F.substring(col(digest), 1, size)


def recency_key(updated: Column | str, published: Column | str) -> Column:
    return F.coalesce(col(updated), col(published), F.lit(""))


def throughput(elapsed: Column, processed: Column, queued: Column) -> Column:
    """Mean seconds per record and estimated seconds for the rest; NULL before any work."""
    mean = elapsed / F.nullif(processed, F.lit(0))
    return F.struct(
        F.round(mean, 3).alias("mean_seconds_per_processed_record"),
        F.round(mean * queued).cast("bigint").alias("estimated_remaining_seconds"),
    )


def retry_due(last_attempt: Column | str, now: str, delay_seconds: int) -> Column:
    """True when never tried, or last tried at least ``delay_seconds`` before ``now``."""
    c = col(last_attempt)
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(delay_seconds))
    return c.isNull() | F.coalesce(F.try_to_timestamp(c) <= cutoff, F.lit(False))

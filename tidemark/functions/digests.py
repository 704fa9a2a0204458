"""Digest expressions and published-integrity checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, lower_ascii


def sha256_hex(content: Column | str) -> Column:
    return F.sha2(col(content), 256)


def subresource_integrity(content: Column | str, bits: int = 512) -> Column:
    """``sha512-<base64>`` form of a digest."""
    return F.concat(F.lit(f"sha{bits}-"), F.base64(F.unhex(F.sha2(col(content), bits))))


def npm_integrity_error(content: Column | str, published: Column | str) -> Column:
    """NULL when ``content`` matches the published ``algorithm-base64`` text."""
    pub = col(published)
    dash = F.position(F.lit("-"), pub)
    algorithm = F.substring(pub, F.lit(1), dash - 1)
    decoded = F.hex(F.try_to_binary(F.substring(pub, dash + 1, F.lit(2**31 - 1)), F.lit("base64")))
    expected = F.when(algorithm == "sha512", F.upper(F.sha2(col(content), 512))).when(
        algorithm == "sha256", F.upper(F.sha2(col(content), 256))
    )
    return (
        F.when(pub.isNull() | (dash == 0), "invalid npm integrity format")
        .when(decoded.isNull(), "invalid npm integrity encoding")
        .when(expected.isNull(), "unsupported npm integrity algorithm")
        .when(decoded != expected, "npm integrity mismatch")
    )


def pypi_integrity_error(content: Column | str, published_sha256: Column | str, size: Column | str) -> Column:
    pub = col(published_sha256)
    return (
        F.when(F.octet_length(col(content)) != col(size), "PyPI artifact size does not match release metadata")
        .when(~F.coalesce(pub.rlike(r"\A[0-9A-Fa-f]{64}\z"), F.lit(False)), "invalid PyPI SHA-256 digest")
        .when(lower_ascii(pub) != F.sha2(col(content), 256), "PyPI SHA-256 integrity mismatch")
    )


def content_address(digest: Column | str, root: str = "sha256") -> Column:
    """``sha256/<aa>/<digest>``."""
    d = col(digest)
    return F.concat(F.lit(root + "/"), F.substring(d, 1, 2), F.lit("/"), d)


def profile_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the compact JSON object of the fields in name order."""
    ordered = [fields[name].cast("string").alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)

"""Golden values of the expressions."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import checks, digests, documents, text, urls


def values(spark, rows, expression, name="v"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col(name))).collect()]


@pytest.mark.parametrize(
    ("left", "right", "same"),
    [
        ("0.1.227-beta", "0.1.227b0", True),
        ("1.0-beta", "1.0b0", True),
        ("1.0-beta1", "1.0b1", True),
        ("1.0-alpha", "1.0a0", True),
        ("1.0-rc1", "1.0rc1", True),
        ("1.0-preview2", "1.0rc2", True),
        ("v1.0-beta", "1.0b0", True),
        ("1.0.0-beta", "1.0b0", True),
        ("1.0", "1.0b0", False),
        ("1.0b1", "1.0b2", False),
        ("1.0rc1", "1.0", False),
        ("1.0.post1", "1.0post1", False),
        ("18446744073709551615", "18446744073709551615.0", True),
        ("18446744073709551616", "18446744073709551616.0", False),
        ("1.0.", "1.0", False),
        ("odd", "odd", True),
    ],
)
def test_version_equivalence(spark, left, right, same):
    row = spark.range(1).select(text.versions_equivalent(F.lit(left), F.lit(right)).alias("v")).first()
    assert row.v is same


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://GitHub.com/o/r.git?x#y", ("https", "github.com", None, "o", "r")),
        ("https://github.com/o/r/", ("https", "github.com", None, None, None)),
        ("https://github.com/o/r/s", ("https", "github.com", None, None, None)),
        ("https://github.com/o/.git", ("https", "github.com", None, None, None)),
        ("https://gitlab.com:443/o/r", ("https", "gitlab.com", 443, "o", "r")),
        ("https://github.com?o/r", ("https", "github.com", None, "o", "r")),
        ("HTTP://[::1]:80/x", ("http", "[::1]", 80, None, None)),
        ("http://[::1", ("http", None, None, None, None)),
        ("http://user@h/x", ("http", None, None, None, None)),
        ("http://h:70000/", ("http", None, None, None, None)),
        ("http://h:0/", ("http", "h", 0, None, None)),
        ("http://:80/", ("http", None, 80, None, None)),
        ("http://h:/", ("http", None, None, None, None)),
        ("http:///x", ("http", None, None, None, None)),
        ("://h", (None, None, None, None, None)),
        ("plain", (None, None, None, None, None)),
        (None, (None, None, None, None, None)),
    ],
)
def test_url_parts(spark, url, want):
    row = spark.range(1).select(urls.url_parts(F.lit(url).cast("string"), True).alias("u")).first().u
    assert (row.scheme, row.host, row.port, row.owner, row.repository_name) == want


@pytest.mark.parametrize(
    ("url", "normalized"),
    [
        ("HTTPS://Registry.Example:443/base//", "https://registry.example/base"),
        ("https://registry.example:8443", "https://registry.example:8443"),
        ("http://localhost:8080/x", "http://localhost:8080/x"),
        ("https://registry.example/", "https://registry.example/"),
        ("http://registry.example", None),
        ("https://u@registry.example", None),
        ("https://registry.example?x", None),
        ("https://registry.example/#f", None),
        ("https://registry.example:0", None),
        ("https://a:b:1", None),
        ("https://[::1]:9/x", "https://[::1]:9/x"),
        ("ftp://x", None),
        ("", None),
    ],
)
def test_registry_base(spark, url, normalized):
    row = spark.range(1).select(urls.registry_base(F.lit(url)).alias("u")).first().u
    assert row.normalized == normalized
    assert (row.error is None) == (normalized is not None)


def test_timestamps_allow_impossible_days(spark):
    rows = ["2024-02-31T00:00:00Z", "2024-01-01T00:00:60Z", "24-07-2026", None, "2024-13-01T00:00:00Z"]
    assert values(spark, rows, checks.valid_utc_timestamp) == [True, False, False, False, False]
    assert values(spark, rows, lambda c: checks.valid_utc_timestamp(c, 60)) == [True, True, False, False, False]


def test_snippet_ends_on_a_character(spark):
    got = values(spark, ["é" * 121, "x" * 241, "x" * 239 + "é", "short"], text.bound_snippet)
    assert got == ["é" * 120 + "...", "x" * 240 + "...", "x" * 239 + "...", "short"]


def test_ascii_folding_leaves_other_letters(spark):
    assert values(spark, ["ÀBc\u212a"], text.lower_ascii) == ["Àbc\u212a"]
    assert values(spark, ["\u212aelvin", "KELVIN 100%"], lambda c: text.contains_ascii_ci(c, "kelvin 1")) == [False, True]


def test_project_names(spark):
    got = values(spark, ["Demo_PyPI", "a..b--c", "-bad", "bad-", "a b", ""], text.normalize_project_name)
    assert got == ["demo-pypi", "a-b-c", None, None, None, None]


def test_integrity(spark):
    df = spark.createDataFrame([(b"data",)], "b binary")
    sri = df.select(digests.subresource_integrity("b")).first()[0]
    row = df.select(
        digests.npm_integrity_error("b", F.lit(sri)).alias("ok"),
        digests.npm_integrity_error("b", F.lit("sha512-AAAA")).alias("bad"),
        digests.npm_integrity_error("b", F.lit("sha512-***")).alias("enc"),
    ).first()
    assert (row.ok, row.bad, row.enc) == (None, "npm integrity mismatch", "invalid npm integrity encoding")


@pytest.mark.parametrize(
    ("registry", "transport", "identifier", "version", "code"),
    [
        ("npm", "stdio", "p", "1", None),
        (" NPM ", "STDIO", "p", "1", None),
        ("oci", "stdio", "p", "1", "unsupported_ecosystem"),
        ("npm", "sse", "p", "1", "unsupported_transport"),
        ("npm", "stdio", " ", "1", "missing_package_identifier"),
        ("npm", "stdio", "p", None, "missing_exact_version"),
    ],
)
def test_runtime_eligibility(spark, registry, transport, identifier, version, code):
    cells = [F.lit(x).cast("string") for x in (registry, transport, identifier, version)]
    assert spark.range(1).select(checks.runtime_eligibility(*cells)["reason_code"]).first()[0] == code


def test_canonical_json():
    assert documents.canonical_text('{"b": 1.0, "a": [1e3, "\\u00e9\\u001f\\/"]}') == '{"a":[1e3,"é\\u001f/"],"b":1.0}'
    assert documents.canonical_text('{"a":1,"a":2}') is None
    assert documents.canonical_text('{"a":NaN}') is None
    assert documents.canonical_text('{"a":"\\ud800"}') is None
    assert documents.canonical_text("{} x") is None


def test_compact_keeps_strings():
    assert documents.compact_text('{ "a b" : "c \\" d" ,\n "e":[ 1 ] }') == '{"a b":"c \\" d","e":[1]}'


GOOD = (
    '{"observation_version":1,"observed_at":"2026-07-24T20:15:60Z","target_id":"t","source_type":"s",'
    '"sensor":{"name":"n","version":"1"},"configuration_profile":"p","extra":{"x":[1]},'
    '"inventory":{"inventory_version":1,"server":{"downstream_executable":"npx"},'
    '"tools":[{"name":"a","d":1},{ "name":"b" }]}}'
)


def test_strict_observation():
    row = documents.parse_observation(GOOD)
    assert [t["definition"] for t in row["tools"]] == ['{"name":"a","d":1}', '{ "name":"b" }']
    assert row["inventory_json"].endswith('{"name":"b"}]}')


@pytest.mark.parametrize(
    "change",
    [
        ('"target_id":"t",', ""),
        ('"target_id":"t",', '"target_id":"t","target_id":"t",'),
        ('"target_id":"t"', '"target_id":""'),
        ('"target_id":"t"', '"target_id":"\\u0074"'),
        ("2026-07-24T20:15:60Z", "24-07-2026"),
        ('"observation_version":1', '"observation_version":2'),
        ('{ "name":"b" }', '{"name":"a"}'),
        ('"a","d":1', '"c","d":1'),
        ('"extra":{"x":[1]}', '"extra":' + "[" * 70 + "]" * 70),
        ('"inventory_version":1', '"inventory_version":1,"inventory_version":1'),
    ],
)
def test_observation_rejects(change):
    with pytest.raises(ValueError):
        documents.parse_observation(GOOD.replace(*change))

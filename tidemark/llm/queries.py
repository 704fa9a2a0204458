"""Registered queries of the subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, centroids, contamination, jaccard, language, licenses, mixing, perfect, quality, suffixes, tokens, urls, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return keep


@registered()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered()
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@registered()
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_report(table(spark, sf_dir, "documents"))


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@registered(f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
phrases AS (
    SELECT DISTINCT item_id, list_slice(w, k, k + 9) AS p FROM (
        SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(p) AS n FROM phrases),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d WHERE len(w) > 0),
found AS (
    SELECT s.doc_id, s.k, l.n, p.item_id FROM starts s JOIN lengths l ON s.k + l.n - 1 <= len(s.w)
    JOIN phrases p ON p.p = list_slice(s.w, s.k, s.k + l.n - 1)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM found) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Shares of tokens that the mixture is to have. The languages are the domains: source names say nothing about the text here.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def by_language(documents: DataFrame) -> DataFrame:
    """The labelled table of the mixing queries."""
    return documents.select("doc_id", F.col("lang").alias("domain"))


@registered()
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mixing.rates(documents, by_language(documents), TARGETS)


@registered()
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


@registered()
def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@registered()
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


@registered("""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(root.b, e.vec_id)) AS component_id,
    e.vec_id = least(e.vec_id, coalesce(root.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN root ON root.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""")
def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _host_sql(url: str) -> str:
    return LOWER.format(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)")


def _address_sql(url: str) -> str:
    tail = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN {_host_sql(url)} <> '' THEN {_host_sql(url)} || CASE WHEN starts_with({tail}, '/') THEN '' ELSE '/' END || {tail} END"


def _attribute_sql(tag: str, name: str, stop: str) -> str:
    pattern = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>{stop}]+))"""
    groups = ", ".join(f"regexp_extract({tag}, '{pattern}', {k})" for k in (1, 2, 3))
    return f"trim(concat({groups}))"


#: Links are read from the pages as the operator's docstring says, and followed in both directions without end.
URL_SQL = rf"""
WITH RECURSIVE rules(action, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
named AS (SELECT url, html, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE {_address_sql("url")} IS NOT NULL),
tags AS (
    SELECT * EXCLUDE (html, tag), {_attribute_sql("tag", "href", "")} AS link FROM (
        SELECT *, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b[^>]*>')) AS tag FROM named)
    UNION ALL SELECT * EXCLUDE (html, tag), {_attribute_sql("replace(tag, '&quot;', chr(34))", "url", ";")} FROM (
        SELECT *, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>')) AS tag FROM named)),
links AS (SELECT * REPLACE (replace(link, '&amp;', '&') AS link) FROM tags),
targets AS (SELECT url, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
    WHEN starts_with(link, '/') THEN site || link WHEN starts_with(link, '?') THEN site || path || link
    WHEN link <> '' AND NOT starts_with(link, '#') THEN site || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)?') END || link END AS target FROM links),
pairs AS (SELECT {_address_sql("url")} AS a, {_address_sql("target")} AS b FROM targets),
edges AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
nodes AS (SELECT DISTINCT a AS address, regexp_extract(a, '^[^/?#]*') AS host, regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM edges),
judged AS (SELECT page_id, {_address_sql("url")} AS address, coalesce({_host_sql("url")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
asked AS (SELECT host, path FROM judged UNION SELECT host, path FROM nodes),
best AS (SELECT q.host, q.path, arg_max(r.host || r.path, length(r.host || r.path) * 2 + (action = 'allow')::INT) AS rule,
        arg_max(action, length(r.host || r.path) * 2 + (action = 'allow')::INT) AS action
    FROM asked q JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY q.host, q.path),
blocking AS (SELECT address FROM nodes JOIN best USING (host, path) WHERE action = 'block'),
blocked AS (SELECT DISTINCT r.a AS address FROM reach r JOIN blocking k ON k.address = r.b)
SELECT page_id, j.host, j.path, rule, coalesce(action, CASE WHEN blocked.address IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN best ON best.host = j.host AND best.path = j.path LEFT JOIN blocked ON blocked.address = j.address
"""


@registered(URL_SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"), RULES)


@registered(f"""
WITH d AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
    row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
""")
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row takes part: about half of them, by a digest of the id, are the history, the others come in."""
    historical = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return perfect.exact_duplicates(table(spark, sf_dir, "documents"), historical).drop("historical", "known")


def _cluster_sql(rounds: int = 10) -> str:
    """Lloyd's rounds with full distances, one after the other."""
    nearest = """{name} AS MATERIALIZED (
    SELECT vec_id, x, arg_min(k, d * 1000 + k) AS cluster, min(d) AS distance FROM (
        SELECT v.vec_id, v.x, c.k, list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c.c[j]) * (v.x[j] - c.c[j])))::BIGINT AS d
        FROM v CROSS JOIN c{r} c) GROUP BY vec_id, x)"""
    moved = """c{n} AS MATERIALIZED (
    SELECT c.k, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (
        SELECT cluster, list(part ORDER BY j) AS c FROM (
            SELECT cluster, j, ((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS part
            FROM a{r}, range(1, 65) AS parts(j) GROUP BY cluster, j) GROUP BY cluster) m ON m.cluster = c.k)"""
    steps = []
    for r in range(rounds):
        steps += [nearest.format(name=f"a{r}", r=r), moved.format(r=r, n=r + 1)]
    return f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, [floor(1024 * y::DOUBLE)::BIGINT FOR y IN embedding] AS x FROM embeddings
    WHERE len(embedding) = 64 AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
{", ".join(steps)}, {nearest.format(name="last", r=rounds)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM last JOIN c{rounds} c ON c.k = last.cluster
"""


@registered(_cluster_sql())
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)


def both_vocabularies() -> tuple[alignment.ByteBpe, alignment.PieceBpe]:
    """The encoders of the alignment query, made in each task."""
    path = public_tokenizers.path
    return (
        alignment.ByteBpe(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        alignment.PieceBpe(path("piece_bpe_32k.model")),
    )


@registered()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), both_vocabularies)

"""Catalog exploration: summaries, filters, listing, search, display."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.urls import url_parts
from ..schemas import CANONICAL_RECORD
from ..session import spread, staged
from .ordering import newest_per_key

# Page sizes and the published BM25 parameters.
MAX_SEARCH_LIMIT = 500
MAX_LIST_LIMIT = 1000
DEFAULT_SEARCH_LIMIT = 20
DEFAULT_LIST_LIMIT = 50
BM25_K1 = 1.2
BM25_B = 0.75
# End of fixed values.


@dataclass
class Catalog:
    """The flat catalog tables (see schemas for their columns)."""

    snapshots: DataFrame
    versions: DataFrame
    links: DataFrame
    repositories: DataFrame
    packages: DataFrame
    remotes: DataFrame
    environment: DataFrame | None = None


def pruned(cat: Catalog, members: DataFrame) -> Catalog:
    """The catalog with the children of the member versions only, so that no history is folded.

    The semi-joins use the key of the aggregation above them, which then needs no further shuffle.
    """
    ids = members.select("server_version_id")

    def own(children: DataFrame) -> DataFrame:
        return children.join(ids, "server_version_id", "left_semi")

    return replace(cat, repositories=own(cat.repositories), packages=own(cat.packages), remotes=own(cat.remotes))


@dataclass
class Filters:
    """Metadata conditions, combined with AND. NULL fields do not restrict."""

    status: str | None = None
    transport: str | None = None
    package_registry: str | None = None
    repository_host: str | None = None
    remote_host: str | None = None
    has_repository: bool = False
    without_repository: bool = False
    has_package: bool = False
    has_remote: bool = False

    def check(self) -> None:
        if self.has_repository and self.without_repository:
            raise ValueError("has_repository contradicts without_repository")


def _equals(column: str, value: str | None) -> Column:
    return F.lit(False) if value is None else F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def _has(column: str, needle: str | None) -> Column:
    if needle is None:
        return F.lit(False)
    return F.coalesce(text.contains_ascii_ci(column, needle), F.lit(False))


def child_facts(cat: Catalog, filters: Filters = Filters(), needle: str | None = None, environment: bool = False) -> DataFrame:
    """Per version: child counts and whether any child meets each condition.

    The rows of all child tables go through one aggregation keyed by version, combined before
    the shuffle, instead of one semi-join per condition.
    """
    host = filters.repository_host and filters.repository_host.lower()
    remote_host = filters.remote_host and filters.remote_host.lower()
    no, zero = F.lit(False), F.lit(0)
    packages = cat.packages.select(
        "server_version_id",
        F.lit(1).alias("p"),
        zero.alias("r"),
        zero.alias("o"),
        zero.alias("e"),
        _equals("transport", filters.transport).alias("transport_hit"),
        _equals("registry_type", filters.package_registry).alias("registry_hit"),
        no.alias("repo_host_hit"),
        no.alias("remote_host_hit"),
        _has("identifier", needle).alias("text_hit"),
    )
    remotes = cat.remotes.select(
        "server_version_id",
        zero.alias("p"),
        F.lit(1).alias("r"),
        zero.alias("o"),
        zero.alias("e"),
        _equals("transport", filters.transport).alias("transport_hit"),
        no.alias("registry_hit"),
        no.alias("repo_host_hit"),
        _equals("host", remote_host).alias("remote_host_hit"),
        (_has("url", needle) | _has("host", needle)).alias("text_hit"),
    )
    repositories = cat.repositories.select(
        "server_version_id",
        zero.alias("p"),
        zero.alias("r"),
        F.lit(1).alias("o"),
        zero.alias("e"),
        no.alias("transport_hit"),
        no.alias("registry_hit"),
        _equals("host", host).alias("repo_host_hit"),
        no.alias("remote_host_hit"),
        _has("url", needle).alias("text_hit"),
    )
    rows = [packages, remotes, repositories]
    if environment and cat.environment is not None:
        owner = cat.packages.select(F.col("id").alias("package_id"), "server_version_id")
        rows.append(
            cat.environment.join(owner, "package_id").select(
                "server_version_id",
                zero.alias("p"),
                zero.alias("r"),
                zero.alias("o"),
                F.lit(1).alias("e"),
                *[no.alias(c) for c in ("transport_hit", "registry_hit", "repo_host_hit", "remote_host_hit", "text_hit")],
            )
        )
    hits = ("transport_hit", "registry_hit", "repo_host_hit", "remote_host_hit", "text_hit")
    return (
        reduce(DataFrame.unionByName, rows)
        .groupBy("server_version_id")
        .agg(
            F.sum("p").cast("bigint").alias("packages"),
            F.sum("r").cast("bigint").alias("remotes"),
            F.sum("o").cast("bigint").alias("repositories"),
            F.sum("e").cast("bigint").alias("environment_variables"),
            *[F.bool_or(h).alias(h) for h in hits],
        )
    )


def versions_with_facts(cat: Catalog, members: DataFrame, facts: DataFrame) -> DataFrame:
    """Member versions with their child facts; versions without children get zeroes."""
    joined = members.join(facts, "server_version_id", "left")
    counts = ("packages", "remotes", "repositories", "environment_variables")
    hits = ("transport_hit", "registry_hit", "repo_host_hit", "remote_host_hit", "text_hit")
    for c in counts:
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0).cast("bigint")))
    for c in hits:
        joined = joined.withColumn(c, F.coalesce(c, F.lit(False)))
    return joined


def summary_counts(rows: DataFrame) -> DataFrame:
    """The eleven counts of one snapshot, in one pass over versions with facts."""
    repo, pkg, rem = F.col("repositories") > 0, F.col("packages") > 0, F.col("remotes") > 0
    return rows.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("server_identifier").alias("unique_server_names"),
        F.count(F.lit(1)).alias("versions"),
        F.count_if(repo).alias("with_repository"),
        F.count_if(~repo).alias("without_repository"),
        F.count_if(pkg).alias("with_package"),
        F.count_if(rem).alias("with_remote"),
        F.count_if(pkg & ~rem).alias("package_only"),
        F.count_if(rem & ~pkg).alias("remote_only"),
        F.count_if(pkg & rem).alias("package_and_remote"),
        F.coalesce(F.sum("environment_variables"), F.lit(0)).alias("declared_environment_variables"),
    )


def grouped_counts(cat: Catalog, links: DataFrame) -> DataFrame:
    """``(dimension, value, count)`` for the six groupings of a snapshot; NULL values drop out.

    The tables are pruned to the snapshot, then all child values are stacked and counted at once.
    """
    ids = links.select("server_version_id")
    cat = replace(pruned(cat, ids), versions=cat.versions.join(ids, F.col("id") == F.col("server_version_id"), "left_semi"))

    def part(df: DataFrame, key: str, pairs: dict[str, str]) -> DataFrame:
        stacked = F.explode(
            F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in pairs.items()])
        )
        return df.select(F.col(key).alias("server_version_id"), stacked.alias("s")).select(
            "server_version_id", "s.dimension", "s.value"
        )

    rows = (
        part(cat.versions, "id", {"status": "registry_status"})
        .unionByName(
            part(cat.packages, "server_version_id", {"package_registry": "registry_type", "package_transport": "transport"})
        )
        .unionByName(part(cat.remotes, "server_version_id", {"remote_transport": "transport", "remote_host": "host"}))
        .unionByName(part(cat.repositories, "server_version_id", {"repository_host": "host"}))
        .filter(F.col("value").isNotNull())
    )
    return rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))


def apply_filters(rows: DataFrame, filters: Filters) -> DataFrame:
    """Keep versions with facts that meet every given condition."""
    filters.check()
    keep = F.lit(True)
    if filters.status is not None:
        keep = keep & (F.col("registry_status") == filters.status)
    for value, hit in (
        (filters.transport, "transport_hit"),
        (filters.package_registry, "registry_hit"),
        (filters.repository_host, "repo_host_hit"),
        (filters.remote_host, "remote_host_hit"),
    ):
        if value is not None:
            keep = keep & F.col(hit)
    if filters.has_repository:
        keep = keep & (F.col("repositories") > 0)
    if filters.without_repository:
        keep = keep & (F.col("repositories") == 0)
    if filters.has_package:
        keep = keep & (F.col("packages") > 0)
    if filters.has_remote:
        keep = keep & (F.col("remotes") > 0)
    return rows.filter(keep)


def row_columns(rows: DataFrame, cat: Catalog) -> DataFrame:
    urls = cat.repositories.select("server_version_id", F.col("url").alias("repository"))
    return rows.join(urls, "server_version_id", "left")


RESULT = [
    "server_identifier",
    "server_version",
    "registry_status",
    "description",
    "repository",
    "packages",
    "remotes",
]


def check_page(limit: int, offset: int, top: int) -> None:
    if not 1 <= limit <= top:
        raise ValueError(f"limit must be between 1 and {top}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def matching(cat: Catalog, members: DataFrame, filters: Filters) -> DataFrame:
    """Member versions that meet the filters: one semi-join for each condition on children, no child is counted."""
    filters.check()
    rows = members if filters.status is None else members.filter(F.col("registry_status") == filters.status)

    def ids(children: DataFrame, column: str | None = None, value: str | None = None) -> DataFrame:
        own = children if column is None else children.filter(F.col(column) == F.lit(value))
        return own.select("server_version_id")

    needed = []
    if filters.transport is not None:
        needed.append(ids(cat.packages, "transport", filters.transport).unionByName(ids(cat.remotes, "transport", filters.transport)))
    if filters.package_registry is not None:
        needed.append(ids(cat.packages, "registry_type", filters.package_registry))
    if filters.repository_host is not None:
        needed.append(ids(cat.repositories, "host", filters.repository_host.lower()))
    if filters.remote_host is not None:
        needed.append(ids(cat.remotes, "host", filters.remote_host.lower()))
    needed += [ids(t) for wanted, t in ((filters.has_repository, cat.repositories), (filters.has_package, cat.packages), (filters.has_remote, cat.remotes)) if wanted]
    for own in needed:
        rows = rows.join(own, "server_version_id", "left_semi")
    if filters.without_repository:
        rows = rows.join(ids(cat.repositories), "server_version_id", "left_anti")
    return rows


PAGE_KEY = ("server_identifier", "server_version", "server_version_id")


def list_versions(
    cat: Catalog,
    members: DataFrame,
    filters: Filters = Filters(),
    limit: int = DEFAULT_LIST_LIMIT,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    """A page of member versions by identifier and version (bytewise).

    ``after`` is the ``PAGE_KEY`` of the last row of the page before: the next page is sought behind it, so deep pages
    cost what the first one does. The page is chosen first; only the children of its rows, ``limit`` at most, are counted.
    """
    check_page(limit, offset, MAX_LIST_LIMIT)
    rows = matching(cat, members, filters)
    if after is not None:
        last = F.struct(*[F.lit(x).cast(rows.schema[c].dataType).alias(c) for c, x in zip(PAGE_KEY, after)])
        rows = rows.filter(F.struct(*PAGE_KEY) > last)
    page = F.broadcast(staged(rows.orderBy(*PAGE_KEY).offset(offset).limit(limit), "page"))
    own = pruned(cat, page)
    return row_columns(versions_with_facts(own, page, child_facts(own)), own).select(*RESULT, "server_version_id").orderBy(*PAGE_KEY)


def match_order(query: str) -> list[Column]:
    name = F.col("server_identifier")
    return [
        F.when(name == query, 0).otherwise(1),
        F.when(text.startswith_ascii_ci(name, query), 0).otherwise(1),
    ]


def search_contains(
    cat: Catalog,
    members: DataFrame,
    query: str,
    filters: Filters = Filters(),
    limit: int = DEFAULT_SEARCH_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """Case-insensitive substring search over names, descriptions, packages, URLs and hosts."""
    if not query:
        raise ValueError("search query must not be empty")
    check_page(limit, offset, MAX_SEARCH_LIMIT)
    filters.check()
    rows = apply_filters(versions_with_facts(cat, members, child_facts(pruned(cat, members), filters, needle=query)), filters)
    hit = _has("server_identifier", query) | _has("description", query) | F.col("text_hit")
    return (
        row_columns(rows.filter(hit), cat)
        .select(*RESULT, "server_version_id")
        .orderBy(*match_order(query), "server_identifier", "server_version", "server_version_id")
        .offset(offset)
        .limit(limit)
    )


SEARCH_FIELDS = ("server_identifier", "description", "package_identifiers", "repository_url", "remote_urls", "remote_hosts")


def search_documents(records: DataFrame, record: str = "record") -> DataFrame:
    """Searchable texts of each nested record: ids, URLs and hosts joined in position order.

    A record carries its own children, so no grouping is needed.
    """
    r = F.col(record)
    remote_hosts = F.transform(F.coalesce(r["remotes"], F.array()), lambda m: url_parts(m["url"])["host"])
    return records.select(
        "*",
        text.joined_in_order(F.coalesce(r["packages"], F.array()), "identifier").alias("package_identifiers"),
        r["repository"]["url"].alias("repository_url"),
        text.joined_in_order(F.coalesce(r["remotes"], F.array()), "url").alias("remote_urls"),
        F.array_join(remote_hosts, " ").alias("remote_hosts"),
    )


def match_terms(docs: DataFrame, query: str, fields: tuple[str, ...]) -> DataFrame:
    """Word counts of each document: ``words`` in all, and ``tf`` of words each term starts.

    Terms are few and come from the caller, so matching is a narrow projection: no term index
    is shuffled and a frequent term costs nothing extra.
    """
    terms = search_terms(query)
    if not terms:
        raise ValueError("search query has no terms")
    lowered = F.lower(F.concat_ws("\n", *fields))
    rows = spread(docs).withColumn("_low", lowered)
    return rows.select(
        *docs.columns,
        text.word_count(F.col("_low")).alias("words"),
        F.array(*[text.prefix_count(F.col("_low"), term) for term in terms]).alias("tf"),
    )


def search_terms(query: str) -> list[str]:
    """Lower-cased query terms, split once more at marks that are no part of a word."""
    return [w for t in text.query_terms(query) for w in re.findall(r"[^\W_]+", t.lower())]


def all_terms(matched: DataFrame) -> DataFrame:
    return matched.filter(F.forall("tf", lambda n: n > 0))


def bm25(matched: DataFrame, terms: int) -> DataFrame:
    """Score documents by BM25 over prefix terms; larger is better. ``matched`` is the whole collection."""
    stats = matched.agg(F.count(F.lit(1)).alias("n"), F.avg("words").alias("avg_length"))
    return scored(matched, stats, document_frequencies(matched, terms), terms)


def document_frequencies(matched: DataFrame, terms: int) -> DataFrame:
    return matched.agg(*[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(terms)])


def scored(matched: DataFrame, collection: DataFrame, frequencies: DataFrame, terms: int) -> DataFrame:
    """The documents that hold all terms, with their BM25 score.

    ``collection`` (n, avg_length) and ``frequencies`` (df0, df1, ...) are one row each, used as scalar subqueries.
    """
    rows = all_terms(matched)
    for name, stats in (("_c", collection), ("_f", frequencies)):
        rows = rows.withColumn(name, stats.select(F.struct(*stats.columns)).scalar())
    score = F.lit(0.0)
    for i in range(terms):
        df, tf = F.col(f"_f.df{i}"), F.col("tf")[i]
        idf = F.log(1 + (F.col("_c.n") - df + 0.5) / (df + 0.5))
        norm = 1 - BM25_B + BM25_B * F.col("words") / F.col("_c.avg_length")
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * norm)
    return rows.withColumn("score", score).drop("_c", "_f")


def search_ranked(
    docs: DataFrame,
    query: str,
    fields: tuple[str, ...],
    keep: tuple[str, ...] = ("server_identifier", "server_version"),
    limit: int = DEFAULT_SEARCH_LIMIT,
    offset: int = 0,
    members: DataFrame | None = None,
    cat: Catalog | None = None,
    filters: Filters = Filters(),
    ties: tuple[str, ...] = ("server_identifier", "server_version"),
) -> DataFrame:
    """Full-text search: exact name, name prefix, score, then ``ties``, by default identifier and version.

    Members that are equal in all of it go by their id, so that a page is the same in every run.

    With ``members`` (a snapshot's versions) and ``cat`` only member versions that meet ``filters`` are
    ranked, by the statistics of the whole collection, and come with their repository and child counts;
    ``docs`` then needs ``server_version_id``.

    The texts are read once: counts per document are staged without them, and both the
    collection statistics and the ranking come from the staged counts.
    """
    if not query:
        raise ValueError("search query must not be empty")
    check_page(limit, offset, MAX_SEARCH_LIMIT)
    keep = tuple(dict.fromkeys([*keep, *(["server_version_id"] if members is not None else [])]))
    matched = staged(match_terms(docs, query, fields).select(*keep, "words", "tf"), "search")
    ranked = bm25(matched, len(search_terms(query))).drop("words", "tf")
    if members is not None:
        fitting = apply_filters(versions_with_facts(cat, members, child_facts(pruned(cat, members), filters)), filters)
        fitting = row_columns(fitting.select("server_version_id", "registry_status", "packages", "remotes"), cat)
        ranked = ranked.join(fitting, "server_version_id")
    return (
        ranked.orderBy(*match_order(query), F.desc("score"), *ties, *(["server_version_id"] if members is not None else []))
        .offset(offset)
        .limit(limit)
    )


def nested(versions: DataFrame) -> DataFrame:
    """Versions with their children as ordered arrays, read from the stored record.

    The record already holds its children in order; nothing is joined or collected.
    """
    return versions.withColumn("record", F.from_json("canonical_json", CANONICAL_RECORD)).select(
        "id",
        "server_identifier",
        "server_version",
        F.col("record.description").alias("description"),
        F.col("record.repository").alias("repository"),
        F.col("record.packages").alias("packages"),
        F.col("record.remotes").alias("remotes"),
    )


def show_versions(versions: DataFrame, identifier: str) -> DataFrame:
    """All versions of one identifier, bytewise by version, children nested in their order."""
    return nested(versions.filter(F.col("server_identifier") == identifier)).orderBy("server_version", "id")


def show_children(cat: Catalog, identifier: str) -> DataFrame:
    """Flat display of one identifier: a row per child, ordered by version, kind and position."""
    mine = cat.versions.filter(F.col("server_identifier") == identifier).select(
        F.col("id").alias("server_version_id"), "server_identifier", "server_version"
    )
    packages = cat.packages.select(
        "server_version_id", F.lit("package").alias("kind"), "position", F.col("identifier").alias("value"), "transport"
    )
    remotes = cat.remotes.select(
        "server_version_id", F.lit("remote").alias("kind"), "position", F.col("url").alias("value"), "transport"
    )
    return (
        packages.unionByName(remotes)
        .join(mine, "server_version_id")
        .orderBy("server_version", "server_version_id", "kind", "position", "value", "transport")
    )


def newest_version_per_server(versions: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest version of each identifier by recency, then id."""
    keyed = versions.withColumn("recency", text.recency_key("updated_at", "published_at"))
    best = newest_per_key(keyed, ["server_identifier"], [F.desc("recency"), F.desc("id")])
    out = best.select("id", "server_identifier", "recency")
    return out if limit is None else out.orderBy(F.desc("recency"), "server_identifier").limit(limit)


def recent(rows: DataFrame, time: Column, id: str = "id", limit: int = DEFAULT_LIST_LIMIT) -> DataFrame:
    """Top ``limit`` rows, newest first, then highest id."""
    return rows.orderBy(F.desc(time), F.desc(id)).limit(limit)


def rendered(rows: DataFrame) -> DataFrame:
    """JSON line per row; NULL members are written as null."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))

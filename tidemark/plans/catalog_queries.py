"""Snapshot, catalog and exploration queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explore, ordering, snapshots, summaries, textindex, validation
from ..operators.explore import Filters
from ..session import scratch, staged
from ..sinks import keyed
from . import views as v
from .views import CATALOG_VIEWS, ORACLES, query, table, with_views

PAIR = """SELECT max(CASE WHEN o = 1 THEN id END) AS latest_id, max(CASE WHEN o = 2 THEN id END) AS previous_id
FROM (SELECT id, row_number() OVER (ORDER BY completed_at DESC, id DESC) AS o FROM {0})"""
DAY_PAIR = {"pair": PAIR.format("day_snapshots")}
YEAR_PAIR = {"pair": PAIR.format("year_snapshots")}


@query(
    "w1_snapshot_order",
    with_views(
        """SELECT id, completed_at, substr(snapshot_sha256, 1, 16) AS sha256_prefix,
        row_number() OVER (ORDER BY completed_at DESC, id DESC) AS ordinal FROM day_snapshots""",
        "day_snapshots",
    ),
)
def snapshot_order(spark: SparkSession, sf: str) -> DataFrame:
    ordered = snapshots.order_snapshots(staged(v.day_snapshots(spark, sf), "snapshots"))
    return ordered.select("id", "completed_at", F.substring("snapshot_sha256", 1, 16).alias("sha256_prefix"), "ordinal")


@query("w2_snapshot_pair", with_views("SELECT * FROM pair", "day_snapshots", **DAY_PAIR))
def snapshot_pair(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.snapshot_pair(v.day_snapshots(spark, sf)).select("latest_id", "previous_id")


def _presence(spark: SparkSession, sf: str) -> DataFrame:
    pair = snapshots.snapshot_pair(v.day_snapshots(spark, sf))
    return snapshots.presence(v.day_links(spark, sf), pair, ["server_version_id"])


_IN = "SELECT server_version_id FROM day_links JOIN pair ON snapshot_id = {0}"


@query(
    "j7_snapshot_additions",
    with_views(
        f"SELECT * FROM ({_IN.format('latest_id')}) EXCEPT SELECT * FROM ({_IN.format('previous_id')})",
        "day_snapshots",
        "day_links",
        **DAY_PAIR,
    ),
)
def snapshot_additions(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.additions(_presence(spark, sf)).select("server_version_id")


@query(
    "j8_snapshot_removals",
    with_views(
        f"SELECT * FROM ({_IN.format('previous_id')}) EXCEPT SELECT * FROM ({_IN.format('latest_id')})",
        "day_snapshots",
        "day_links",
        **DAY_PAIR,
    ),
)
def snapshot_removals(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.removals(_presence(spark, sf)).select("server_version_id")


@query(
    "u3_snapshot_unchanged",
    with_views(
        f"SELECT * FROM ({_IN.format('previous_id')}) INTERSECT SELECT * FROM ({_IN.format('latest_id')})",
        "day_snapshots",
        "day_links",
        **DAY_PAIR,
    ),
)
def snapshot_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.unchanged(_presence(spark, sf)).select("server_version_id")


@query(
    "t11_addition_listing",
    with_views(
        """SELECT id, server_identifier, server_version, registry_status, published_at, updated_at,
        substr(canonical_sha256, 1, 16) AS canonical_sha256_prefix FROM versions
        WHERE id IN (SELECT server_version_id FROM day_links JOIN pair ON snapshot_id = latest_id
                     EXCEPT SELECT server_version_id FROM day_links JOIN pair ON snapshot_id = previous_id)
        ORDER BY server_identifier, server_version, id LIMIT 500""",
        "day_snapshots",
        "day_links",
        "versions",
        **DAY_PAIR,
    ),
)
def addition_listing(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.change_listing(snapshots.additions(_presence(spark, sf)), v.versions(spark, sf))


@query(
    "w8_all_snapshot_diffs",
    with_views(
        """SELECT a.position, a.server_version_id, 'added' AS change FROM placed a
        LEFT JOIN placed b ON b.position = a.position - 1 AND b.server_version_id = a.server_version_id
        WHERE a.position > 1 AND b.position IS NULL
        UNION ALL
        SELECT a.position + 1, a.server_version_id, 'removed' FROM placed a
        LEFT JOIN placed b ON b.position = a.position + 1 AND b.server_version_id = a.server_version_id
        WHERE a.position < (SELECT max(position) FROM numbered) AND b.position IS NULL""",
        "day_snapshots",
        "day_links",
        numbered="SELECT id, row_number() OVER (ORDER BY completed_at, id) AS position FROM day_snapshots",
        placed="SELECT position, server_version_id FROM day_links JOIN numbered ON id = snapshot_id",
    ),
)
def all_snapshot_diffs(spark: SparkSession, sf: str) -> DataFrame:
    # A snapshot list is short and used several times: one pass over the events writes it.
    days = staged(v.day_snapshots(spark, sf), "snapshots")
    numbered = ordering.global_position(
        days, [F.asc("completed_at"), F.asc("id")], F.substring("completed_at", 1, 7), False, "position"
    ).select(F.col("id").alias("snapshot_id"), "position")
    return snapshots.snapshot_diffs(v.day_links(spark, sf), numbered, "server_version_id")


_MEMBERS = """SELECT versions.* FROM year_links JOIN versions ON id = server_version_id
WHERE snapshot_id = (SELECT latest_id FROM pair)"""


def _members(spark: SparkSession, sf: str, cat: explore.Catalog) -> DataFrame:
    newest = snapshots.select_snapshot(cat.snapshots)
    return snapshots.snapshot_members(cat.links, newest, cat.versions)


@query(
    "j1_snapshot_members",
    with_views(
        "SELECT id AS server_version_id, server_identifier, server_version, registry_status FROM members",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def snapshot_members(spark: SparkSession, sf: str) -> DataFrame:
    rows = _members(spark, sf, v.catalog(spark, sf))
    return rows.select("server_version_id", "server_identifier", "server_version", "registry_status")


@query(
    "s10_pinned_snapshot",
    with_views(
        "SELECT server_version_id, snapshot_id FROM year_links WHERE snapshot_id = (SELECT min(id) FROM year_snapshots)",
        "year_snapshots",
        "year_links",
    ),
)
def pinned_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    cat = v.catalog(spark, sf)
    oldest = cat.snapshots.orderBy("id").limit(1)
    return snapshots.snapshot_members(cat.links, oldest).select("server_version_id", "snapshot_id")


@query(
    "j2_members_with_repository",
    with_views(
        """SELECT id AS server_version_id, server_identifier, url AS repository FROM members
        LEFT JOIN repositories ON server_version_id = id""",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def members_with_repository(spark: SparkSession, sf: str) -> DataFrame:
    cat = v.catalog(spark, sf)
    urls = cat.repositories.select("server_version_id", F.col("url").alias("repository"))
    return _members(spark, sf, cat).join(urls, "server_version_id", "left").select(
        "server_version_id", "server_identifier", "repository"
    )


def _rows(spark: SparkSession, sf: str, filters: Filters = Filters(), environment: bool = False) -> DataFrame:
    cat = v.catalog(spark, sf)
    members = _members(spark, sf, cat)
    facts = explore.child_facts(explore.pruned(cat, members), filters, environment=environment)
    return explore.versions_with_facts(cat, members, facts)


_HAS = "EXISTS (SELECT 1 FROM {0} c WHERE c.server_version_id = m.id)"
_P, _R, _O = (_HAS.format(t) for t in ("packages", "remotes", "repositories"))


@query(
    "a3_snapshot_summary",
    with_views(
        f"""SELECT count(*) AS records, count(DISTINCT server_identifier) AS unique_server_names, count(*) AS versions,
        count(*) FILTER (WHERE {_O}) AS with_repository, count(*) FILTER (WHERE NOT {_O}) AS without_repository,
        count(*) FILTER (WHERE {_P}) AS with_package, count(*) FILTER (WHERE {_R}) AS with_remote,
        count(*) FILTER (WHERE {_P} AND NOT {_R}) AS package_only, count(*) FILTER (WHERE {_R} AND NOT {_P}) AS remote_only,
        count(*) FILTER (WHERE {_P} AND {_R}) AS package_and_remote,
        (SELECT count(*) FROM environment e JOIN packages p ON p.id = e.package_id JOIN members ON members.id = p.server_version_id)
          AS declared_environment_variables
        FROM members m""",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def snapshot_summary(spark: SparkSession, sf: str) -> DataFrame:
    return explore.summary_counts(_rows(spark, sf, environment=True))


def _group(dimension: str, value: str, source: str) -> str:
    return f"SELECT '{dimension}' AS dimension, {value} AS value FROM {source} t JOIN members ON members.id = t.server_version_id"


@query(
    "a4_grouped_counts",
    with_views(
        "SELECT dimension, value, count(*) AS count FROM stacked WHERE value IS NOT NULL GROUP BY 1, 2",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
        stacked=" UNION ALL ".join(
            [
                "SELECT 'status' AS dimension, registry_status AS value FROM members",
                _group("package_registry", "t.registry_type", "packages"),
                _group("package_transport", "t.transport", "packages"),
                _group("remote_transport", "t.transport", "remotes"),
                _group("remote_host", "t.host", "remotes"),
                _group("repository_host", "t.host", "repositories"),
            ]
        ),
    ),
)
def grouped_counts(spark: SparkSession, sf: str) -> DataFrame:
    cat = v.catalog(spark, sf)
    newest = snapshots.select_snapshot(cat.snapshots)
    return explore.grouped_counts(cat, snapshots.snapshot_members(cat.links, newest))


@query(
    "a5_child_counts",
    with_views(
        """SELECT id AS server_version_id, (SELECT count(*) FROM packages c WHERE c.server_version_id = m.id) AS packages,
        (SELECT count(*) FROM remotes c WHERE c.server_version_id = m.id) AS remotes FROM members m""",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def child_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("server_version_id", "packages", "remotes")


FILTERS = Filters(status="promo", transport="streamable-http", package_registry="npm", repository_host="GitHub.com", remote_host=None, has_remote=True)


@query(
    "v15_metadata_filters",
    with_views(
        f"""SELECT id AS server_version_id, server_identifier FROM members m WHERE registry_status = 'promo'
        AND (EXISTS (SELECT 1 FROM packages c WHERE c.server_version_id = m.id AND c.transport = 'streamable-http')
          OR EXISTS (SELECT 1 FROM remotes c WHERE c.server_version_id = m.id AND c.transport = 'streamable-http'))
        AND EXISTS (SELECT 1 FROM packages c WHERE c.server_version_id = m.id AND c.registry_type = 'npm')
        AND EXISTS (SELECT 1 FROM repositories c WHERE c.server_version_id = m.id AND c.host = 'github.com') AND {_R}""",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def metadata_filters(spark: SparkSession, sf: str) -> DataFrame:
    return explore.apply_filters(_rows(spark, sf, FILTERS), FILTERS).select("server_version_id", "server_identifier")


@query(
    "j4_without_children",
    with_views(
        f"""SELECT id AS server_version_id, NOT {_O} AS no_repository, {_P} AND NOT {_R} AS package_only,
        {_R} AND NOT {_P} AS remote_only FROM members m WHERE NOT {_O} OR NOT {_P} OR NOT {_R}""",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def without_children(spark: SparkSession, sf: str) -> DataFrame:
    repo, pkg, rem = F.col("repositories") > 0, F.col("packages") > 0, F.col("remotes") > 0
    return (
        _rows(spark, sf)
        .filter(~repo | ~pkg | ~rem)
        .select("server_version_id", (~repo).alias("no_repository"), (pkg & ~rem).alias("package_only"), (rem & ~pkg).alias("remote_only"))
    )


@query(
    "j24_environment_counts",
    with_views(
        """SELECT p.server_version_id, count(*) AS environment_variables FROM environment e
        JOIN packages p ON p.id = e.package_id JOIN members ON members.id = p.server_version_id GROUP BY 1""",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def environment_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf, environment=True)
    return rows.filter("environment_variables > 0").select("server_version_id", "environment_variables")


_RESULT = """m.server_identifier, m.server_version, m.registry_status, m.description, r.url AS repository,
(SELECT count(*) FROM packages c WHERE c.server_version_id = m.id) AS packages,
(SELECT count(*) FROM remotes c WHERE c.server_version_id = m.id) AS remotes, m.id AS server_version_id
FROM members m LEFT JOIN repositories r ON r.server_version_id = m.id"""


@query(
    "t1_list_versions",
    with_views(
        f"SELECT {_RESULT} WHERE {_O} ORDER BY m.server_identifier, m.server_version, m.id LIMIT 100 OFFSET 30",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def list_versions(spark: SparkSession, sf: str) -> DataFrame:
    cat = v.catalog(spark, sf)
    return explore.list_versions(cat, _members(spark, sf, cat), Filters(has_repository=True), 100, 30)


@query(
    "t1_list_after",
    with_views(
        f"SELECT {_RESULT} WHERE {_O} AND {_P} ORDER BY m.server_identifier, m.server_version, m.id LIMIT 200 OFFSET 100",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def list_after(spark: SparkSession, sf: str) -> DataFrame:
    """The second page, sought behind the last row of the first."""
    cat = v.catalog(spark, sf)
    members, wanted = _members(spark, sf, cat), Filters(has_repository=True, has_package=True)
    first = explore.list_versions(cat, members, wanted, 100).collect()
    return explore.list_versions(cat, members, wanted, 200, after=tuple(first[-1][c] for c in explore.PAGE_KEY) if first else None)


@query(
    "t2_search_contains",
    with_views(
        f"""SELECT {_RESULT} WHERE lower(m.server_identifier) LIKE '%ring%' OR lower(m.description) LIKE '%ring%'
        OR EXISTS (SELECT 1 FROM packages c WHERE c.server_version_id = m.id AND lower(c.identifier) LIKE '%ring%')
        OR lower(r.url) LIKE '%ring%'
        OR EXISTS (SELECT 1 FROM remotes c WHERE c.server_version_id = m.id AND (lower(c.url) LIKE '%ring%' OR c.host LIKE '%ring%'))
        ORDER BY CASE WHEN m.server_identifier = 'RING' THEN 0 ELSE 1 END,
          CASE WHEN lower(m.server_identifier) LIKE 'ring%' THEN 0 ELSE 1 END, m.server_identifier, m.server_version, m.id LIMIT 200""",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def search_contains(spark: SparkSession, sf: str) -> DataFrame:
    cat = v.catalog(spark, sf)
    return explore.search_contains(cat, _members(spark, sf, cat), "RING", limit=200)


@query(
    "t2_search_child_text",
    with_views(
        f"""SELECT {_RESULT} WHERE lower(m.description) LIKE '%s7.example%' OR
        EXISTS (SELECT 1 FROM remotes c WHERE c.server_version_id = m.id AND (lower(c.url) LIKE '%s7.example%' OR c.host LIKE '%s7.example%'))
        ORDER BY m.server_identifier, m.server_version, m.id LIMIT 500""",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
    ),
)
def search_child_text(spark: SparkSession, sf: str) -> DataFrame:
    cat = v.catalog(spark, sf)
    return explore.search_contains(cat, _members(spark, sf, cat), "S7.example", limit=500)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat_ws("/", "source", "lang").alias("server_identifier"),
        F.col("doc_id").cast("string").alias("server_version"),
        F.col("text").alias("description"),
        "doc_id",
    )


@query(
    "j23_term_match",
    """WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS tok FROM documents)
    SELECT doc_id, len(list_filter(tok, lambda x: starts_with(x, 'the'))) AS tf_first,
      len(list_filter(tok, lambda x: starts_with(x, 'or'))) AS tf_second FROM t
    WHERE len(list_filter(tok, lambda x: starts_with(x, 'the'))) > 0 AND len(list_filter(tok, lambda x: starts_with(x, 'or'))) > 0""",
)
def term_match(spark: SparkSession, sf: str) -> DataFrame:
    matched = explore.all_terms(explore.match_terms(_documents(spark, sf), "the, or", ("description",)))
    return matched.select(
        "doc_id", F.col("tf")[0].cast("bigint").alias("tf_first"), F.col("tf")[1].cast("bigint").alias("tf_second")
    )


@query(
    "t2_search_ranked",
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tok FROM documents),
    f AS (SELECT doc_id, len(tok) AS dl, len(list_filter(tok, lambda x: starts_with(x, 'the'))) AS a,
            len(list_filter(tok, lambda x: starts_with(x, 'erst'))) AS b FROM t),
    s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f)
    SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl))
         + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score
    FROM f, s WHERE a > 0 AND b > 0
    ORDER BY ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl))
         + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) DESC, doc_id LIMIT 500""",
)
def search_ranked(spark: SparkSession, sf: str) -> DataFrame:
    found = explore.search_ranked(_documents(spark, sf), "the erst", ("description",), ("server_identifier", "server_version", "doc_id"), limit=500, ties=("doc_id",))
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(
    "t2_search_ranked_filtered",
    with_views(
        f"""SELECT m.id AS server_version_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl))
          + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score, r.url AS repository,
          (SELECT count(*) FROM packages c WHERE c.server_version_id = m.id) AS packages,
          (SELECT count(*) FROM remotes c WHERE c.server_version_id = m.id) AS remotes
        FROM f JOIN members m ON m.id = f.id LEFT JOIN repositories r ON r.server_version_id = m.id, s WHERE a > 0 AND b > 0 AND {_O} AND {_P}
        ORDER BY ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl))
          + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) DESC, m.server_identifier, m.server_version LIMIT 500""",
        *CATALOG_VIEWS,
        **YEAR_PAIR,
        members=_MEMBERS,
        t="SELECT id, list_filter(regexp_split_to_array(lower(description), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tok FROM versions",
        f="""SELECT id, len(tok) AS dl, len(list_filter(tok, lambda x: starts_with(x, 'size'))) AS a,
            len(list_filter(tok, lambda x: starts_with(x, '1'))) AS b FROM t""",
        s="SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f",
    ),
)
def search_ranked_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked search among the versions of a snapshot that have a repository and a package."""
    cat = v.catalog(spark, sf)
    docs = cat.versions.withColumnRenamed("id", "server_version_id")
    found = explore.search_ranked(
        docs, "size 1", ("description",), limit=500, members=_members(spark, sf, cat), cat=cat, filters=Filters(has_repository=True, has_package=True)
    )
    return found.select("server_version_id", F.round("score", 6).alias("score"), "repository", "packages", "remotes")


def _text_index(spark: SparkSession, docs: DataFrame, doc: str, segments: int = 3) -> textindex.TextIndex:
    """A stored index over the descriptions, put together from several segments."""
    root = scratch(spark, "text-index")
    for k in range(segments):
        own = docs.filter(F.pmod(F.xxhash64(doc), F.lit(segments)) == k)
        textindex.add_segment(textindex.segment(own, doc, ("description",)), root, k)
    return textindex.TextIndex.read(spark, root)


@query("j23_index_terms", ORACLES["j23_term_match"])
def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The same matches, from stored postings of three segments."""
    found = textindex.match_index(_text_index(spark, _documents(spark, sf), "doc_id"), "the, or")
    return found.select(F.col("doc").alias("doc_id"), F.col("tf")[0].alias("tf_first"), F.col("tf")[1].alias("tf_second"))


@query("t2_search_indexed", ORACLES["t2_search_ranked"])
def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    found = textindex.search_index(_text_index(spark, _documents(spark, sf), "doc_id"), "the erst", limit=500, ties=("doc",))
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("t2_search_indexed_filtered", ORACLES["t2_search_ranked_filtered"])
def search_indexed_filtered(spark: SparkSession, sf: str) -> DataFrame:
    cat = v.catalog(spark, sf)
    index = _text_index(spark, cat.versions, "id")
    found = textindex.search_index(
        index, "size 1", limit=500, members=_members(spark, sf, cat), cat=cat, filters=Filters(has_repository=True, has_package=True)
    )
    return found.select(F.col("doc").alias("server_version_id"), F.round("score", 6).alias("score"), "repository", "packages", "remotes")


@query(
    "t3_show_children",
    with_views(
        """SELECT c.server_version_id, c.kind, c.position, c.value, c.transport, v.server_identifier, v.server_version
        FROM (SELECT server_version_id, 'package' AS kind, position, identifier AS value, transport FROM packages
              UNION ALL SELECT server_version_id, 'remote', position, url, transport FROM remotes) c
        JOIN versions v ON v.id = c.server_version_id WHERE v.server_identifier = 'small ring'""",
        *CATALOG_VIEWS,
    ),
)
def show_children(spark: SparkSession, sf: str) -> DataFrame:
    return explore.show_children(v.catalog(spark, sf), "small ring")


_RECENCY = "coalesce(updated_at, published_at, '')"


@query(
    "w4_newest_per_server",
    with_views(
        f"""SELECT id, server_identifier, {_RECENCY} AS recency FROM versions
        QUALIFY row_number() OVER (PARTITION BY server_identifier ORDER BY {_RECENCY} DESC, id DESC) = 1""",
        "versions",
    ),
)
def newest_per_server(spark: SparkSession, sf: str) -> DataFrame:
    return explore.newest_version_per_server(v.versions(spark, sf))


@query(
    "t4_recent_versions",
    with_views(f"SELECT id, {_RECENCY} AS recency FROM versions ORDER BY {_RECENCY} DESC, id DESC LIMIT 50", "versions"),
)
def recent_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.versions(spark, sf).withColumn("recency", F.coalesce("updated_at", "published_at", F.lit("")))
    return explore.recent(rows, F.col("recency")).select("id", "recency")


@query(
    "t4_recent_analyses",
    with_views("SELECT id FROM runs WHERE status = 'completed' ORDER BY started_at DESC, id DESC LIMIT 50", "runs"),
)
def recent_analyses(spark: SparkSession, sf: str) -> DataFrame:
    return explore.recent(v.runs(spark, sf).filter("status = 'completed'"), F.col("started_at")).select("id")


@query(
    "k8_rendered_rows",
    with_views(
        """SELECT id AS server_version_id, '{"server_identifier":"' || server_identifier || '","server_version":"' || server_version ||
        '","status":"' || registry_status || '","published_at":' || coalesce('"' || published_at || '"', 'null') || '}' AS line
        FROM versions""",
        "versions",
    ),
)
def rendered_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.versions(spark, sf).select(
        "id", "server_identifier", "server_version", F.col("registry_status").alias("status"), "published_at"
    )
    names = ["server_identifier", "server_version", "status", "published_at"]
    return rows.select(F.col("id").alias("server_version_id"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))


# --- import splits, state over snapshots, sync ------------------------------------------------

_TRIPLES = """SELECT DISTINCT server_identifier, server_version, canonical_sha256 FROM versions
WHERE id IN (SELECT server_version_id FROM year_links WHERE snapshot_id {0} (SELECT {1} FROM pair))"""
_SPLIT = {
    **YEAR_PAIR,
    "incoming": _TRIPLES.format("=", "latest_id"),
    "existing": _TRIPLES.format("=", "previous_id"),
    "outcomes": """SELECT i.*, CASE WHEN EXISTS (SELECT 1 FROM existing e WHERE e.server_identifier = i.server_identifier
        AND e.server_version = i.server_version AND e.canonical_sha256 = i.canonical_sha256) THEN 'reused'
        WHEN EXISTS (SELECT 1 FROM existing e WHERE e.server_identifier = i.server_identifier AND e.server_version = i.server_version)
        THEN 'changed' ELSE 'new' END AS outcome FROM incoming i""",
}


def _incoming_existing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cat = v.catalog(spark, sf)
    pair = snapshots.snapshot_pair(cat.snapshots)
    sides = []
    for name in ("latest_id", "previous_id"):
        only = cat.links.filter(F.col("snapshot_id") == pair.select(name).scalar()).select(F.col("server_version_id").alias("id"))
        sides.append(cat.versions.join(only, "id", "left_semi"))
    return sides[0], sides[1]


@query(
    "j5_j6_import_split",
    with_views("SELECT * FROM outcomes", "year_snapshots", "year_links", "versions", **_SPLIT),
)
def import_split(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.split_incoming(*_incoming_existing(spark, sf))


@query(
    "a6_import_statistics",
    with_views(
        """SELECT count(*) AS records, count(*) FILTER (WHERE outcome <> 'reused') AS inserted_records,
        count(*) FILTER (WHERE outcome = 'reused') AS reused_records, count(*) FILTER (WHERE outcome = 'changed') AS changed_identity_records,
        count(*) AS links, count(DISTINCT server_identifier) AS unique_names FROM outcomes""",
        "year_snapshots",
        "year_links",
        "versions",
        **_SPLIT,
    ),
)
def import_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.import_statistics(snapshots.split_incoming(*_incoming_existing(spark, sf)))


@query(
    "i3_current_state",
    with_views(
        """SELECT v.id, server_identifier, server_version, snapshot_id FROM versions v JOIN
        (SELECT server_version_id, arg_max(snapshot_id, completed_at) AS snapshot_id, max(completed_at) AS seen
         FROM year_links JOIN year_snapshots ON id = snapshot_id GROUP BY 1) l ON l.server_version_id = v.id
        QUALIFY row_number() OVER (PARTITION BY server_identifier, server_version ORDER BY seen DESC, snapshot_id DESC, v.id DESC) = 1""",
        "year_snapshots",
        "year_links",
        "versions",
    ),
)
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    cat = v.catalog(spark, sf)
    return snapshots.current_state(cat.links, cat.snapshots, cat.versions)


@query(
    "i2_refresh_baseline",
    with_views(
        """SELECT snapshot_sha256 AS base_snapshot_sha256, completed_at AS updated_since, 'incremental' AS collection_mode
        FROM day_snapshots ORDER BY completed_at DESC, id DESC LIMIT 1""",
        "day_snapshots",
    ),
)
def refresh_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.refresh_baseline(v.day_snapshots(spark, sf))


_SOURCE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'"
_TARGET = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
o_orderpriority FROM orders WHERE o_orderstatus <> 'O'"""


def _sync_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus"))
    return orders.filter("o_orderstatus <> 'P'"), orders.filter("o_orderstatus <> 'O'").withColumn("o_orderstatus", urgent)


_OUTCOMES = """SELECT s.o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'insert'
WHEN t.o_custkey = s.o_custkey AND t.o_orderstatus = s.o_orderstatus AND t.o_orderpriority = s.o_orderpriority
THEN 'validated' ELSE 'mismatch' END AS outcome FROM source s LEFT JOIN target t ON t.o_orderkey = s.o_orderkey"""


@query("j19_table_sync", with_views("SELECT * FROM outcomes", source=_SOURCE, target=_TARGET, outcomes=_OUTCOMES))
def table_sync(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.sync_table(*_sync_pair(spark, sf), ["o_orderkey"])


@query("j19_keyed_sync", ORACLES["j19_table_sync"])
def keyed_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The same outcomes against a table kept in files by key range."""
    source, target = _sync_pair(spark, sf)
    root = scratch(spark, "keyed")
    keyed.create(target, ["o_orderkey"], root, "g1")
    return keyed.compare(source, ["o_orderkey"], root)


@query("u4_keyed_sync", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def keyed_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Target and source share rows; each has rows of its own, and all are there in the end."""
    source, _ = _sync_pair(spark, sf)
    target = table(spark, sf, "orders").filter("o_orderstatus <> 'O'").select(*source.columns)
    root = scratch(spark, "keyed")
    keyed.create(target, ["o_orderkey"], root, "g1")
    keyed.sync(source, ["o_orderkey"], root, "g2")
    return keyed.read(spark, root)


@query(
    "a20_sync_statistics",
    with_views(
        """SELECT count(*) FILTER (WHERE outcome = 'insert') AS inserted, count(*) FILTER (WHERE outcome = 'validated') AS validated,
        count(*) FILTER (WHERE outcome = 'mismatch') AS mismatched FROM outcomes""",
        source=_SOURCE,
        target=_TARGET,
        outcomes=_OUTCOMES,
    ),
)
def sync_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.sync_statistics(snapshots.sync_table(*_sync_pair(spark, sf), ["o_orderkey"]))


@query(
    "u4_synced_table",
    f"""WITH source AS ({_SOURCE}) SELECT * FROM source""",
)
def synced_table(spark: SparkSession, sf: str) -> DataFrame:
    source, _ = _sync_pair(spark, sf)
    return snapshots.synced(source, source.filter("o_orderstatus = 'F'"), ["o_orderkey"])


@query(
    "u5_table_difference",
    with_views(
        """SELECT *, 1::BIGINT AS left_copies, 0::BIGINT AS right_copies FROM (SELECT * FROM source EXCEPT ALL SELECT * FROM target)
        UNION ALL SELECT *, 0, 1 FROM (SELECT * FROM target EXCEPT ALL SELECT * FROM source)""",
        source=_SOURCE,
        target=_TARGET,
    ),
)
def table_difference(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.table_difference(*_sync_pair(spark, sf))


# --- validation ----------------------------------------------------------------------------

_PAGES = """SELECT conv_id AS bundle, turn + 1 AS page, sha256(text) AS cursor_out,
lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS cursor_in FROM conversations"""


@query(
    "v13_page_chain",
    """WITH c AS (SELECT conv_id AS bundle, turn + 1 AS page, sha256(role) AS cursor_in, sha256(text) AS cursor_out FROM conversations),
    l AS (SELECT c.*, b.cursor_out AS expected, b.page IS NOT NULL AS has_before FROM c LEFT JOIN c b ON b.bundle = c.bundle AND b.page = c.page - 1),
    n AS (SELECT bundle, count(*) AS pages, min(page) AS first_page, max(page) AS last_page,
      count(*) FILTER (WHERE page <> 1 AND NOT has_before) AS gaps, CAST(0 AS BIGINT) AS after_terminal,
      count(*) FILTER (WHERE expected IS NOT NULL AND cursor_in IS DISTINCT FROM expected) AS broken_links FROM l GROUP BY 1),
    r AS (SELECT bundle, count(*) FILTER (WHERE k > 1) AS repeated_cursors FROM
      (SELECT bundle, cursor_out, count(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1)
    SELECT n.*, r.repeated_cursors, (first_page = 1 AND last_page = pages AND gaps + broken_links + repeated_cursors = 0) AS valid
    FROM n JOIN r USING (bundle)""",
)
def page_chain(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("b"), (F.col("turn") + 1).alias("p"), F.sha2("role", 256).alias("i"), F.sha2("text", 256).alias("o")
    )
    return validation.page_chain(pages, "b", "p", "i", "o")


@query("w6_previous_cursor", f"WITH c AS ({_PAGES}) SELECT bundle, page, cursor_in, cursor_out FROM c")
def previous_cursor(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("bundle"), (F.col("turn") + 1).alias("page"), F.sha2("text", 256).alias("cursor_out")
    )
    before = ordering.previous_in_key(pages, ["bundle"], ["page"], ["cursor_out"], F.floor(F.col("page") / 1000), "b")
    return before.select("bundle", "page", F.col("b.cursor_out").alias("cursor_in"), "cursor_out")


@query(
    "w5_order_breaks",
    """WITH l AS (SELECT doc_id, source, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents)
    SELECT doc_id, source FROM l WHERE before IS NOT NULL AND text <= before""",
)
def order_breaks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return validation.order_breaks(docs, "source", "doc_id", ["text"]).select("doc_id", "source")


@query(
    "v10_duplicate_identities",
    "SELECT sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_identities(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"))
    return validation.duplicate_identities(docs, ["digest"])


@query(
    "v14_conflicting_duplicates",
    "SELECT p_name, p_brand, count(DISTINCT p_type) AS variants FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) > 1",
)
def conflicting_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return validation.conflicting_duplicates(table(spark, sf, "part"), ["p_name", "p_brand"], F.col("p_type"))


@query("u1_collapsed_duplicates", "SELECT DISTINCT sha256(text) AS digest, lang FROM documents")
def collapsed_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), "lang").distinct()


@query(
    "v18_outside_domain",
    with_views("SELECT id, disposition FROM findings WHERE disposition NOT IN ('unreviewed', 'expected', 'mitigated')", "findings"),
)
def outside_domain(spark: SparkSession, sf: str) -> DataFrame:
    rows = validation.outside_domain(v.findings(spark, sf), "disposition", ("unreviewed", "expected", "mitigated"))
    return rows.select("id", "disposition")


@query(
    "v19_orphans",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    served = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return validation.orphans(table(spark, sf, "customer"), served, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(
    "v20_rule_conflicts",
    "SELECT p_name, count(DISTINCT p_type) AS variants FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1",
)
def rule_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return validation.rule_metadata_conflicts(table(spark, sf, "part"), ["p_name"], ["p_type"])


@query(
    "v30_store_check",
    with_views(
        """SELECT table_name, row_count, latest_digest, TRUE AS digest_ok FROM
        (SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'part', count(*) FROM part) t,
        (SELECT snapshot_sha256 AS latest_digest FROM day_snapshots ORDER BY completed_at DESC, id DESC LIMIT 1) d""",
        "day_snapshots",
    ),
)
def store_check(spark: SparkSession, sf: str) -> DataFrame:
    tables = {n: table(spark, sf, n) for n in ("orders", "part")}
    return validation.store_check(v.day_snapshots(spark, sf), tables, None)


@query(
    "a15_package_coverage",
    """SELECT count(*) AS package_records,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')) AS analyzed_package_records,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) AS failed_package_records,
    count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS never_analyzed_package_records FROM customer""",
)
def package_coverage(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed")
    attempts = table(spark, sf, "orders").select(F.col("o_custkey").alias("package_id"), status.alias("status"))
    return summaries.package_coverage(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), attempts)

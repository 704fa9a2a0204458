"""Equal scores at the end of a page: ranked searches break them as their SQL does."""

import duckdb
import pytest
from oracle import compare

from tidemark.operators import explore, textindex
from tidemark.plans import registry
from tidemark.session import scratch


@pytest.fixture(scope="module")
def tied(spark):
    """600 equal documents and one without the words: 500 of them fill a page, by number and not by text of the id."""
    root = scratch(spark, "tied")
    rows = [(i, "the erste", "en", "src0", 9) for i in range(1, 601)] + [(601, "none", "en", "src0", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{root}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet/*.parquet'")
    return root, con


@pytest.mark.parametrize("name", ["t2_search_ranked", "t2_search_indexed"])
def test_documents_of_one_score_go_by_number(spark, tied, name):
    root, con = tied
    problem, rows, _ = compare(spark, con, root, registry.queries()[name], registry.oracle_sql()[name])
    assert problem is None and rows == 500, problem


def test_members_equal_in_name_and_version_go_by_id(spark):
    rows = [(i, "a/b", "1", "size 1", "active") for i in (7, 3, 9, 1, 5)]
    docs = spark.createDataFrame(rows, "server_version_id long, server_identifier string, server_version string, description string, registry_status string")
    none = spark.createDataFrame([], "server_version_id long, id string, transport string, registry_type string, identifier string, url string, host string")
    members = docs.select("server_version_id", "registry_status")
    cat = explore.Catalog(None, None, None, none, none, none)
    ranked = explore.search_ranked(docs, "size", ("description",), limit=3, members=members, cat=cat)
    assert [r.server_version_id for r in ranked.collect()] == [1, 3, 5]
    root = scratch(spark, "tied-index")
    textindex.add_segment(textindex.segment(docs, "server_version_id", ("description",)), root, 0)
    found = textindex.search_index(textindex.TextIndex.read(spark, root), "size", limit=3, members=members, cat=cat)
    assert [r.doc for r in found.collect()] == [1, 3, 5]

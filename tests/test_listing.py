"""Pages of a listing: filters without folds, seeking, and counts for shown rows only."""

import itertools

import pytest

from tidemark.operators import explore
from tidemark.operators.explore import Catalog, Filters


@pytest.fixture(scope="module")
def parts(spark):
    make = spark.createDataFrame
    versions = make([(k, f"s{k % 7}", f"{k % 3}.0", "active" if k % 4 else "deprecated", f"d{k}") for k in range(60)], "id long, server_identifier string, server_version string, registry_status string, description string")
    packages = make([(k, k % 60, ["npm", "pypi"][k % 2], f"p{k}", ["stdio", "sse"][k % 3 == 0]) for k in range(70) if k % 60 % 5], "id long, server_version_id long, registry_type string, identifier string, transport string")
    remotes = make([(k, f"https://h{k % 2}.example/", f"h{k % 2}.example", "sse") for k in range(60) if k % 3 == 0], "server_version_id long, url string, host string, transport string")
    repositories = make([(k, "https://github.com/x", "github.com" if k % 2 else "gitlab.com") for k in range(60) if k % 6], "server_version_id long, url string, host string")
    cat = Catalog(None, versions, None, repositories, packages, remotes)
    return cat, versions.withColumnRenamed("id", "server_version_id")


CASES = [
    Filters(),
    Filters(status="active", transport="sse"),
    Filters(package_registry="npm", has_remote=True),
    Filters(repository_host="GitHub.com", remote_host="h1.example"),
    Filters(without_repository=True, has_package=True),
    Filters(has_repository=True, transport="nothing"),
]


@pytest.mark.parametrize("filters", CASES)
def test_filters_are_those_of_the_facts(parts, filters):
    cat, members = parts
    facts = explore.apply_filters(explore.versions_with_facts(cat, members, explore.child_facts(cat, filters)), filters)
    want = [tuple(r) for r in explore.row_columns(facts, cat).select(*explore.RESULT, "server_version_id").orderBy(*explore.PAGE_KEY).collect()]
    got = [tuple(r) for r in explore.list_versions(cat, members, filters, 100).collect()]
    assert got == want
    pages, after = [], None
    for _ in itertools.repeat(None, 4):  # pages behind one another
        page = explore.list_versions(cat, members, filters, 17, after=after).collect()
        pages += [tuple(r) for r in page]
        after = tuple(page[-1][c] for c in explore.PAGE_KEY) if page else after
    assert pages == want[: 4 * 17]


def test_only_children_of_the_page_are_counted(parts):
    cat, members = parts
    plan = explore.list_versions(cat, members, Filters(has_repository=True), 5)._jdf.queryExecution().optimizedPlan().toString()
    children = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert len(children) >= 3 and all("rightHint=(strategy=broadcast)" in line for line in children)  # each child table meets the page first
    with pytest.raises(ValueError):
        explore.list_versions(cat, members, Filters(has_repository=True, without_repository=True))

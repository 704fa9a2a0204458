"""Requests meet packages once, by their whole key; duplicates and strangers keep their answers."""

from tidemark.operators import workqueue


def test_requests_meet_packages_by_their_key(spark):
    versions = spark.createDataFrame([(1, "a", "1"), (2, "b", "1")], "id long, server_identifier string, server_version string")
    rows = [("p", 1, 0, "npm", "x", "1.0"), ("q", 1, 1, "npm", "x", "1.0"), ("r", 2, 0, "npm", "x", "2.0"), ("s", 2, 1, "pypi", "x", "2.0"), ("t", 2, 2, "npm", "y", None)]
    packages = spark.createDataFrame(rows, "id string, server_version_id long, position int, registry_type string, identifier string, version string")
    asked = [("a", "1", "x"), ("a", "1", "x"), ("b", "1", "x"), ("b", "1", "y"), ("c", "1", "x"), ("a", "1", "y")]
    requests = spark.createDataFrame(asked, "server_identifier string, server_version string, package_identifier string")
    found = workqueue.resolve_packages(requests, packages, versions)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [("a", "1", "x", "resolved", "p")] * 2
        + [("b", "1", "x", "ambiguous_package", None), ("b", "1", "y", "missing_version", None)]
        + [("c", "1", "x", "package_not_found", None), ("a", "1", "y", "package_not_found", None)],
        key=repr,
    )

"""Rule metadata is folded without sorting every finding."""

import re

from tidemark.plans import registry


def test_findings_are_hashed_not_sorted(spark, sf):
    plan = registry.queries()["a8_rule_definitions"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    folds = [line for line in plan.splitlines() if "Aggregate" in line and "analysis_run_id" in line]
    assert folds and not any("SortAggregate" in line for line in folds), plan
    assert not re.search(r"SortAggregate\(key=\[analysis_run_id", plan)

"""Finding reviews: optimistic acceptance, current dispositions, the open review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import DISPOSITIONS
from .ordering import newest_per_key

REVIEW_DISPOSITIONS = tuple(d for d in DISPOSITIONS if d != "unreviewed")
MAX_REVIEWER_BYTES = 200


def current_dispositions(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with the disposition of their latest review, if any."""
    last = reviews.groupBy("finding_id").agg(F.max_by("disposition", "id").alias("reviewed"))
    return (
        findings.join(last.withColumnRenamed("finding_id", "id"), "id", "left")
        .withColumn("disposition", F.coalesce("reviewed", "disposition"))
        .drop("reviewed")
    )


def judge_reviews(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """Outcome of each review request against the current dispositions.

    A request is accepted when it expects the current value and changes it. Of several
    requests for one finding the earliest (by ``seq``) is judged, the rest are conflicts: after
    it has been applied their expectation no longer holds, or they must be asked again.
    """
    valid = (
        F.col("expected_disposition").isin(*DISPOSITIONS)
        & F.col("disposition").isin(*REVIEW_DISPOSITIONS)
        & F.octet_length("reviewer").between(1, MAX_REVIEWER_BYTES)
    )
    valid = F.coalesce(valid, F.lit(False))
    current = findings.select(F.col("id").alias("finding_id"), F.col("disposition").alias("current"))
    rows = requests.join(current, "finding_id", "left").withColumn(
        "fits",
        F.coalesce(
            valid & (F.col("current") == F.col("expected_disposition")) & (F.col("current") != F.col("disposition")),
            F.lit(False),
        ),
    )
    first = newest_per_key(
        rows.filter("fits").select("finding_id", "seq"), ["finding_id"], [F.asc("seq")]
    ).select("finding_id", "seq", F.lit(True).alias("won"))
    outcome = (
        F.when(~valid, "invalid")
        .when(F.col("current").isNull(), "not_found")
        .when(F.col("won"), "accepted")
        .otherwise("conflict")
    )
    return rows.join(first, ["finding_id", "seq"], "left").select(*requests.columns, outcome.alias("outcome"))


def review_queue(findings: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Open high and critical findings: severity as text ascending, newest run, highest id."""
    return (
        findings.filter((F.col("disposition") == "unreviewed") & F.col("severity").isin("high", "critical"))
        .orderBy(F.asc("severity"), F.desc("analysis_run_id"), F.desc("id"))
        .offset(offset)
        .limit(limit)
    )

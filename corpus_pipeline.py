"""From raw documents to a weighted training corpus: five stages, each by one operator of ``tidemark.llm``.

Every stage takes (spark, docs, sf_dir) and returns what it keeps. Its result is written as Parquet
and read again before the next stage, so a lost executor costs a re-read and no stage is computed
twice. A stage that begins deletes the working tables that the stage before it left in the shared
folder: by then that stage's result is written.

1. ``quality``: documents that the byte-level classifier rejects go.
2. ``near_duplicates``: one document of each group that shingle links connect stays (the smallest doc_id).
3. ``repeats``: byte strings of 200 and more that occur again, anywhere, leave the texts.
4. ``benchmark``: words of benchmark phrases leave the texts.
5. ``mixture``: token counts, domain memberships, rates and draws are added; every document stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import contamination, jaccard, mixing, quality, suffixes
from tidemark.llm.queries import TARGETS, by_language, table
from tidemark import session
from tidemark.session import staged


_left: list[str] = []  # working tables of the stage that was begun last


def _stage(step, first: bool = False):
    """A stage that drops what the one before it left, and notes what it leaves itself."""

    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in [] if first else _left:
            session.remove(spark, path)
        before = len(session.STAGED)
        kept = step(spark, docs, sf_dir)
        _left[:] = session.STAGED[before:]
        return kept

    return begun


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, by_language(docs), TARGETS)


STAGES = [
    ("quality", _stage(keep_good, first=True)),
    ("near_duplicates", _stage(keep_one_of_each_group)),
    ("repeats", _stage(cut_repeats)),
    ("benchmark", _stage(cut_benchmark)),
    ("mixture", _stage(weigh)),
]

#: The classifier's scores are no SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs

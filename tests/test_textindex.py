"""The stored text index against ranking from the texts."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import explore, textindex
from tidemark.session import scratch

TEXTS = [
    (1, "alpha", "1.0", "The weather server, with weather data and Weathering"),
    (2, "weather", "2.0", "nothing of the kind"),
    (3, "weatherly", "1.0", "weather_weather weather-vane 7weather"),
    (4, "beta", None, None),
    (5, "gamma", "1.0", ""),
    (6, "delta", "1.0", "Öl und Äther, naïve wéather Wetter-Daten"),
    (7, "weather", "1.0", "data data data weather"),
    (8, "Weather", "1.0", "data " * 300),
    (9, "日本 server", "1.0", "天気 天気予報 data"),
]
FIELDS = ("server_identifier", "description")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, server_identifier string, server_version string, description string")


@pytest.fixture(scope="module")
def index(spark, docs):
    root = scratch(spark, "index")
    for k in range(3):
        textindex.add_segment(textindex.segment(docs.filter(F.col("id") % 3 == k), "id", FIELDS), root, k)
    return textindex.TextIndex.read(spark, root)


@pytest.mark.parametrize("query", ["weather", "Weather data", "d", "the weather", "天気", "äther", "öl wett", "weather absent", "7weather", "a-b", "server"])
def test_ranking_is_that_of_the_texts(docs, index, query):
    want = explore.search_ranked(docs, query, FIELDS, ("id", "server_identifier", "server_version")).collect()
    got = textindex.search_index(index, query).collect()
    assert [(r.doc, r.server_identifier, round(r.score, 9)) for r in got] == [(r.id, r.server_identifier, round(r.score, 9)) for r in want]


def test_pages_and_wrong_queries(docs, index):
    every = [r.doc for r in textindex.search_index(index, "weather").collect()]
    assert len(every) > 3
    assert [textindex.search_index(index, "weather", 2, k).collect()[0].doc for k in range(3)] == every[:3]
    for wrong in ("", "..."):
        with pytest.raises(ValueError):
            textindex.search_index(index, wrong)
    with pytest.raises(ValueError):
        textindex.search_index(index, "x", 501)


def test_a_search_reads_the_postings_of_its_terms_only(index):
    plan = index.matches(["weather", "data"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 3 and "description" not in plan
    for scan in scans:
        assert "first#" in scan.split("PartitionFilters: [")[1].split("]")[0]
        assert "StringStartsWith(term,weather)" in scan and "StringStartsWith(term,data)" in scan
    files = index.postings.where(F.col("first") == ord("w") % textindex.FOLDERS).select(F.input_file_name()).distinct().count()
    assert 0 < files < index.postings.select(F.input_file_name()).distinct().count()


def test_segments_hold_statistics(docs, index):
    row = index.totals().first()
    lengths = [r.words for r in explore.match_terms(docs, "x", FIELDS).collect()]
    assert row.n == len(TEXTS) and row.avg_length == pytest.approx(sum(lengths) / len(lengths))
    with pytest.raises(FileNotFoundError):
        textindex.TextIndex.read(docs.sparkSession, scratch(docs.sparkSession, "none"))


def test_an_attempt_that_broke_off_is_not_searched(spark, docs):
    root = scratch(spark, "index")
    textindex.add_segment(textindex.segment(docs.filter("id < 4"), "id", FIELDS), root, 1)
    for name, df in textindex.segment(docs.filter("id >= 4"), "id", FIELDS).items():
        df.write.parquet(f"{root}/segment-00000002/{name}")
    assert textindex.TextIndex.read(spark, root).names.count() == 3
    textindex.add_segment(textindex.segment(docs.filter("id >= 4"), "id", FIELDS), root, 2)
    assert textindex.TextIndex.read(spark, root).names.count() == len(TEXTS)
    with pytest.raises(FileExistsError):
        textindex.add_segment(textindex.segment(docs, "id", FIELDS), root, 2)


def test_words_are_counted_in_their_row(docs):
    """One shuffle brings the postings to their files: none counts words, and no sample makes them twice."""
    postings = textindex.segment(docs, "id", FIELDS)["postings"]
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1 and "ASC NULLS FIRST], true" not in plan
    rows = {(r.doc, r.term): (r.tf, r.words, r["first"]) for r in postings.collect()}
    assert rows[8, "data"] == (300, 301, ord("d") % textindex.FOLDERS) and rows[8, "weather"][:2] == (1, 301)
    assert rows[3, "weather"][:2] == (3, 6) and (2, "weather") in rows and rows[4, "beta"][:2] == (1, 1)
    assert sum(tf for tf, _, _ in rows.values()) == textindex.segment(docs, "id", FIELDS)["statistics"].first().words

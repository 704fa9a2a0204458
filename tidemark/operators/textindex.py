"""A stored inverted index over the searchable texts of records.

Each import adds one segment, three tables that become visible with the import:

``postings``    (first, term, doc, tf, words): how often a term stands in a document, and the document's length.
                Folders by ``first``, a number from the term's first character; files sorted by term, so that row
                groups and pages cover narrow ranges of terms. A file holds a share of the documents, so a frequent
                term lies in many files.
``names``       what a listing shows of a document: its id, identifier and version.
``statistics``  documents and words of the segment.

A search reads the folders of its terms' first characters, in these the row groups whose range of terms meets
the prefix, and no text. Document frequencies of prefix terms come from the same postings, the collection's
size and mean length from the statistics of all segments.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import staged
from ..sinks.publish import generations, publish_generation
from . import explore

FOLDERS = 64  # of postings in one segment
PARTS = 16  # of a folder, by document: a file each, or fewer where Spark puts them together
NAMES = ("server_identifier", "server_version")


def _first(term: Column) -> Column:
    return F.pmod(F.ascii(term), F.lit(FOLDERS)).cast("int")


def _lowered(fields: Iterable[str]) -> Column:
    return F.lower(F.concat_ws("\n", *fields))


def segment(docs: DataFrame, doc: str, fields: tuple[str, ...], names: tuple[str, ...] = NAMES) -> dict[str, DataFrame]:
    """The tables of one segment for documents with a unique id in the column ``doc``."""
    words = docs.select(F.col(doc).alias("doc"), F.sort_array(text.tokens(_lowered(fields))).alias("sorted"))
    # all words of a document are in its row, so they are counted there: equal ones are neighbours, and a run ends where the next begins
    place = F.sequence(F.lit(1), F.size("sorted"))
    last = F.filter(place, lambda i: F.coalesce(F.get("sorted", i) != F.get("sorted", i - 1), F.lit(True)))
    ends = words.filter(F.size("sorted") > 0).withColumn("ends", last)
    runs = F.transform("ends", lambda e, k: F.struct(F.get("sorted", e - 1).alias("term"), (e - F.coalesce(F.get("ends", k - 1), F.lit(0))).alias("tf")))
    counted = ends.select("doc", F.size("sorted").alias("words"), F.explode(runs).alias("run"))
    postings = counted.select(_first(F.col("run.term")).alias("first"), "run.term", "doc", "run.tf", "words")
    # ranges would be found by a sample of all postings, made a second time for it
    part = F.pmod(F.xxhash64("doc"), F.lit(PARTS))
    postings = postings.repartition("first", part).sortWithinPartitions("first", "term", "doc")
    lengths = docs.select(F.size(text.tokens(_lowered(fields))).alias("words"))
    return {
        "postings": postings,
        "names": docs.select(F.col(doc).alias("doc"), *names),
        "statistics": lengths.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).cast("bigint").alias("words")),
    }


#: The table that is written in folders, and the column that names them.
FOLDERED = {"postings": "first"}


def add_segment(tables: dict[str, DataFrame], root: str, number: int) -> str:
    """Add a segment to a stored index; it becomes visible when all its tables are written."""
    return publish_generation(tables, root, f"segment-{number:08d}", FOLDERED)


@dataclass
class TextIndex:
    """The postings, names and statistics of all segments."""

    postings: DataFrame
    names: DataFrame
    statistics: DataFrame

    @staticmethod
    def read(spark: SparkSession, root: str, pattern: str = "segment-*", prefix: str = "") -> TextIndex:
        """All visible segments below ``root`` as one index; segments share no documents."""
        folders = generations(spark, root, pattern)
        if not folders:
            raise FileNotFoundError(f"no segment below {root}")
        # folders of several segments have no common root, so each is read with its own partition column
        postings = [spark.read.parquet(f"{f}/{prefix}postings") for f in folders]
        return TextIndex(
            reduce(DataFrame.unionByName, postings),
            *(spark.read.parquet(*[f"{f}/{prefix}{name}" for f in folders]) for name in ("names", "statistics")),
        )

    def matches(self, terms: list[str]) -> DataFrame:
        """(doc, words, tf) of every document with a word that starts with a term; ``tf`` holds a count for each term."""
        if not terms:
            raise ValueError("search query has no terms")
        starts = [F.startswith("term", F.lit(t)) for t in terms]
        folders = sorted({ord(t[0]) % FOLDERS for t in terms})
        hits = self.postings.where(F.col("first").isin(folders) & reduce(lambda a, b: a | b, starts))
        return hits.groupBy("doc").agg(
            F.max("words").alias("words"),
            F.array(*[F.sum(F.when(s, F.col("tf")).otherwise(0)) for s in starts]).alias("tf"),
        )

    def totals(self) -> DataFrame:
        """(n, avg_length) of the whole collection; one row."""
        return self.statistics.agg(F.sum("documents").alias("n"), (F.sum("words") / F.sum("documents")).alias("avg_length"))


def match_index(index: TextIndex, query: str) -> DataFrame:
    """(doc, words, tf) of the documents that hold all terms of a query as word starts."""
    return explore.all_terms(index.matches(explore.search_terms(query)))


def search_index(
    index: TextIndex,
    query: str,
    limit: int = explore.DEFAULT_SEARCH_LIMIT,
    offset: int = 0,
    members: DataFrame | None = None,
    cat: explore.Catalog | None = None,
    filters: explore.Filters = explore.Filters(),
    ties: tuple[str, ...] = NAMES,
) -> DataFrame:
    """As ``explore.search_ranked``, from the stored index: exact name, name prefix, score, ``ties`` and the id.

    Returns (doc, the names, score); with ``members`` and ``cat`` also the facts of the member versions, whose id is ``doc``.
    """
    if not query:
        raise ValueError("search query must not be empty")
    explore.check_page(limit, offset, explore.MAX_SEARCH_LIMIT)
    terms = explore.search_terms(query)
    matched = staged(index.matches(terms), "matches")  # read for the frequencies and for the ranking
    ranked = explore.scored(matched, index.totals(), explore.document_frequencies(matched, len(terms)), len(terms)).drop("words", "tf")
    ranked = ranked.join(index.names, "doc")
    if members is not None:
        facts = explore.versions_with_facts(cat, members, explore.child_facts(explore.pruned(cat, members), filters))
        fitting = explore.row_columns(explore.apply_filters(facts, filters).select("server_version_id", "registry_status", "packages", "remotes"), cat)
        ranked = ranked.join(fitting.withColumnRenamed("server_version_id", "doc"), "doc")
    return (
        ranked.orderBy(*explore.match_order(query), F.desc("score"), *ties, "doc")
        .offset(offset)
        .limit(limit)
    )

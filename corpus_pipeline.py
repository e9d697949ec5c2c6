"""A corpus pipeline: classify, deduplicate, redact, mix, pack.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. run() applies them to the documents table, writing each
stage's rows as Parquet in the shared folder and reading them again for the next.

For every stage: docs needs doc_id and text (mixing: source too); further columns, whatever their names, are carried
unread, but for n_chars, which follows a changed text. A null in any column, empty and very long texts are rows like
others. An empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import stored, table
from corpusmill.llm.jaccard import MOST_BROADCAST, represented, row_hash
from corpusmill.llm.mixing import mixed
from corpusmill.llm.packing import packed
from corpusmill.llm.pii import redacted
from corpusmill.llm.quality import accepted
from corpusmill.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text is scored as one of no words. Repeated rows get one score and stay or go together. Rows without an id
    never train. Without labels nothing is known against a document, and all stay.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of five-word-shingle similarity 0.8 or more stays.

    Rows with one doc_id and one text are one document, and one of them stays; other texts under that id, or without an
    id, are others. An id comes before none; of several texts under the smallest id (or without one) in a group, that
    with the least hash stays. Texts without words (null, empty) are like no other and stay, one for an id.
    """
    ship(spark)
    rows = stored(represented(docs, words=5, percent=80), "components")
    known = "_kept_row"
    while known in docs.columns:
        known += "_"
    stay = rows.filter("kept").select(F.col("row").alias(known))
    different = stay.distinct()
    n = different.count()
    one = docs.join(F.broadcast(different) if n <= MOST_BROADCAST else different, row_hash() == F.col(known), "left_semi")
    return one.dropDuplicates(["doc_id", "text"]) if stay.count() > n else one


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind. A null text stays null; repeated rows are masked alike."""
    ship(spark)
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document at the edge of a quota is cut after its last word taken.

    A null source is a source of its own, after all others. Texts without words (null, empty) are taken no time. Each of
    repeated rows counts.
    """
    ship(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece. A null or empty text is its end token; repeats are packed each."""
    ship(spark)
    return packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs


#: The stages learn models and tokenise, which SQL cannot express; tests hold each against a plain version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

"""From raw documents to packed training sequences: five stages, each one operator of ``riskframe.llm``.

A stage takes (spark, docs, sf_dir) and returns a table: the documents it keeps, with their columns, and the last
one the packed pieces. ``run`` writes each result to the shared folder as Parquet and reads it back as the next
stage's documents, so a stage starts from files and never recomputes an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import exact_dedup, mixing, packing, quality_knn, simhash
from riskframe.llm.common import documents, labels, written
from riskframe.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote does not reject; labels.parquet gives the labelled sample."""
    return quality_knn.keep_good(docs, labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links connect."""
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, drawn from the sources at a flatter mix; a document used twice is two rows."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]

#: The stages learn, follow chains of links and solve a program, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs

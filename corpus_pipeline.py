"""A corpus pipeline over ``documents``: classify, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airtally.llm import bpe, mixing, near_duplicates, quality
from airtally.llm.queries import find_package, table, word_bpe
from airtally.llm.shared import materialize


def free_name(name: str, docs: DataFrame) -> str:
    """A name that no column has, in any spelling."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, rows that repeat each on its own; without labels of
    both kinds all of them. Nulls and empty texts are scored like any other value."""
    find_package(spark)
    name = free_name("verdict", docs)
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), name=name)
    return scored.where(F.col(name)["kept"]).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, null last, of rows with
    one id that with the smallest digest.

    Rows are linked by a number of their own, so texts of one id that are not alike all stay, and so
    do all texts without words; rows with a null id are compared like others.
    """
    find_package(spark)
    row, digest = free_name("row", docs), F.xxhash64(*docs.columns)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows", "zstd")
    linked = near_duplicates.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("number"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", digest.alias("digest"), F.col(row).alias("number"))
    named = rows.select(F.col(row).alias("number"), order.alias("place"))
    first = linked.join(named, "number").groupBy("component_id").agg(F.min("place")["number"].alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken. Null sources are a source; texts
    without words are in no mix; rows that repeat are documents of their own."""
    find_package(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sizes and digests of the ids of every row and of what they decode to; a null text has no ids."""
    find_package(spark)
    return bpe.round_trip(docs, word_bpe())


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicates", one_of_each_group),
    ("source mixing", source_mix),
    ("token ids", token_ids),
]

#: The classifier is fitted and BPE encodes, so SQL cannot express this.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs

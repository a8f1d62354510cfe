"""Documents to packed training sequences in five stages; each is written as Parquet and reread.

Every stage works on all that its predecessor kept and its decisions take effect: toxic documents
go, one of each group of equal and of near-equal texts stays, documents with benchmark passages
go, and what is left is packed. All but the last return the columns of ``documents``.

Edge cases: a stage decides about rows, not ids. Where doc_ids repeat or are null, rows are numbered by
doc_id (null first) and text, and the numbers stand in for ids: one row of each group stays all the same.
Null texts are empty and thus equal; an empty table goes through as one; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incrementa.llm.common import load, partitions, prepare, settle
from incrementa.llm.decontam import without_contaminated
from incrementa.llm.exact import exact_groups
from incrementa.llm.packing import pack_documents
from incrementa.llm.simhash import simhash_groups, similar_scheme
from incrementa.llm.toxicity import without_toxic

ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique number of each row: its doc_id, or where ids repeat or are missing its place by doc_id and text, in a settled copy."""
    number = F.col("doc_id").cast("long")
    if docs.groupBy(number.alias("n")).count().where("n is null or count > 1").isEmpty():
        return docs.withColumn(ROW, number)
    order = [number.asc_nulls_first(), F.xxhash64("text")]
    placed = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    return settle(placed.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def keep(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Those of ``rows`` whose number is a ``numbers(doc_id)``. The numbers grow with the documents, so the join is a merge at every size."""
    kept = settle(numbers.select(F.col("doc_id").alias(ROW)), "kept")
    return rows.join(kept.hint("merge"), ROW, "left_semi").drop(ROW)


def named(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with the rows' numbers for ids."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the lexicon model does not reject."""
    return without_toxic(docs, load(spark, sf_dir, "labels"), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts."""
    rows = numbered(docs)
    return keep(rows, exact_groups(named(rows)).where("kept")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of similar texts: five-word shingles, similarity 0.8 or more."""
    rows = numbered(docs)
    groups = simhash_groups(named(rows), similar_scheme(width=5, similarity=0.8))
    return keep(rows, groups.where("doc_id = component_id")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark passage."""
    return without_contaminated(docs, load(spark, sf_dir, "benchmark"), window=13, share=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return pack_documents(docs, capacity=2048, end_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: learned scores, fingerprints and token ids are beyond SQL; tests hold the first four stages against their operators, which have tests of their own
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

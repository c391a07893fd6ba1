"""Documents to training sequences in five stages.

quality classifier -> n-gram Jaccard join -> benchmark decontamination ->
personal data -> best-fit packing.  Each stage takes what its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, jaccard_join, packing, personal_data, quality
from tallyforge.llm.common import boxed, fold, stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled documents outside fold 0."""
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return quality.score(boxed(docs, text=F.col("text")), model, ["row"]).where("predicted = 1").select("row.*")


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id."""
    return jaccard_join.kept(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def impersonal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars (where there is one) counted anew; null texts stay null."""
    out = personal_data.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences."""
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", different), ("decontamination", untested), ("personal_data", impersonal), ("packing", packed)]

#: The classifiers and the search aren't SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, what each keeps written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Profiles of corpora and masters: many counters in one pass, strata, key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corpus(df: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Counts by each grouping column in turn, by grouping sets: dimension, value, n, chars."""
    columns = list(groups.values())
    counted = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.sum("size").alias("chars"), F.grouping_id().alias("g"))
    k = len(columns)
    name = F.coalesce(*[F.when(F.col("g").bitwiseAND(1 << (k - 1 - i)) == 0, F.lit(label)) for i, label in enumerate(groups)])
    value = F.coalesce(*[F.when(F.col("g").bitwiseAND(1 << (k - 1 - i)) == 0, F.col(c).cast("string")) for i, c in enumerate(columns)])
    return counted.select(name.alias("dimension"), value.alias("value"), "n", "chars")


def stratified(df: DataFrame, strata: list[str], n: int, order: str) -> DataFrame:
    """The first n rows of each stratum."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def key_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys, those with several values, null keys and null values, in one row."""
    own = df.groupBy(key).agg(F.count_distinct(value).alias("values"), F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("blank"))
    present = F.col(key).isNotNull()
    return own.agg(F.count_if(present).alias("keys"), F.count_if(present & (F.col("values") > 1)).alias("several"), F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_keys"), F.sum("blank").alias("null_values"))


def shared_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct keys of two namespaces: in both, in either."""
    a = left.toDF("k").where("k is not null").distinct().withColumn("a", F.lit(1))
    b = right.toDF("k").where("k is not null").distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count("*").alias("n_any"))

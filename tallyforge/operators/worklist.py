"""Worklists, counts and directories: filters, projections, sorts and grouped counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY, money_equal, money_round

# States of an invoice.
STATUSES = ("queued", "processing", "needs_review", "ready", "exported", "failed")
MATCHED = ("auto", "confirmed")


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle in any of the columns; letters of either case, % and _ of the needle stand for anything."""
    return df.where(reduce(Column.__or__, (F.col(c).ilike(f"%{needle}%") for c in columns)))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def status_counts(invoices: DataFrame) -> DataFrame:
    """Invoices of every state, zero where there are none, and the total."""
    spark = invoices.sparkSession
    states = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = invoices.groupBy("status").agg(F.count("*").alias("n"))
    filled = F.broadcast(counted).join(states, "status", "right").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return filled.unionByName(counted.agg(F.lit("total").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def line_counts(lines: DataFrame) -> DataFrame:
    """Lines and matched lines of each invoice."""
    matched = F.col("rms_item_id").isNotNull() & F.col("match_status").isin(*MATCHED)
    return lines.groupBy("invoice_id").agg(F.count("*").alias("line_count"), F.count_if(matched).alias("matched_lines"), F.count_if(F.col("match_status") == "auto").alias("auto_lines"))


def summary(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Each invoice with its lines' count and total at its currency's digits, null if a line's can't be made, and how that differs from the subtotal.

    Lines are summed up by invoice and digits of rounding before they meet
    their invoice: each sum is kept for the digits there are.
    """
    value = F.col("quantity") * F.col("unit_price")
    sums = {d: F.sum(money_round(value, F.lit(d))).alias(f"sum{d}") for d in (0, 2, 3)}
    counted = lines.groupBy("invoice_id").agg(F.count("*").alias("line_count"), F.count_if(F.col("rms_item_id").isNotNull() & F.col("match_status").isin(*MATCHED)).alias("matched_lines"), F.count_if(value.isNull()).alias("missing"), *sums.values())
    total = F.when(F.col("missing") == 0, F.when(F.col("digits") == 0, F.col("sum0")).when(F.col("digits") == 3, F.col("sum3")).otherwise(F.col("sum2"))).cast("decimal(28,4)")
    joined = invoices.join(counted, invoices["id"] == counted["invoice_id"], "left")
    out = joined.select("id", "status", "currency", F.coalesce("line_count", F.lit(0)).cast("long").alias("line_count"), F.coalesce("matched_lines", F.lit(0)).cast("long").alias("matched_lines"), total.alias("target_total"), "subtotal", "digits")
    variance = (F.col("target_total") - F.col("subtotal")).cast("decimal(28,4)")
    return out.select("id", "status", "currency", "line_count", "matched_lines", "target_total", variance.alias("variance"), (~F.coalesce(money_equal(F.col("target_total").cast(MONEY), F.col("subtotal").cast(MONEY), F.col("digits")), F.lit(False))).alias("review"))


def missing_fields(df: DataFrame, fields: list[str]) -> Column:
    """Names of the fields that are null or blank, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields]))


def newest(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The newest n rows, n held between 1 and 1000."""
    return df.orderBy(F.col(order).desc()).limit(max(1, min(1000, n)))


def first_positions(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, at its first position."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")

"""Where results go: the export triple, the exceptions sheet, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import sheet_safe


def write_export(header: DataFrame, tax: DataFrame, details: DataFrame, folder: str, kind: str = "parquet") -> None:
    """The three tables under a folder; a run that fails leaves no _SUCCESS in the table it was at."""
    for name, df in (("Header", header), ("Tax_Breakdown", tax), ("Details", details)):
        writer = df.write.mode("overwrite")
        if kind == "csv":
            writer.option("header", True).csv(f"{folder}/{name}")
        else:
            writer.parquet(f"{folder}/{name}")


def write_exceptions(rows: DataFrame, folder: str) -> None:
    """Exceptions as CSV for spreadsheets: cells that would be formulas are text, lines end in CR and LF."""
    texts = {c for c, kind in rows.dtypes if kind == "string"}
    safe = rows.select(*[sheet_safe(F.col(c)).alias(c) if c in texts else F.col(c) for c in rows.columns])
    safe.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").csv(folder)


def write_receipt(summary: DataFrame, folder: str) -> None:
    """A summary of a few rows as one JSON file."""
    summary.select(F.to_json(F.struct(*summary.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(folder)

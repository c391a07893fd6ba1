"""The three export tables, their check, and row-level imports as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import order_number, sheet_safe


def number_invoices(ids: DataFrame, bucket: Column) -> DataFrame:
    """transaction (text, from 1) of each id(id, position), in the order of position.

    bucket grows with position, a month of a day for instance: ranks are
    counted inside each, after the sizes of those before it, so no task holds
    all ids.
    """
    cut = ids.withColumn("bucket", bucket)
    from_start = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each bucket
    sizes = cut.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(from_start, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("position", "id"))
    return cut.withColumn("r", inside).join(sizes, "bucket").select("id", (F.col("before") + F.col("r")).cast("string").alias("transaction"))


def eligible(ids: DataFrame, invoices: DataFrame, errors: DataFrame, states=("ready", "exported")) -> DataFrame:
    """What becomes of each id(id, position), the first of repeated ones: export, missing, not_ready or invalid."""
    first = ids.groupBy("id").agg(F.min("position").alias("position"))
    bad = errors.select("id").distinct().withColumn("bad", F.lit(True))
    j = first.join(invoices.select("id", "status"), "id", "left").join(bad, "id", "left")
    state = F.when(F.col("status").isNull(), "missing").when(~F.col("status").isin(*states), "not_ready").when(F.col("bad"), "invalid").otherwise("export")
    return j.select("id", "position", state.alias("outcome"))


def master_order(lines: DataFrame) -> DataFrame:
    """The one valid order number that an invoice's lines have, or null."""
    orders = F.collect_set(order_number(F.col("rms_po_number")))
    return lines.groupBy("invoice_id").agg(F.when(F.size(orders) == 1, F.get(orders, F.lit(0))).alias("master_po"))


def header(numbered: DataFrame, invoices: DataFrame, orders: DataFrame) -> DataFrame:
    j = numbered.join(invoices, "id").join(orders, F.col("id") == F.col("invoice_id"), "left")
    return j.select("transaction", F.col("number").alias("document"), F.coalesce(order_number(F.col("po_number")), "master_po").alias("order_no"), "invoice_date", F.col("subtotal").alias("total_ex_tax"), "tax_total", sheet_safe(F.col("comment")).alias("comment"))


def tax(numbered: DataFrame, invoices: DataFrame) -> DataFrame:
    return numbered.join(invoices, "id").select("transaction", "tax_code", F.col("subtotal").alias("tax_basis"))


def details(numbered: DataFrame, lines: DataFrame, include_code: bool = False) -> DataFrame:
    j = numbered.join(lines, numbered["id"] == lines["invoice_id"])
    return j.select("transaction", "line_no", F.coalesce("parent_item", "rms_item_id").alias("item"), (F.col("upc") if include_code else F.lit(None).cast("string")).alias("upc"), F.col("unit_price").alias("unit_cost"), "quantity")


def conformance(head: DataFrame, taxes: DataFrame, det: DataFrame) -> DataFrame:
    """Transactions by fault: no_details, no_tax, orphan_details, basis_differs, total_differs, formula."""
    total = det.groupBy("transaction").agg(F.sum(F.round(F.col("unit_cost") * F.col("quantity"), 2)).alias("lines"))
    basis = taxes.groupBy("transaction").agg(F.sum("tax_basis").alias("basis"))
    j = head.join(total.withColumn("has", F.lit(True)), "transaction", "full").join(basis, "transaction", "left")
    known = F.col("total_ex_tax").isNotNull()
    faults = F.array_compact(
        F.array(
            F.when(known & F.col("has").isNull(), "no_details"), F.when(known & F.col("basis").isNull(), "no_tax"), F.when(~known, "orphan_details"),
            F.when(F.col("basis") != F.col("total_ex_tax"), "basis_differs"), F.when(F.abs(F.col("lines") - F.col("total_ex_tax")) > 0.01, "total_differs"), F.when(F.col("comment").rlike(r"^[=+\-@]"), "formula"),
        )
    )
    return j.select("transaction", F.explode(faults).alias("fault"))


def upsert(old: DataFrame, new: DataFrame, key: str, created: str = "created_at") -> DataFrame:
    """Snapshot in which the new row of a key wins, and the earliest creation stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in old.columns if c not in (key, created)]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), "_new").alias("_r"), F.min(created).alias(created)).select(key, created, *[F.col(f"_r.{c}").alias(c) for c in columns])


def apply_versions(rows: DataFrame, changes: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows after changes(id, expected_version, new value), and the changes that met another version."""
    j = rows.join(changes.select("id", "expected_version", F.col(value).alias("_v")), "id", "left")
    hit = F.coalesce(F.col("expected_version") == F.col("version"), F.lit(False))
    after = j.select(*[c for c in rows.columns if c not in (value, "version")], F.when(hit, F.col("_v")).otherwise(F.col(value)).alias(value), (F.col("version") + hit.cast("int")).alias("version"))
    return after, j.where(F.col("expected_version").isNotNull() & ~hit).select("id", "expected_version", "version")


def occurrences(rows: DataFrame, identity: list[Column], order: list[str]) -> DataFrame:
    """Rows with occurrence, their number among those of the same identity, from 1."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*identity).orderBy(*order)))


def validate_master(rows: DataFrame) -> DataFrame:
    """Rows of an item master with their faults: no item, no description, no cost or a negative one, a currency that isn't three letters."""
    cost = F.regexp_replace(F.trim("unit_cost"), ",", "").try_cast("decimal(18,4)")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    faults = F.array_compact(F.array(F.when(blank("rms_item_id"), "item"), F.when(blank("description"), "description"), F.when(cost.isNull() & ~blank("unit_cost"), "cost"), F.when(cost < 0, "negative_cost"), F.when(~blank("cost_currency") & ~F.upper(F.trim("cost_currency")).rlike("^[A-Z]{3}$"), "currency")))
    return rows.withColumn("cost", cost).withColumn("faults", faults)

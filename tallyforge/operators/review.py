"""Validation, reason codes, the exception queue and control figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY, money_equal

# Reason codes in their order, with owner and where the evidence lives.
REASONS = [
    ("extraction_failed", "pilot_owner", "invoice"),
    ("extraction_limit", "pilot_owner", "invoice"),
    ("document_type_not_invoice", "brand_operator", "invoice"),
    ("supplier_unresolved", "brand_operator", "invoice"),
    ("line_unmapped", "item_master_owner", "line"),
    ("line_low_confidence", "brand_reviewer", "line"),
    ("unit_unconfirmed", "brand_reviewer", "line"),
    ("price_above_tolerance", "brand_reviewer", "line"),
    ("adjustment_unpaired", "brand_reviewer", "line"),
    ("currency_basis_mismatch", "finance_owner", "invoice"),
    ("total_reconciliation_failed", "brand_reviewer", "invoice"),
    ("duplicate_suspected", "finance_owner", "invoice"),
    ("header_field_missing", "brand_operator", "invoice"),
]
# The reason of each validation code that has one whatever its field.
CODES = {
    "invalid_date": "header_field_missing", "invalid_currency": "header_field_missing", "invalid_order_number": "header_field_missing", "not_invoice": "document_type_not_invoice",
    "invalid_number": "total_reconciliation_failed", "negative_money": "total_reconciliation_failed", "nonpositive_quantity": "total_reconciliation_failed", "line_calculation_mismatch": "total_reconciliation_failed",
    "sum_mismatch": "total_reconciliation_failed", "target_cost_mismatch": "total_reconciliation_failed", "unmapped": "line_unmapped", "unknown_rms_item": "line_unmapped", "catalog_item_mismatch": "line_unmapped",
    "supplier_item_mismatch": "line_unmapped", "unit_unconfirmed": "unit_unconfirmed", "target_cost_review_required": "price_above_tolerance", "duplicate_supplier_invoice": "duplicate_suspected", "duplicate_suspected": "duplicate_suspected",
}
# The reason of a required field, by the field's last part.
REQUIRED = {
    "supplier_id": "supplier_unresolved", "supplier_name": "supplier_unresolved", "lines": "extraction_failed", "description": "line_unmapped",
    "quantity": "total_reconciliation_failed", "unit_price": "total_reconciliation_failed", "line_total": "total_reconciliation_failed",
}
FAILURES = {"ExtractionLimitError": "extraction_limit", "UnsupportedDocumentError": "extraction_failed", "DocumentExtractionError": "extraction_failed"}
UNGOVERNED = "ungoverned"


def _pick(key: Column, table: dict[str, str], default) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(default)


def line_number(field: Column) -> Column:
    """Line that a field such as lines.3.quantity is of, or null."""
    return F.regexp_extract(field, r"^lines\.([0-9]+)\.", 1).try_cast("int")


def reason(field: Column, code: Column, match_status: Column, description: Column) -> Column:
    """Reason code of one validation error; a code that none governs gives UNGOVERNED, for the caller to refuse."""
    from tallyforge.functions.text import is_adjustment

    leaf = F.element_at(F.split(field, r"\."), -1)
    header = F.when(line_number(field).isNull(), F.lit("header_field_missing")).otherwise(F.lit(UNGOVERNED))
    unmapped = F.when(match_status == "suggested", "line_low_confidence").when(is_adjustment(description), "adjustment_unpaired").otherwise("line_unmapped")
    return F.when(code == "required", _pick(leaf, REQUIRED, header)).when((code == "unmapped") & line_number(field).isNotNull(), unmapped).otherwise(_pick(code, CODES, F.lit(UNGOVERNED)))


def failure_reason(error: Column) -> Column:
    """Reason of a failed document from its error's class name."""
    return _pick(F.regexp_extract(F.coalesce(error, F.lit("")), "^([A-Za-z]+)", 1), FAILURES, F.lit("extraction_failed"))


def comparison_state(status: Column, review: Column) -> Column:
    return F.when(status.isin("above_tolerance", "within_tolerance"), status).when(status.startswith("unavailable") | review, "unavailable")


def _error(when: Column, field: Column | str, code: str) -> Column:
    return F.when(when, F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(code).alias("code")))


def line_errors(lines: DataFrame) -> DataFrame:
    """Errors of lines as rows: id, line_no, field, code, match_status, description.

    lines(invoice_id, line_no, description, quantity, unit_price, line_total,
    rms_item_id, match_status, digits).
    """
    at = lambda leaf: F.concat(F.lit("lines."), F.col("line_no").cast("string"), F.lit(f".{leaf}"))
    q, p, t = F.col("quantity"), F.col("unit_price"), F.col("line_total")
    mismatch = ~money_equal((q * p).cast(MONEY), t.cast(MONEY), F.col("digits"))
    found = F.array_compact(
        F.array(
            _error(F.coalesce(F.trim("description"), F.lit("")) == "", at("description"), "required"),
            _error(q.isNull(), at("quantity"), "required"),
            _error(q <= 0, at("quantity"), "nonpositive_quantity"),
            _error(p.isNull(), at("unit_price"), "required"),
            _error(p < 0, at("unit_price"), "negative_money"),
            _error(t.isNull(), at("line_total"), "required"),
            _error(t < 0, at("line_total"), "negative_money"),
            _error(mismatch, at("line_total"), "line_calculation_mismatch"),
            _error(F.col("rms_item_id").isNull() | ~F.col("match_status").isin("auto", "confirmed"), at("rms_item_id"), "unmapped"),
        )
    )
    return lines.select(F.col("invoice_id").alias("id"), "line_no", "match_status", "description", F.explode(found).alias("e")).select("id", "line_no", "e.field", "e.code", "match_status", "description")


def header_errors(invoices: DataFrame, reconciled: DataFrame, duplicated: DataFrame) -> DataFrame:
    """Errors of headers as rows: id, field, code.

    invoices(id, number, invoice_date, currency, total), reconciled as
    pricing.reconcile gives it, duplicated(id).
    """
    j = invoices.join(reconciled.select("id", "sum_mismatch", "total_mismatch", F.col("line_sum").isNull().alias("no_lines")), "id", "left").join(duplicated.select("id", F.lit(True).alias("doubled")), "id", "left")
    found = F.array_compact(
        F.array(
            _error(F.col("number").isNull() | (F.col("number") == ""), "invoice_number", "required"),
            _error(F.col("invoice_date").isNull(), "invoice_date", "required"),
            _error(~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(True)), "currency", "invalid_currency"),
            _error(F.col("currency").isNull(), "currency", "required"),
            _error(F.col("total").isNull(), "total", "required"),
            _error(F.col("total") < 0, "total", "negative_money"),
            _error(F.coalesce("no_lines", F.lit(True)), "lines", "required"),
            _error(F.col("sum_mismatch"), "subtotal", "sum_mismatch"),
            _error(F.col("total_mismatch"), "total", "sum_mismatch"),
            _error(F.col("doubled"), "invoice_number", "duplicate_supplier_invoice"),
        )
    )
    return j.select("id", F.explode(found).alias("e")).select("id", "e.field", "e.code")


def reasons(header: DataFrame, line: DataFrame) -> DataFrame:
    """(id, reason) once each, from error rows."""
    a = header.select("id", reason(F.col("field"), F.col("code"), F.lit(None).cast("string"), F.lit("")).alias("reason"))
    b = line.select("id", reason(F.col("field"), F.col("code"), F.col("match_status"), F.col("description")).alias("reason"))
    return a.unionByName(b).distinct()


def exception_queue(reasons_: DataFrame, invoices: DataFrame, now: Column, first: int = 100) -> DataFrame:
    """Groups by reason: invoices, the oldest and its age in days, owner and place, and the ids of the first members, oldest first; most invoices first.

    invoices(id, created_at).  A reason that isn't registered is an error.  The
    members of a group are ranked with a limit for each task before they meet.
    """
    spark = reasons_.sparkSession
    registry = spark.createDataFrame([(i, *r) for i, r in enumerate(REASONS)], "ord int, reason string, owner string, level string")
    age = F.datediff(now, F.to_date("created_at"))
    held = reasons_.join(invoices.select("id", "created_at"), "id")
    groups = held.groupBy("reason").agg(F.count("*").alias("n"), F.max(age).alias("oldest_days"), F.min(F.struct("created_at", "id")).alias("oldest"))
    oldest = Window.partitionBy("reason").orderBy("created_at", "id")
    members = held.withColumn("r", F.row_number().over(oldest)).where(F.col("r") <= first).groupBy("reason").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("members"))
    known = groups.join(members, "reason").join(F.broadcast(registry), "reason", "left")
    order = F.coalesce("ord", F.raise_error(F.concat(F.lit("no such reason: "), F.col("reason"))).cast("int"))
    out = known.select("reason", "owner", "level", order.alias("ord"), "n", "oldest_days", F.col("oldest.id").alias("oldest_id"), F.array_join(F.transform("members", lambda m: m["id"].cast("string")), ",").alias("members"), (F.col("n") > first).alias("truncated"))
    return out.orderBy(F.desc("n"), "reason")


def touchless(trails: DataFrame, statuses=("ready", "exported")) -> DataFrame:
    """Share of trails that reached a state without a person's event beyond upload, approval and export.

    trails: events with invoice_id, event_type, actor, to_status; the
    denominator is all trails.
    """
    person = ~F.col("actor").isin("system", "demo_seed") & ~F.col("event_type").isin("uploaded", "invoice_approved", "invoice_exported")
    own = trails.groupBy("invoice_id").agg(F.bool_or(person).alias("touched"), F.bool_or(F.col("to_status").isin(*statuses)).alias("reached"))
    return own.agg(F.count_if(F.col("reached") & ~F.col("touched")).alias("touchless"), F.count("*").alias("trails"))


def first_of(events: DataFrame, kind: str, *columns: str) -> DataFrame:
    """First event of a kind of each trail, by id."""
    first = events.where(F.col("event_type") == kind).groupBy("invoice_id").agg(F.min_by(F.struct("id", *columns), "id").alias("f"))
    return first.select("invoice_id", "f.id", *[f"f.{c}" for c in columns])


def latest_status(events: DataFrame) -> DataFrame:
    """State of each trail: where its last event with a state led."""
    return events.where("to_status is not null").groupBy("invoice_id").agg(F.max_by("to_status", "id").alias("status"), F.max("id").alias("id"))


def cycle_time(events: DataFrame) -> DataFrame:
    """Median seconds from a trail's first event to its first ready, over trails that are ready now."""
    own = events.groupBy("invoice_id").agg(F.min("created_at").alias("start"), F.min_by("created_at", F.when(F.col("to_status") == "ready", F.col("id"))).alias("ready"), F.max_by("to_status", F.when(F.col("to_status").isNotNull(), F.col("id"))).alias("now"))
    seconds = (F.unix_micros(F.col("ready").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    return own.where("now = 'ready'").agg(F.count("*").alias("n"), F.round(F.median(seconds), 3).alias("median_seconds"))

"""Checks before an invoice may be approved, as rows of errors.

Figures come as printed text, so that what isn't a number is told from what is
missing.  Lines meet their invoice and the item that they are mapped to, each
by one join on its key; everything else is a condition on a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.money import minor_units, money_equal, money_round, to_decimal
from tallyforge.operators.units import unit_state

# Fields that a header must have.
REQUIRED = ("supplier_id", "supplier_name", "invoice_number", "invoice_date", "currency", "document", "supplier_site", "location", "location_type", "tax_code")
FIGURES = ("subtotal", "tax_total", "total")
PRICE = "decimal(18,4)"


def _missing(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _found(rules: list[tuple[str, str, Column]], prefix: Column | None = None) -> Column:
    """One struct(field, code) for each rule (field, code, condition) that holds."""
    place = lambda field: F.lit(field) if prefix is None else F.concat(prefix, F.lit(f".{field}"))
    return F.array_compact(F.array(*[F.when(holds, F.struct(place(field).alias("field"), F.lit(code).alias("code"))) for field, code, holds in rules]))


def _figure(c: str) -> tuple[Column, Column]:
    """A printed figure as a decimal, and whether something is printed that isn't one."""
    value = to_decimal(F.col(c), PRICE)
    return value, ~_missing(c) & value.isNull()


def _figure_rules(c: str, both: bool) -> list[tuple[str, str, Column]]:
    """A figure that isn't a number, is missing (with both: also where it isn't a number), or is negative."""
    value, wrong = _figure(c)
    return [(c, "invalid_number", wrong), (c, "required", value.isNull() if both else _missing(c)), (c, "negative_money", value < 0)]


def _attributes(text: str, unit: str) -> Column:
    stated = lambda norm: F.struct(T.sizes(norm).alias("sizes"), T.packs(norm).alias("packs"), T.shades(norm).alias("shades"), T.unit(F.col(unit)).alias("uom"))
    return T.let(T.match_text(F.coalesce(F.col(text), F.lit(""))), stated)


def _unproved(line: Column, item: Column) -> Column:
    """Whether a line's unit can't be told to be its item's; each side's attributes are worked out once."""
    both = F.struct(line.alias("line"), item.alias("item"))
    side = lambda s, name: {k: s[name][k] for k in ("sizes", "packs", "shades", "uom")}
    return T.let(both, lambda s: unit_state(side(s, "line"), side(s, "item")) == "unconfirmed")


def line_findings(lines: DataFrame, invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with found, their errors, and worth, what they add to their invoice at its currency's digits.

    A line that is mapped is held against the item of its key: the item must
    be known, have the line's number, belong to the invoice's supplier or to
    none, and its unit must be provable.  Only the first of these counts.
    """
    header = invoices.select(F.col("id").alias("invoice_id"), F.col("supplier_id").alias("invoice_supplier"), minor_units(F.col("currency")).alias("digits"))
    item = items.select("catalog_item_id", F.col("rms_item_id").alias("item_number"), F.col("supplier_id").alias("item_supplier"), F.col("description").alias("item_text"), F.col("uom").alias("item_uom"), F.lit(True).alias("known"))
    j = lines.join(header, "invoice_id").join(item, "catalog_item_id", "left")
    quantity, wrong_quantity = _figure("quantity")
    price, total, target = (_figure(c)[0] for c in ("unit_price", "line_total", "target_unit_cost"))
    mapped = F.col("rms_item_id").isNotNull() & F.col("catalog_item_id").isNotNull() & F.coalesce(F.col("match_status").isin("auto", "confirmed"), F.lit(False))
    other = ~_missing("item_supplier") & (_missing("invoice_supplier") | (F.lower("item_supplier") != F.lower("invoice_supplier")))
    unproved = _unproved(_attributes("description", "uom"), _attributes("item_text", "item_uom"))
    mapping = (
        F.when(~mapped, "unmapped").when(F.col("known").isNull(), "unknown_rms_item").when(~F.col("item_number").eqNullSafe(F.col("rms_item_id")), "catalog_item_mismatch")
        .when(other, "supplier_item_mismatch").when(unproved, "unit_unconfirmed")
    )
    prefix = F.concat(F.lit("lines."), F.col("line_no").cast("string"))
    field = lambda m: F.when(m == "catalog_item_mismatch", "catalog_item_id").when(m == "unit_unconfirmed", "uom").otherwise("rms_item_id")
    of_item = T.let(mapping, lambda m: F.when(m.isNotNull(), F.struct(F.concat_ws(".", prefix, field(m)).alias("field"), m.alias("code"))))
    rules = [
        ("description", "required", _missing("description")),
        ("quantity", "invalid_number", wrong_quantity), ("quantity", "required", quantity.isNull()), ("quantity", "nonpositive_quantity", quantity <= 0),
        *_figure_rules("unit_price", True), *_figure_rules("line_total", True),
        ("line_total", "line_calculation_mismatch", ~money_equal(quantity * price, total, F.col("digits"))),
        ("target_unit_cost", "target_cost_mismatch", ~F.coalesce(target == price, F.lit(False))),
    ]
    worth = money_round(F.coalesce(quantity * price, total.cast("decimal(37,8)")), F.col("digits"))
    found = F.concat(_found(rules, prefix), F.array_compact(F.array(of_item)))
    return j.select("invoice_id", "line_no", "match_status", "description", found.alias("found"), worth.alias("worth"), total.isNotNull().alias("totalled"))


def approval_errors(invoices: DataFrame, lines: DataFrame, items: DataFrame, duplicated: DataFrame) -> DataFrame:
    """Everything that keeps an invoice from being approved: id, field, code.

    invoices(id, the REQUIRED fields, document_type, po_number, FIGURES,
    cost_review, cost_reviewed), lines(invoice_id, line_no, description,
    quantity, uom, unit_price, line_total, target_unit_cost, rms_item_id,
    catalog_item_id, match_status), items(catalog_item_id, rms_item_id,
    supplier_id, description, uom), duplicated(id); figures and dates are
    text.  An empty text is a missing one.  Lines without an invoice are left
    out.
    """
    checked = line_findings(lines, invoices, items)
    sums = checked.groupBy("invoice_id").agg(F.sum("worth").alias("lines_sum"), F.bool_and("totalled").alias("whole"), F.count("*").alias("n"))
    j = invoices.join(sums, F.col("id") == F.col("invoice_id"), "left").join(duplicated.select("id", F.lit(True).alias("doubled")), "id", "left")
    digits = minor_units(F.col("currency"))
    subtotal, tax, total = (_figure(c)[0] for c in FIGURES)
    day = F.col("invoice_date")
    rules = [
        *[(c, "required", _missing(c)) for c in REQUIRED],
        ("invoice_date", "invalid_date", ~_missing("invoice_date") & ~(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & day.try_cast("date").isNotNull())),
        ("currency", "invalid_currency", ~_missing("currency") & ~F.col("currency").rlike("^[A-Z]{3}$")),
        ("document_type", "not_invoice", ~F.coalesce(F.col("document_type") == "invoice", F.lit(False))),
        ("po_number", "invalid_order_number", ~_missing("po_number") & T.order_number(F.col("po_number")).isNull()),
        *[r for c in FIGURES for r in _figure_rules(c, False)],
        ("lines", "required", F.col("n").isNull()),
        ("subtotal", "sum_mismatch", F.col("whole") & ~money_equal(F.col("lines_sum"), subtotal, digits)),
        ("target_cost_reviewed", "target_cost_review_required", F.col("cost_review") & ~F.coalesce("cost_reviewed", F.lit(False))),
        ("total", "sum_mismatch", ~money_equal(subtotal + tax, total, digits)),
        ("invoice_number", "duplicate_supplier_invoice", F.col("doubled") & ~_missing("invoice_number")),
    ]
    header = j.select("id", F.inline(_found(rules)))
    return header.unionByName(checked.select(F.col("invoice_id").alias("id"), F.inline("found")))

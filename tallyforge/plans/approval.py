"""Query of the checks before approval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import approval as A
from tallyforge.operators import pricing as P
from tallyforge.operators import relations as R
from tallyforge.plans.matching import UNIT
from tallyforge.plans.registry import query

CODES = ("description:required:d", "quantity:invalid_number:qx", "quantity:required:qn", "quantity:nonpositive_quantity:qz", "unit_price:required:pn", "line_total:required:tn", "line_total:line_calculation_mismatch:calc", "target_unit_cost:target_cost_mismatch:tc")


@query("approval_errors", R.with_("inv", "num", "cat") + f""", x AS (SELECT id, 'S' || (id % 7) AS supplier_id, id % 43 = 0 AS no_name, CASE WHEN id % 31 <> 0 THEN number END AS invoice_number, CASE WHEN id % 37 = 0 THEN NULL WHEN id % 47 = 0 THEN '31/12/1999' ELSE 'ok' END AS day,
 CASE WHEN id % 41 = 0 THEN 'aed' WHEN id % 53 <> 0 THEN currency END AS currency, CASE WHEN id % 41 = 0 OR id % 53 = 0 THEN 2 ELSE digits END AS digits, CASE WHEN id % 17 > 1 THEN subtotal END AS subtotal, id % 17 AS sub, tax_total, CASE WHEN id % 19 = 0 THEN -5.00 ELSE total END AS total, supplier_id AS customer, number FROM inv),
ci AS (SELECT item_key, rms_item_id, CASE WHEN rms_item_id % 2 = 1 THEN 's' || (rms_item_id % 7) END AS supplier_id, {UNIT.format('uom')} AS uom FROM cat),
lt AS (SELECT invoice_id, line_no, position, description, part_id, match_status, CASE WHEN position <> 6 THEN CAST(quantity AS DECIMAL(18,4)) END AS q, CAST(unit_price AS DECIMAL(18,4)) AS p, CASE WHEN part_id % 71 <> 0 THEN line_total END AS t, {UNIT.format('uom')} AS uom,
 CASE part_id % 5 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE unit_price END AS target, CASE WHEN position = 3 THEN rms_item_id + 1 ELSE rms_item_id END AS rms, CASE WHEN position % 6 = 5 THEN 'x' ELSE num.supplier_id || ':' || part_id END AS item_key FROM num),
lj AS (SELECT lt.*, x.supplier_id AS inv_supplier, digits, ci.rms_item_id AS item_rms, ci.supplier_id AS item_supplier, ci.uom AS item_uom, CAST(q * p AS DECIMAL(28,8)) AS qp FROM lt JOIN x ON x.id = invoice_id LEFT JOIN ci USING (item_key)),
lf AS (SELECT *, trim(coalesce(description, '')) = '' AS d, position = 6 AS qx, q IS NULL AS qn, q <= 0 AS qz, p IS NULL AS pn, t IS NULL AS tn, target IS NULL OR p IS NULL OR target <> p AS tc,
 CASE digits WHEN 0 THEN round(qp, 0) <> round(t, 0) WHEN 3 THEN round(qp, 3) <> t ELSE round(qp, 2) <> t END AS calc,
 CASE WHEN rms IS NULL OR match_status NOT IN ('auto', 'confirmed') THEN 'rms_item_id:unmapped' WHEN item_rms IS NULL THEN 'rms_item_id:unknown_rms_item' WHEN item_rms <> rms THEN 'catalog_item_id:catalog_item_mismatch' WHEN lower(item_supplier) <> lower(inv_supplier) THEN 'rms_item_id:supplier_item_mismatch'
 WHEN uom IS NULL AND item_uom IN ('PACK', 'BOX', 'CASE', 'CARTON', 'DOZEN') THEN 'uom:unit_unconfirmed' END AS mapping, coalesce(qp, t) AS w FROM lj),
le AS (SELECT invoice_id AS id, line_no, unnest(list_filter([mapping, """ + ", ".join(f"CASE WHEN {c.split(':')[2]} THEN '{c.rsplit(':', 1)[0]}' END" for c in CODES) + """], lambda e: e IS NOT NULL)) AS e FROM lf),
s AS (SELECT invoice_id AS id, sum(CAST(CASE digits WHEN 0 THEN round(w, 0) WHEN 3 THEN round(w, 3) ELSE round(w, 2) END AS DECIMAL(28,4))) AS lines_sum, bool_and(t IS NOT NULL) AS whole FROM lf GROUP BY 1),
dp AS (SELECT customer, number FROM x GROUP BY 1, 2 HAVING count(*) > 1),
h AS (SELECT id, unnest(list_filter([CASE WHEN no_name THEN 'supplier_name:required' END, CASE WHEN x.invoice_number IS NULL THEN 'invoice_number:required' END, CASE WHEN day IS NULL THEN 'invoice_date:required' WHEN day <> 'ok' THEN 'invoice_date:invalid_date' END, CASE WHEN currency IS NULL THEN 'currency:required' WHEN currency = 'aed' THEN 'currency:invalid_currency' END,
 CASE WHEN id % 59 = 0 THEN 'document:required' END, CASE WHEN id % 61 = 0 THEN 'location:required' END, CASE WHEN id % 11 = 0 THEN 'document_type:not_invoice' END, CASE WHEN id % 13 = 0 THEN 'po_number:invalid_order_number' END,
 CASE sub WHEN 0 THEN 'subtotal:invalid_number' WHEN 1 THEN 'subtotal:required' END, CASE WHEN total < 0 THEN 'total:negative_money' END, CASE WHEN whole IS NULL THEN 'lines:required' END,
 CASE WHEN whole AND CASE digits WHEN 0 THEN round(lines_sum, 0) <> round(subtotal, 0) ELSE lines_sum <> subtotal END THEN 'subtotal:sum_mismatch' END, CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN 'target_cost_reviewed:target_cost_review_required' END,
 CASE WHEN CASE digits WHEN 0 THEN round(subtotal + tax_total, 0) <> round(total, 0) ELSE subtotal + tax_total <> total END THEN 'total:sum_mismatch' END, CASE WHEN x.invoice_number IS NOT NULL AND dp.number IS NOT NULL THEN 'invoice_number:duplicate_supplier_invoice' END], lambda e: e IS NOT NULL)) AS e FROM x LEFT JOIN s USING (id) LEFT JOIN dp USING (customer, number))
SELECT id, split_part(e, ':', 1) AS field, split_part(e, ':', 2) AS code FROM h UNION ALL SELECT id, 'lines.' || line_no || '.' || split_part(e, ':', 1), split_part(e, ':', 2) FROM le""")
def approval_errors(spark, d):
    inv, k = R.invoices(spark, d), F.col("id")
    text = lambda c: F.col(c).cast("string")
    header = inv.select(
        "id", F.concat(F.lit("S"), (k % 7).cast("string")).alias("supplier_id"), F.when(k % 43 != 0, "N").alias("supplier_name"), F.when(k % 31 != 0, F.col("number")).alias("invoice_number"),
        F.when(k % 37 == 0, None).when(k % 47 == 0, "31/12/1999").otherwise(F.date_format("invoice_date", "yyyy-MM-dd")).alias("invoice_date"), F.when(k % 41 == 0, "aed").when(k % 53 != 0, F.col("currency")).alias("currency"),
        F.when(k % 59 != 0, "D").otherwise(" ").alias("document"), F.lit("X").alias("supplier_site"), F.when(k % 61 != 0, "L").alias("location"), F.lit("W").alias("location_type"), F.lit("T").alias("tax_code"),
        F.when(k % 11 == 0, "credit_note").otherwise("invoice").alias("document_type"), F.when(k % 13 == 0, "PO Box 7").when(k % 13 == 1, "P-1").alias("po_number"),
        F.when(k % 17 == 0, "n/a").when(k % 17 > 1, text("subtotal")).alias("subtotal"), text("tax_total").alias("tax_total"), F.when(k % 19 == 0, "-5.00").otherwise(text("total")).alias("total"), (k % 5 == 0).alias("cost_review"), (k % 10 == 0).alias("cost_reviewed"),
    )
    n, p = F.col("position"), F.col("part_id")
    lines = R.numbered(R.lines(spark, d)).select(
        "invoice_id", "line_no", "description", "uom", "match_status", F.when(n == 6, "two").otherwise(text("quantity")).alias("quantity"), text("unit_price").alias("unit_price"), F.when(p % 71 != 0, text("line_total")).alias("line_total"),
        F.when(p % 5 == 0, "1").when(p % 5 > 1, text("unit_price")).alias("target_unit_cost"), (F.col("rms_item_id") + F.when(n == 3, 1).otherwise(0)).alias("rms_item_id"), F.when(n % 6 == 5, "x").otherwise(F.concat_ws(":", text("supplier_id"), text("part_id"))).alias("catalog_item_id"),
    )
    r = F.col("rms_item_id")
    items = R.catalog(spark, d).select(F.col("item_key").alias("catalog_item_id"), "rms_item_id", F.when(r % 2 == 1, F.concat(F.lit("s"), (r % 7).cast("string"))).alias("supplier_id"), "description", "uom")
    return A.approval_errors(header, lines, items, P.duplicates(inv))

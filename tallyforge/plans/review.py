"""Queries of validation, reasons, exceptions and control figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import pricing as P
from tallyforge.operators import relations as R
from tallyforge.operators import review as V
from tallyforge.operators import worklist as W
from tallyforge.plans.registry import query


def _lines(spark, d):
    own = R.numbered(R.lines(spark, d))
    inv = R.invoices(spark, d).select(F.col("id").alias("invoice_id"), "digits")
    return own.join(inv, "invoice_id").withColumn("description", F.when(F.col("part_id") % 23 == 0, F.lit("  ")).when(F.col("part_id") % 29 == 0, F.lit("Volume discount")).otherwise(F.col("description")))


def _header(spark, d):
    inv = R.invoices(spark, d)
    known = inv.select("id", "supplier_id", F.when(F.col("id") % 31 != 0, F.col("number")).alias("number"), F.when(F.col("id") % 37 != 0, F.col("invoice_date")).alias("invoice_date"), F.when(F.col("id") % 41 == 0, "aed").otherwise(F.col("currency")).alias("currency"), "total", "status", "digits")
    return V.header_errors(known, P.reconcile(inv, R.raw_lines(spark, d)), P.duplicates(known))


LN = R.with_("inv", "num") + """, v AS (SELECT num.* EXCLUDE (description), digits, CASE WHEN part_id % 23 = 0 THEN '  ' WHEN part_id % 29 = 0 THEN 'Volume discount' ELSE description END AS description FROM num JOIN inv ON inv.id = num.invoice_id),
le AS (SELECT invoice_id AS id, line_no, match_status, description, unnest(list_filter([CASE WHEN trim(coalesce(description, '')) = '' THEN 'description:required' END, CASE WHEN quantity IS NULL THEN 'quantity:required' END, CASE WHEN quantity <= 0 THEN 'quantity:nonpositive_quantity' END,
 CASE WHEN unit_price IS NULL THEN 'unit_price:required' END, CASE WHEN unit_price < 0 THEN 'unit_price:negative_money' END, CASE WHEN line_total IS NULL THEN 'line_total:required' END, CASE WHEN line_total < 0 THEN 'line_total:negative_money' END,
 CASE WHEN CASE digits WHEN 0 THEN round(quantity * unit_price, 0) <> round(line_total, 0) WHEN 3 THEN round(quantity * unit_price, 3) <> line_total ELSE round(quantity * unit_price, 2) <> line_total END THEN 'line_total:line_calculation_mismatch' END,
 CASE WHEN rms_item_id IS NULL OR match_status NOT IN ('auto', 'confirmed') THEN 'rms_item_id:unmapped' END], lambda x: x IS NOT NULL)) AS e FROM v),
l AS (SELECT id, line_no, 'lines.' || line_no || '.' || split_part(e, ':', 1) AS field, split_part(e, ':', 2) AS code, match_status, description FROM le)"""
HD = """, x AS (SELECT id, supplier_id, CASE WHEN id % 31 <> 0 THEN number END AS number, CASE WHEN id % 37 <> 0 THEN invoice_date END AS invoice_date, CASE WHEN id % 41 = 0 THEN 'aed' ELSE currency END AS currency, total FROM inv),
rv AS (SELECT invoice_id, CAST(coalesce(quantity * unit_price, line_total) AS DECIMAL(28,8)) AS v FROM raw), rs AS (SELECT invoice_id, CAST(sum(round(v, 0)) AS DECIMAL(28,4)) AS s0, CAST(sum(round(v, 2)) AS DECIMAL(28,4)) AS s2, CAST(sum(round(v, 3)) AS DECIMAL(28,4)) AS s3 FROM rv GROUP BY 1),
rj AS (SELECT inv.id, s0 IS NULL AS no_lines, CASE digits WHEN 0 THEN round(s0, 0) <> round(subtotal, 0) WHEN 3 THEN s3 <> subtotal ELSE s2 <> subtotal END AS sum_mismatch, CASE digits WHEN 0 THEN round(subtotal + tax_total, 0) <> round(total, 0) ELSE subtotal + tax_total <> total END AS total_mismatch FROM inv LEFT JOIN rs ON rs.invoice_id = inv.id),
dp AS (SELECT supplier_id, number FROM x WHERE number IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
h AS (SELECT id, unnest(list_filter([CASE WHEN x.number IS NULL THEN 'invoice_number:required' END, CASE WHEN invoice_date IS NULL THEN 'invoice_date:required' END, CASE WHEN currency = 'aed' THEN 'currency:invalid_currency' END, CASE WHEN no_lines THEN 'lines:required' END,
 CASE WHEN sum_mismatch THEN 'subtotal:sum_mismatch' END, CASE WHEN total_mismatch THEN 'total:sum_mismatch' END, CASE WHEN dp.number IS NOT NULL THEN 'invoice_number:duplicate_supplier_invoice' END], lambda y: y IS NOT NULL)) AS e FROM x JOIN rj USING (id) LEFT JOIN dp USING (supplier_id, number)),
hd AS (SELECT id, split_part(e, ':', 1) AS field, split_part(e, ':', 2) AS code FROM h),
rr AS (SELECT DISTINCT id, reason FROM (SELECT id, CASE code WHEN 'required' THEN CASE field WHEN 'lines' THEN 'extraction_failed' ELSE 'header_field_missing' END WHEN 'invalid_currency' THEN 'header_field_missing' WHEN 'sum_mismatch' THEN 'total_reconciliation_failed' ELSE 'duplicate_suspected' END AS reason FROM hd
 UNION ALL SELECT id, CASE WHEN code = 'required' THEN CASE WHEN field LIKE '%description' THEN 'line_unmapped' ELSE 'total_reconciliation_failed' END WHEN code = 'unmapped' THEN CASE WHEN match_status = 'suggested' THEN 'line_low_confidence' WHEN regexp_matches(description, '(?i)\\b(discount|rebate|credit|allowance|adjustment|surcharge|promotion|promo|rounding)') THEN 'adjustment_unpaired' ELSE 'line_unmapped' END ELSE 'total_reconciliation_failed' END FROM l))"""


@query("line_validation_errors", LN + " SELECT id, line_no, field, code FROM l")
def line_validation_errors(spark, d):
    return V.line_errors(_lines(spark, d)).select("id", "line_no", "field", "code")


@query("header_validation_errors", LN + HD + " SELECT * FROM hd")
def header_validation_errors(spark, d):
    return _header(spark, d)


@query("reason_codes", LN + HD + " SELECT * FROM rr")
def reason_codes(spark, d):
    return V.reasons(_header(spark, d), V.line_errors(_lines(spark, d)))


@query("exception_queue", LN + HD + ", reg(ord, reason, owner, level) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(V.REASONS)) + """), q AS (SELECT reason, inv.id, created_at, row_number() OVER (PARTITION BY reason ORDER BY created_at, inv.id) AS r FROM rr JOIN inv ON inv.id = rr.id)
SELECT reason, owner, level, ord, count(*) AS n, max(date_diff('day', CAST(created_at AS DATE), DATE '2002-01-01')) AS oldest_days, arg_min(id, r) AS oldest_id, string_agg(id, ',' ORDER BY r) FILTER (r <= 100) AS members, count(*) > 100 AS truncated FROM q JOIN reg USING (reason) GROUP BY 1, 2, 3, 4""")
def exception_queue(spark, d):
    found = V.reasons(_header(spark, d), V.line_errors(_lines(spark, d)))
    return V.exception_queue(found, R.invoices(spark, d), F.lit("2002-01-01").cast("date"))


@query("failure_reasons", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'extraction_limit' ELSE 'extraction_failed' END AS reason FROM events WHERE event_type = 'error'")
def failure_reasons(spark, d):
    e = F.col("event_id") % 4
    error = F.when(e == 0, "ExtractionLimitError: too many pages").when(e == 1, "UnsupportedDocumentError: x").when(e == 2, "ExtractionTimeBudgetError: slow")
    return R.read(spark, d, "events").where("event_type = 'error'").select("event_id", V.failure_reason(error).alias("reason"))


@query("kpi_touchless", R.with_("ev") + ", t AS (SELECT invoice_id, bool_or(actor = 'user' AND event_type NOT IN ('uploaded', 'invoice_approved', 'invoice_exported')) AS touched, bool_or(coalesce(to_status = 'ready', false)) AS reached FROM ev GROUP BY 1) SELECT count(*) FILTER (reached AND NOT touched) AS touchless, count(*) AS trails FROM t")
def kpi_touchless(spark, d):
    return V.touchless(R.events(spark, d))


@query("kpi_first_time_match", R.with_("ev") + ", f AS (SELECT invoice_id, arg_min(k, id) AS k FROM ev WHERE event_type = 'extraction_completed' GROUP BY 1) SELECT count(*) FILTER (k % 3 = 0 AND k > 0) AS first_time, count(*) AS evaluated FROM f")
def kpi_first_time_match(spark, d):
    # a trail's first extraction matched all lines where its count is a multiple of three
    first = V.first_of(R.events(spark, d), "extraction_completed", "k")
    return first.agg(F.count_if((F.col("k") % 3 == 0) & (F.col("k") > 0)).alias("first_time"), F.count("*").alias("evaluated"))


@query("kpi_cycle_time", R.with_("ev") + ", t AS (SELECT invoice_id, min(created_at) AS s, arg_min(created_at, id) FILTER (to_status = 'ready') AS r, arg_max(to_status, id) FILTER (to_status IS NOT NULL) AS now_ FROM ev GROUP BY 1) SELECT count(*) AS n, round(median((epoch_us(r) - epoch_us(s)) / 1e6), 3) AS median_seconds FROM t WHERE now_ = 'ready'")
def kpi_cycle_time(spark, d):
    return V.cycle_time(R.events(spark, d))


@query("first_ready_event", R.with_("ev") + " SELECT invoice_id, min(id) AS id, arg_min(actor, id) AS actor FROM ev WHERE event_type = 'invoice_approved' GROUP BY 1")
def first_ready_event(spark, d):
    return V.first_of(R.events(spark, d), "invoice_approved", "actor")


@query("latest_status", R.with_("ev") + " SELECT invoice_id, arg_max(to_status, id) AS status, max(id) AS id FROM ev WHERE to_status IS NOT NULL GROUP BY 1")
def latest_status(spark, d):
    return V.latest_status(R.events(spark, d))


@query("human_edits", R.with_("ev") + " SELECT DISTINCT invoice_id FROM ev WHERE event_type = 'invoice_edited' AND actor <> 'system' AND k % 2 = 0")
def human_edits(spark, d):
    changed = F.from_json(F.when(F.col("k") % 2 == 0, '{"changed_fields":["lines","total"]}').otherwise('{"changed_fields":["total"]}'), "changed_fields array<string>")
    return R.events(spark, d).where("event_type = 'invoice_edited' and actor <> 'system'").where(F.array_contains(changed["changed_fields"], "lines")).select("invoice_id").distinct()


@query("rematch_demotions", R.with_("raw", "ev") + """, e AS (SELECT DISTINCT CAST(split_part(invoice_id, '-', 1) AS BIGINT) AS invoice_id FROM ev WHERE event_type = 'invoice_edited' AND actor <> 'system' AND k % 2 = 0)
SELECT match_status, CASE WHEN match_status = 'confirmed' AND e.invoice_id IS NULL THEN 'auto' ELSE match_status END AS start_status, count(*) AS n FROM raw LEFT JOIN e USING (invoice_id) GROUP BY 1, 2""")
def rematch_demotions(spark, d):
    edited = human_edits(spark, d).select(F.split("invoice_id", "-")[0].cast("long").alias("invoice_id")).distinct().withColumn("edited", F.lit(True))
    j = R.raw_lines(spark, d).join(edited, "invoice_id", "left")
    start = F.when((F.col("match_status") == "confirmed") & F.col("edited").isNull(), "auto").otherwise(F.col("match_status"))
    return j.groupBy("match_status", start.alias("start_status")).agg(F.count("*").alias("n"))


@query("audit_latest_per_trail", R.with_("ev") + " SELECT invoice_id, max(id) AS id, arg_max(event_type, id) AS event_type FROM ev GROUP BY 1")
def audit_latest_per_trail(spark, d):
    return W.latest(R.events(spark, d).select("invoice_id", "id", "event_type"), "invoice_id", "id")

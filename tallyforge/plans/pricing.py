"""Queries of costs, tolerances, reconciliation and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import pricing as P
from tallyforge.operators import relations as R
from tallyforge.plans.registry import query


def _ten():
    return F.lit("10").cast("decimal(10,2)")


ASOF = "rt AS (SELECT inv.id, currency, invoice_date, rate FROM inv LEFT JOIN LATERAL (SELECT rate FROM rates WHERE from_currency = inv.currency AND to_currency = 'AED' AND effective_date <= inv.invoice_date ORDER BY effective_date DESC, rate_id DESC LIMIT 1) q ON true)"


def rated(spark, d):
    inv = R.invoices(spark, d).select("id", "currency", "invoice_date")
    rates = R.rates(spark).where("to_currency = 'AED'").select(F.col("from_currency").alias("currency"), "rate_id", "rate", "effective_date")
    return P.as_of(inv, rates, ["currency"], "invoice_date", "effective_date", "rate_id", "rate")


@query("asof_rate", R.with_("inv", "rates") + ", " + ASOF + " SELECT * FROM rt")
def asof_rate(spark, d):
    return rated(spark, d).select("id", "currency", "invoice_date", "rate")


def cost_lines(spark, d):
    lines = R.raw_lines(spark, d)
    parts = R.parts(spark, d).select("part_id", "unit_cost")
    inv = R.invoices(spark, d).select("id", "digits")
    j = lines.join(rated(spark, d), lines["invoice_id"] == F.col("id")).drop("id").join(parts, "part_id", "left")
    n = F.col("position")
    scoped = j.select(
        "invoice_id", "position", "part_id", "supplier_id", "quantity", "line_total", "ship_date", "tax_rate", "rms_item_id", "currency", "rate",
        F.when(n == 4, "unverified").when(n == 6, "unconfirmed").otherwise("confirmed").alias("unit_state"),
        F.when(F.col("part_id") % 17 == 0, F.lit("0.01").cast("decimal(18,2)")).otherwise(F.col("unit_cost")).alias("cost"),
        F.when(F.col("part_id") % 13 != 0, F.col("unit_price")).alias("invoice_cost"),
        F.when(F.col("part_id") % 2 == 0, F.lit("AED")).when(F.col("part_id") % 3 == 0, F.col("currency")).alias("master_currency"),
        (F.col("currency") != "KWD").alias("in_scope"),
    )
    # the master states costs in dirhams; rates turn the invoice's currency into them, so the inverse is what a cost needs
    return P.compare_costs(scoped.withColumn("rate", F.when(F.col("rate") > 0, F.round(F.lit(1).cast("decimal(2,0)") / F.col("rate"), 6)).cast("decimal(18,6)")), _ten())


COST = R.with_("inv", "raw", "part_t", "rates") + ", " + ASOF + """, s AS (SELECT invoice_id, position, raw.part_id, quantity, line_total, rms_item_id, currency,
 CAST((2000000000000 + CAST(rate * 10000 AS BIGINT) * 100) // (2 * CAST(rate * 10000 AS BIGINT) * 100) AS BIGINT) AS inv6, rate,
 CASE position WHEN 4 THEN 'unverified' WHEN 6 THEN 'unconfirmed' ELSE 'confirmed' END AS unit_state, CASE WHEN raw.part_id % 17 = 0 THEN CAST(0.01 AS DECIMAL(18,2)) ELSE unit_cost END AS cost, CASE WHEN raw.part_id % 13 <> 0 THEN unit_price END AS invoice_cost,
 CASE WHEN raw.part_id % 2 = 0 THEN 'AED' WHEN raw.part_id % 3 = 0 THEN currency END AS master_currency, currency <> 'KWD' AS in_scope FROM raw JOIN rt ON rt.id = raw.invoice_id LEFT JOIN part_t USING (part_id)),
c0 AS (SELECT *, master_currency IS NOT NULL AND master_currency <> currency AS is_foreign FROM s),
c AS (SELECT *, CASE WHEN is_foreign THEN CAST(((CAST(cost * 100 AS HUGEINT) * inv6 + 5000) // 10000) AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(4,4)) ELSE CAST(cost AS DECIMAL(18,4)) END AS conv FROM c0),
v AS (SELECT *, CAST(invoice_cost - conv AS DECIMAL(18,4)) AS var FROM c),
t AS (SELECT *, CASE WHEN rms_item_id IS NULL THEN 'unavailable_no_match' WHEN unit_state IN ('unverified', 'unconfirmed') THEN 'unavailable_uom_mismatch' WHEN NOT coalesce(cost > 0.01, false) THEN 'unavailable_rms_cost' WHEN NOT in_scope THEN 'unavailable_currency'
 WHEN invoice_cost IS NULL THEN 'unavailable_invoice_cost' WHEN is_foreign AND rate IS NULL THEN 'currency_basis_mismatch' WHEN abs(var) > 10 THEN 'above_tolerance' ELSE 'within_tolerance' END AS status FROM v)"""


@query("cost_comparison", COST + " SELECT invoice_id, position, part_id, line_total, status, CASE WHEN status IN ('above_tolerance', 'within_tolerance') THEN CAST(conv AS DECIMAL(18,4)) END AS converted, CASE WHEN status IN ('above_tolerance', 'within_tolerance') THEN var END AS variance, status <> 'within_tolerance' AS review FROM t")
def cost_comparison(spark, d):
    return cost_lines(spark, d).select("invoice_id", "position", "part_id", "line_total", "status", "converted", "variance", "review")


@query("tolerance_per_invoice", COST + """, z AS (SELECT invoice_id, count(*) FILTER (status IN ('above_tolerance', 'within_tolerance')) AS comparable, count(*) FILTER (status IN ('above_tolerance', 'within_tolerance') AND quantity IS NULL) AS missing,
 CAST(sum(CASE WHEN status IN ('above_tolerance', 'within_tolerance') THEN CAST(quantity * var AS DECIMAL(28,8)) END) AS DECIMAL(28,4)) AS variance, CAST(sum(CASE WHEN status IN ('above_tolerance', 'within_tolerance') THEN CAST(quantity * conv AS DECIMAL(28,8)) END) AS DECIMAL(28,4)) AS base FROM t GROUP BY 1)
SELECT invoice_id, comparable, variance, base, CASE WHEN comparable = 0 OR missing > 0 THEN 'unavailable' WHEN abs(variance) > 10 THEN 'above_tolerance' ELSE 'within_tolerance' END AS verdict FROM z""")
def tolerance_per_invoice(spark, d):
    return P.invoice_tolerance(cost_lines(spark, d), _ten())


@query("comparison_histogram", COST + " SELECT invoice_id, count(*) FILTER (status = 'above_tolerance') AS above, count(*) FILTER (status = 'within_tolerance') AS within_, count(*) FILTER (status NOT IN ('above_tolerance', 'within_tolerance')) AS unavailable FROM t GROUP BY 1")
def comparison_histogram(spark, d):
    s = F.col("status")
    return cost_lines(spark, d).groupBy("invoice_id").agg(F.count_if(s == "above_tolerance").alias("above"), F.count_if(s == "within_tolerance").alias("within_"), F.count_if(~s.isin("above_tolerance", "within_tolerance")).alias("unavailable"))


@query("cost_range", R.with_("cat") + """, c AS (SELECT rms_item_id % 500 AS rms_item_id, CASE WHEN rms_item_id % 9 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE unit_cost END AS unit_cost FROM cat),
g AS (SELECT rms_item_id, count(DISTINCT unit_cost) FILTER (unit_cost > 0.01) AS costs, min(unit_cost) FILTER (unit_cost > 0.01) AS lo, max(unit_cost) FILTER (unit_cost > 0.01) AS hi FROM c GROUP BY 1)
SELECT rms_item_id, costs, CASE WHEN costs <= 1 THEN lo END AS cost, CASE WHEN costs > 1 THEN lo END AS low, CASE WHEN costs > 1 THEN hi END AS high FROM g""")
def cost_range(spark, d):
    i = F.col("rms_item_id")
    return P.cost_range(R.catalog(spark, d).select((i % 500).alias("rms_item_id"), F.when(i % 9 == 0, F.lit(0)).otherwise(F.col("unit_cost")).cast("decimal(18,2)").alias("unit_cost")))


@query("reconciliation_errors", R.with_("inv", "raw") + """, v AS (SELECT invoice_id, line_total, CAST(coalesce(quantity * unit_price, line_total) AS DECIMAL(28,8)) AS v FROM raw), s AS (SELECT invoice_id, CAST(sum(round(v, 0)) AS DECIMAL(28,4)) AS s0, CAST(sum(round(v, 2)) AS DECIMAL(28,4)) AS s2, CAST(sum(round(v, 3)) AS DECIMAL(28,4)) AS s3 FROM v GROUP BY 1),
j AS (SELECT inv.*, CAST(CASE digits WHEN 0 THEN s0 WHEN 3 THEN s3 ELSE s2 END AS DECIMAL(28,4)) AS line_sum FROM inv LEFT JOIN s ON s.invoice_id = inv.id)
SELECT id, line_sum, CASE digits WHEN 0 THEN round(line_sum, 0) <> round(subtotal, 0) WHEN 3 THEN round(line_sum, 3) <> subtotal ELSE round(line_sum, 2) <> subtotal END AS sum_mismatch,
 CASE digits WHEN 0 THEN round(subtotal + tax_total, 0) <> round(total, 0) ELSE subtotal + tax_total <> total END AS total_mismatch FROM j""")
def reconciliation_errors(spark, d):
    return P.reconcile(R.invoices(spark, d), R.raw_lines(spark, d))


@query("duplicate_suspicion", R.with_("inv") + """, i AS (SELECT id, supplier_id % 50 AS supplier_id, number, CASE WHEN id % 6 <> 0 THEN invoice_date END AS invoice_date, CAST(floor(total / 100000) AS DECIMAL(18,2)) AS total, status FROM inv WHERE status <> 'queued'),
p AS (SELECT a.id, b.id AS other, CASE WHEN a.total = b.total AND a.invoice_date = b.invoice_date THEN 0 ELSE 1 END AS weak FROM i a JOIN i b ON a.supplier_id = b.supplier_id AND a.number = b.number AND a.id <> b.id)
SELECT id, count(*) AS others, CASE WHEN min(weak) = 0 THEN 'strong' ELSE 'weak' END AS level, arg_min(other, (weak, other)) AS first_other FROM p GROUP BY 1""")
def duplicate_suspicion(spark, d):
    inv = R.invoices(spark, d).where("status <> 'queued'").select("id", (F.col("supplier_id") % 50).alias("supplier_id"), "number", F.when(F.col("id") % 6 != 0, F.col("invoice_date")).alias("invoice_date"), F.floor(F.col("total") / 100000).cast("decimal(18,2)").alias("total"), "status", F.lit(2).alias("digits"))
    return P.duplicates(inv)

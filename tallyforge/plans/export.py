"""Queries of exports and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import export as X
from tallyforge.operators import relations as R
from tallyforge.plans.registry import query

EX = R.with_("inv", "num") + """, e AS (SELECT id, number, subtotal, tax_total, invoice_date, CASE id % 6 WHEN 0 THEN 'PO BOX 9' WHEN 1 THEN 'P' || id END AS po_number, CASE WHEN id % 5 = 0 THEN '=SUM(A1)' ELSE 'ok' END AS comment, 'T' || digits AS tax_code, row_number() OVER (ORDER BY created_at, id) AS rn FROM inv WHERE status = 'exported'),
o AS (SELECT invoice_id, CASE WHEN count(DISTINCT po) = 1 THEN min(po) END AS master_po FROM (SELECT invoice_id, CASE WHEN part_id % 3 = 0 THEN 'M' || part_id % 5 END AS po FROM num) GROUP BY 1),
hd AS (SELECT CAST(rn AS VARCHAR) AS transaction, number AS document, coalesce(CASE WHEN po_number NOT LIKE 'PO BOX%' THEN po_number END, master_po) AS order_no, invoice_date, subtotal AS total_ex_tax, tax_total, CASE WHEN comment LIKE '=%' THEN '''' || comment ELSE comment END AS comment FROM e LEFT JOIN o ON o.invoice_id = e.id)"""


def _export(spark, d):
    i = F.col("id")
    inv = R.invoices(spark, d).where("status = 'exported'").select(
        "id", "number", "subtotal", "tax_total", "invoice_date", "created_at", F.when(i % 6 == 0, "PO BOX 9").when(i % 6 == 1, F.concat(F.lit("P"), i.cast("string"))).alias("po_number"),
        F.when(i % 5 == 0, "=SUM(A1)").otherwise("ok").alias("comment"), F.concat(F.lit("T"), F.col("digits").cast("string")).alias("tax_code"),
    )
    return inv, X.number_invoices(inv.select("id", F.col("created_at").alias("position")), F.date_trunc("month", "position"))


def _lines(spark, d):
    p = F.col("part_id")
    own = R.numbered(R.lines(spark, d))
    return own.select("invoice_id", "line_no", "quantity", "unit_price", F.col("rms_item_id").cast("string").alias("rms_item_id"), F.when(p % 4 == 0, F.concat(F.lit("G"), (p % 10).cast("string"))).alias("parent_item"), p.cast("string").alias("upc"), F.when(p % 3 == 0, F.concat(F.lit("M"), (p % 5).cast("string"))).alias("rms_po_number"))


@query("export_header", EX + " SELECT * FROM hd")
def export_header(spark, d):
    inv, n = _export(spark, d)
    return X.header(n, inv, X.master_order(_lines(spark, d)))


@query("export_tax", EX + " SELECT CAST(rn AS VARCHAR) AS transaction, tax_code, subtotal AS tax_basis FROM e")
def export_tax(spark, d):
    inv, n = _export(spark, d)
    return X.tax(n, inv)


@query("export_details", EX + " SELECT CAST(rn AS VARCHAR) AS transaction, line_no, coalesce(CASE WHEN part_id % 4 = 0 THEN 'G' || part_id % 10 END, CAST(rms_item_id AS VARCHAR)) AS item, CAST(NULL AS VARCHAR) AS upc, unit_price AS unit_cost, quantity FROM e JOIN num ON num.invoice_id = e.id")
def export_details(spark, d):
    _, n = _export(spark, d)
    return X.details(n, _lines(spark, d))


@query("export_conformance", EX + """, t AS (SELECT rn, subtotal, comment, sum(round(unit_price * quantity, 2)) AS s, count(num.invoice_id) AS k FROM e LEFT JOIN num ON num.invoice_id = e.id GROUP BY 1, 2, 3)
SELECT CAST(rn AS VARCHAR) AS transaction, unnest(list_filter([CASE WHEN k = 0 THEN 'no_details' END, CASE WHEN k > 0 AND abs(s - subtotal) > 0.01 THEN 'total_differs' END], lambda x: x IS NOT NULL)) AS fault FROM t""")
def export_conformance(spark, d):
    inv, n = _export(spark, d)
    lines = _lines(spark, d)
    return X.conformance(X.header(n, inv, X.master_order(lines)), X.tax(n, inv), X.details(n, lines))


@query("export_eligibility", R.with_("inv") + ", q AS (SELECT id, min(p) AS position FROM (SELECT o_orderkey AS id, 2 * o_orderkey AS p FROM orders UNION ALL SELECT o_orderkey + 7, 2 * o_orderkey + 1 FROM orders) GROUP BY 1) SELECT q.id, position, CASE WHEN status IS NULL THEN 'missing' WHEN status <> 'exported' THEN 'not_ready' WHEN q.id % 9 = 0 THEN 'invalid' ELSE 'export' END AS outcome FROM q LEFT JOIN inv USING (id)")
def export_eligibility(spark, d):
    # every invoice is asked for, nearly all of them twice, and some that aren't there
    k = F.col("o_orderkey")
    orders = R.read(spark, d, "orders")
    ids = orders.select(k.alias("id"), (2 * k).alias("position")).unionByName(orders.select((k + 7).alias("id"), (2 * k + 1).alias("position")))
    inv = R.invoices(spark, d)
    return X.eligible(ids, inv, inv.where("id % 9 = 0"))


@query("catalog_upsert", R.with_("cat") + ", o AS (SELECT item_key AS k, description, unit_cost, DATE '2020-01-01' AS created_at FROM cat WHERE rms_item_id % 3 <> 0), n AS (SELECT item_key AS k, upper(description) AS description, CAST(unit_cost + 1 AS DECIMAL(18,2)) AS unit_cost, DATE '2021-06-01' AS created_at FROM cat WHERE rms_item_id % 2 = 0) SELECT k, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.description, o.description) AS description, coalesce(n.unit_cost, o.unit_cost) AS unit_cost FROM o FULL JOIN n USING (k)")
def catalog_upsert(spark, d):
    c = R.catalog(spark, d)
    day = lambda x: F.lit(x).cast("date").alias("created_at")
    old = c.where("rms_item_id % 3 <> 0").select(F.col("item_key").alias("k"), "description", "unit_cost", day("2020-01-01"))
    new = c.where("rms_item_id % 2 = 0").select(F.col("item_key").alias("k"), F.upper("description").alias("description"), (F.col("unit_cost") + 1).cast("decimal(18,2)").alias("unit_cost"), day("2021-06-01"))
    return X.upsert(old, new, "k")


@query("version_conflicts", R.with_("inv") + ", r AS (SELECT id, CAST(id % 4 AS INTEGER) AS version FROM inv WHERE id % 3 = 0) SELECT id, 2 AS expected_version, version FROM r WHERE version <> 2")
def version_conflicts(spark, d):
    rows = R.invoices(spark, d).select("id", (F.col("id") % 4).cast("int").alias("version"), "status")
    changes = rows.where("id % 3 = 0").select("id", F.lit(2).alias("expected_version"), F.lit("ready").alias("status"))
    return X.apply_versions(rows, changes, "status")[1]


@query("versioned_update", R.with_("inv") + " SELECT id, CASE WHEN id % 3 = 0 AND id % 4 = 2 THEN 'ready' ELSE status END AS status, CAST(id % 4 + CASE WHEN id % 3 = 0 AND id % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS version FROM inv")
def versioned_update(spark, d):
    rows = R.invoices(spark, d).select("id", (F.col("id") % 4).cast("int").alias("version"), "status")
    changes = rows.where("id % 3 = 0").select("id", F.lit(2).alias("expected_version"), F.lit("ready").alias("status"))
    return X.apply_versions(rows, changes, "status")[0]


@query("surrogate_keys", R.with_("ln") + ", o AS (SELECT part_id, supplier_id, uom, row_number() OVER (PARTITION BY supplier_id, part_id, lower(coalesce(uom, '')) ORDER BY invoice_id, position, quantity NULLS FIRST, line_total) AS occurrence FROM ln) SELECT part_id, supplier_id, occurrence, substr(sha256(concat_ws('|', CAST(supplier_id AS VARCHAR), CAST(part_id AS VARCHAR), lower(coalesce(uom, '')), CAST(occurrence AS VARCHAR))), 1, 32) AS key FROM o")
def surrogate_keys(spark, d):
    unit = F.lower(F.coalesce("uom", F.lit("")))
    own = X.occurrences(R.lines(spark, d), [F.col("supplier_id"), F.col("part_id"), unit], ["invoice_id", "position", "quantity", "line_total"])
    return own.select("part_id", "supplier_id", "occurrence", T.evidence_key(F.col("supplier_id"), F.col("part_id"), unit, F.col("occurrence")).alias("key"))


@query("master_validation", """WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS description, CASE p_partkey % 5 WHEN 0 THEN '-1' WHEN 1 THEN '1,234.50' WHEN 2 THEN 'n/a' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS unit_cost, CASE p_partkey % 4 WHEN 0 THEN 'aed' WHEN 1 THEN 'dirham' END AS cur FROM part)
SELECT p_partkey AS id, TRY_CAST(replace(unit_cost, ',', '') AS DECIMAL(18,4)) AS cost, concat_ws(',', CASE WHEN description = '' THEN 'description' END, CASE WHEN unit_cost = 'n/a' THEN 'cost' END, CASE WHEN unit_cost = '-1' THEN 'negative_cost' END, CASE WHEN cur = 'dirham' THEN 'currency' END) AS faults FROM m""")
def master_validation(spark, d):
    p = F.col("p_partkey")
    rows = R.read(spark, d, "part").select(
        p.alias("id"), p.cast("string").alias("rms_item_id"), F.when(p % 7 == 0, "").otherwise(F.col("p_name")).alias("description"),
        F.when(p % 5 == 0, "-1").when(p % 5 == 1, "1,234.50").when(p % 5 == 2, "n/a").otherwise(F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("unit_cost"),
        F.when(p % 4 == 0, "aed").when(p % 4 == 1, "dirham").alias("cost_currency"),
    )
    return X.validate_master(rows).select("id", "cost", F.array_join("faults", ",").alias("faults"))


@query("currency_fill", R.with_("cat") + " SELECT item_key, CASE WHEN rms_item_id % 4 = 0 THEN 'USD' WHEN supplier_id = 3 THEN 'AED' END AS cost_currency FROM cat")
def currency_fill(spark, d):
    c = F.when(F.col("rms_item_id") % 4 == 0, "USD")
    return R.catalog(spark, d).select("item_key", F.coalesce(c, F.when(F.col("supplier_id") == 3, "AED")).alias("cost_currency"))


@query("exceptions_csv_rows", R.with_("inv") + " SELECT id, concat_ws(' | ', CASE WHEN subtotal + tax_total <> total THEN 'total' END, CASE WHEN currency = 'JPY' THEN 'currency' END) AS reasons FROM inv WHERE subtotal + tax_total <> total OR currency = 'JPY'")
def exceptions_csv_rows(spark, d):
    total = F.when(F.col("subtotal") + F.col("tax_total") != F.col("total"), "total")
    return R.invoices(spark, d).select("id", F.concat_ws(" | ", total, F.when(F.col("currency") == "JPY", "currency")).alias("reasons")).where("reasons <> ''")

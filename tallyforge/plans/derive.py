"""Queries of derived figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import derive as D
from tallyforge.operators import relations as R
from tallyforge.plans.registry import query


@query("net_prices", R.with_("raw") + " SELECT invoice_id, position, part_id, line_total, CASE WHEN part_id % 5 = 0 THEN CAST(1.5 AS DECIMAL(18,4)) WHEN part_id % 7 = 0 OR part_id % 11 = 0 OR part_id % 13 = 0 THEN NULL ELSE CAST(unit_price AS DECIMAL(18,4)) END AS price, NOT (part_id % 5 = 0 OR part_id % 7 = 0 OR part_id % 11 = 0 OR part_id % 13 = 0) AS derived FROM raw")
def net_prices(spark, d):
    p = F.col("part_id")
    net = F.when(p % 5 == 0, F.lit("1.5").cast("decimal(18,4)"))
    got = D.net_price(F.col("unit_price"), net, F.when(p % 7 == 0, F.lit(1)), F.when(p % 11 == 0, "gross").otherwise("unit"), F.when(p % 13 == 0, "gross"))
    return R.raw_lines(spark, d).select("invoice_id", "position", "part_id", "line_total", got.alias("g")).select("invoice_id", "position", "part_id", "line_total", "g.price", "g.derived")


@query("repaired_quantities", """WITH q AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, l_partkey AS part_id, CAST(l_quantity AS BIGINT) AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total FROM lineitem), t AS (SELECT *, CASE part_id % 4 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN replace(CAST(n AS VARCHAR), '1', 'I') WHEN 2 THEN n || '7' ELSE 'xx' END AS printed FROM q)
SELECT invoice_id, position, part_id, line_total, printed, CASE part_id % 4 WHEN 0 THEN NULL WHEN 3 THEN NULL WHEN 2 THEN n ELSE CASE WHEN contains(printed, 'I') THEN n END END AS quantity FROM t""")
def repaired_quantities(spark, d):
    n = F.col("l_quantity").cast("long")
    p = F.col("l_partkey")
    printed = F.when(p % 4 == 0, n.cast("string")).when(p % 4 == 1, F.translate(n.cast("string"), "1", "I")).when(p % 4 == 2, F.concat(n.cast("string"), F.lit("7"))).otherwise("xx")
    rate = p % 90 + 3
    return R.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("position"), p.alias("part_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("line_total"), printed.alias("printed"), D.repaired_quantity(printed, rate, rate * n).alias("quantity"))


@query("derived_totals", R.with_("inv", "raw") + """, l AS (SELECT invoice_id, line_total, CASE WHEN position <> 7 AND invoice_id % 5 <> 0 THEN CAST(line_total * tax_rate AS DECIMAL(18,2)) END AS tax_amount FROM raw), s AS (SELECT invoice_id, sum(tax_amount) AS taxes, bool_and(tax_amount IS NOT NULL) AS taxed, bool_and(tax_amount IS NULL) AS untaxed, sum(line_total) AS lt FROM l GROUP BY 1),
i AS (SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE subtotal END AS subtotal, CASE WHEN id % 3 <> 0 THEN NULL ELSE tax_total END AS tax_total, CASE WHEN id % 5 = 0 THEN coalesce(CAST(lt AS DECIMAL(18,2)), total) ELSE total END AS total, taxes, taxed, untaxed, lt FROM inv LEFT JOIN s ON s.invoice_id = inv.id),
t AS (SELECT *, CASE WHEN tax_total IS NOT NULL THEN 'printed' WHEN taxed THEN 'lines' WHEN untaxed AND subtotal IS NULL AND lt = total THEN 'zero' ELSE 'none' END AS tax_from FROM i), u AS (SELECT *, CAST(CASE tax_from WHEN 'printed' THEN tax_total WHEN 'lines' THEN taxes WHEN 'zero' THEN 0 END AS DECIMAL(18,2)) AS tax FROM t)
SELECT id, CAST(coalesce(subtotal, total - tax) AS DECIMAL(18,2)) AS subtotal, CASE WHEN subtotal IS NOT NULL THEN 'printed' WHEN tax IS NOT NULL THEN 'difference' ELSE 'none' END AS subtotal_from, tax AS tax_total, tax_from FROM u""")
def derived_totals(spark, d):
    lines = R.raw_lines(spark, d)
    tax = F.when((F.col("position") != 7) & (F.col("invoice_id") % 5 != 0), (F.col("line_total") * F.col("tax_rate")).cast("decimal(18,2)"))
    own = lines.select("invoice_id", "line_total", tax.alias("tax_amount"))
    sums = lines.groupBy(F.col("invoice_id").alias("id")).agg(F.sum("line_total").cast("decimal(18,2)").alias("lt"))
    k = F.col("id")
    inv = R.invoices(spark, d).join(sums, "id", "left").select("id", F.when(k % 2 != 0, F.col("subtotal")).alias("subtotal"), F.when(k % 3 == 0, F.col("tax_total")).alias("tax_total"), F.when(k % 5 == 0, F.coalesce("lt", "total")).otherwise(F.col("total")).alias("total"))
    return D.derived_totals(inv, own)


@query("seller_names", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Acme Trading LLC' WHEN 2 THEN 'Beta Co. Ltd' END AS seller FROM documents")
def seller_names(spark, d):
    k = F.col("doc_id") % 5
    page = (
        F.when(k == 0, "| Acme  Trading LLC -\n\nDubai\nBill To: X Ltd").when(k == 1, "Foo\nBill to: y").when(k == 2, "Beta Co. Ltd é\nTAX INVOICE").when(k == 3, "Client Gamma LLC\nInvoice").otherwise("Delta LLC\na\nb\nc\nd\nSold to Epsilon")
    )
    return R.read(spark, d, "documents").select("doc_id", D.seller(page).alias("seller"))


@query("page_worths", "SELECT doc_id, CAST(50.0 + 3.0 * (CASE doc_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 3 THEN 5 ELSE 0 END) + CASE doc_id % 4 WHEN 0 THEN 0.5 WHEN 3 THEN 13.25 ELSE 0 END AS DOUBLE) AS worth FROM documents")
def page_worths(spark, d):
    k = F.col("doc_id") % 4
    page = F.when(k == 0, "Invoice No: 7\nQty\n1 2.5 3\n4 5 6\nSub-Total\n").when(k == 1, "NET 5").when(k == 3, "Quantity   Description\n Description   Qty   Unit Price   Net Amount\nMist   2   1.50   3.00").otherwise("x")
    return R.read(spark, d, "documents").select("doc_id", D.page_worth(page, F.lit(50.0)).alias("worth"))

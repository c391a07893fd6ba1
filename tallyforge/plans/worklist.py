"""Queries of worklists, counts and directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import relations as R
from tallyforge.operators import worklist as W
from tallyforge.plans.registry import query


@query("invoice_summary", R.with_("inv", "raw") + """, s AS (SELECT invoice_id, count(*) AS line_count, count(*) FILTER (rms_item_id IS NOT NULL AND match_status IN ('auto', 'confirmed')) AS matched_lines, bool_or(quantity IS NULL) AS missing,
 CAST(sum(round(CAST(quantity * unit_price AS DECIMAL(28,8)), 0)) AS DECIMAL(28,4)) AS s0, CAST(sum(round(CAST(quantity * unit_price AS DECIMAL(28,8)), 2)) AS DECIMAL(28,4)) AS s2, CAST(sum(round(CAST(quantity * unit_price AS DECIMAL(28,8)), 3)) AS DECIMAL(28,4)) AS s3 FROM raw GROUP BY 1),
j AS (SELECT inv.*, coalesce(line_count, 0) AS line_count, coalesce(matched_lines, 0) AS matched_lines, CAST(CASE WHEN NOT missing THEN CASE digits WHEN 0 THEN s0 WHEN 3 THEN s3 ELSE s2 END END AS DECIMAL(28,4)) AS target_total FROM inv LEFT JOIN s ON s.invoice_id = inv.id)
SELECT id, status, currency, line_count, matched_lines, target_total, CAST(target_total - subtotal AS DECIMAL(28,4)) AS variance,
 NOT coalesce(CASE digits WHEN 0 THEN round(target_total, 0) = round(CAST(subtotal AS DECIMAL(28,4)), 0) WHEN 3 THEN round(target_total, 3) = round(CAST(subtotal AS DECIMAL(28,4)), 3) ELSE round(target_total, 2) = subtotal END, false) AS review FROM j""")
def invoice_summary(spark, d):
    return W.summary(R.invoices(spark, d), R.raw_lines(spark, d))


@query("worklist_page", R.with_("inv") + " SELECT id, supplier_id, number, status, total FROM inv WHERE status = 'needs_review' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def worklist_page(spark, d):
    found = R.invoices(spark, d).where("status = 'needs_review'").select("id", "supplier_id", "number", "status", "total", "created_at")
    return W.page(found, [F.col("created_at").desc(), F.col("id").desc()], 50, 100).drop("created_at")


@query("worklist_search", R.with_("inv") + ", t AS (SELECT count(*) AS matches FROM inv WHERE status = 'exported' AND (CAST(supplier_id AS VARCHAR) ILIKE '%199_0%' OR number ILIKE '%199_0%')) SELECT id, number, supplier_id, matches FROM inv, t WHERE status = 'exported' AND (CAST(supplier_id AS VARCHAR) ILIKE '%199_0%' OR number ILIKE '%199_0%')")
def worklist_search(spark, d):
    found = W.search(R.invoices(spark, d).where("status = 'exported'").withColumn("supplier", F.col("supplier_id").cast("string")), "199_0", "supplier", "number")
    # one row, so every match can carry it
    n = found.agg(F.first(F.lit("exported")).alias("status"), F.count("*").alias("matches"))
    return found.join(F.broadcast(n), "status").select("id", "number", "supplier_id", "matches")


@query("status_counts_zero_filled", R.with_("inv") + " SELECT s.status, count(inv.id) AS n FROM (VALUES ('queued'), ('processing'), ('needs_review'), ('ready'), ('exported'), ('failed')) s(status) LEFT JOIN inv USING (status) GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM inv")
def status_counts_zero_filled(spark, d):
    return W.status_counts(R.invoices(spark, d).select("status"))


@query("line_match_counts", R.with_("raw") + " SELECT invoice_id, count(*) AS line_count, count(*) FILTER (rms_item_id IS NOT NULL AND match_status IN ('auto', 'confirmed')) AS matched_lines, count(*) FILTER (match_status = 'auto') AS auto_lines FROM raw GROUP BY 1")
def line_match_counts(spark, d):
    return W.line_counts(R.raw_lines(spark, d))


@query("global_line_counts", R.with_("raw") + " SELECT count(*) AS total_lines, count(*) FILTER (rms_item_id IS NOT NULL AND match_status IN ('auto', 'confirmed')) AS matched_lines FROM raw")
def global_line_counts(spark, d):
    matched = F.col("rms_item_id").isNotNull() & F.col("match_status").isin(*W.MATCHED)
    return R.raw_lines(spark, d).agg(F.count("*").alias("total_lines"), F.count_if(matched).alias("matched_lines"))


@query("supplier_directory", R.with_("cat") + " SELECT s_suppkey AS supplier_id, max(s_name) AS supplier_name, count(*) AS row_count FROM cat JOIN supplier ON s_suppkey = supplier_id GROUP BY 1")
def supplier_directory(spark, d):
    own = R.catalog(spark, d).groupBy("supplier_id").agg(F.count("*").alias("row_count"))
    names = R.read(spark, d, "supplier").groupBy(F.col("s_suppkey").alias("supplier_id")).agg(F.max("s_name").alias("supplier_name"))
    return own.join(names, "supplier_id").select("supplier_id", "supplier_name", "row_count")


@query("catalog_search", R.with_("cat") + " SELECT item_key, description, supplier_id, unit_cost FROM cat WHERE (description ILIKE '%red%' OR upc ILIKE '%red%' OR item_key ILIKE '%red%') ORDER BY description, rms_item_id, item_key LIMIT 100")
def catalog_search(spark, d):
    found = W.search(R.catalog(spark, d), "red", "description", "upc", "item_key")
    return W.page(found, [F.col("description"), F.col("rms_item_id"), F.col("item_key")], 100).select("item_key", "description", "supplier_id", "unit_cost")


@query("supplier_scope_catalog", R.with_("cat") + ", c AS (SELECT *, CASE WHEN rms_item_id % 11 <> 0 THEN supplier_id END AS scope FROM cat) SELECT item_key, rms_item_id, scope FROM c WHERE scope IS NULL OR scope = 7")
def supplier_scope_catalog(spark, d):
    scoped = R.catalog(spark, d).withColumn("scope", F.when(F.col("rms_item_id") % 11 != 0, F.col("supplier_id")))
    return scoped.where("scope is null or scope = 7").select("item_key", "rms_item_id", "scope")


@query("required_fields_missing", """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer)
SELECT id, concat_ws(',', CASE WHEN trim(coalesce(name, '')) = '' THEN 'name' END, CASE WHEN trim(coalesce(segment, '')) = '' THEN 'segment' END, CASE WHEN trim(coalesce(nation, '')) = '' THEN 'nation' END) AS missing FROM c""")
def required_fields_missing(spark, d):
    k = F.col("c_custkey")
    df = R.read(spark, d, "customer").select(k.alias("id"), F.when(k % 5 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return df.select("id", F.array_join(W.missing_fields(df, ["name", "segment", "nation"]), ",").alias("missing"))


@query("audit_newest", R.with_("ev") + " SELECT id, invoice_id, event_type, actor FROM ev ORDER BY id DESC LIMIT 100")
def audit_newest(spark, d):
    return W.newest(R.events(spark, d).select("id", "invoice_id", "event_type", "actor"), 100)


@query("audit_trail", R.with_("ev") + " SELECT id, event_type, actor, to_status, k FROM ev WHERE invoice_id LIKE '1-202401%'")
def audit_trail(spark, d):
    return R.events(spark, d).where(F.col("invoice_id").startswith("1-202401")).select("id", "event_type", "actor", "to_status", "k")


@query("queue_ready", R.with_("inv") + " SELECT id, created_at AS next_attempt_at FROM inv WHERE status = 'queued' AND (id % 4 = 0 OR created_at <= TIMESTAMP '1998-01-01') ORDER BY created_at, id LIMIT 25")
def queue_ready(spark, d):
    ready = (F.col("id") % 4 == 0) | (F.col("created_at") <= F.lit("1998-01-01").cast("timestamp"))
    return R.invoices(spark, d).where("status = 'queued'").where(ready).orderBy("created_at", "id").limit(25).select("id", F.col("created_at").alias("next_attempt_at"))


@query("status_in_list", R.with_("inv") + " SELECT status, count(*) AS n, max(created_at) AS last_activity FROM inv WHERE status IN ('queued', 'processing') GROUP BY 1")
def status_in_list(spark, d):
    return R.invoices(spark, d).where(F.col("status").isin("queued", "processing")).groupBy("status").agg(F.count("*").alias("n"), F.max("created_at").alias("last_activity"))


@query("catalog_fingerprint", R.with_("cat") + " SELECT count(*) AS n, max(unit_cost) AS max_cost, max(rms_item_id) AS max_item FROM cat")
def catalog_fingerprint(spark, d):
    return R.catalog(spark, d).agg(F.count("*").alias("n"), F.max("unit_cost").alias("max_cost"), F.max("rms_item_id").alias("max_item"))


@query("undeclared_currency_rows", R.with_("cat") + ", c AS (SELECT supplier_id AS import_id, CASE WHEN rms_item_id % 4 = 0 THEN 'AED' END AS cost_currency FROM cat) SELECT s_suppkey AS import_id, count(c.import_id) AS undeclared FROM supplier LEFT JOIN c ON c.import_id = s_suppkey AND cost_currency IS NULL GROUP BY 1")
def undeclared_currency_rows(spark, d):
    c = R.catalog(spark, d).where("rms_item_id % 4 <> 0").groupBy(F.col("supplier_id").alias("import_id")).agg(F.count("*").alias("undeclared"))
    return R.read(spark, d, "supplier").select(F.col("s_suppkey").alias("import_id")).join(c, "import_id", "left").select("import_id", F.coalesce("undeclared", F.lit(0)).cast("long").alias("undeclared"))


@query("adjustment_lines", "SELECT doc_id, regexp_matches(text, '(?i)\\b(discount|rebate|credit|allowance|adjustment|surcharge|promotion|promo|rounding)') AS adjustment FROM documents")
def adjustment_lines(spark, d):
    return R.read(spark, d, "documents").select("doc_id", T.is_adjustment(F.col("text")).alias("adjustment"))


@query("ids_deduped", R.with_("raw") + " SELECT part_id, min(invoice_id) AS invoice_id FROM raw GROUP BY 1")
def ids_deduped(spark, d):
    return W.first_positions(R.raw_lines(spark, d), "part_id", "invoice_id")


@query("key_sets", R.with_("raw") + ", a AS (SELECT DISTINCT part_id FROM raw WHERE match_status = 'auto'), b AS (SELECT DISTINCT part_id FROM raw WHERE match_status = 'suggested') SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both, (SELECT count(*) FROM (FROM a UNION FROM b)) AS n_any, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_only_auto")
def key_sets(spark, d):
    own = R.raw_lines(spark, d).groupBy("part_id").agg(F.bool_or(F.col("match_status") == "auto").alias("a"), F.bool_or(F.col("match_status") == "suggested").alias("b"))
    return own.agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") | F.col("b")).alias("n_any"), F.count_if(F.col("a") & ~F.col("b")).alias("n_only_auto"))


@query("semi_join_known_suppliers", R.with_("cat") + " SELECT s_suppkey AS supplier_id, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM cat WHERE supplier_id = s_suppkey AND unit_cost > 995)")
def semi_join_known_suppliers(spark, d):
    known = R.catalog(spark, d).where("unit_cost > 995").select("supplier_id")
    return R.read(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_name").join(known, "supplier_id", "left_semi")


@query("invoices_without_lines", R.with_("inv", "raw") + " SELECT id, status FROM inv WHERE id NOT IN (SELECT invoice_id FROM raw)")
def invoices_without_lines(spark, d):
    own = R.raw_lines(spark, d).select(F.col("invoice_id").alias("id"))
    return R.invoices(spark, d).select("id", "status").join(own, "id", "left_anti")


@query("supplier_rules", "SELECT s_suppkey AS supplier_id, site, tax_code FROM supplier LEFT JOIN (VALUES ('supplier#000000003', 'S-3', 'T5'), ('supplier#000000007', 'S-7', 'T0')) r(name, site, tax_code) ON lower(s_name) = name")
def supplier_rules(spark, d):
    # the rules of one settings row; the first of a name counts
    rules = spark.createDataFrame([(0, "Supplier#000000003", "S-3", "T5"), (1, "SUPPLIER#000000007", "S-7", "T0"), (2, "supplier#000000007", "S-8", "T1")], "n int, name string, site string, tax_code string")
    first = rules.groupBy(F.lower("name").alias("name")).agg(F.min(F.struct("n", "site", "tax_code")).alias("r")).select("name", "r.site", "r.tax_code")
    s = R.read(spark, d, "supplier")
    return s.join(F.broadcast(first), F.lower("s_name") == F.col("name"), "left").select(F.col("s_suppkey").alias("supplier_id"), "site", "tax_code")

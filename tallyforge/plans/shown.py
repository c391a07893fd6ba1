"""Queries of rows as readers get them, of stored settings, and of what is appended or replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import policy as Y
from tallyforge.operators import relations as R
from tallyforge.operators import shown as H
from tallyforge.plans import matching as P
from tallyforge.plans.registry import query

PLAIN = "CASE WHEN contains(CAST({0} AS VARCHAR), '.') THEN regexp_replace(CAST({0} AS VARCHAR), '\\.?0+$', '') ELSE CAST({0} AS VARCHAR) END"


@query("lines_shown", R.with_("num") + f""" SELECT invoice_id || '-' || line_no AS line_id, description, {PLAIN.format('quantity')} AS quantity, {PLAIN.format('unit_price')} AS unit_price, {PLAIN.format('line_total')} AS line_total, {PLAIN.format('tax_rate')} AS tax_rate, CAST(rms_item_id AS VARCHAR) AS rms_item_id, CAST(rms_item_id AS VARCHAR) AS rms_parent_item,
 CASE WHEN position % 2 = 0 THEN 'master holds multiple prices for this RMS item' END AS rms_unit_cost_note, match_status, CASE WHEN position % 3 = 0 THEN 0.0 ELSE CAST(90 + position AS DOUBLE) END AS confidence, CASE position % 4 WHEN 0 THEN '[{{"a":1,"b":2}}]' ELSE '[]' END AS candidates FROM num""")
def lines_shown(spark, d):
    n = F.col("position")
    own = R.numbered(R.lines(spark, d)).select(
        F.concat_ws("-", F.col("invoice_id").cast("string"), F.col("line_no").cast("string")).alias("line_id"), "description", "quantity", "unit_price", "line_total", "tax_rate", F.col("rms_item_id").cast("string").alias("rms_item_id"),
        F.when(n % 2 == 0, F.col("unit_price")).alias("rms_unit_cost_min"), "match_status", F.when(n % 3 != 0, n + 90).alias("confidence"), F.when(n % 4 == 0, '[{"b": 2, "a": 1}]').when(n % 4 == 1, "[{").when(n % 4 == 2, "").alias("candidates"),
    )
    return H.lines_shown(own)


@query("candidates_shown", P.BASE + """ SELECT item_key, '{' || concat_ws(',', CASE WHEN rms_item_id % 3 <> 0 THEN '"catalog_item_id":"' || item_key || '"' END, '"description":"' || description || '"', '"reason":"exact"',
 CASE WHEN rms_item_id % 3 <> 0 AND supplier_id % 2 = 0 THEN '"rms_cost_currency":"USD"' END, '"rms_item_id":"' || rms_item_id || '"', CASE WHEN rms_item_id % 3 <> 0 THEN '"rms_unit_cost":' || unit_cost END, CASE WHEN rms_item_id % 3 <> 0 THEN '"rms_upc":"' || upc || '"' END, '"score":100', CASE WHEN rms_item_id % 3 <> 0 AND uom IS NOT NULL THEN '"uom":"' || uom || '"' END) || '}' AS candidate FROM cn""")
def candidates_shown(spark, d):
    own = R.catalog(spark, d).withColumns({"key": F.col("item_key"), "item_key": F.when(F.col("rms_item_id") % 3 != 0, F.col("item_key")), "score": F.lit(100), "reason": F.lit("exact"), "cost_currency": F.when(F.col("supplier_id") % 2 == 0, "USD")})
    return own.select(F.col("key").alias("item_key"), H.candidate_shown().alias("candidate"))


@query("attributes_shown", "SELECT p_partkey AS part_id, p_size || CASE p_partkey % 3 WHEN 0 THEN 'ml' WHEN 1 THEN 'g' ELSE ' weight_oz' END AS shown FROM part")
def attributes_shown(spark, d):
    k = F.col("p_partkey")
    norm = F.concat_ws(" ", F.lit("tin"), F.col("p_size").cast("string"), F.when(k % 3 == 0, "ml").when(k % 3 == 1, "g").otherwise("oz"))
    return R.read(spark, d, "part").select(k.alias("part_id"), H.attribute_text(T.sizes(norm)).alias("shown"))


@query("details_json", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '{\"none\":true}' ELSE CAST(json(props) AS VARCHAR) END AS details FROM events")
def details_json(spark, d):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, '{"k":').when(e % 4 == 1, "").otherwise(F.col("props"))
    return R.read(spark, d, "events").select("event_id", H.json_or(text, '{"none":true}').alias("details"))


@query("document_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <= 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def document_dates(spark, d):
    k, at = F.col("o_orderkey"), F.to_date("o_orderdate")
    # the week's year is that of its thursday
    week = F.format_string("%04d-W%02d-%d", F.year(F.date_add(F.trunc(at, "week"), 3)), F.weekofyear(at), F.weekday(at) + 1)
    text = F.when(k % 5 == 0, F.date_format(at, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(at, "yyyyMMdd")).when(k % 5 == 2, week).when(k % 5 == 3, F.date_format(at, "dd/MM/yyyy")).otherwise("1997-02-30")
    return R.read(spark, d, "orders").select(k.alias("id"), H.document_date(text).alias("day"))


@query("completion_events", R.with_("raw") + ", c AS (SELECT invoice_id, count(*) AS line_count, count(*) FILTER (rms_item_id IS NOT NULL AND match_status = 'auto') AS auto_matched_lines FROM raw GROUP BY 1) SELECT *, '{\"auto_matched_lines\":' || auto_matched_lines || ',\"line_count\":' || line_count || '}' AS details FROM c")
def completion_events(spark, d):
    return H.completion(R.raw_lines(spark, d))


@query("queue_stall", R.with_("inv", "ev") + ", a AS (SELECT max(created_at) AS last FROM ev WHERE event_type IN ('uploaded', 'extraction_completed')) SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, any_value(round(epoch_us(TIMESTAMP '2030-01-01') / 1000000.0 - epoch_us(last) / 1000000.0, 1)) AS idle_seconds, count(*) FILTER (status = 'queued') > 0 AS stalled FROM inv, a")
def queue_stall(spark, d):
    activity = R.events(spark, d).where("event_type in ('uploaded', 'extraction_completed')").select(F.col("created_at").alias("at"))
    return H.queue_state(R.invoices(spark, d), activity, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


@query("children_replaced", R.with_("num") + " SELECT invoice_id, line_no, CASE WHEN invoice_id % 5 = 0 THEN CAST(quantity + 1 AS DECIMAL(10,0)) ELSE quantity END AS quantity FROM num WHERE invoice_id % 5 <> 0 OR (line_no < 2 AND invoice_id % 10 = 0)")
def children_replaced(spark, d):
    own = R.numbered(R.raw_lines(spark, d)).select("invoice_id", "line_no", "quantity")
    new = own.where("line_no < 2 and invoice_id % 10 = 0").withColumn("quantity", (F.col("quantity") + 1).cast("decimal(10,0)"))
    return H.replace_children(own, new, own.where("invoice_id % 5 = 0").select("invoice_id"), "invoice_id")


def _stored(e):
    return F.when(e % 5 == 0, '{"version":3,"owner":"ops","effective_date":"2024-01-31","absolute_tolerance":2.5,"percentage_tolerance":"1.5","scope":"per_invoice","invoice_currency_scope":["aed","usd"]}').when(e % 5 == 1, '{"absolute_tolerance":"n/a","scope":"all","invoice_currency_scope":[]}').when(e % 5 == 2, "[1]").when(e % 5 == 3, "{broken")


STORED = """st AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 3 ELSE 1 END AS version, CASE event_id % 5 WHEN 0 THEN 'ops' ELSE '' END AS owner, CASE event_id % 5 WHEN 0 THEN '2024-01-31' ELSE '' END AS effective_date, CAST(CASE WHEN event_id % 5 = 0 THEN 2.5 WHEN event_id % 5 >= 2 AND event_id % 2 = 0 THEN 7 ELSE 10 END AS DECIMAL(18,6)) AS absolute_tolerance,
 CAST(CASE event_id % 5 WHEN 0 THEN 1.5 END AS DECIMAL(18,6)) AS percentage_tolerance, CASE event_id % 5 WHEN 0 THEN 'per_invoice' ELSE 'per_line' END AS scope, CASE event_id % 5 WHEN 0 THEN 'AED,USD' ELSE 'AED' END AS currencies FROM events)"""


def _policies(spark, d):
    e = F.col("event_id")
    legacy = F.when(e % 2 == 0, '{"maximum_absolute_difference_aed":7}')
    return R.read(spark, d, "events").select("event_id", Y.stored_policy(_stored(e), legacy).alias("current"))


def _flat(df, at, *more):
    parts = ("version", "owner", "effective_date", "absolute_tolerance", "percentage_tolerance", "scope")
    return df.select("event_id", *[F.col(f"{at}.{c}").alias(c) for c in parts], F.array_join(f"{at}.currencies", ",").alias("currencies"), *more)


@query("stored_policies", f"WITH {STORED} SELECT * FROM st")
def stored_policies(spark, d):
    return _flat(_policies(spark, d), "current")


@query("submitted_policies", f"""WITH {STORED}, q AS (SELECT *, event_id % 7 AS r FROM st)
SELECT event_id, version + CASE WHEN r IN (0, 1) OR (r = 2 AND effective_date = '') THEN 1 ELSE 0 END AS version, CASE r WHEN 0 THEN 'lee' ELSE owner END AS owner, CASE WHEN r = 0 THEN '2025-02-28' WHEN r IN (1, 2) AND effective_date = '' THEN '2025-06-01' ELSE effective_date END AS effective_date, CAST(CASE r WHEN 0 THEN 1250.5 ELSE absolute_tolerance END AS DECIMAL(18,6)) AS absolute_tolerance,
 CAST(CASE r WHEN 0 THEN NULL WHEN 1 THEN 99 ELSE percentage_tolerance END AS DECIMAL(18,6)) AS percentage_tolerance, CASE r WHEN 0 THEN 'per_invoice' ELSE scope END AS scope, CASE r WHEN 0 THEN 'EUR,AED' ELSE currencies END AS currencies,
 CASE r WHEN 3 THEN 'owner:invalid,absolute_tolerance:invalid_number,scope:invalid' WHEN 4 THEN 'effective_date:invalid_date,percentage_tolerance:invalid_number,currencies:invalid_currency' WHEN 5 THEN 'tolerance_policy:invalid' WHEN 6 THEN 'percentage_tolerance:invalid_number,currencies:required' ELSE '' END AS errors FROM q""")
def submitted_policies(spark, d):
    r = F.col("event_id") % 7
    raw = (
        F.when(r == 0, '{"version":99,"owner":" lee ","effective_date":"2025-02-28","absolute_tolerance":"1,250.5","percentage_tolerance":null,"scope":"per_invoice","invoice_currency_scope":"eur, aed;eur"}')
        .when(r == 1, '{"percentage_tolerance":99}').when(r == 2, "{}").when(r == 3, '{"owner":5,"absolute_tolerance":-1,"scope":"some"}')
        .when(r == 4, '{"effective_date":"2025-02-30","percentage_tolerance":"x","invoice_currency_scope":["AED","dirham"]}').when(r == 5, "[]").otherwise('{"percentage_tolerance":101,"invoice_currency_scope":[]}')
    )
    own = Y.submitted(_policies(spark, d).withColumn("raw", raw), "raw", "current", F.lit("2025-06-01").cast("date"))
    return _flat(own, "policy", F.array_join("errors", ",").alias("errors"))

"""Queries of profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import profiles as C
from tallyforge.operators import relations as R
from tallyforge.plans.registry import query


@query("corpus_summary", """WITH t AS (SELECT lang, source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS band, n_chars AS size FROM documents)
SELECT 'lang' AS dimension, lang AS value, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars FROM t GROUP BY 2 UNION ALL SELECT 'source', source, count(*), CAST(sum(size) AS BIGINT) FROM t GROUP BY 2 UNION ALL SELECT 'band', band, count(*), CAST(sum(size) AS BIGINT) FROM t GROUP BY 2""")
def corpus_summary(spark, d):
    n = F.col("n_chars")
    df = R.read(spark, d, "documents").select("lang", "source", F.when(n < 500, "short").when(n < 5000, "middle").otherwise("long").alias("band"), n.alias("size"))
    return C.corpus(df, {"lang": "lang", "source": "source", "band": "band"})


@query("stratified_sample", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def stratified_sample(spark, d):
    return C.stratified(R.read(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 3, "doc_id")


@query("po_location_profile", "WITH k AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS po, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS loc FROM orders), g AS (SELECT po, count(DISTINCT loc) AS v FROM k WHERE po IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FROM g) AS keys, (SELECT count(*) FROM g WHERE v > 1) AS several, (SELECT count(*) FROM k WHERE po IS NULL) AS null_keys, (SELECT count(*) FROM k WHERE loc IS NULL) AS null_values")
def po_location_profile(spark, d):
    k = F.col("o_orderkey")
    df = R.read(spark, d, "orders").select(F.when(k % 50 != 0, F.col("o_custkey")).alias("po"), F.when(k % 9 != 0, F.col("o_orderpriority")).alias("loc"))
    return C.key_profile(df, "po", "loc")


@query("shared_keys", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem) SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM (FROM a UNION FROM b)) AS n_any")
def shared_keys(spark, d):
    return C.shared_keys(R.read(spark, d, "orders").select("o_custkey"), R.read(spark, d, "lineitem").select("l_partkey"))


@query("content_dedupe", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedupe(spark, d):
    return R.read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("uom_normalise", "SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'EACH' WHEN 'ECONOMY' THEN 'PACK' WHEN 'MEDIUM' THEN 'BOX' WHEN 'PROMO' THEN 'DOZEN' WHEN 'LARGE' THEN 'LARGE' END AS unit FROM part")
def uom_normalise(spark, d):
    t = F.col("p_type")
    printed = F.when(t == "STANDARD", "pcs.").when(t == "ECONOMY", " Pkg ").when(t == "MEDIUM", "bx").when(t == "PROMO", "doz").when(t == "SMALL", "12").otherwise(F.col("p_type"))
    return R.read(spark, d, "part").select("p_partkey", T.unit(printed).alias("unit"))


@query("attributes_extract", "SELECT p_partkey, 'volume_ml:' || p_size * 1000 AS sizes, CAST(p_size % 7 + 2 AS VARCHAR) AS packs, 'shade:' || p_size AS shades FROM part")
def attributes_extract(spark, d):
    s = F.col("p_size").cast("string")
    norm = T.match_text(F.concat(F.col("p_name"), F.lit(" pack of "), (F.col("p_size") % 7 + 2).cast("string"), F.lit(" Shade No "), s, F.lit(" bottle "), s, F.lit("ML")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return R.read(spark, d, "part").select("p_partkey", text(T.sizes(norm)).alias("sizes"), text(T.packs(norm)).alias("packs"), text(T.shades(norm)).alias("shades"))


@query("gtin_check", """WITH g AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 AS VARCHAR), 13, '0') AS code FROM part), w AS (SELECT p_partkey, code, sum(CAST(substr(code, 14 - i, 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) AS s FROM g, range(1, 14) r(i) GROUP BY 1, 2)
SELECT p_partkey, code, s % 10 = 0 AS valid FROM w""")
def gtin_check(spark, d):
    code = F.lpad((F.col("p_partkey") * 7919).cast("string"), 13, "0")
    return R.read(spark, d, "part").select("p_partkey", code.alias("code"), T.gtin_valid(code).alias("valid"))


@query("doc_completeness", "SELECT lang, count(*) AS n, count(*) FILTER (text IS NOT NULL AND trim(text) <> '') AS with_text, count(*) FILTER (n_chars > 1000) AS long_ones, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1")
def doc_completeness(spark, d):
    text = F.col("text")
    return R.read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(text.isNotNull() & (F.trim(text) != "")).alias("with_text"), F.count_if(F.col("n_chars") > 1000).alias("long_ones"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))

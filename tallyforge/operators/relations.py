"""The invoice model's relations over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Conversion rates by day, with a pair that starts late and a tie of days.
RATES = [
    (1, "USD", "AED", "3.6725", "1994-01-01"), (2, "USD", "AED", "3.6730", "1997-01-01"), (3, "USD", "AED", "3.6740", "1997-01-01"), (4, "KWD", "AED", "12.0500", "1994-06-01"),
    (5, "KWD", "AED", "11.9000", "1998-03-15"), (6, "JPY", "AED", "0.0310", "1999-01-01"), (7, "JPY", "AED", "0.0330", "2000-07-01"), (8, "USD", "AED", "3.6800", "2001-01-01"),
]
# Units of the item master by kind of part.
PART_UNITS = {"STANDARD": "EA", "ECONOMY": "PK", "MEDIUM": "BX", "PROMO": "CS", "LARGE": "CTN", "SMALL": "DZ"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key, table: dict, default=None):
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("o_totalprice").cast("decimal(18,2)")
    tax = (total * F.lit("0.05").cast("decimal(2,2)")).cast("decimal(18,2)")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("supplier_id"),
        F.date_format("o_orderdate", "yyyyMM").alias("number"),
        F.to_date("o_orderdate").alias("invoice_date"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        total.alias("total"),
        tax.alias("tax_total"),
        (total - tax - F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0).cast("decimal(2,0)")).cast("decimal(18,2)").alias("subtotal"),
        _case(F.col("o_orderstatus"), {"F": "exported", "O": "needs_review"}, "queued").alias("status"),
        _case(F.col("o_custkey") % 4, {0: "AED", 1: "KWD", 2: "JPY"}, "USD").alias("currency"),
        _case(F.col("o_custkey") % 4, {1: 3, 2: 0}, 2).alias("digits"),
        F.col("o_orderpriority").alias("priority"),
    )


def part_text(size=None):
    size = F.concat(F.col("p_size").cast("string"), F.lit("ml")) if size is None else size
    return F.concat_ws(" ", "p_name", "p_brand", size)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without their text and number: no shuffle."""
    n = F.col("l_linenumber")
    quantity = F.when(n != 7, F.col("l_quantity")).cast("decimal(10,0)")
    total = F.col("l_extendedprice").cast("decimal(18,2)")
    price = F.round(F.try_divide(total, F.col("l_quantity").cast("decimal(10,0)")), 4).cast("decimal(18,4)")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"),
        n.alias("position"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        quantity.alias("quantity"),
        price.alias("unit_price"),
        total.alias("line_total"),
        F.col("l_tax").cast("decimal(6,4)").alias("tax_rate"),
        F.when(n % 5 != 0, F.col("l_partkey")).alias("rms_item_id"),
        _case(n % 4, {0: "auto", 1: "confirmed", 2: "suggested"}, "unmatched").alias("match_status"),
        F.to_date("l_shipdate").alias("ship_date"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), "p_name", "p_brand", "p_size",
        part_text().alias("item_description"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("unit_cost"),
        _case(F.col("p_type"), PART_UNITS).alias("item_uom"),
    )


def line_texts():
    """The ways in which a supplier prints a part, by the line's position."""
    size = F.col("p_size").cast("string")
    return [part_text(), part_text(F.concat(size, F.lit(" millilitres"))), F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_name", F.lit("extra"), "p_brand", F.concat(size, F.lit("ml")))]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with text and unit as a supplier would print them; parts are a dimension, joined as Spark sees fit."""
    n = F.col("position")
    first, respelt, short, extra = line_texts()
    text = F.when(n % 4 == 0, first).when(n % 4 == 1, respelt).when(n % 4 == 2, short).otherwise(extra)
    own = raw_lines(spark, sf_dir)
    joined = own.join(parts(spark, sf_dir), "part_id", "left")
    return joined.select(*own.columns, text.alias("description"), F.when(n % 3 != 2, F.col("item_uom")).alias("uom"))


LINE_ORDER = ["position", "part_id", "supplier_id", "quantity", "line_total", "ship_date", "tax_rate"]


def numbered(lines_: DataFrame) -> DataFrame:
    """Lines with line_no, their number in the invoice from 0."""
    return lines_.withColumn("line_no", F.row_number().over(Window.partitionBy("invoice_id").orderBy(*LINE_ORDER)) - 1)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item master: one row for each supplier and part that lines have."""
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id")).distinct()
    return pairs.join(parts(spark, sf_dir), "part_id").select(
        F.concat_ws(":", F.col("supplier_id").cast("string"), F.col("part_id").cast("string")).alias("item_key"),
        F.col("part_id").alias("rms_item_id"),
        "supplier_id",
        F.col("item_description").alias("description"),
        F.col("item_uom").alias("uom"),
        "unit_cost",
        F.lpad((F.col("part_id") * 37 + F.col("supplier_id") % 3).cast("string"), 12, "0").alias("upc"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events: a trail for each user and day."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("invoice_id"),
        _case(kind, {"signup": "uploaded", "view": "extraction_completed", "click": "invoice_edited", "purchase": "invoice_approved"}, "processing_failed").alias("event_type"),
        F.when(F.col("event_id") % 3 == 0, "system").otherwise("user").alias("actor"),
        F.when(kind == "purchase", "ready").when(kind == "error", "failed").when(kind == "view", "needs_review").when(kind == "signup", "queued").alias("to_status"),
        F.col("ts").alias("created_at"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.col("props").alias("details"),
    )


def rates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(RATES, "rate_id int, from_currency string, to_currency string, rate string, effective string")
    return rows.select("rate_id", "from_currency", "to_currency", F.col("rate").cast("decimal(12,4)").alias("rate"), F.to_date("effective").alias("effective_date"))


# The same relations for DuckDB, by name.
SQL = {
    "inv": """inv AS (SELECT o_orderkey AS id, o_custkey AS supplier_id, strftime(o_orderdate, '%Y%m') AS number, CAST(o_orderdate AS DATE) AS invoice_date, o_orderdate AS created_at,
 CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.05 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS tax_total,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.05 AS DECIMAL(2,2)) AS DECIMAL(18,2)) - CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS subtotal,
 CASE o_orderstatus WHEN 'F' THEN 'exported' WHEN 'O' THEN 'needs_review' ELSE 'queued' END AS status,
 CASE o_custkey % 4 WHEN 0 THEN 'AED' WHEN 1 THEN 'KWD' WHEN 2 THEN 'JPY' ELSE 'USD' END AS currency, CASE o_custkey % 4 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 2 END AS digits, o_orderpriority AS priority FROM orders)""",
    "part_t": """part_t AS (SELECT p_partkey AS part_id, p_name, p_brand, p_size, p_name || ' ' || p_brand || ' ' || p_size || 'ml' AS item_description, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_cost,
 CASE p_type WHEN 'STANDARD' THEN 'EA' WHEN 'ECONOMY' THEN 'PK' WHEN 'MEDIUM' THEN 'BX' WHEN 'PROMO' THEN 'CS' WHEN 'LARGE' THEN 'CTN' WHEN 'SMALL' THEN 'DZ' END AS item_uom FROM part)""",
    "raw": """raw AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, l_partkey AS part_id, l_suppkey AS supplier_id, CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS DECIMAL(10,0)) END AS quantity,
 CAST(((CAST(round(l_extendedprice * 100) AS BIGINT) * 200 + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT))) AS DECIMAL(14,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS unit_price,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total, CAST(l_tax AS DECIMAL(6,4)) AS tax_rate, CASE WHEN l_linenumber % 5 <> 0 THEN l_partkey END AS rms_item_id,
 CASE l_linenumber % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'suggested' ELSE 'unmatched' END AS match_status, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem)""",
    "ln": """ln AS (SELECT raw.*, CASE position % 4 WHEN 0 THEN item_description WHEN 1 THEN p_name || ' ' || p_brand || ' ' || p_size || ' millilitres' WHEN 2 THEN p_name || ' ' || p_brand ELSE p_name || ' extra ' || p_brand || ' ' || p_size || 'ml' END AS description,
 CASE WHEN position % 3 <> 2 THEN item_uom END AS uom FROM raw LEFT JOIN part_t USING (part_id))""",
    "num": "num AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY position NULLS FIRST, part_id NULLS FIRST, supplier_id NULLS FIRST, quantity NULLS FIRST, line_total NULLS FIRST, ship_date NULLS FIRST, tax_rate NULLS FIRST) - 1 AS line_no FROM ln)",
    "cat": """cat AS (SELECT supplier_id || ':' || part_id AS item_key, part_id AS rms_item_id, supplier_id, item_description AS description, item_uom AS uom, unit_cost, lpad(CAST(part_id * 37 + supplier_id % 3 AS VARCHAR), 12, '0') AS upc
 FROM (SELECT DISTINCT l_partkey AS part_id, l_suppkey AS supplier_id FROM lineitem) JOIN part_t USING (part_id))""",
    "ev": """ev AS (SELECT event_id AS id, user_id || '-' || strftime(ts, '%Y%m%d') AS invoice_id, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'extraction_completed' WHEN 'click' THEN 'invoice_edited' WHEN 'purchase' THEN 'invoice_approved' ELSE 'processing_failed' END AS event_type,
 CASE WHEN event_id % 3 = 0 THEN 'system' ELSE 'user' END AS actor, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'needs_review' WHEN 'signup' THEN 'queued' END AS to_status, ts AS created_at, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props AS details FROM events)""",
    "rates": "rates(rate_id, from_currency, to_currency, rate, effective_date) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', CAST({r} AS DECIMAL(12,4)), DATE '{d}')" for i, a, b, r, d in RATES) + ")",
}
NEEDS = {"ln": ("part_t", "raw"), "num": ("part_t", "raw", "ln"), "cat": ("part_t",)}


def with_(*names: str) -> str:
    """WITH clause of the named relations and those they read; more may follow after a comma."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ",\n".join(SQL[n] for n in order)

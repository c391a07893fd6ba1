"""Rows as readers get them: numbers, candidates and details as canonical JSON, attributes, dates, cleaned texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The note on an item whose master rows differ in cost.
COST_NOTE = "master holds multiple prices for this RMS item"


def shown_number(value: Column, kind: str = "decimal(38,10)") -> Column:
    """A number as JSON would have it: whole ones without a point, others without trailing zeros; null for what isn't one."""
    text = value.try_cast(kind).cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def canonical(**fields: Column) -> Column:
    """Fields as compact JSON with sorted keys; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def json_or(text: Column, fallback: str) -> Column:
    """JSON text as compact JSON, keys sorted; fallback where it is null, empty or broken."""
    return F.coalesce(F.to_json(F.try_parse_json(F.when(F.trim(text) != "", text))), F.lit(fallback))


def lines_shown(lines: DataFrame) -> DataFrame:
    """Stored lines as shown: numbers, the parent item, the note on several prices, candidates.

    lines(line_id, description, quantity, unit_price, line_total, tax_rate,
    rms_item_id, rms_unit_cost_min, match_status, confidence, candidates).
    No confidence is 0, broken candidates are an empty list.
    """
    note = F.when(F.col("rms_unit_cost_min").isNotNull(), COST_NOTE)
    numbers = [shown_number(F.col(c)).alias(c) for c in ("quantity", "unit_price", "line_total", "tax_rate")]
    return lines.select("line_id", "description", *numbers, "rms_item_id", F.col("rms_item_id").alias("rms_parent_item"), note.alias("rms_unit_cost_note"), "match_status", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), json_or(F.col("candidates"), "[]").alias("candidates"))


def candidate_shown() -> Column:
    """Public JSON of a candidate row: code and cost by their public names, nulls left out, master fields only with a key.

    Columns read: rms_item_id, description, score, reason, item_key, uom, upc,
    unit_cost, cost_currency.
    """
    own = lambda c: F.when(F.col("item_key").isNotNull(), F.col(c))
    return canonical(
        rms_item_id=F.col("rms_item_id").cast("string"), description=F.col("description"), score=F.col("score"), reason=F.col("reason"), catalog_item_id=F.col("item_key"),
        uom=own("uom"), rms_upc=own("upc"), rms_unit_cost=own("unit_cost"), rms_cost_currency=own("cost_currency"),
    )


def attribute_text(values: Column) -> Column:
    """Attributes (kind:thousandths, as functions.text.sizes has them) as a reader sees them: 50ml, 1.5g, 3 fluid_oz."""

    def one(v):
        kind, n = F.split_part(v, F.lit(":"), F.lit(1)), F.split_part(v, F.lit(":"), F.lit(2)).try_cast("decimal(30,0)")
        amount = shown_number((n / 1000).cast("decimal(33,3)"), "decimal(33,3)")
        unit = F.when(kind == "volume_ml", "ml").when(kind == "weight_g", "g").otherwise(F.concat(F.lit(" "), kind))
        return F.when(n.isNotNull(), F.concat(amount, unit)).otherwise(v)

    return F.array_join(F.transform(values, one), ", ")


def document_date(text: Column) -> Column:
    """ISO dates only, as calendar days (with or without dashes) or as year, week and day; null for all else."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    week = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"
    y, w, d = (F.regexp_extract(text, week, i).try_cast("int") for i in (1, 2, 3))
    monday = F.date_add(F.trunc(F.try_to_date(F.concat(F.regexp_extract(text, week, 1), F.lit("-01-04")), "yyyy-MM-dd"), "week"), (w - 1) * 7)
    # week 53 of a year that has none is week 1 of the next
    return F.coalesce(day, F.when(text.rlike(week) & (w >= 1) & (F.weekofyear(monday) == w), F.date_add(monday, F.coalesce(d, F.lit(1)) - 1)))


def completion(lines: DataFrame) -> DataFrame:
    """invoice_id, line_count, auto_matched_lines and the details of the completion event; matched is auto with an item."""
    own = lines.groupBy("invoice_id").agg(F.count("*").alias("line_count"), F.count_if(F.col("rms_item_id").isNotNull() & (F.col("match_status") == "auto")).alias("auto_matched_lines"))
    return own.withColumn("details", canonical(line_count=F.col("line_count"), auto_matched_lines=F.col("auto_matched_lines")))


def queue_state(invoices: DataFrame, activity: DataFrame, now: Column, stall_seconds: float = 120.0) -> DataFrame:
    """One row: queued, processing, idle_seconds since the last activity, and whether the queue stands still.

    invoices(status), activity(at).  Stalled is a queue with nothing in work
    and no activity for longer than stall_seconds; without any activity the
    idle time is null and nothing counts as stalled.
    """
    depth = invoices.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "processing").alias("processing"), F.lit(1).alias("k"))
    last = activity.agg(F.max("at").alias("last_activity"), F.lit(1).alias("k"))
    idle = F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_activity").cast("timestamp"))) / 1e6, 1)
    # a row on either side
    j = depth.join(F.broadcast(last), "k").withColumn("idle_seconds", idle)
    return j.select("queued", "processing", "idle_seconds", F.coalesce((F.col("queued") > 0) & (F.col("processing") == 0) & (F.col("idle_seconds") > stall_seconds), F.lit(False)).alias("stalled"))


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Snapshot in which each parent of parents(key) has only its new rows; one without new rows loses all, others keep theirs."""
    return old.join(parents.select(key).distinct(), key, "left_anti").unionByName(new.join(parents.select(key).distinct(), key, "left_semi"))

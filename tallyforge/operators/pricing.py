"""Costs: rates as of a day, the comparison ladder, tolerances, cost ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY, exceeds, money_round

USABLE = "0.01"


def as_of(rows: DataFrame, rates: DataFrame, keys: list[str], day: str, effective: str, tie: str, value: str) -> DataFrame:
    """rows with the value of the latest rate not after their day, the highest tie of equal days; null where there is none.

    Rates are summed up by month: what is in force at its start, and what
    changes within it.  So no row meets every rate, and hot keys are cut into
    months.
    """
    month = lambda c: F.trunc(c, "month")
    known = rates.where(F.col(value).isNotNull() & F.col(effective).isNotNull())
    months = rows.select(*keys, month(F.col(day)).alias("_m")).distinct()
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col(effective).alias("e")), F.struct(effective, tie))
    # rates are few against rows: each month of a key has the last of those before it, and its own
    starts = months.join(known, keys).where(F.col(effective) <= F.col("_m")).groupBy(*keys, "_m").agg(best.alias("_s"))
    inside = known.withColumn("_m", month(F.col(effective))).select(*keys, "_m", F.struct(F.col(effective), F.col(tie), F.col(value)).alias("_r")).groupBy(*keys, "_m").agg(F.collect_list("_r").alias("_rs"))
    joined = rows.withColumn("_m", month(F.col(day))).join(starts, [*keys, "_m"], "left").join(inside, [*keys, "_m"], "left")
    own = F.array_max(F.filter("_rs", lambda r: r[effective] <= F.col(day)))
    return joined.withColumn(value, F.coalesce(own[value], F.col("_s.v"))).drop("_m", "_s", "_rs")


def compare_costs(lines: DataFrame, absolute: Column, percentage: Column | None = None) -> DataFrame:
    """First reason that fits why a line's cost can't be compared, or the comparison.

    lines(line_id, rms_item_id, unit_state, cost, invoice_cost, currency,
    master_currency, in_scope, rate): adds converted, variance, status.
    """
    usable = F.coalesce(F.col("cost") > F.lit(USABLE).cast("decimal(4,2)"), F.lit(False))
    foreign = F.col("master_currency").isNotNull() & (F.col("master_currency") != F.col("currency"))
    converted = F.when(foreign, F.round(F.col("cost") * F.col("rate"), 4).cast("decimal(18,4)")).otherwise(F.col("cost").cast("decimal(18,4)"))
    variance = (F.col("invoice_cost") - converted).cast("decimal(18,4)")
    status = (
        F.when(F.col("rms_item_id").isNull(), "unavailable_no_match").when(F.col("unit_state").isin("unverified", "unconfirmed"), "unavailable_uom_mismatch").when(~usable, "unavailable_rms_cost")
        .when(~F.col("in_scope"), "unavailable_currency").when(F.col("invoice_cost").isNull(), "unavailable_invoice_cost").when(foreign & F.col("rate").isNull(), "currency_basis_mismatch")
        .when(exceeds(variance, converted, absolute, percentage), "above_tolerance").otherwise("within_tolerance")
    )
    compared = status.isin("above_tolerance", "within_tolerance")
    return lines.withColumns({"status": status, "converted": F.when(compared, converted), "variance": F.when(compared, variance)}).withColumn("review", F.col("status") != "within_tolerance")


def invoice_tolerance(lines: DataFrame, absolute: Column) -> DataFrame:
    """Verdict on each invoice from its lines' variances times quantities; unavailable if a comparable line lacks its quantity, or none is comparable.

    lines(invoice_id, quantity, variance, converted).
    """
    comparable = F.col("variance").isNotNull()
    total = F.sum(F.when(comparable, (F.col("quantity") * F.col("variance")).cast(MONEY)))
    sums = lines.groupBy("invoice_id").agg(F.count_if(comparable).alias("comparable"), F.count_if(comparable & F.col("quantity").isNull()).alias("missing"), total.cast("decimal(28,4)").alias("variance"), F.sum(F.when(comparable, (F.col("quantity") * F.col("converted")).cast(MONEY))).cast("decimal(28,4)").alias("base"))
    verdict = F.when((F.col("comparable") == 0) | (F.col("missing") > 0), "unavailable").when(exceeds(F.col("variance"), F.col("base"), absolute), "above_tolerance").otherwise("within_tolerance")
    return sums.select("invoice_id", "comparable", "variance", "base", verdict.alias("verdict"))


def cost_range(items: DataFrame) -> DataFrame:
    """Usable costs of each item: the one there is, or null with the least and the most."""
    usable = F.when(F.col("unit_cost") > F.lit(USABLE).cast("decimal(4,2)"), F.col("unit_cost"))
    own = items.groupBy("rms_item_id").agg(F.count_distinct(usable).alias("costs"), F.min(usable).alias("low"), F.max(usable).alias("high"))
    many = F.col("costs") > 1
    return own.select("rms_item_id", "costs", F.when(~many, F.col("low")).alias("cost"), F.when(many, F.col("low")).alias("low"), F.when(many, F.col("high")).alias("high"))


def reconcile(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether lines add up to the subtotal, and subtotal and tax to the total, at the currency's digits; null without the figures."""
    value = F.coalesce(F.col("quantity") * F.col("unit_price"), F.col("line_total"))
    sums = lines.groupBy("invoice_id").agg(*[F.sum(money_round(value, F.lit(k))).alias(f"s{k}") for k in (0, 2, 3)], F.bool_and(F.col("line_total").isNotNull()).alias("complete"))
    joined = invoices.join(sums, invoices["id"] == sums["invoice_id"], "left")
    d = F.col("digits")
    line_sum = F.when(d == 0, F.col("s0")).when(d == 3, F.col("s3")).otherwise(F.col("s2")).cast("decimal(28,4)")
    return joined.select(
        "id", line_sum.alias("line_sum"),
        F.when(F.col("complete"), money_round(line_sum, d) != money_round(F.col("subtotal"), d)).alias("sum_mismatch"),
        (money_round(F.col("subtotal") + F.col("tax_total"), d) != money_round(F.col("total"), d)).alias("total_mismatch"),
    )


def duplicates(invoices: DataFrame) -> DataFrame:
    """Invoices of one supplier and number: how many others each has, whether one is strong (same total and day), and the first of them, strong ones first.

    Groups are counted, not paired: the others of an invoice are its group's
    rows without it, the strong ones those of its group, total and day.
    """
    live = invoices.where("status <> 'failed' and number is not null and trim(number) <> ''").withColumn("key", F.lower(F.trim("number")))
    live = live.withColumn("strong_key", F.when(F.col("invoice_date").isNotNull() & F.col("total").isNotNull(), F.struct(money_round(F.col("total"), F.col("digits")).alias("t"), F.col("invoice_date").alias("d"))))
    group = live.groupBy("supplier_id", "key").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    second = live.join(group, ["supplier_id", "key"]).where("id <> m").groupBy("supplier_id", "key").agg(F.min("id").alias("m2"))
    strong = live.where("strong_key is not null").groupBy("supplier_id", "key", "strong_key").agg(F.count("*").alias("sn"), F.min("id").alias("sm"))
    strong2 = live.join(strong, ["supplier_id", "key", "strong_key"]).where("id <> sm").groupBy("supplier_id", "key", "strong_key").agg(F.min("id").alias("sm2"))
    j = live.join(group, ["supplier_id", "key"]).where("n > 1").join(second, ["supplier_id", "key"], "left").join(strong, ["supplier_id", "key", "strong_key"], "left").join(strong2, ["supplier_id", "key", "strong_key"], "left")
    has = F.coalesce(F.col("sn"), F.lit(1)) > 1
    other = lambda a, b: F.when(F.col("id") == F.col(a), F.col(b)).otherwise(F.col(a))
    return j.select("id", (F.col("n") - 1).alias("others"), F.when(has, "strong").otherwise("weak").alias("level"), F.when(has, other("sm", "sm2")).otherwise(other("m", "m2")).alias("first_other"))

"""The tolerance policy: what a stored one says, and what a submitted one changes or gets wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.shown import document_date

# Scopes, defaults and bounds of a policy.
SCOPES = ("per_line", "per_invoice")
ABSOLUTE, CURRENCIES = 10, ("AED",)
MOST_ABSOLUTE, MOST_PERCENTAGE, OWNER_LENGTH = 100_000, 100, 200
AMOUNT = "decimal(18,6)"


def _object(text: Column) -> Column:
    """JSON text if it is an object, else null."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def _list(text: Column) -> Column:
    return F.from_json(F.when(text.startswith("["), text), "array<string>")


def _amount(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", "").try_cast(AMOUNT)


def _defaults() -> Column:
    return F.array(*[F.lit(c) for c in CURRENCIES])


def stored_policy(stored: Column, legacy: Column) -> Column:
    """Policy as a struct: version, owner, effective_date, absolute_tolerance, percentage_tolerance, scope, currencies.

    stored is JSON text; where it is no object the legacy text's only number
    counts.  What is missing, null or of no use becomes the default.
    """
    own, old = _object(stored), _object(legacy)
    at = lambda key: F.get_json_object(own, f"$.{key}")
    absolute = F.when(own.isNull(), _amount(F.get_json_object(old, "$.maximum_absolute_difference_aed"))).otherwise(_amount(at("absolute_tolerance")))
    currencies = F.filter(F.transform(_list(at("invoice_currency_scope")), lambda c: F.upper(c)), lambda c: c != "")
    return F.struct(
        F.coalesce(F.nullif(at("version").try_cast("int"), F.lit(0)), F.lit(1)).alias("version"), F.coalesce(at("owner"), F.lit("")).alias("owner"), F.coalesce(at("effective_date"), F.lit("")).alias("effective_date"),
        F.coalesce(absolute, F.lit(ABSOLUTE).cast(AMOUNT)).alias("absolute_tolerance"), _amount(at("percentage_tolerance")).alias("percentage_tolerance"),
        F.when(at("scope").isin(*SCOPES), at("scope")).otherwise(SCOPES[0]).alias("scope"), F.when(F.size(currencies) > 0, currencies).otherwise(_defaults()).alias("currencies"),
    )


def submitted(rows: DataFrame, raw: str, current: str, today: Column) -> DataFrame:
    """rows with policy and errors (field:code) of a submitted JSON text against the current policy, a struct as stored_policy gives it.

    Keys that are missing keep their value.  With any error the policy is the
    current one; without, the version goes up where something else differs: a
    submitted version is never taken.  Text that is no object is one error.
    """
    own, now = _object(F.col(raw)), F.col(current)
    has = lambda key: F.coalesce(F.array_contains(F.json_object_keys(own), key), F.lit(False))
    at = lambda key: F.get_json_object(own, f"$.{key}")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(own), "$.owner", "variant"))
    wrong_owner = has("owner") & at("owner").isNotNull() & (kind != "STRING")
    owner = F.when(has("owner"), F.substring(F.trim(F.replace(F.coalesce(at("owner"), F.lit("")), F.lit("\x00"), F.lit(""))), 1, OWNER_LENGTH)).otherwise(now["owner"])
    date = F.coalesce(F.nullif(F.substring(F.trim(F.when(has("effective_date"), at("effective_date")).otherwise(now["effective_date"])), 1, 10), F.lit("")), today.cast("string"))
    absolute = F.when(has("absolute_tolerance"), _amount(at("absolute_tolerance"))).otherwise(now["absolute_tolerance"])
    stated = F.coalesce(F.trim(at("percentage_tolerance")), F.lit("")) != ""
    percentage = F.when(has("percentage_tolerance"), F.when(stated, _amount(at("percentage_tolerance")))).otherwise(now["percentage_tolerance"])
    scope = F.when(has("scope"), F.coalesce(at("scope"), F.lit(""))).otherwise(now["scope"])
    text = at("invoice_currency_scope")
    listed = F.coalesce(_list(text), F.filter(F.split(text, r"[\s,;]+"), lambda c: c != ""))
    currencies = F.when(has("invoice_currency_scope"), F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda c: F.upper(F.trim(F.coalesce(c, F.lit("")))))).otherwise(now["currencies"])
    outside = lambda c, most: F.coalesce((c < 0) | (c > most), F.lit(True))
    errors = F.when(own.isNull(), F.array(F.lit("tolerance_policy:invalid"))).otherwise(
        F.array_compact(
            F.array(
                F.when(wrong_owner, "owner:invalid"), F.when(document_date(date).isNull(), "effective_date:invalid_date"), F.when(outside(absolute, MOST_ABSOLUTE), "absolute_tolerance:invalid_number"),
                F.when(percentage.isNotNull() & outside(percentage, MOST_PERCENTAGE) | has("percentage_tolerance") & stated & percentage.isNull(), "percentage_tolerance:invalid_number"), F.when(~scope.isin(*SCOPES), "scope:invalid"),
                F.when(F.size(currencies) == 0, "currencies:required").when(F.exists(currencies, lambda c: ~c.rlike("^[A-Z]{3}$")), "currencies:invalid_currency"),
            )
        )
    )
    values = {"owner": owner, "effective_date": date, "absolute_tolerance": absolute, "percentage_tolerance": percentage, "scope": scope, "currencies": F.array_distinct(currencies)}
    out = rows.withColumn("errors", errors)
    changed = F.lit(False)
    for name, v in values.items():
        changed |= ~v.eqNullSafe(now[name])
    fresh = F.struct((now["version"] + changed.cast("int")).alias("version"), *[v.alias(name) for name, v in values.items()])
    return out.withColumn("policy", F.when(F.size("errors") == 0, fresh).otherwise(now))

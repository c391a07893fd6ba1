"""Item masters and alias files as validated rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import plain_text, unit
from tallyforge.operators.export import occurrences, validate_master

FIELDS = ("rms_item_id", "description", "supplier_id", "supplier_name", "uom", "unit_cost", "upc", "parent_item", "cost_currency", "master_po_number")
# Spellings of an item master's headings.
HEADINGS = {
    "rms_item_id": "rmsitemid rmsitem item itemid itemnumber", "description": "description itemdescription itemdesc", "supplier_id": "supplierid supplier vendorid", "supplier_name": "suppliername vendorname",
    "uom": "uom unitofmeasure standarduom", "unit_cost": "unitcost cost", "upc": "upc barcode ean", "parent_item": "parentitem itemparent", "cost_currency": "costcurrency currency currencycode", "master_po_number": "ponumber orderno rmsorderno",
}
NAMED = {s: name for name, spellings in HEADINGS.items() for s in spellings.split()}


def renamed(df: DataFrame) -> DataFrame:
    """df with its headings by their usual names, fields that it lacks as nulls; the first of two headings of a field counts, others go."""
    first: dict[str, str] = {}
    for c in df.columns:
        first.setdefault(NAMED.get(re.sub(r"[^a-z]", "", c.lower()), ""), c)
    return df.select(*[(F.col(f"`{first[f]}`").cast("string") if f in first else F.lit(None).cast("string")).alias(f) for f in FIELDS])


def read_master(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Rows of a CSV master, with cost, faults, and a key from supplier, item, code, unit and occurrence."""
    rows = renamed(spark.read.csv(path, header=True, sep=separator))
    return keyed(validate_master(rows))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with item_key: rows alike in supplier, item, code and unit are told apart by their number, in an order of all they hold."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    identity = [F.lower(blank("supplier_id")), blank("rms_item_id"), blank("upc"), F.lower(blank("uom"))]
    numbered = occurrences(rows, identity, list(FIELDS))
    return numbered.withColumn("item_key", F.substring(F.sha2(F.concat_ws("|", *identity, F.col("occurrence").cast("string")), 256), 1, 32))


def read_aliases(spark: SparkSession, path: str, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases of a JSON file that name one item of their supplier, and those that don't, with how many they name.

    The file has {"aliases": [{supplier_id, description, rms_item_id, uom}]};
    items(supplier_id, rms_item_id, item_key).
    """
    entry = "struct<supplier_id: string, description: string, rms_item_id: string, uom: string>"
    rows = spark.read.schema(f"aliases array<{entry}>").json(path, multiLine=True).select(F.explode("aliases").alias("a")).select("a.*")
    own = rows.select(F.lower(F.trim("supplier_id")).alias("scope"), plain_text(F.col("description")).alias("norm"), unit(F.col("uom")).alias("uom"), "rms_item_id")
    targets = items.select(F.lower(F.trim("supplier_id")).alias("scope"), "rms_item_id", "item_key").groupBy("scope", "rms_item_id").agg(F.count("*").alias("targets"), F.min("item_key").alias("item_key"))
    found = own.join(targets, ["scope", "rms_item_id"], "left").withColumn("targets", F.coalesce("targets", F.lit(0)))
    return found.where("targets = 1").drop("targets"), found.where("targets <> 1").drop("item_key")

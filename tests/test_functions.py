from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates, money, text, unicode


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("given", "want"),
    [("2026-09-25", "2026-09-25"), ("25 September 2026", "2026-09-25"), ("25-Sep-2026", "2026-09-25"), ("13/02/2026", "2026-02-13"), ("02/13/26", "2026-02-13"), ("03/04/2026", None), ("5.5.2026", "2026-05-05"), ("2026-02-30", None), ("x", None), (None, None)],
)
def test_dates(spark, given, want):
    got = one(spark, dates.parse_date(F.lit(given).cast("string")))
    assert (str(got) if got else None) == want


def test_money(spark):
    assert one(spark, money.money_round(F.lit("2.345").cast("decimal(9,3)"), F.lit(2))) == Decimal("2.35")
    assert one(spark, money.money_round(F.lit("2.5").cast("decimal(9,3)"), F.lit(0))) == Decimal("3")
    assert one(spark, money.minor_units(F.lit("KWD"))) == 3 and one(spark, money.minor_units(F.lit("XXX"))) == 2 and one(spark, money.minor_units(F.lit(None).cast("string"))) == 2
    assert one(spark, money.divide_money(F.lit("10.00").cast("decimal(18,2)"), F.lit("3").cast("decimal(10,3)"))) == Decimal("3.33333333")
    assert one(spark, money.divide_money(F.lit("10.00").cast("decimal(18,2)"), F.lit("0").cast("decimal(10,3)"))) is None
    assert one(spark, money.to_decimal(F.lit("1,234.5"))) == Decimal("1234.5") and one(spark, money.to_decimal(F.lit("n/a"))) is None
    ten = F.lit(10)
    assert not one(spark, money.exceeds(F.lit(10), F.lit(1), ten)) and one(spark, money.exceeds(F.lit(11), F.lit(1), ten))
    assert one(spark, money.exceeds(F.lit(5), F.lit(20), ten, F.lit(20)))


def test_text(spark):
    assert one(spark, text.match_text(F.lit("Hydrating Cleanser 50ml & Clr"))) == "hydrating cleanser 50 ml and color"
    cases = ["12PCS pk Clr&Moisturiser 5Litres", "", "ea", "eaea 3kilograms-x 2grams", " PKG  of12btls "]
    for c in cases:
        assert one(spark, text.match_text(F.lit(c))) == unicode.fold(c)
    assert unicode.fold("Crème 50ML × 2") == "creme 50 ml x 2"
    assert one(spark, text.unit(F.lit("pcs."))) == "EACH" and one(spark, text.unit(F.lit("12"))) is None
    assert one(spark, text.name_key(F.lit("Desert Beauty Trading L.L.C"))) == "DESERTBEAUTY"
    assert one(spark, text.coded_prefix(F.lit("abc001 x"))) == "ABC" and one(spark, text.coded_prefix(F.lit("ab1"))) is None
    assert one(spark, text.upc(F.lit("ULT_000123"))) == "000123"
    assert one(spark, text.order_number(F.lit("po  box 7"))) is None and one(spark, text.order_number(F.lit("PO-1"))) == "PO-1"
    assert one(spark, text.gtin_valid(F.lit("4006381333931"))) and not one(spark, text.gtin_valid(F.lit("4006381333932")))
    assert one(spark, text.sheet_safe(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, text.sizes(text.match_text(F.lit("Serum 50ml 1l")))) == ["volume_ml:1000000", "volume_ml:50000"]


@pytest.mark.parametrize(
    ("given", "sizes", "packs", "shades"),
    [
        ("serum 3 50ml", ["volume_ml:50000"], [], []),
        ("Oil 1.5 l", ["volume_ml:5000000"], [], []),
        ("Cream 12 fl oz 2 oz 7cl", ["fluid_oz:12000", "volume_ml:70000", "weight_oz:2000"], [], []),
        ("Tea pack of 20 2kg box 3", ["weight_g:2000000"], [3, 20], []),
        ("6PK soda 4 x 330ml case of", ["volume_ml:330000"], [4, 6], []),
        ("Lipstick shade no 12 colour red", [], [], ["color:red", "shade:12"]),
        ("shade no", [], [], ["shade:no"]),
        ("color shade 5", [], [], ["shade:5"]),
        ("no size of 50 mlx", [], [], []),
        (None, None, None, None),
    ],
)
def test_attributes(spark, given, sizes, packs, shades):
    norm = text.match_text(F.lit(given).cast("string"))
    assert (one(spark, text.sizes(norm)), one(spark, text.packs(norm)), one(spark, text.shades(norm))) == (sizes, packs, shades)


@pytest.mark.parametrize(
    ("given", "want"),
    [("Desert Beauty Trading L.L.C", "DESERTBEAUTY"), ("Gulf Star FZ-LLC", "GULFSTAR"), ("FZ Brands", "FZBRANDS"), ("Coral S.A.", "CORAL"), ("Étoile 7 GmbH & Co.", "TOILE"), (None, ""), ("Company Ltd", "")],
)
def test_name_keys(spark, given, want):
    assert one(spark, text.name_key(F.lit(given).cast("string"))) == want


def test_repaired_quantities(spark):
    from tallyforge.operators.derive import repaired_quantity

    fixed = lambda printed, rate, total: one(spark, repaired_quantity(F.lit(printed).cast("string"), F.lit(rate).cast("decimal(18,4)"), F.lit(total).cast("decimal(18,4)")))
    assert [fixed("l0", "2.00", "20.00"), fixed("37", "5", "100"), fixed("21", "5", "100"), fixed("20", "5", "100"), fixed("20", "0", "0"), fixed(None, "5", "100"), fixed("2O", "3", "100")] == [10, None, 20, None, None, None, None]


def test_similarity():
    assert unicode.similarity("a b", "a b") == 100.0 and unicode.similarity("", "a") == 0.0
    assert unicode.similarity("red widget 50 ml", "widget red 50 ml") > 60

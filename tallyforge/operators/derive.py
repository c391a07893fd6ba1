"""What a document doesn't print but its figures prove: net prices, totals, misread quantities, the seller's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.sources.documents import NAMED

# Legal forms that a seller's name has, words of other companies, words of a buyer's line.
FORMS = ("LLC", "LTD", "LIMITED", "INC", "CORP", "CORPORATION", "PLC", "FZE", "FZC", "WLL", "GMBH", "SA")
COMPANIES = ("COMPANY", "CO")
BUYERS = ("CLIENT", "CUSTOMER", "BUYER", "BILL", "DELIVER", "SHIP")
# What stands over a buyer's address, and titles of an invoice.
BILLED = ("BILL TO", "INVOICE TO", "SOLD TO")
TITLES = ("INVOICE", "TAX INVOICE", "COMMERCIAL INVOICE", "SALES INVOICE", "CREDIT INVOICE")
# Letters that recognition takes digits for.
MISREAD = {"O": "0", "o": "0", "I": "1", "i": "1", "l": "1", "T": "1"}
# What makes a recognised page worth more than another.
EVIDENCE = ("invoice", "invoice no", "description", "qty", "quantity", "unit price", "gross", "net", "subtotal", "total", "currency")


def net_price(unit_price: Column, net: Column, gross: Column, basis: Column, total_basis: Column) -> Column:
    """(price, derived): the net price, or a plain printed rate where nothing says that it is gross."""
    plain = net.isNull() & unit_price.isNotNull() & gross.isNull() & ~F.coalesce(basis.isin("gross", "pre_discount"), F.lit(False)) & ~F.coalesce(total_basis == "gross", F.lit(False))
    return F.struct(F.when(plain, unit_price).otherwise(net).alias("price"), plain.alias("derived"))


def repaired_quantity(printed: Column, rate: Column, total: Column) -> Column:
    """A misread quantity, if total over rate is a whole number that the print is one misreading away from; null if it is right already or can't be proved."""
    price, amount = rate.cast("decimal(18,4)"), total.cast("decimal(18,4)")
    exact = F.try_divide(amount, price)
    proved = F.when((price > 0) & (amount >= 0) & (F.abs(exact - F.round(exact, 0)) <= 0.000001), F.nullif(F.round(exact, 0).cast("long"), F.lit(0).cast("long")))
    signs = F.regexp_replace(F.coalesce(printed, F.lit("")), "[^A-Za-z0-9]", "")
    as_digits = F.translate(signs, "".join(MISREAD), "".join(MISREAD.values()))
    only_digits = F.nullif(F.regexp_replace(signs, "[^0-9]", ""), F.lit(""))
    misread = (as_digits == proved.cast("string")) | F.coalesce(F.levenshtein(only_digits, proved.cast("string")) <= 1, F.lit(False))
    right = F.coalesce(printed.try_cast("decimal(18,4)") * price == amount, F.lit(False))
    return F.when(misread & ~right, proved)


def derived_totals(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """tax_total and subtotal with where each is from: printed, lines (all lines state their tax), zero (none does, nothing else either, and they add up to the total), difference, or none.

    invoices(id, subtotal, tax_total, total), lines(invoice_id, line_total, tax_amount).
    """
    own = lines.groupBy("invoice_id").agg(F.sum("tax_amount").alias("taxes"), F.bool_and(F.col("tax_amount").isNotNull()).alias("taxed"), F.bool_and(F.col("tax_amount").isNull()).alias("untaxed"), F.sum("line_total").alias("lines_total"))
    j = invoices.join(own, F.col("id") == F.col("invoice_id"), "left")
    printed, total = F.col("tax_total"), F.col("total")
    zero = F.col("untaxed") & F.col("subtotal").isNull() & (F.round("lines_total", 2) == F.round(total, 2))
    source = F.when(printed.isNotNull(), "printed").when(total.isNotNull() & F.col("taxed"), "lines").when(F.coalesce(zero, F.lit(False)), "zero").otherwise("none")
    tax = F.when(source == "printed", printed).when(source == "lines", F.round("taxes", 2)).when(source == "zero", 0).cast("decimal(18,2)")
    out = j.select("id", "total", "subtotal", tax.alias("tax_total"), source.alias("tax_from"))
    difference = (F.col("total") - F.col("tax_total")).cast("decimal(18,2)")
    known = F.when(F.col("subtotal").isNotNull(), "printed").when(difference.isNotNull(), "difference").otherwise("none")
    return out.select("id", F.coalesce("subtotal", difference).cast("decimal(18,2)").alias("subtotal"), known.alias("subtotal_from"), "tax_total", "tax_from")


def seller(text: Column) -> Column:
    """Seller's name in the first 60 lines of a page.

    The nearest line with a legal form up to four lines over a buyer's address
    ("bill to"), else the nearest of a company up to three lines over the
    invoice's title, unless it names a buyer.  Null if there is none.
    """
    ascii_ = lambda x: F.btrim(F.regexp_replace(x, r"[^\x21-\x7E]+", " "), F.lit(" |:-"))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 60), lambda x: F.struct(ascii_(x).alias("line"), T.upper_words(x).alias("words")))
    says = lambda x: F.concat(F.lit(" "), F.array_join(x["words"], " "), F.lit(" "))
    has = lambda x, words: F.arrays_overlap(x["words"], F.array(*map(F.lit, words)))
    size = lambda x, least: F.length(x["line"]).between(least, 160)

    def nearest(page, marked, reach, ok):
        # the mark's place from 1; 0 if no line is marked
        above = lambda at: F.filter(page, lambda x, i: (i + 1 < at) & (i + 1 >= at - reach) & ok(x))
        return F.try_element_at(T.let(F.array_position(F.transform(page, marked), True), above), F.lit(-1))["line"]

    def found(page):
        address = nearest(page, lambda x: sum((says(x).contains(f" {p} ").cast("int") for p in BILLED), F.lit(0)) > 0, 4, lambda x: has(x, FORMS) & size(x, 1))
        title = nearest(page, lambda x: F.array_join(x["words"], " ").isin(*TITLES), 3, lambda x: has(x, FORMS + COMPANIES) & ~has(x, BUYERS) & size(x, 3))
        return F.coalesce(address, title)

    return T.let(lines, found)


def heading_strength(text: Column) -> Column:
    """Two for each named column of the page's best table heading, five more if it has a unit price; 0 without a heading.

    A heading's cells stand two blanks apart; it names a description and two
    other columns.
    """
    cells = lambda x: F.transform(F.split(F.trim(x), r"\s{2,}|\t"), lambda c: T.lookup(NAMED, F.regexp_replace(F.lower(c), "[^a-z]", "")))
    fields = F.transform(F.split(text, "\n"), lambda x: F.array_distinct(F.array_compact(cells(x))))
    headings = F.filter(fields, lambda f: F.array_contains(f, "description") & (F.size(f) >= 3))
    worth = F.transform(headings, lambda f: F.size(f) * 2 + F.when(F.array_contains(f, "unit_price"), 5).otherwise(0))
    return F.coalesce(F.array_max(worth), F.lit(0))


def page_worth(text: Column, confidence: Column) -> Column:
    """Worth of a recognised page: its confidence, three for each term that invoices have, a quarter for each of up to twenty rows of three numbers, and the strength of its table's heading."""
    said = F.array_join(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), " ")
    terms = T.let(said, lambda words: F.size(F.filter(F.array(*map(F.lit, EVIDENCE)), lambda t: words.contains(t))))
    figures = F.size(F.filter(F.split(text, "\n"), lambda x: F.regexp_count(x, F.lit(r"[0-9][0-9,.]*")) >= 3))
    return F.coalesce(confidence, F.lit(0.0)) + terms * 3.0 + F.least(figures, F.lit(20)) * 0.25 + heading_strength(text)

"""The match ladder, matching again and the policy on small cases, odd ones included."""

import pytest
from pyspark.sql import functions as F
from test_matching import ITEM, LINE

from tallyforge.functions.unicode import similarity
from tallyforge.operators import ladder as L
from tallyforge.operators import matching as M
from tallyforge.operators import policy as Y
from tallyforge.operators import shown as H


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ladder_precedence(spark):
    lines = spark.createDataFrame([(x,) for x in "abcdefg"], "line_id string")
    keyed = spark.createDataFrame([("a", "K", "confirmed", 100.0), ("b", None, "cleared", None)], "line_id string, item_key string, state string, confidence double")
    coded = spark.createDataFrame([("a", "C", False), ("b", "C", False), ("c", None, True), ("d", "C", False), ("e", None, False)], "line_id string, item_key string, blocks boolean")
    aliased = spark.createDataFrame([("b", "C"), ("c", "A"), ("d", "A"), ("e", "A")], "line_id string, item_key string")
    decided = spark.createDataFrame([(x, "auto", "D", None, 97.0, "fuzzy") for x in "abcdef"], "line_id string, state string, item_key string, suggestion string, confidence double, path string")
    got = {r.line_id: tuple(r)[1:] for r in L.ladder(lines, keyed, coded, aliased, decided).collect()}
    assert got == {
        "a": ("confirmed", "key", "K", None, 100.0), "b": ("auto", "code", "C", None, 100.0),
        # a code that doesn't match, and one that differs from the alias, select nothing below
        "c": ("suggested", None, None, "D", 97.0), "d": ("suggested", None, None, "D", 97.0),
        "e": ("auto", "alias", "A", None, 100.0), "f": ("auto", "fuzzy", "D", None, 97.0), "g": ("unmatched", None, None, None, 0.0),
    }


def test_scopes(spark):
    invoices = spark.createDataFrame([(1, "S"), (2, None), (3, " ")], "id int, supplier_id string")
    state = lambda items: {r.id: (r.scope, r.supplier_resolution) for r in L.scopes(invoices, spark.createDataFrame(items, "supplier_id string")).collect()}
    assert state([("S",), (None,)]) == {1: ("S", "resolved"), 2: ("*", "unresolved"), 3: ("*", "unresolved")}
    for items in ([], [(None,)]):
        assert state(items) == {1: ("S", "resolved"), 2: (None, "not_required"), 3: (None, "not_required")}


def test_fallback_selects_nothing(spark):
    items = [("k1", "R1", "S", "red tea", [], [], [], None), ("k2", "R2", "T", "blue mist", [], [], [], None), ("k3", "R3", "T", "red tea box", [], [], [], None)]
    lines = [("a", None, "red tea", [], [], [], None), ("b", None, "zzz", [], [], [], None), ("c", None, None, [], [], [], None)]
    its, ls = spark.createDataFrame(items, ITEM), spark.createDataFrame(lines, LINE)
    got = {r.line_id: (r.state, r.item_key, r.suggestion) for r in L.fallback_decisions(ls, its).collect()}
    best = max(similarity("zzz", x[3]) for x in items)
    assert best < M.SUGGEST and got == {"a": ("suggested", None, "k1"), "b": ("unmatched", None, None), "c": ("unmatched", None, None)}
    assert {r.line_id: (r.state, r.suggestion, r.candidates) for r in L.fallback_exact(ls, its).collect()} == {"a": ("suggested", "k1", 1), "b": ("unmatched", None, 0), "c": ("unmatched", None, 0)}


def test_suggestions_put_named_items_first(spark):
    ranked = spark.createDataFrame([("a", "k1", "R1", 90.0, 90.0, False, False), ("a", "k2", "R2", 45.0, 45.0, False, True), ("b", "k1", "R1", 80.0, 80.0, False, False)], "line_id string, item_key string, rms_item_id string, raw double, score double, exact boolean, conflict boolean")
    coded = spark.createDataFrame([("a", "k3"), ("b", None)], "line_id string, item_key string")
    aliased = spark.createDataFrame([("a", "k2"), ("b", "k1")], "line_id string, item_key string")
    items = spark.createDataFrame([(f"k{i}", f"R{i}") for i in range(1, 4)], "item_key string, rms_item_id string")
    got = sorted((r.line_id, r["rank"], r.item_key, r.score, r.reason) for r in L.suggest(ranked, coded, aliased, items, 2).collect())
    # the alias of a conflicting item doesn't lift it
    assert got == [("a", 1, "k3", 100.0, "code"), ("a", 2, "k1", 90.0, "strong"), ("b", 1, "k1", 100.0, "alias")]


def test_rematch_outcomes(spark):
    invoices = spark.createDataFrame([(1, "ready", 2), (2, "processing", 1), (3, "ready", 5), (4, "failed", 1)], "id int, status string, version int")
    asked = spark.createDataFrame([(1, 2, "user"), (2, 1, "user"), (3, 4, "user"), (4, 1, None), (9, 1, "system")], "id int, expected_version int, actor string")
    stored = spark.createDataFrame([(1, "auto"), (1, "confirmed"), (1, None)], "invoice_id int, match_status string")
    human = spark.createDataFrame([], "invoice_id int")
    got = {r.id: tuple(r)[1:] for r in L.rematch_outcome(invoices, asked, stored, human).collect()}
    assert got == {
        1: ("rematched", "needs_review", 3, '{"auto_lines_preserved":1,"line_count":3,"unrecorded_confirmations_demoted":1}'), 2: ("busy", "processing", 1, None),
        3: ("conflict", "ready", 5, None), 4: ("bad_actor", "failed", 1, None), 9: ("missing", None, None, None),
    }
    again = L.rematch_outcome(invoices, asked, stored, spark.createDataFrame([(1,), (1,)], "invoice_id int")).where("id = 1").collect()
    assert [r.details for r in again] == ['{"auto_lines_preserved":1,"line_count":3,"unrecorded_confirmations_demoted":0}']


@pytest.mark.parametrize(("text", "want"), [("2024-W01-1", "2024-01-01"), ("2020-W53-7", "2021-01-03"), ("2021-W53-1", None), ("2024W05", "2024-01-29"), ("2024-02-30", None), ("20240229", "2024-02-29"), (" 2024-01-01", None), ("", None), (None, None)])
def test_document_date(spark, text, want):
    got = one(spark, H.document_date(F.lit(text).cast("string")))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("value", "want"), [("100", "100"), ("100.00", "100"), ("0.500", "0.5"), ("-3.0", "-3"), ("0.0", "0"), ("n/a", None), (None, None)])
def test_shown_number(spark, value, want):
    assert one(spark, H.shown_number(F.lit(value).cast("string"))) == want


def test_json(spark):
    assert one(spark, H.json_or(F.lit('{"b":[1, 2],"a":null}'), "[]")) == '{"a":null,"b":[1,2]}'
    assert [one(spark, H.json_or(F.lit(t).cast("string"), "[]")) for t in (None, "", " ", "{")] == ["[]"] * 4
    sizes = F.array(F.lit("volume_ml:50000"), F.lit("weight_g:1500"), F.lit("fluid_oz:250"), F.lit("other"))
    assert one(spark, H.attribute_text(sizes)) == "50ml, 1.5g, 0.25 fluid_oz, other"


def test_children(spark):
    rows = lambda *x: spark.createDataFrame(x, "p int, v string")
    got = H.replace_children(rows((1, "a"), (1, "b"), (2, "c"), (3, "d")), rows((1, "x"), (3, "y")), rows((1, ""), (2, ""), (1, "")), "p").collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (3, "d")]


def test_stall(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    state = lambda rows, at: tuple(H.queue_state(spark.createDataFrame(rows, "status string"), spark.createDataFrame(at, "at string").select(F.col("at").cast("timestamp")), now).first())
    assert state([("queued",)], [("2024-01-01 00:57:00",)]) == (1, 0, 180.0, True)
    assert state([("queued",)], [("2024-01-01 00:58:00",)]) == (1, 0, 120.0, False)
    assert state([("queued",), ("processing",)], [("2024-01-01 00:00:00",)]) == (1, 1, 3600.0, False)
    assert state([("queued",)], []) == (1, 0, None, False) and state([], []) == (0, 0, None, False)


def test_policy_that_repeats_itself_keeps_its_version(spark):
    own = spark.createDataFrame([('{"version":4,"owner":"ops","effective_date":"2024-01-31","invoice_currency_scope":["AED"]}', x) for x in ('{"owner":"ops","version":9}', '{"invoice_currency_scope":"aed AED"}', '{"absolute_tolerance":100001}', None)], "stored string, raw string")
    out = Y.submitted(own.withColumn("current", Y.stored_policy(F.col("stored"), F.lit(None).cast("string"))), "raw", "current", F.lit("2025-01-01").cast("date"))
    got = {r.raw: (r.policy.version, r.errors) for r in out.collect()}
    assert got == {'{"owner":"ops","version":9}': (4, []), '{"invoice_currency_scope":"aed AED"}': (4, []), '{"absolute_tolerance":100001}': (4, ["absolute_tolerance:invalid_number"]), None: (4, ["tolerance_policy:invalid"])}

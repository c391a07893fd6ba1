from tallyforge.operators import matching as M
from tallyforge.operators import pricing as P

ITEM = "item_key string, rms_item_id string, supplier_id string, norm string, sizes array<string>, packs array<long>, shades array<string>, uom string"
LINE = "line_id string, supplier_id string, norm string, sizes array<string>, packs array<long>, shades array<string>, uom string"


def decisions(spark, lines, items):
    ls, its = spark.createDataFrame(lines, LINE), spark.createDataFrame(items, ITEM)
    return {r.line_id: r for r in M.decide(M.ranked(ls, its), ls).collect()}


def test_decisions(spark):
    items = [
        ("k1", "R1", "S", "hydrating cleanser 50 ml", ["volume_ml:50000"], [], [], "EACH"),
        ("k2", "R2", "S", "tissue box", [], [], [], "EACH"),
        ("k3", "R3", "S", "tissue box", [], [], [], "EACH"),
        ("k4", "R4", "T", "hydrating cleanser 100 ml", ["volume_ml:100000"], [], [], "EACH"),
    ]
    lines = [
        ("exact", "S", "hydrating cleanser 50 ml", ["volume_ml:50000"], [], [], "EACH"),
        ("twice", "S", "tissue box", [], [], [], "EACH"),
        ("other supplier", "T", "hydrating cleanser 50 ml", ["volume_ml:50000"], [], [], "EACH"),
        ("one-sided", "S", "hydrating cleanser", [], [], [], "EACH"),
        ("none", "S", "zzz", [], [], [], None),
    ]
    got = decisions(spark, lines, items)
    assert (got["exact"].state, got["exact"].item_key, got["exact"].confidence) == ("auto", "k1", 100.0)
    assert got["twice"].state == "suggested"
    assert got["other supplier"].state == "unmatched" and got["other supplier"].confidence <= 45
    assert got["one-sided"].state == "suggested" and got["one-sided"].suggestion == "k1"; assert got["one-sided"].confidence <= 92
    assert (got["none"].state, got["none"].item_key) == ("unmatched", None)


def test_codes_keep_zeros(spark):
    items = spark.createDataFrame([("k", "S", "000123", "EACH", [])], "item_key string, supplier_id string, upc string, uom string, packs array<long>")
    lines = spark.createDataFrame([("a", "S", "000123", "EACH", []), ("b", "S", "123", "EACH", []), ("c", None, "000123", "EACH", []), ("d", "S", None, "EACH", []), ("e", "S", "000123", None, [])], "line_id string, supplier_id string, upc string, uom string, packs array<long>")
    got = {r.line_id: r.state for r in M.code_match(lines, items).collect()}
    assert got == {"a": "matched", "b": "not_found", "c": "missing_supplier", "d": "absent", "e": "incompatible_evidence"}


def test_duplicates(spark):
    rows = [(1, 7, "A1", "2020-01-01", "10.00"), (2, 7, "a1 ", "2020-01-01", "10.00"), (3, 7, "A1", "2020-01-02", "10.00"), (4, 8, "A1", "2020-01-01", "10.00"), (5, 7, None, None, None)]
    df = spark.createDataFrame(rows, "id long, supplier_id long, number string, d string, t string").selectExpr("id", "supplier_id", "number", "to_date(d) invoice_date", "cast(t as decimal(18,2)) total", "'ready' status", "2 digits")
    got = {r.id: (r.others, r.level, r.first_other) for r in P.duplicates(df).collect()}
    assert got == {1: (2, "strong", 2), 2: (2, "strong", 1), 3: (2, "weak", 1)}


def test_unit_states(spark):
    from tallyforge.operators.units import unit_state

    empty = ([], [], [])
    rows = [
        ("confirmed", *empty, "EACH", *empty, "EACH"), ("unconfirmed", *empty, "EACH", *empty, "BOX"), ("unconfirmed", *empty, None, *empty, "BOX"), ("assumed", *empty, None, *empty, "EACH"),
        ("assumed", *empty, "BOX", *empty, None), ("unconfirmed", *empty, None, *empty, "ML"), ("unverified", [], [], [], "EACH", ["volume_ml:1"], [], [], "EACH"), ("unconfirmed", ["volume_ml:2"], [], [], "EACH", ["volume_ml:1"], [], [], "EACH"),
        ("unconfirmed", *empty, None, [], [6], [], "EACH"),
    ]
    kinds = "want string, " + ", ".join(f"{s}_sizes array<string>, {s}_packs array<long>, {s}_shades array<string>, {s}_uom string" for s in "ab")
    from pyspark.sql import functions as F

    a, b = ({c: F.col(f"{s}_{c}") for c in ("sizes", "packs", "shades", "uom")} for s in "ab")
    got = spark.createDataFrame(rows, kinds).select("want", unit_state(a, b).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_registered_matching_equals_brute_force(spark, monkeypatch):
    from tallyforge.functions.unicode import similarity
    from tallyforge.plans import matching as plans

    # the nearest text shares no word with the line; more than eight others share one
    texts = ["hydratin cleansers gentl", *[f"hydrating {w} {w}s" for w in "soap balm mask foam milk tonic serum cream lotion powder scrub wipe".split()], *[f"cleanser {i} gentle extra" for i in range(12)]]
    items = [(f"k{i:02}", i, 1, t, None) for i, t in enumerate(texts)] + [("other", 99, 2, "hydrating cleanser gentle", None)]
    lines = [("a", 1, "hydrating cleanser gentle", None), ("b", 1, "hydrating soap", None), ("c", 1, "zzz", None)]
    monkeypatch.setattr(plans, "items", lambda s, d: s.createDataFrame(items, "item_key string, rms_item_id long, supplier_id long, norm string, uom string"))
    monkeypatch.setattr(plans, "lines", lambda s, d: s.createDataFrame(lines, "line_id string, supplier_id long, norm string, uom string"))
    best = {line: sorted((-similarity(text, t), i) for i, t in enumerate(texts))[:5] for line, _, text, _ in lines}
    got = {}
    for r in plans.fuzzy_topk(spark, "").orderBy("line_id", "rank").collect():
        got.setdefault(r.line_id, []).append((-r.raw, int(r.item_key[1:])))
    assert got == best and got["a"][0][1] == 0
    made = {r.line_id: r for r in plans.match_decisions(spark, "").collect()}
    assert all(made[x].confidence == -b[0][0] and made[x].margin == round(b[1][0] - b[0][0], 1) for x, b in best.items()), made
    assert made["a"].suggestion == "k00"


def test_large_scopes_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 3)
    monkeypatch.setattr(M, "TEXTS", 1)
    items = [(f"k{i}", f"R{i}", "S", f"tea {i}", [], [], [], None) for i in range(4)] + [(f"t{i}", f"R{i}", "T", f"tea {i}", [], [], [], None) for i in range(3)]
    lines = [("a", "S", "tea 1", [], [], [], None), ("b", "T", "tea 1", [], [], [], None), ("c", "T", "zzz", [], [], [], None), ("d", "S", None, [], [], [], None)]
    found = M.bundles(spark.createDataFrame(lines, LINE), spark.createDataFrame(items, ITEM), 1).collect()
    got = sorted((r.supplier_id, t.norm, i.item_key) for r in found for t in r["texts"] for i in r["items"])
    # a supplier of three items is compared whole, one of four by the heaviest shared words and equal texts
    assert got == [("S", "tea 1", "k1"), *[("T", t, f"t{i}") for t in ("tea 1", "zzz") for i in range(3)]]


def test_ranks_equal_all_pairs(spark, monkeypatch):
    """Ranks, the best other score and decisions beside a plain comparison of every line with every item of its supplier."""
    import random

    from tallyforge.functions.unicode import similarity

    r = random.Random(3)
    some = lambda p, *x: [r.choice(x)] if r.random() < p else []
    words = "red blue serum mist cream box soft ml 50 100 night day".split()
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 5)))
    items = [(f"k{i:03}", f"R{i % 40:02}", r.choice("STU"), text(), some(0.5, "a", "b"), some(0.3, 1, 2), some(0.1, "x"), r.choice(("EACH", "PACK", None))) for i in range(150)]
    lines = [(f"l{i}", r.choice(["S", "T", "U", "V", None]), r.choice([text(), items[i][3]]) if i % 30 else None, some(0.5, "a", "b"), some(0.3, 1, 2), some(0.1, "x"), r.choice(("EACH", "PACK", None))) for i in range(90)]
    ls, its = spark.createDataFrame(lines, LINE), spark.createDataFrame(items, ITEM)
    want = {}
    for line in lines:
        scope = [x for x in items if x[2] == line[1]]
        silent = len({x[7] or "" for x in scope}) == 1
        rows = []
        for x in scope if line[2] is not None else []:
            pairs = list(zip(line[3:6], x[4:7]))
            conflict = any(a and b and a != b for a, b in pairs) or bool(line[6] and x[7] and line[6] != x[7])
            unknown = any(bool(a) != bool(b) for a, b in pairs) or (line[6] is None) != (x[7] is None) and not silent
            exact = line[2] == x[3]
            raw = min(100.0 if exact else similarity(line[2], x[3]), 45.0 if conflict else 100.0)
            rows.append((-raw, -min(raw, 92.0) if unknown and not conflict and not exact else -raw, x[1], x[0]))
        want[line[0]] = sorted(rows)
    for small in (2_000, 0):
        monkeypatch.setattr(M, "SMALL", small)
        got = {}
        for x in M.ranked(ls, its).collect():
            got.setdefault(x.line_id, []).append(x)
        if small:
            assert {k for k, v in want.items() if v} == set(got)
            for k, v in got.items():
                v.sort(key=lambda x: x.rank)
                assert [(-x.raw, -x.score, x.rms_item_id, x.item_key) for x in v[:5]] == want[k][:5]
                assert v[0].others == max((-x[1] for x in want[k][1:]), default=0.0)
        else:  # by shared rare words: a part of all pairs, ranked alike
            assert got and all(set((x.item_key) for x in v) <= {x[3] for x in want[k]} for k, v in got.items())


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    jvm = spark._jvm
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))


def test_suppliers_of_a_prefix_are_counted_by_name(spark):
    from pyspark.sql import functions as F

    directory = spark.range(500).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("supplier_id"), F.concat(F.lit("ABC00"), F.col("id").cast("string")).alias("supplier_name"))
    more = [("S1", "ABCD1"), ("S1", "ABC9"), ("S900", "QRS1"), ("S901", "Qrstu 2"), ("S902", "XYZ 1")]
    directory = directory.unionByName(spark.createDataFrame(more, directory.schema))
    names = {0: "Abcdef Stores", 1: "Qrstuv", 2: "xyzzy", 3: "Abcdef Stores", 4: "Nobody", 5: "Qrstuv", 6: "Abcdef Stores"}
    invoices = spark.createDataFrame([(i, None, names[i]) for i in names] + [(i, None, "Abcdef Stores") for i in range(7, 2000)], "id long, supplier_id string, supplier_name string")
    evidence = spark.createDataFrame([(0, "S1", 3), (0, "S2", 2), (0, "S902", 9), (3, "S1", 2), (3, "S2", 2), (4, "S1", 5), (5, "S901", 1)], "id long, supplier_id string, hits long")
    before = shuffled(spark)
    got = {r.id: (r.resolved_id, r.method) for r in M.resolve_suppliers(invoices, directory, evidence).collect()}
    assert len(got) == 2000 and got[0] == ("S1", "line_evidence") and got[1] == (None, "ambiguous") and got[2] == ("S902", "supplier_name_prefix")
    assert got[3] == (None, "ambiguous") and got[4] == (None, "unresolved") and got[5] == ("S901", "line_evidence") and got[1999] == (None, "ambiguous")
    assert shuffled(spark) - before < 50_000  # not each invoice with each supplier


def test_candidates_are_found_without_shuffling_pairs(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    monkeypatch.setattr(M, "PART", 150)  # several blocks of lines
    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(r.randint(1, 4)))
    items = [(f"{s}:{i}", s, text()) for s in (1, 2) for i in range(300)] + [("1:none", 1, None), ("3:0", None, "aa")]
    lines = [(f"l{i}", r.choice([1, 2, 3, None]), text()) for i in range(600)] + [("null", 1, None), ("empty", 1, "")]
    want = {}
    for line, s, norm in lines:
        own = {k: set(n.split(" ")) if n else set() for k, x, n in items if x == s and s is not None}
        df = Counter(t for words in own.values() for t in words)
        weigh = {t: math.log(len(own) / n) for t, n in df.items() if n <= max(50, len(own) // 5)}
        words = set(norm.split(" ")) if norm else set()
        met = {k: sum(weigh[t] for t in words & has if t in weigh) for k, has in own.items() if any(t in weigh for t in words & has)}
        best = set(sorted(met, key=lambda k: (-round(met[k], 6), k))[:20]) | {k for k, x, n in items if x == s and s is not None and n == norm and n is not None}
        if best:
            want[line] = sorted(best)
    ls, its = spark.createDataFrame(lines, "line_id string, supplier_id long, norm string"), spark.createDataFrame(items, "item_key string, supplier_id long, norm string")
    before = shuffled(spark)
    got = {x.line_id: x["items"] for x in M.candidate_lists(ls, its, 20).collect()}
    assert got == want
    assert shuffled(spark) - before < 5 * (len(lines) + len(items))
    pairs = M.candidates(ls, its, 20).collect()
    assert sorted((x.line_id, x.item_key) for x in pairs) == sorted((k, v) for k, vs in want.items() for v in vs)


def test_likeness_of_many_pairs_is_that_of_each():
    import random

    import numpy as np

    from tallyforge.functions import likeness
    from tallyforge.functions.unicode import similarity

    r = random.Random(5)
    words = "red blue serum mist cream é😀 ml 50 100 aa ab ba aaa".split()
    text = lambda: r.choice(["", "".join(r.choice("ab ") for _ in range(r.randint(1, 70))), " ".join(r.choice(words) for _ in range(r.randint(1, 9))), " ".join(r.choice(words) for _ in range(r.randint(50, 90)))])
    a, b = [text() for _ in range(60)], [text() for _ in range(60)]
    left, right = np.divmod(np.arange(3600), 60)
    want = [similarity(a[i], b[j]) for i, j in zip(left.tolist(), right.tolist(), strict=True)]
    pairs = likeness.Pairs(a, b)
    assert (pairs.likeness(left, right) / 10).tolist() == want
    assert (pairs.likeness(left, right) / 10).tolist() == want  # known by now
    assert (pairs.reach()[left, right] / 10 >= want).all()


def test_ranking_shuffles_lines_and_items_only(spark, monkeypatch):
    import random

    from tallyforge.functions.unicode import similarity

    monkeypatch.setattr(M, "PART", 150)  # several blocks of lines
    monkeypatch.setattr(M, "SMALL", 150)  # one supplier's items are met whole, the other's by shared words
    r = random.Random(4)
    text = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(r.randint(1, 4)))
    items = [(f"{s}{i:03}", f"R{i % 40:02}", s, text(), [], [], [], r.choice(("EACH", None))) for s, n in (("S", 100), ("T", 200)) for i in range(n)]
    lines = [(f"l{i}", r.choice("STU"), text(), [], [], [], r.choice(("EACH", "PACK"))) for i in range(800)]
    ls, its = spark.createDataFrame(lines, LINE), spark.createDataFrame(items, ITEM)
    before = shuffled(spark)
    got = {}
    for x in M.ranked(ls, its, 20).orderBy("line_id", "rank").collect():
        got.setdefault(x.line_id, []).append((x.raw, x.score, x.item_key))
    assert shuffled(spark) - before < 6 * (len(lines) + len(items)) + 5 * len(lines)  # the last are sorted here
    near = {}
    for x in M.candidates(ls.where("supplier_id = 'T'"), its, 20).collect():
        near.setdefault(x.line_id, set()).add(x.item_key)
    want = {}
    for line, s, norm, *_, uom in lines:
        rows = []
        for key, number, of, other, *_, unit in items:
            if of == s and (s == "S" or key in near.get(line, ())):
                likeness = 100.0 if norm == other else similarity(norm, other)
                raw = min(likeness, 45.0) if unit and unit != uom else likeness
                score = min(raw, 92.0) if unit is None and norm != other else raw
                rows.append((-raw, -score, number, key))
        if rows:
            want[line] = [(-x[0], -x[1], x[3]) for x in sorted(rows)[:5]]
    assert got == want


def test_top_items_are_of_all_at_any_size(spark, monkeypatch):
    import random

    from tallyforge.functions.unicode import similarity
    from tallyforge.plans import matching as plans

    monkeypatch.setattr(M, "SMALL", 3)
    monkeypatch.setattr(M, "WHOLE", 3, raising=False)  # several blocks of lines
    monkeypatch.setattr(M, "ITEMS", 7, raising=False)  # and of items
    r = random.Random(6)
    # the nearest text shares no word with the line; of some texts there are more copies than ranks
    texts = ["zhydratin cleansers gentl", *[f"hydrating {w} {w}s" for w in "soap balm mask foam milk tonic serum".split()], *["hydrating soap"] * 9, *["hydrating foams"] * 8, "cleanser 1 gentle extra", None]
    r.shuffle(texts)
    items = [(f"k{i:02}", i // 2, 1, t, r.choice(("EACH", "PACK", None))) for i, t in enumerate(texts)] + [("other", 99, 2, "hydrating cleanser gentle", None)]
    said = ["hydrating cleanser gentle", "hydrating soap", "zzz", "hydrating foam foams", "cleansers gentl"]
    lines = [(f"l{i}", 1, t, u) for i, (t, u) in enumerate((t, u) for t in said for u in ("EACH", None))]
    monkeypatch.setattr(plans, "items", lambda s, d: s.createDataFrame(items, "item_key string, rms_item_id long, supplier_id long, norm string, uom string"))
    monkeypatch.setattr(plans, "lines", lambda s, d: s.createDataFrame(lines, "line_id string, supplier_id long, norm string, uom string"))
    want, others, exacts = {}, {}, {}
    for line, _, norm, unit in lines:
        rows = []
        for key, number, of, text, uom in items:
            if of == 1:
                conflict, unknown, exact = bool(unit and uom and unit != uom), (unit is None) != (uom is None), norm == text
                raw = min(100.0 if exact else similarity(norm, text), 45.0 if conflict else 100.0)
                rows.append((-raw, -min(raw, 92.0) if unknown and not conflict and not exact else -raw, number, key))
                exacts[line] = exacts.get(line, 0) + (exact and not conflict)
        rows.sort()
        want[line], others[line] = [(-x[0], -x[1], x[3]) for x in rows[:5]], max(-x[1] for x in rows[1:])
    got = {}
    for x in plans.fuzzy_topk(spark, "").orderBy("line_id", "rank").collect():
        got.setdefault(x.line_id, []).append((x.raw, x.score, x.item_key))
    assert got == want
    made = M.ranked(plans._attributed(plans.lines(spark, "")), plans._attributed(plans.items(spark, "")), None).where("rank = 1").collect()
    assert {x.line_id: (x.others, x.exacts) for x in made} == {k: (others[k], exacts[k]) for k in others}

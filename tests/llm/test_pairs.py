"""Near-duplicates, passages and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import decontamination, jaccard_join, substring_dedup
from tallyforge.llm.components import components
from tallyforge.llm.common import words


def shingled(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(texts):
    sets = [shingled(t) for t, _ in texts]
    links = {i: set() for i in range(len(sets))}
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in links:
        if i not in root:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in root:
                    root[x] = i
                    stack += links[x]
    return root, links


def test_join_equals_brute_force(docs, texts):
    root, links = brute(texts)
    assert sum(map(len, links.values())) > 20
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (root[i], len(links[i])) for i in links}


def test_blocks_change_nothing(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 1)
    root, links = brute(texts)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (root[i], len(links[i])) for i in links}


def test_pivots_change_nothing(docs, texts, monkeypatch):
    """One of each class stays, with blocks so small that every bucket and group is compared with its first member."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 1)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    root, _ = brute(texts)
    assert sorted(r.doc_id for r in jaccard_join.kept(docs).collect()) == [i for i in root if root[i] == i]


def test_chains_of_near_copies(spark, monkeypatch):
    """A chain whose ends aren't alike: members far from the first one hang together through others."""
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(40):
        base[8 * i : 8 * i + 8] = [f"v{r.randrange(10**6)}" for _ in range(8)]
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(50))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root, links = brute([(t, "") for _, t in rows])
    assert len(set(root.values())) == 6 and len(links[0]) < 39
    for block in (512, 4):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_join.near_duplicates(docs).collect()}
        assert got == {i: (0 if i < 100 else i, len(links[k])) for k, (i, _) in enumerate(rows)}
        assert sorted(x.doc_id for x in jaccard_join.kept(docs).collect()) == [0, 100, 101, 102, 103, 104]


def test_many_near_copies_use_the_matrix():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[: 300 - k % 60], r.integers(0, 1 << 60, k % 50).astype(np.uint64)])) for k in range(150)]
    near = jaccard_join.plausible(np.array([jaccard_join.signature(x) for x in sets]))
    got = jaccard_join.verified(near, sets)
    for i in range(150):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (10 * len(a & b) >= 8 * len(a | b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40) if i != 20] + [(100, 7), (55, 55), (60, 61), (61, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in [*range(1, 21), 100]} | {i: 21 for i in range(21, 41)} | {60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = [(None, 1), (2, None), (None, None), (3, 3), (4, 5), (4, 5)]
    assert {r.node: r.root for r in components(spark.createDataFrame(odd, "a long, b long")).collect()} == {4: 4, 5: 4}


def test_passages(docs, texts):
    seen, again = {}, set()
    for i, (t, _) in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) != i:
                again.add(i)
    tens = {}
    for i, (t, _) in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 5):
            tens.setdefault(tuple(w[k : k + 6]), set()).add(i)
    shares = {i for s in tens.values() if len(s) > 1 for i in s}
    marked = {r.doc_id for r in substring_dedup.repeated_passages(docs).where("repeated").collect()}
    assert len(again) > 5 and again <= marked <= shares


def test_chunks_join_to_texts_and_resist_shifts(docs, texts):
    own = substring_dedup.gear()
    data = "".join(t for t, _ in texts[:20]).encode()
    a, b = (set(substring_dedup.cuts(np.frombuffer(x, np.uint8), own).tolist()) for x in (data, b"inserted" + data))
    assert len({x + 8 for x in a} ^ b) <= 4 and len(a) > 100
    cut = {}
    for r in substring_dedup.chunks(docs).collect():
        cut.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, (t, _) in enumerate(texts):
        held = sorted(cut[i])
        assert held[0][0] == 0 and all(s + n == s2 for (s, n), (s2, _) in zip(held, held[1:])) and sum(held[-1]) == len(t.encode())


def test_periodic_stretches_are_cut_from_their_start(spark):
    own = substring_dedup.gear()
    for unit in (b"word ", b"ab", b"x", "é ".encode()):
        for lead in (b"", b"something else before it, "):
            data = lead + unit * 4000
            at = substring_dedup.cuts(np.frombuffer(data, np.uint8), own)
            sizes = np.diff([0, *at, len(data)])
            assert sizes.max() <= substring_dedup.MOST + 4 and (np.diff(at) > 0).all()
            b"".join(data[a:b] for a, b in zip([0, *at], [*at, len(data)])).decode()
            [data[a:b].decode() for a, b in zip([0, *at], [*at, len(data)])]
    docs = spark.createDataFrame([(1, "first, then " + "over and " * 2000), (2, "second, then " + "over and " * 2000)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    assert got[2].n_repeated > 0.9 * got[2].n_bytes


def test_repeated_passages_of_any_text(spark):
    """Every passage of fifty words that stands in two texts is marked in the later one, whatever stands around it."""
    r = random.Random(21)
    rows = []
    for i in range(300):
        passage = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(51))
        around = lambda: " ".join("".join(r.choice("klmnopqrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(0, 30)))
        rows += [(2 * i, f"{around()} {passage} {around()}"), (2 * i + 1, f"{around()} {passage} {around()}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = {x.doc_id for x in substring_dedup.repeated_passages(docs).where("repeated").collect()}
    assert marked == {2 * i + 1 for i in range(300)}


def test_cleaning_takes_out_the_passage(spark):
    passage = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"first text {passage} end of it"), (2, f"é second {passage} last words"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert got[1].startswith("first text word0") and got[3] is None and len(got[2]) < 250 and got[2].startswith("é second") and got[2].endswith("last words")


def hits(text, items, window=10):
    w, at, found = words(text), set(), set()
    for item, t in items:
        q = words(t)
        k = min(window, len(q))
        for s in range(len(q) - k + 1) if k else []:
            for i in range(len(w) - k + 1):
                if w[i : i + k] == q[s : s + k]:
                    at |= set(range(i, i + k))
                    found |= {item} - {None}
    return len(at), len(found)


def near(texts, items, rare=3, within=30):
    """Items that each text comes near, plainly."""
    all_words = [words(t) for t in texts]
    n = Counter(x for w in all_words for x in w)
    out = [set() for _ in texts]
    for item, t in items:
        chosen = sorted((x for x in set(words(t)) if n[x]), key=lambda x: (n[x], x))[:rare]
        for i, w in enumerate(all_words):
            if len(chosen) > 1 and item is not None and any(set(chosen) <= set(w[k : k + within]) for k in range(len(w))):
                out[i].add(str(item))
    return out


def test_decontamination(docs, texts, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    got = {r.doc_id: r for r in decontamination.contamination(docs, benchmark).collect()}
    assert {i: (r.n_hit, r.n_items) for i, r in got.items()} == {i: hits(t, items) for i, (t, _) in enumerate(texts)} and got[0].n_hit >= 15
    assert [set(filter(None, got[i].near_items.split(","))) for i in range(len(texts))] == near([t for t, _ in texts], items)
    assert any(r.n_near for r in got.values()) and all(r.contaminated == (r.n_hit > 0) for r in got.values())
    assert {r.doc_id for r in decontamination.clean(docs, benchmark).collect()} == {i for i in got if not got[i].n_hit}


def test_items_of_every_length(spark, texts):
    """Many items that overlap, of one word to all of a text, beside brute force."""
    r = random.Random(8)
    items = [(9, texts[1][0])]
    for k in range(30):
        w = words(r.choice(texts)[0])
        n, at = r.choice((1, 2, 5, 9, 10, 11, 12, 30)), r.randrange(len(w))
        items.append((r.choice((k, None)), " ".join(w[at : at + n])))
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    rows += [(500, " ".join(["the"] * 40)), (501, " ".join(texts[1][0].split()[:25] * 3))]
    items += [(70, "the " * 12), (71, "the the")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_hit, x.n_items) for x in decontamination.contamination(docs, benchmark).collect()}
    assert got == {i: hits(t, items) for i, t in rows}


def test_large_tests_are_joined_by_shuffles(docs, benchmark, monkeypatch):
    whole = {tuple(r) for r in decontamination.contamination(docs, benchmark).collect()}
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", 4)
    monkeypatch.setattr(decontamination, "BROADCAST_TEXTS", 0)
    assert {tuple(r) for r in decontamination.contamination(docs, benchmark).collect()} == whole


def test_no_python_on_the_main_path(docs, benchmark):
    plan = decontamination.contamination(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    index = decontamination.build(docs, spark.createDataFrame([(9, "alpha beta gamma"), (8, "gamma"), (9, "alpha beta gamma")], "item_id long, text string"))
    found = decontamination.proximity_matches(index, 3, 10).join(index.texts, "rid").collect()
    assert sorted((r.doc_id, r.item_id, r.first, r.last) for r in found) == [(1, 9, 0, 5), (3, 9, 0, 2)]


def test_near_duplicates_broadcasts_no_table_of_rows(spark, docs):
    """What is broadcast to every task is built in the driver first: no table that grows with the texts may be."""
    from tallyforge.llm import components, jaccard_join

    for found in (jaccard_join.near_duplicates(docs), jaccard_join.kept(docs)):
        assert found.count() and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    a = spark.range(300).selectExpr("id a", "id + 1 b")
    assert {r.root for r in components.components(a).collect()} == {0}

import random

from tallyforge.llm import licenses as L


def test_postfix():
    assert L.postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2", "bsd-3", "and", "or"]
    assert L.postfix("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0") == ["mit", "apache-2", "or", "gpl-2", "classpath-exception-2.0", "with", "and"]
    assert L.postfix("MIT */ rest") == ["mit"] and L.postfix("AND MIT") == [] and L.postfix("MIT OR") == ["mit"] and L.postfix("(MIT") == ["mit"] and L.postfix("") == []
    assert L.allows(L.postfix("MIT AND (GPL-3.0 OR ISC)"), {"mit", "isc"}) and not L.allows(L.postfix("MIT AND GPL-3.0"), {"mit"})
    assert L.names(L.postfix("GPL-2.0 WITH x OR MIT")) == {"gpl-2", "mit"}


def plain(text):
    words = L.words(text)
    at = [i for p in L.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min(at, default=None), max(at, default=None)


def test_scan():
    for t in ["Released under the MIT License.", "x CC-BY-NC cc by nc 4.0", "under the mit license under the mit license", "Apache License, Version 2.0; under the MIT licensed", "", "É under THE mit\nlicense"]:
        got = L.scan(t)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == plain(t)
    got = L.scan("// SPDX-License-Identifier: MIT OR GPL-3.0\nunder the mit license")
    assert got["base_labels"] == "mit" and got["labels"] == "gpl-3,mit" and got["allowed"] and 0.9 < got["score"] < 1


def test_base_places_beside_a_plain_search():
    r = random.Random(2)
    pieces = ["under", "the", "mit", "license", "apache", "License", "version", "2", "cc", "BY", "nc", "cc-by-nc", "x", "é", "the mit license", "under the MIT"]
    for _ in range(3000):
        t = r.choice((" ", ", ", "-", "\n")).join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        got = L.scan(t)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == plain(t)
        w = " " + " ".join(L.words(t)) + " "
        assert got["base_labels"] == ",".join(sorted({x for p, x in L.BASE.items() if f" {p} " in w}))
        assert set(filter(None, got["labels"].split(","))) == {x for p, x in (L.BASE | L.NOTICES).items() if f" {p} " in w}

"""Learned operators: held-out accuracy, and parts against plain versions."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import language, personal_data, quality, quality_rules


def test_language(docs, texts):
    model = language.train(docs.select("text", "lang", (F.col("doc_id") % 3 == 1).cast("int").alias("part"), F.xxhash64("doc_id").alias("key")).where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [i for i in got if i % 4 == 2]
    assert all(got[i].lang_pred == texts[i][1] and 0 <= got[i].score <= 1 for i in held)
    # probabilities of a context's characters sum to one
    codes = np.arange(1 << language.BITS, dtype=np.uint64) | np.uint64(int(language.grams(["the"])[0][2]) << language.BITS & (1 << 64) - 1)
    assert np.allclose(np.exp(model._log(codes, language.ORDER)).sum(0), 1, atol=1e-3)
    # parts of a long text add up
    e, n = model.entropies(["the ring " * 50])
    language_slice, language.SLICE = language.SLICE, 100
    try:
        e2, n2 = model.entropies(["the ring " * 50])
    finally:
        language.SLICE = language_slice
    assert np.allclose(e, e2) and n.tolist() == n2.tolist()


def test_language_calibrates_on_all_rows(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(language, "CALIBRATE", 5, raising=False)
    part = (F.col("doc_id") % 3 == 1).cast("int").alias("part")
    model = language.train(docs.select("text", "lang", part, F.xxhash64("doc_id").alias("key")))
    first = language.train(docs.where("doc_id % 3 <> 1").select("text", "lang", F.lit(0).alias("part"), F.xxhash64("doc_id").alias("key")))
    own = [(t, x) for i, (t, x) in enumerate(texts) if i % 3 == 1]
    entropy, sizes = first.entropies([t for t, _ in own])
    truth = np.array([first.langs.index(x) for _, x in own])
    want = [np.quantile(entropy[truth == j, j], 1 - language.REJECT) + 0.5 for j in range(len(first.langs))]
    assert np.allclose(model.ready["floor"], want, atol=1e-3)
    # the fit's slope and shift are where the likelihood of all gaps is level
    x, y = language.gap(entropy, sizes), (entropy.argmin(1) == truth).astype(float)
    x, y = np.concatenate([x, [0.0, 0.0, 0.5]]), np.concatenate([y, [0.0, 1.0, 1.0]])
    w = np.array([model.ready["slope"], model.ready["shift"]])
    p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
    assert np.allclose([x @ (y - p), (y - p).sum()], 0.01 * w, atol=0.05)


def plain_kneser_ney(texts, order=4):
    """Interpolated Kneser-Ney over letters, by dictionaries: text -> cross-entropy of a character."""

    def spelt(text):  # words of letters between boundaries
        return [list(w) + [0] for w in "".join(c.lower() if c.isalpha() else " " for c in text).split()]

    def n_grams(text):
        return [tuple(([0] * order + w[:i + 1])[-order:]) for w in spelt(text) for i in range(len(w))]

    counts = [Counter(g for t in texts for g in n_grams(t))]
    for _ in range(order - 1):
        counts.insert(0, Counter(g[1:] for g in counts[0]))
    off = []
    for c in counts:
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        off.append(min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5)
    total, kinds = {}, {}
    for c in counts:
        for g, n in c.items():
            total[len(g), g[:-1]] = total.get((len(g), g[:-1]), 0) + n
            kinds[len(g), g[:-1]] = kinds.get((len(g), g[:-1]), 0) + 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / 65536
        all_, below = total.get((k, g[:-1])), p(g[1:])
        if not all_:
            return below
        d = off[k - 1]
        return max(counts[k - 1].get(g, 0) - d, 0) / all_ + d * kinds[k, g[:-1]] / all_ * below

    return lambda text: -sum(math.log(p(g)) for g in n_grams(text)) / len(n_grams(text))


def test_language_equals_plain_kneser_ney(texts):
    own = {"en": [t for t, x in texts if x == "en"][:30], "ru": ["привет мир, как дела", "мир и Труд!"], "he": ["שלום עולם", "עולם טוב"], "zh": ["天地玄黃 宇宙洪荒", "天地"], "got": ["𐌰𐌱𐌲 𐌰𐌱", "𐌲𐌰🙂𐌱"]}
    counts = []
    for x in sorted(own):
        code, n = np.unique(language.grams(own[x])[0], return_counts=True)
        counts.append((code, n))
    model = language.Model(sorted(own), counts)
    asked = [own["en"][3], "the ring é", "мир Дела", "עולם", "天 地玄", "𐌰𐌱 x", "🙂a🙂"]
    found, _ = model.entropies(asked)
    # a letter of two units is two characters: the plain version reads it so too
    halves = lambda t: "".join(c if ord(c) < 65536 or not c.isalpha() else "".join(chr(0x3400 + (u & 0x7FF)) for u in struct.unpack("<2H", c.encode("utf-16-le"))) for c in t)
    for j, x in enumerate(sorted(own)):
        plain = plain_kneser_ney([halves(t) for t in own[x]])
        assert np.allclose(found[:, j], [plain(halves(t)) for t in asked], rtol=1e-4)
    best = [sorted(own)[j] for j in found.argmin(1)]
    assert best[:6] == ["en", "en", "ru", "he", "zh", "got"]


def test_scripts_do_not_meet():
    """Letters whose numbers agree in the last bits are different letters."""
    code = {x: language.grams([x])[0][0] for x in "аאaα天𐌰"}
    assert len(set(code.values())) == 6 and language.grams(["Ab"])[0].tolist() == language.grams(["aB"])[0].tolist()


def test_language_keeps_all_n_grams(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(language, "MOST_GRAMS", 100, raising=False)
    small = spark.createDataFrame([("zażółć gęślą jaźń", "pl", 0, 1), ("ďábelské ódy", "cs", 1, 2)], "text string, lang string, part int, key long")
    model = language.train(docs.select("text", "lang", (F.col("doc_id") % 3 == 1).cast("int").alias("part"), F.xxhash64("doc_id").alias("key")).unionByName(small))
    assert model.langs == ["cs", "de", "en", "fr", "pl"] and len(model.ready["floor"]) == 5
    want = np.unique(language.grams([t for t, _ in texts] + ["zażółć gęślą jaźń", "ďábelské ódy"])[0])
    assert np.array_equal(np.sort(model.levels[-1].keys), np.sort(language.mixed(want)))


def test_quality(docs, labels, texts):
    model = quality.train(docs, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(got[i].predicted == int("%%%" not in t) for i, (t, _) in enumerate(texts) if i % 5 == 0)


def test_quality_reads_long_tokens_whole():
    r, tokens = random.Random(6), quality.Tokens()
    start = "天地玄黄宇宙洪荒日月盈昃" * 8  # 96 signs without a blank, the same in all texts
    text = lambda good: start + "".join(r.choice("春夏秋冬山水花鳥風雪" if good else "甲乙丙丁戊己庚辛壬癸") for _ in range(200))
    model = quality.fit([quality.features(text(i % 2), tokens) for i in range(60)], [i % 2 for i in range(60)])
    p = [quality.probability(model, quality.features(text(i % 2), tokens)) for i in range(40)]
    assert min(p[1::2]) > 0.5 > max(p[::2])
    # runs beyond the eighth and the 64th sign count, in shorter tokens as in longer ones
    assert quality.shapes("a1" * 5 + "#") == ["x9x9x9x9", "x9#"] and quality.shapes("a" * 70 + "9")[0] == "x9"
    assert len(np.setdiff1d(quality.features("a1" * 5 + "#", tokens), quality.features("a1" * 5, tokens)))


def test_descent_finds_the_margin():
    rows = [np.array([0]), np.array([1])] * 4
    w, bias = quality.descend(rows, [np.ones(1)] * 8, np.array([1.0, -1.0] * 4), np.full(8, 10.0), 200)
    assert abs(w[0] + bias - 1) < 0.01 and abs(w[1] + bias + 1) < 0.01


def test_descent_equals_the_plain_dual():
    """Against projected gradient on the whole dual problem, which is slow and plain."""
    r = np.random.default_rng(4)
    rows = [np.sort(r.choice(6, r.integers(1, 5), replace=False)) for _ in range(14)]
    values = [r.normal(size=len(x)) for x in rows]
    y = np.where(r.random(14) > 0.4, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 1.3)
    w, bias = quality.descend(rows, values, y, cost, 3000)
    x = np.zeros((14, 7))
    for i in range(14):
        x[i, rows[i]], x[i, 6] = values[i], 1
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha = np.zeros(14)
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    want = (alpha * y) @ x
    assert np.allclose(w[:6], want[:6], atol=2e-3) and abs(bias - want[6]) < 2e-3


def test_ratios_and_features_are_those_of_the_method():
    tokens = quality.Tokens()
    texts = [("good plain words here", 1), ("good words", 1), ("bad junk words", 0)]
    rows = [quality.features(t, tokens) for t, _ in texts]
    word = lambda w: zlib.crc32(w.encode()) % quality.SIZE
    two = lambda a, b: (word(a) * 1_000_003 + word(b) * 7_919 + 11) % quality.SIZE
    assert {word("good"), word("plain"), two("good", "plain"), two("words", "here")} <= set(rows[0].tolist()) and two("good", "words") not in rows[0]
    r = quality.ratios(rows, np.array([1.0, 1.0, -1.0]))
    good, bad = Counter(f for x in rows[:2] for f in x.tolist()), Counter(rows[2].tolist())
    totals = [sum(c.values()) + quality.SIZE for c in (good, bad)]
    for f in {*good, *bad}:
        assert abs(r[f] - math.log((good[f] + 1) / totals[0] / ((bad[f] + 1) / totals[1]))) < 1e-9


def test_quality_held_out(spark):
    """Two kinds of prose that differ in words alone, or in the order of words alone: the score must tell them apart on texts it hasn't seen."""
    r = random.Random(12)
    names = [f"w{chr(97 + i)}" for i in range(20)]

    def text(label):
        out = []
        for _ in range(60):
            a, b = r.sample(range(20), 2)
            out += [names[min(a, b)], names[max(a, b)]] if label else [names[max(a, b)], names[min(a, b)]]
        return " ".join(out)

    rows = [(i, text(i % 2)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400) if i % 5], "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [i for i in got if i % 5 == 0]
    assert sum((got[i] > 0.5) == bool(i % 2) for i in held) >= 0.95 * len(held)


def plain_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_statistics(spark):
    r = random.Random(2)
    texts = [None, "", "a", "a b c d e", "a b c d e a b c d e", "a " * 40, "x\ny\n\nx\n x\nx", " lead x \x0b\x1c y é🙂 |#"]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(1, 60))) for _ in range(40)] + ["".join(r.choice("ab \n\t|%é") for _ in range(80)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in quality_rules.statistics(df, "doc_id").collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_rules():
    r = np.random.default_rng(3)
    x = r.random((900, len(quality_rules.STATISTICS)))
    bad = ((x[:, 2] > 0.8) & (x[:, 1] < 0.6)) | (x[:, 4] > 0.9)
    rules = quality_rules.learn(x, bad)
    taken = np.zeros(len(x), bool)
    for rule in rules:
        taken |= quality_rules._takes(rule, x)
    assert (taken & bad).sum() > 0.9 * bad.sum() and (taken & ~bad).sum() < 0.02 * len(x)
    assert quality_rules.learn(x, np.zeros(900, bool)) == []


def test_a_condition_is_the_best_of_all():
    """The first condition of a rule beside all thresholds of all statistics, tried one by one."""
    r = np.random.default_rng(5)
    for _ in range(20):
        x = np.round(r.random((40, len(quality_rules.STATISTICS))), 1)
        bad = r.random(40) < 0.3 + 0.5 * (x[:, 1] > 0.6)
        if bad.all() or not bad.any():
            continue
        before = math.log2(bad.mean())
        gains = []
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            for t in (v[1:] + v[:-1]) / 2:
                for own in (x[:, j] <= t, x[:, j] >= t):
                    p = (own & bad).sum()
                    gains.append(p * (math.log2(p / own.sum()) - before) if p else 0)
        own = quality_rules._takes(quality_rules._grow(x, bad)[:1], x)
        p = (own & bad).sum()
        assert abs(p * (math.log2(p / own.sum()) - before) - max(gains)) < 1e-9


def test_rules_as_columns(docs, labels, texts):
    rules = quality_rules.train(docs, labels)
    got = {r.doc_id: r for r in quality_rules.judge(docs, rules).collect()}
    assert rules and all(r.kept == (not r.base_failed and "%%%" not in texts[i][0]) for i, r in got.items())


def plain_base(t):
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    cases = ["".join(r.choice("a1.@-+ (0)é2") for _ in range(r.randint(1, 60))) for _ in range(4000)]
    cases += ["".join(r.choice("0123456789 -.") for _ in range(r.randint(10, 60))) for _ in range(2000)]
    for t in cases:
        assert sorted(personal_data.base_spans(t)) == plain_base(t)


def test_added_spans(spark):
    text = "mail ab.cd@mail.example.com and password=1f3870be274f6c49b3 then +1 (555) 555-0100 card 4111111111111111 id 123456789012 end"
    docs = spark.createDataFrame([(i, text) for i in range(30)] + [(99, "nothing here, token of thanks: none")], "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.find_personal_data(docs).collect()}
    kinds = [s.split(":")[0] for s in got[0].spans.split(",")]
    assert kinds == ["email", "secret", "phone", "card"] and got[99].spans == ""
    assert "1f3870be" not in personal_data.redact(docs).where("doc_id = 0").collect()[0].text


def test_long_secrets(spark):
    secret = "".join(random.Random(n).choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for n in range(500))
    text = f"set password={secret} and go on"
    at = text.index(secret)
    assert [x[:3] for x in personal_data.candidates(text)] == [(at, at + 500, "secret")]
    docs = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    assert {r.spans for r in personal_data.find_personal_data(docs).collect()} == {f"secret:{at}:{at + 500}"}
    assert {r.text for r in personal_data.redact(docs).collect()} == {"set password=[SECRET] and go on"}


def test_reliabilities():
    votes, given = personal_data.estimate({("card", "++++++"): 90, ("card", "-----0"): 80, ("card", "-+++++"): 20, ("card", "+-----"): 10})
    assert votes["card", "++++++"] > 0.9 > 0.1 > votes["card", "-----0"] and given.shape == (6, 2, 3)
    assert personal_data.estimate({})[0] == {}


def plain_estimate(rows, rounds):
    """Expectation-maximisation, row by row: probability of each."""
    p = [min(0.95, max(0.05, 0.5 + sum("-0+".index(c) - 1 for c in v) / (2 * len(v)))) for v in rows]
    for _ in range(rounds):
        given = [[[10 * s for s in ((2.0, 1.0, 0.5), (0.5, 1.0, 2.0))[t]] for t in (0, 1)] for _ in rows[0]]
        for v, x in zip(rows, p, strict=True):
            for j, c in enumerate(v):
                given[j][1]["-0+".index(c)] += x
                given[j][0]["-0+".index(c)] += 1 - x
        prior = (sum(p) + 10) / (len(p) + 20)
        out = []
        for v in rows:
            odds = prior / (1 - prior)
            for j, c in enumerate(v):
                a = "-0+".index(c)
                odds *= given[j][1][a] / sum(given[j][1]) / (given[j][0][a] / sum(given[j][0]))
            out.append(odds / (1 + odds))
        p = out
    return p


def test_estimates_equal_the_plain_ones():
    r = random.Random(9)
    rows = []
    for _ in range(300):
        truth = r.random() < 0.4
        rows.append("".join("0" if r.random() < 0.2 else "+" if truth == (r.random() < sure) else "-" for sure in (0.95, 0.9, 0.8, 0.7, 0.6, 0.55)))
    found, _ = personal_data.estimate(Counter(("card", v) for v in rows), 25)
    assert np.allclose([found["card", v] for v in rows], plain_estimate(rows, 25), atol=1e-6)


def test_the_classifier_reads_spans_and_contexts():
    """Where votes say nothing, what stands around a span decides."""
    texts = [(f"password = {'ab12' * 4}{i} x", "++++++") for i in range(40)] + [(f"sample = {'ab12' * 4}{i} x", "------") for i in range(40)]
    at = lambda t: (t.index("ab12"), t.index(" x"))
    sample = [("secret", v, personal_data.features(t, *at(t), "secret", v)) for t, v in texts]
    model = personal_data.learn({("secret", "++++++"): 4000, ("secret", "------"): 4000}, sample)
    p = [personal_data.probability(model, personal_data.features(t, *at(t), "secret", "000000")) for t in ("password = ab12ab12q x", "sample = ab12ab12q x")]
    assert p[0] > 0.7 > 0.3 > p[1]
    assert personal_data.probability(personal_data.learn({}, []), personal_data.features(texts[0][0], 11, 30, "secret", "000000")) == 0.5

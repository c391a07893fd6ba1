"""Quality rules learned as a decision list (operator 8), in DataFrame functions only.

Statistics of whole texts are columns; the list is learned on the driver from
the statistics of a bounded sample of labelled rows and becomes one ``when``
chain, so applying it is part of the same scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import UPPER, table

BLANK = " \t\n\x0b\x0c\r"
SIGNS = "#*$%&|<>"
#: Words of a window that is looked for again in its text.
WINDOW = 5
#: Labelled rows of each class that rules are learned from, about.
ROWS = 3_000
#: Share of bad rows among those that a rule takes (grown, and held out).
PURE = 0.95
#: Statistics that conditions are on.
STATISTICS = ("n_words", "mean_word", "sign_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def repeated(words: Column) -> Column:
    """Words that stand in windows of five that the text has twice or more, the first included; each word once."""

    def of_windows(win):
        def of_sorted(s):
            twin = lambda x, other: F.coalesce(other["w"] == x["w"], F.lit(False))
            marked = F.transform(s, lambda x, j: F.when(twin(x, F.get(s, j - 1)) | twin(x, F.get(s, j + 1)), x["i"]))
            places = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("past"))
            covered = F.aggregate(places, start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["past"])).alias("n"), (i + WINDOW).alias("past")))
            return covered["n"]

        numbered = F.array_sort(F.transform(win, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(numbered, of_sorted))

    def of_hashes(h):
        win = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(h) > WINDOW, let(win, of_windows)).otherwise(F.lit(0).cast("long"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep with counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks.

    Windows are told apart by 64-bit hashes of their words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, BLANK)) > 0)
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n = F.length(text)
    return docs.select(
        *keep,
        counted.alias("counted"),
        of_lines.alias("of_lines"),
        F.length(_without(text, BLANK)).cast("long").alias("word_chars"),
        (n - F.length(_without(text, SIGNS))).cast("long").alias("n_symbols"),
        (n - F.length(_without(text, UPPER))).cast("long").alias("n_upper"),
        (n - F.length(_without(text, "!?"))).cast("long").alias("n_marks"),
    ).select(*keep, "counted.n_words", "word_chars", "n_symbols", "of_lines.n_dup_lines", "counted.n_repeat_words", "of_lines.n_lines", "n_upper", "n_marks")


def shares() -> list[Column]:
    """The columns that rules have conditions on, from the counts; shares of nothing are 0."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return [
        F.col("n_words").cast("double").alias("n_words"),
        part("word_chars", "n_words").alias("mean_word"),
        part("n_symbols", "n_words").alias("sign_share"),
        part("n_dup_lines", "n_lines").alias("dup_line_share"),
        part("n_repeat_words", "n_words").alias("repeat_share"),
        part("n_upper", "word_chars").alias("upper_share"),
        part("n_marks", "n_words").alias("mark_share"),
    ]


Rule = list[tuple[str, str, float]]


def _takes(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, value in rule:
        c = x[:, STATISTICS.index(name)]
        out &= c >= value if sign == ">=" else c <= value
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition of most information gained, until only bad rows are taken or nothing is gained."""
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while True:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        before = np.log2(p / (p + n))
        best, gained = None, 1e-9
        for j, name in enumerate(STATISTICS):
            values, own = x[inside, j], bad[inside]
            order = np.argsort(values, kind="stable")
            v, good = values[order], own[order]
            cp, ct = np.cumsum(good), np.arange(1, len(v) + 1)
            ends = np.nonzero(v[1:] != v[:-1])[0]  # a threshold lies between two values
            middle = (v[ends] + v[ends + 1]) / 2
            for sign, tp, total in (("<=", cp[ends], ct[ends]), (">=", p - cp[ends], p + n - ct[ends])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(tp > 0, tp * (np.log2(tp / total) - before), 0)
                if len(gain) and gain.max() > gained:
                    k = int(gain.argmax())
                    best, gained = (name, sign, float(middle[k])), float(gain[k])
        if best is None:
            break
        rule.append(best)
        inside &= _takes([best], x)
    return rule


def _counts(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[int, int]:
    t = _takes(rule, x)
    return int((t & bad).sum()), int((t & ~bad).sum())


def _prune(rule: Rule, grown: tuple, held: tuple) -> Rule:
    """Drop last conditions while the rule stays pure and that doesn't worsen what it is worth on rows it wasn't grown on."""

    def worth(r: Rule) -> float:
        p, n = _counts(r, *held)
        return (p - n) / (p + n) if p + n else 0.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        p, n = _counts(rule[:k], *grown)
        if p >= PURE * (p + n) and worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, keep it if it is pure on both, take out what it covers, go on.

    Bad rows that only an impure rule would cover are set aside, so every round
    settles some and the list ends by itself.
    """
    rules: list[Rule] = []
    held = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while (left & ~held & bad).any():
        grown, rest = left & ~held, left & held
        rule = _grow(x[grown], bad[grown])
        if not rule:
            break
        rule = _prune(rule, (x[grown], bad[grown]), (x[rest], bad[rest]))
        t = _takes(rule, x) & left
        (p, n), (ph, nh) = _counts(rule, x[left], bad[left]), _counts(rule, x[rest], bad[rest])
        if p >= 3 and p >= PURE * (p + n) and ph >= PURE * (ph + nh):
            rules.append(rule)
            left &= ~t
        else:
            left &= ~(t & bad)
    return rules


def train(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from the statistics of about ROWS labelled documents of each class, chosen by hash of the id.

    Null labels are left out; of several labels of one id the smallest counts.
    Without bad or without good rows there are no rules.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = known.where(F.when(F.col("quality") == 1, place < ROWS / n[1] * (1 << 20)).otherwise(place < ROWS / n[0] * (1 << 20)))
    # about 2 x ROWS small rows, whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = statistics(rows, "doc_id", "quality").select(F.xxhash64("doc_id").alias("place"), "quality", *shares()).collect()
    found = sorted(map(tuple, found))
    return learn(np.array([r[2:] for r in found], float).reshape(-1, len(STATISTICS)), np.array([r[1] == 0 for r in found], bool))


def written(rule: Rule) -> str:
    return " and ".join(f"{name} {sign} {value:.6g}" for name, sign, value in rule)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional: the first rule that takes a row, as text, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        taken = F.lit(True)
        for name, sign, value in rule:
            taken &= F.col(name) >= value if sign == ">=" else F.col(name) <= value
        out = F.when(taken, F.lit(written(rule))).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts of every whole text, whether it fails the fixed limits, and whether the rules keep it.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and rule (the one that rejects), one row
    for each row of docs; repeated rows stay.  A null or empty text has no
    words and fails.  Other columns are not read.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = statistics(docs, "doc_id")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rated = counted.select("doc_id", F.struct(*counts).alias("counts"), failed.alias("base_failed"), *shares())
    rated = rated.select("doc_id", "counts", "base_failed", verdict(rules).alias("rule"))
    return rated.select("doc_id", *[f"counts.{c}" for c in counts], "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))

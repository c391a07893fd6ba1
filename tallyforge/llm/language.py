"""Language identification by interpolated Kneser-Ney character models (operator 1)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import fold, scratch, stored, table

#: Characters of an n-gram.
ORDER = 4
#: Bits of a character: a UTF-16 unit, so every letter has a code of its own and four fill 64 bits; what isn't a letter is 0.
BITS = 16
#: Decimals of the cross-entropies and gaps that are counted for calibration.
ENTROPY, GAP = 4, 2
#: Share of its own language's texts that rejection costs.
REJECT = 0.001
#: Characters that are worked on at once.
SLICE = 2_000_000


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """The small letter of every UTF-16 unit, 0 for what isn't a letter; and which code points beyond those are letters."""
    small = np.zeros(1 << BITS, np.uint16)
    for c in range(1 << BITS):
        if chr(c).isalpha():
            low = chr(c).lower()
            small[c] = ord(low) if len(low) == 1 and ord(low) < 1 << BITS else c
    return small, np.fromiter((chr(c).isalpha() for c in range(1 << BITS, 0x110000)), bool, 0x100000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of texts one after the other, and the place where each text's begin (len(texts) + 1 places).

    A text is read as its small letters, runs of anything else being one
    boundary; each ends in a boundary and starts after one.  A letter beyond
    the first 65,536 code points is read as its two units.
    """
    joined = "\n".join(texts) + "\n"
    units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
    small, beyond = letters()
    kind = small[units]
    sizes = map(len, texts)
    if len(units) > len(joined):
        at = np.flatnonzero(units & 0xFC00 == 0xD800)
        at = at[units[at + 1] & 0xFC00 == 0xDC00]  # the last unit is a line's end
        at = at[beyond[(units[at].astype(np.int64) - 0xD800 << 10) + units[at + 1] - 0xDC00]]
        kind[at], kind[at + 1] = units[at], units[at + 1]
        sizes = (len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts)
    ends = np.cumsum(np.fromiter(sizes, np.int64, len(texts)) + 1)
    keep = kind != 0
    keep[1:] |= kind[:-1] != 0  # the first sign after a letter stands for the whole run
    kept = np.concatenate([[0], np.cumsum(keep)])
    kind = kind[keep].astype(np.uint64)
    code = kind.copy()
    for back in range(1, ORDER):
        code[back:] |= kind[:-back] << np.uint64(BITS * back)
    # what stands before a text's first boundary belongs to another text; a boundary hides it
    for back in range(1, ORDER - 1):
        cut = np.zeros(len(kind), bool)
        cut[back:] = kind[:-back] == 0
        code[cut] &= np.uint64((1 << BITS * (back + 1)) - 1)
    return code, np.concatenate([[0], kept[ends]])


def shorter(codes: np.ndarray, order: int) -> np.ndarray:
    """The last order characters of n-grams."""
    return codes & np.uint64((1 << BITS * order) - 1)


def before(codes: np.ndarray) -> np.ndarray:
    """N-grams without their last character."""
    return codes >> np.uint64(BITS)


def mixed(codes: np.ndarray) -> np.ndarray:
    """Hash of n-gram codes; one-to-one, so that no two n-grams meet."""
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class Level:
    """One order of all languages' models as sorted hash arrays: hash, and a row of log probabilities (or of back-off weights)."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        hashed = mixed(codes)
        order = np.argsort(hashed)
        self.keys, self.rows = hashed[order], rows[order].astype(np.float32)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each code, and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        hashed = mixed(codes)
        at = np.searchsorted(self.keys, hashed)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == hashed


class Model:
    """Kneser-Ney models of some languages, interpolated over all orders."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language the codes of its n-grams and how often they stand."""
        self.langs = langs
        self.levels: list[Level] = []
        self.contexts: list[Level] = []
        uniform = -math.log(1 << BITS)
        stats = []
        for codes, n in counts:
            per_order, n = {}, n.astype(float)
            for order in range(ORDER, 0, -1):
                per_order[order] = (codes, n)
                # each n-gram counts once for the shorter one it ends in
                codes, n = np.unique(shorter(codes, order - 1), return_counts=True)
                n = n.astype(float)
            stats.append(per_order)
        for order in range(1, ORDER + 1):
            every = np.unique(np.concatenate([s[order][0] for s in stats])) if stats else np.zeros(0, np.uint64)
            above = np.unique(before(every))
            rows, weights = np.empty((len(every), len(langs))), np.empty((len(above), len(langs)))
            if order == 1:
                lower = np.full((len(every), len(langs)), uniform)
            else:
                lower = self._log(shorter(every, order - 1), order - 1)
            for j, s in enumerate(stats):
                codes, n = s[order]
                n1, n2 = float((n == 1).sum()), float((n == 2).sum())
                off = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
                context, which = np.unique(before(codes), return_inverse=True)
                total, kinds = np.bincount(which, n), np.bincount(which)
                at = np.searchsorted(context, above)
                at[at == len(context)] = 0
                seen = context[at] == above
                share = np.where(seen, off * kinds[at] / total[at], 1.0)
                weights[:, j] = np.log(share)
                own = np.zeros(len(every))
                own[np.searchsorted(every, codes)] = (n - off) / total[which]
                mine = np.searchsorted(above, before(every))
                rows[:, j] = np.log(own + share[mine] * np.exp(lower[:, j]))
            self.levels.append(Level(every, rows))
            self.contexts.append(Level(above, weights))
        self.ready: dict = {"floor": [0.0] * len(langs), "slope": 1.0, "shift": 0.0}

    def _log(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of each language, backing off where an n-gram is in no language."""
        if order == 0:
            return np.full((len(codes), len(self.langs)), -math.log(1 << BITS), np.float32)
        level = self.levels[order - 1]
        at, found = level.find(codes)
        if found.all():
            return level.rows[at]
        out = np.empty((len(codes), len(self.langs)), np.float32)
        out[found] = level.rows[at[found]]
        rest = codes[~found]
        below = self._log(shorter(rest, order - 1), order - 1)
        context = self.contexts[order - 1]
        at, found_above = context.find(before(rest))
        if len(context.rows):
            below = below + np.where(found_above[:, None], context.rows[at], 0)
        out[~found] = below
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text and language, and characters that were scored."""
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= SLICE):
                chars += len(texts[end])
                end += 1
            codes, ends = grams(texts[start:end])
            for i in range(0, len(codes), SLICE):  # a very long text is summed part by part
                part = codes[i : i + SLICE]
                logs = self._log(part, ORDER)
                cuts = np.clip(ends, i, i + len(part)) - i
                total = np.zeros((len(part) + 1, len(self.langs)))
                np.cumsum(logs, axis=0, out=total[1:], dtype=float)
                sums[start:end] += total[cuts[1:]] - total[cuts[:-1]]
            sizes[start:end] = np.diff(ends)
            start = end
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def calibrate(self, floors: dict[str, float], gaps: np.ndarray, right: np.ndarray, n: np.ndarray) -> None:
        """Fit what turns the gap between the two best models into a probability (n texts of each gap, whether they were told right), and take what cross-entropy is too high to belong to a language."""
        self.ready["floor"] = [floors.get(x, math.inf) for x in self.langs]
        if len(gaps) and len(self.langs) > 1:
            # a few made-up answers keep the curve finite where all answers are right
            x, y, n = (np.concatenate([a, b]) for a, b in ((gaps, [0.0, 0.0, 0.5]), (right, [0.0, 1.0, 1.0]), (n, [1.0, 1.0, 1.0])))
            w = np.zeros(2)
            for _ in range(50):
                z = np.stack([x, np.ones(len(x))], 1)
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                bend = (z * (n * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
                w = w + np.linalg.solve(bend, z.T @ (n * (y - p)) - 0.01 * w)
            self.ready |= {"slope": max(float(w[0]), 1e-3), "shift": float(w[1])}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        scored = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        if scored:
            entropy, sizes = self.entropies([texts[i] for i in scored])
            best = entropy.argmin(1)
            if len(self.langs) > 1:
                p = 1 / (1 + np.exp(-np.clip(self.ready["slope"] * gap(entropy, sizes) + self.ready["shift"], -30, 30)))
            else:
                p = np.ones(len(scored))
            for k, i in enumerate(scored):
                out[i] = (self.langs[best[k]], float(p[k]), bool(entropy[k, best[k]] > self.ready["floor"][best[k]] or p[k] < 0.5))
        return out


def gap(entropy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far the best model is ahead: difference of cross-entropies times the root of the length."""
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return (two[:, 1] - two[:, 0]) * np.sqrt(sizes)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(docs: DataFrame) -> Model:
    """Learn from docs(text, lang, part): models from the n-grams of all rows of parts 0 and 1.

    Calibration is by all rows of part 1, with models of part 0 alone; part
    1's n-grams are added after it.  Its cross-entropies and gaps are counted
    by Spark to ENTROPY and GAP decimals, so that what reaches the driver
    doesn't grow with the rows.  N-grams are counted in each task and summed
    over tasks by Spark; all of them reach the driver, some 28 bytes for each
    language's n-gram.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches):
        held: dict[tuple[str, int], list] = {}

        def merged(parts):
            codes = np.concatenate([c for c, _ in parts])
            code, which = np.unique(codes, return_inverse=True)
            return code, np.bincount(which, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            by: dict[tuple[str, int], list[str]] = {}
            for text, lang, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by.setdefault((lang, part), []).append(text)
            for key, texts in by.items():
                parts = held.setdefault(key, [])
                while texts:
                    take, chars = 0, 0
                    while take < len(texts) and (not take or chars + len(texts[take]) <= SLICE):
                        chars += len(texts[take])
                        take += 1
                    codes, _ = grams(texts[:take])
                    texts = texts[take:]
                    parts.append(np.unique(codes, return_counts=True))
                if len(parts) > 8:
                    held[key] = [merged(parts)]
        for (lang, part), parts in held.items():
            code, n = merged(parts)
            n = n.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n), pa.array(n * (part == 0))], ["lang", "gram", "n", "first"])

    found = known.where("part in (0, 1)").select("text", "lang", F.col("part").cast("int")).mapInArrow(count, "lang string, gram long, n long, first long")
    rows = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("first").alias("first")).toArrow()
    gram, every, first = (rows.column(c).to_numpy() for c in ("gram", "n", "first"))
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    gram = gram.view(np.uint64)

    def learn(n):
        langs, counts = [], []
        for x in sorted(names):
            own = np.flatnonzero((lang == names.index(x)) & (n > 0))
            if len(own):
                own = own[np.argsort(gram[own])]
                langs.append(x)
                counts.append((gram[own], n[own]))
        return Model(langs, counts)

    model = learn(first)
    if model.langs:
        index = {x: i for i, x in enumerate(model.langs)}
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def score(batches):
            for batch in batches:
                entropy, sizes = shared.value.entropies(batch.column(0).to_pylist())
                truth = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
                ok = np.flatnonzero((truth >= 0) & (sizes > 0))
                truth, entropy, sizes = truth[ok], entropy[ok], sizes[ok]
                ahead = gap(entropy, sizes) if len(index) > 1 else np.zeros(len(ok))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(ok)), pa.array(entropy[np.arange(len(ok)), truth]), pa.array(ahead), pa.array((entropy.argmin(1) == truth).astype(float))], ["lang", "entropy", "gap", "right"])

        with scratch(docs.sparkSession):
            scored = known.where("part = 1").select("text", "lang").mapInArrow(score, "lang string, entropy double, gap double, right double")
            scored = stored(docs.sparkSession, scored, "calibration")
            floors = scored.groupBy("lang").agg(F.percentile(F.round("entropy", ENTROPY), F.lit(1 - REJECT)).alias("e")).collect()
            gaps = scored.groupBy(F.round("gap", GAP).alias("gap"), "right").agg(F.count("*").alias("n")).orderBy("gap", "right").toArrow()
        model.calibrate({r.lang: r.e + 0.5 for r in floors}, *(gaps.column(c).to_numpy().astype(float) for c in ("gap", "right", "n")))
    whole = learn(every)
    floor = dict(zip(model.langs, model.ready["floor"], strict=True))
    whole.ready = model.ready | {"floor": [floor.get(x, math.inf) for x in whole.langs]}
    return whole


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every whole text.

    Returns doc_id, lang_pred, score and rejected, one row for each row of
    docs; repeated rows stay.  lang_pred is `und` (score 0, rejected) where a
    text is null or has no letter, or where nothing was learned; the model's
    best language is given otherwise, and rejected marks texts that fit none
    well or fit two alike.  Ties go to the language first in the alphabet.
    Other columns are not read.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a row of some floats for each n-gram

    def run(batches):
        for batch in batches:
            found = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), pa.array([x for _, _, x in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 4)
    model = train(docs.where(part != 2).select("text", "lang", F.when(part == 1, 1).otherwise(0).alias("part")))
    found = identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")

"""Quality classifier: naive Bayes features in a support vector machine (operator 10)."""

from __future__ import annotations

import math
import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tallyforge.llm.common import fold, table

#: Labelled rows of each class that the model is fitted on, about.
ROWS = 2_000
#: Features that hashing leaves apart (2^20 at most, as tokens are remembered as pairs of 20 bits).
SIZE = 1 << 20
#: Share of the machine's own weights, cost of a hinge, rounds of descent.
BETA, COST, ROUNDS = 0.25, 1.0, 15
THRESHOLD = 0.3
REMEMBER = 150_000
#: Signs from which a token is read by its n-grams too (texts without blanks), and signs of such an n-gram.
LONG, GRAM = 64, 3
RUNS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def shapes(token: str) -> list[str]:
    """What a whole token looks like, eight runs at a time: runs of letters as x, X or Xx, runs of digits as 9, signs as themselves."""
    out = []
    for run in RUNS.findall(token):
        c = run[0]
        kind = ("X" if run.isupper() and len(run) > 1 else "Xx" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return ["".join(out[i : i + 8]) for i in range(0, len(out), 8)] or [""]


def _shape_feature(s: str) -> int:
    return zlib.crc32(b"\x00shape" + s.encode()) % SIZE


class Tokens(dict):
    """token -> feature of its first shape (above bit 20) and of its word, remembered; bit 40 marks tokens that rest() has more of."""

    def __missing__(self, token):
        first, *more = shapes(token)
        pair = bool(more or len(token) > LONG) << 40 | _shape_feature(first) << 20 | zlib.crc32(token.lower().encode()) % SIZE
        if len(token) <= LONG:
            if len(self) >= REMEMBER:
                self.clear()
            self[token] = pair
        return pair


def rest(token: str) -> set[int]:
    """Features of a token beyond those of its first shape and its word: its other shapes, pairs of its neighbouring shapes, and the n-grams of a long one."""
    every = [_shape_feature(s) for s in shapes(token)]
    out = set(every[1:]) | {(a * 31 + b * 17 + 7) % SIZE for a, b in pairwise(every)}
    if len(token) > LONG:
        low = token.lower()
        out |= {zlib.crc32(b"\x00gram" + g.encode("utf-8", "surrogatepass")) % SIZE for g in {low[i : i + GRAM] for i in range(len(low) - GRAM + 1)}}
    return out


def level(share: float) -> int:
    return min(7, int(share * 16)) if share > 0 else -1


def features(text: str | None, tokens: Tokens) -> np.ndarray:
    """Features of a whole text, sorted.

    N-gram indicators: its words and pairs of neighbouring words, and the
    character n-grams of long tokens.  Beside them, made by hand: shapes of
    tokens, pairs of neighbouring shapes, and levels of length, of repeated
    lines and words and of signs.  A null or empty text has the one feature of
    having no words.
    """
    found = (text or "").split()
    if not found:
        return np.array([zlib.crc32(b"\x00none") % SIZE])
    pairs = np.fromiter(map(tokens.__getitem__, found), np.int64, len(found))
    first, each = pairs >> 20 & 0xFFFFF, pairs & 0xFFFFF
    words, two = np.unique(each), (each[:-1] * 1_000_003 + each[1:] * 7_919 + 11) % SIZE
    both = (first[:-1] * 31 + first[1:] * 17 + 7) % SIZE
    more = set().union(*map(rest, {found[i] for i in np.flatnonzero(pairs >> 40)}))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    n, kinds = len(found), len(words)
    whole = [
        f"size{int(math.log2(n))}",
        f"lines{level(1 - len(set(lines)) / len(lines))}",
        f"kinds{level(1 - kinds / n) if n >= 20 else 'few'}",
        f"signs{level(sum(map(text.count, '#*$%&|<>!')) / len(text) * 4)}",
    ]
    return np.unique(np.concatenate([words, two, np.unique(first), both, np.fromiter(more, np.int64, len(more)), [zlib.crc32(f"\x00{w}".encode()) % SIZE for w in whole]]))


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each feature: how much oftener it is in texts of class 1, against class 0."""
    good, bad = np.ones(SIZE), np.ones(SIZE)
    for x, label in zip(rows, y, strict=True):
        (good if label > 0 else bad)[x] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss: one multiplier for each row, moved to its best place in turn."""
    w, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slope = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            to = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if to != alpha[i]:
                step = (to - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(to - alpha[i]))
                alpha[i] = to
        if moved < 1e-4:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: list[int]) -> dict:
    """Weights by feature, bias, and the curve that makes margins probabilities."""
    y = np.where(np.array(labels, float) > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return {"weights": np.zeros(SIZE, np.float32), "bias": 0.0, "slope": 0.0, "shift": 2.0 if not len(y) or y[0] > 0 else -2.0}
    r = ratios(rows, y)
    values = [r[x] / math.sqrt(len(x)) for x in rows]
    cost = np.where(y > 0, COST * len(y) / (2 * (y > 0).sum()), COST * len(y) / (2 * (y < 0).sum()))
    w, bias = descend(rows, values, y, cost)
    # between naive Bayes alone (each feature at the mean weight) and the machine
    w = (1 - BETA) * np.abs(w).mean() + BETA * w
    weights = (w * r).astype(np.float32)
    margin = np.array([float(weights[x].sum()) / math.sqrt(len(x)) + bias for x in rows])
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    curve = np.zeros(2)
    z = np.stack([margin, np.ones(len(margin))], 1)
    weigh = cost / cost.mean()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        bend = (z * (weigh * p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(2)
        curve = curve + np.linalg.solve(bend, z.T @ (weigh * (target - p)) - 0.5 * curve)
    return {"weights": weights, "bias": bias, "slope": float(max(curve[0], 0)), "shift": float(curve[1])}


def probability(model: dict, x: np.ndarray) -> float:
    margin = float(model["weights"][x].sum()) / math.sqrt(len(x)) + model["bias"]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model["slope"] * margin + model["shift"]))))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on about ROWS labelled documents of each class, whole texts, chosen by hash of the id.

    docs(doc_id, text), labels(doc_id, quality): rows with a null label are
    left out; of several labels of one id the smallest counts.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = known.where(F.when(F.col("quality") == 1, place < ROWS / max(1, n.get(1, 0)) * (1 << 20)).otherwise(place < ROWS / max(1, n.get(0, 0)) * (1 << 20)))

    def extract(batches):
        tokens = Tokens()
        for batch in batches:
            xs = [features(t, tokens).astype(np.int32) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["x", "quality", "place"])

    # about 2 x ROWS small rows, whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int"), F.xxhash64("doc_id").alias("place"))
    found = rows.mapInArrow(extract, "x array<int>, quality int, place long").toArrow().to_pydict()
    order = sorted(range(len(found["x"])), key=lambda i: (found["place"][i], len(found["x"][i])))
    return fit([np.array(found["x"][i]) for i in order], [found["quality"][i] for i in order])


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id alone unless given) with score and predicted (1 from THRESHOLD on) for every whole text.

    One row for each row of docs; repeated rows stay.  Null and empty texts
    are scored as texts without words.  With no labelled rows every score is
    that of an unknown text, about 0.88.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights
    kept = docs.select(*keep, F.col("text").cast("string").alias("text_to_score"))
    schema = StructType([*kept.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        tokens = Tokens()
        for batch in batches:
            p = [probability(shared.value, features(t, tokens)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32())], [*batch.schema.names[:-1], "score", "predicted"])

    return kept.mapInArrow(run, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")

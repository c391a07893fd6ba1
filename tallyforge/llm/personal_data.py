"""Personal data by weak supervision (operator 9).

Candidates come from patterns.  Six labelers vote on each (format, checksum,
gazetteer, context, shape, surroundings); the votes of all documents are
counted by pattern of votes; expectation-maximisation estimates how reliable
each labeler is.  A logistic classifier then learns the estimated labels from
what spans look like and the words around them, on a bounded sample of spans
of each pattern, weighted by how many there are.  It decides which candidates
beyond the contract's four kinds are added.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table

#: Kinds in the order that ties of start take; the first four are the contract's.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The contract's patterns, written so that long runs of digits take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"\b(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\b[\"']?[ \t]{0,4}(?:=|:)[ \t]{0,4}[\"']?([A-Za-z0-9_+/=.-]{8,}+)", re.I)
CUE = re.compile(r"=|:")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
DIGIT = re.compile(r"[0-9]")
CONTEXT = {
    "email": re.compile(r"mail|contact|write|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adresse", re.I),
    "card": re.compile(r"card|visa|pay|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|ruf", re.I),
    "secret": re.compile(r"pass|token|secret|key|auth|login", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "iban": re.compile(r"iban|bank|konto|account", re.I),
}
LOOK = 40
#: Gazetteers, fixed values: first digits of card networks, common top-level domains, country codes of phones and of accounts.
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
TOP_LEVEL = frozenset("com org net edu gov io de fr es uk us eu info co".split())
DIALS = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
ACCOUNTS = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
LABELERS = ("format", "checksum", "gazetteer", "context", "shape", "surroundings")
#: Probability from which a candidate beyond the base is taken.
TAKE = 0.8
#: Spans of each pattern of votes that the classifier learns from, about; features that hashing leaves apart.
SAMPLE, SIZE = 400, 1 << 14
#: Rounds of descent, decay of weights, most that a span weighs against the mean.
ROUNDS, DECAY, HEAVY = 200, 1e-5, 10
AROUND = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping addresses: each @ with the run of local signs before it and the domain after it."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            past = m.end()
            at = text.find("@", past)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) that the contract's four patterns take."""
    return [(s, e, k) for s, e, k, ok in _four(text or "") if ok]


def _four(text: str):
    if "@" in text:
        for s, e in emails(text):
            yield s, e, "email", True
    if DIGIT.search(text):
        for m in IP.finditer(text):
            yield m.start(), m.end(), "ip", all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if len(digits) >= 12:
                    yield m.start(), m.end(), "card", len(digits) <= 19 and luhn(digits)
        if "+" in text:
            for m in PHONE.finditer(text):
                yield m.start(), m.end(), "phone", 9 <= sum(map(str.isdigit, m[0])) <= 15


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """All candidates: (start, end, kind, whether it is of the base)."""
    found = list(_four(text))
    if CUE.search(text):
        found += [(m.start(1), m.end(1), "secret", False) for m in SECRET.finditer(text)]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ssn", False) for m in SSN.finditer(text)]
        found += [(m.start(), m.end(), "iban", False) for m in IBAN.finditer(text)]
    return found


def _checksum(kind: str, span: str) -> int:
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "card":
        return 1 if 12 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == "ip":
        return 1 if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split(".")) else -1
    if kind == "phone":
        return 1 if 9 <= len(digits) <= 15 else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == "iban":
        flat = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    return 0


def votes(text: str, start: int, end: int, kind: str, base: bool) -> str:
    """One sign for each labeler: + for personal data, - against it, 0 for no opinion."""
    span, before = text[start:end], text[max(0, start - LOOK) : start]
    known = {
        "email": lambda: span.rpartition(".")[2].lower() in TOP_LEVEL,
        "card": lambda: span.startswith(ISSUERS),
        "phone": lambda: span[1:].startswith(DIALS),
        "iban": lambda: span[:2] in ACCOUNTS,
        "secret": lambda: any(c.isdigit() for c in span),
        "ip": lambda: not span.startswith(("0.", "127.", "255.")),
        "ssn": lambda: True,
    }[kind]()
    signs = Counter(c for c in span if c.isalnum())
    total = sum(signs.values())
    spread = -sum(n / total * math.log2(n / total) for n in signs.values()) if total else 0.0
    outer = text[start - 1 : start] + text[end : end + 1]
    cast = (
        1 if base or kind == "secret" and len(span) >= 12 else 0 if kind in ("secret", "ssn", "iban") else -1,
        _checksum(kind, span),
        1 if known else -1 if kind in ("secret", "iban") else 0,
        1 if kind == "secret" or CONTEXT[kind].search(before) else 0,
        1 if spread >= (2.5 if kind == "secret" else 1.5) else -1,
        -1 if any(c.isalnum() for c in outer) else 1,
    )
    return "".join("-0+"[v + 1] for v in cast)


def estimate(counts: dict[tuple[str, str], int], rounds: int = 60):
    """Expectation-maximisation over counted vote patterns (Dawid and Skene's model with three answers).

    counts: (kind, votes) -> places.  Returns the probability of personal data
    of each key and each labeler's answers given the truth, as
    [labeler][truth][answer].
    """
    keys = sorted(counts)
    if not keys:
        return {}, np.full((len(LABELERS), 2, 3), 1 / 3)
    n = np.array([counts[k] for k in keys], float)
    answers = np.array([["-0+".index(c) for c in v] for _, v in keys])
    p = np.clip(0.5 + (answers - 1).sum(1) / (2 * len(LABELERS)), 0.05, 0.95)
    for _ in range(rounds):
        given = np.empty((len(LABELERS), 2, 3))
        for j in range(len(LABELERS)):
            for a in range(3):
                at = answers[:, j] == a
                given[j, 1, a] = (n * p)[at].sum()
                given[j, 0, a] = (n * (1 - p))[at].sum()
        # smoothing: each labeler is taken to be a little better than chance
        given[:, 1] += np.array([0.5, 1.0, 2.0]) * 10
        given[:, 0] += np.array([2.0, 1.0, 0.5]) * 10
        given /= given.sum(2, keepdims=True)
        prior = (float((n * p).sum()) + 10) / (float(n.sum()) + 20)
        logs = np.full(len(keys), math.log(prior / (1 - prior)))
        for j in range(len(LABELERS)):
            logs += np.log(given[j, 1, answers[:, j]] / given[j, 0, answers[:, j]])
        p = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True)), given


def _share(n: int, total: int) -> int:
    return min(4, 5 * n // total) if total else 0


def features(text: str, start: int, end: int, kind: str, cast: str) -> list[int]:
    """Hashed features of a span, each with its kind: the labelers' votes, its length, signs and their neighbours, and the words and signs around it."""
    span, before, after = text[start:end], text[max(0, start - LOOK) : start], text[end : end + LOOK]
    classes = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else " " if c.isspace() else c for c in span)
    n = len(span)
    out = {"", f"long{n.bit_length()}", f"digits{_share(classes.count('9'), n)}", f"upper{_share(classes.count('X'), n)}", f"kinds{_share(len(set(span)), n)}"}
    out |= {f"vote{j}{c}" for j, c in enumerate(cast)}
    out |= {f"pair{x}" for x in {classes[i : i + 2] for i in range(n - 1)}}
    out |= {f"before {w}" for w in AROUND.findall(before.lower())[-3:]} | {f"after {w}" for w in AROUND.findall(after.lower())[:2]}
    out |= {f"left{before[-1:]}", f"right{after[:1]}"}
    return [zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % SIZE for x in out]


def learn(counts: dict[tuple[str, str], int], sample: list[tuple[str, str, list[int]]]) -> dict:
    """The span classifier: logistic regression of the estimated labels on the features of sampled spans (kind, votes, features).

    A sampled span weighs as many as its pattern has for each sampled one, at
    most HEAVY times the mean.  Patterns are few and spans many, so that
    features of the span and of the words around decide where votes are split.
    """
    labels, given = estimate(counts)
    weights = np.zeros(SIZE + 1)
    rows = sorted((k, v, sorted(x)) for k, v, x in sample if (k, v) in labels)
    if rows:
        taken = Counter((k, v) for k, v, _ in rows)
        most = max(len(x) for _, _, x in rows)
        x = np.full((len(rows), most), SIZE)
        for i, (_, _, own) in enumerate(rows):
            x[i, : len(own)] = own
        y = np.array([labels[k, v] for k, v, _ in rows])
        n = np.array([counts[k, v] / taken[k, v] for k, v, _ in rows])
        n = np.minimum(n / n.mean(), HEAVY)
        n /= n.sum()
        squares = np.full(SIZE + 1, 1e-8)
        for _ in range(ROUNDS):
            q = 1 / (1 + np.exp(-np.clip(weights[x].sum(1), -30, 30)))
            slope = np.bincount(x.ravel(), np.repeat(n * (q - y), most), SIZE + 1) + DECAY * weights
            slope[SIZE] = 0
            squares += slope * slope
            weights -= 0.5 * slope / np.sqrt(squares)
    return {"weights": weights[:SIZE].astype(np.float32), "given": given.tolist()}


def probability(model: dict, x: list[int]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(model["weights"][x].sum())))))


def spans(text: str | None, model: dict) -> list[tuple[int, int, str]]:
    """All spans of a text: those of the base, and candidates that the model takes and that don't overlap what is taken already."""
    if not text:
        return []
    found = candidates(text)
    taken = [(s, e, k) for s, e, k, ok in found if ok]
    scored = []
    for s, e, k, ok in found:
        if not ok:
            p = probability(model, features(text, s, e, k, votes(text, s, e, k, False)))
            if p >= TAKE:
                scored.append((-p, s, e, k))
    if scored:
        taken += _apart(taken, [(s, e, k) for _, s, e, k in sorted(scored)])
    return sorted(taken, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _apart(taken, more):
    """Those of more, best first, that overlap nothing before them."""
    import bisect

    edges = sorted((s, e) for s, e, _ in taken)
    merged: list[list[int]] = []
    for s, e in edges:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts, ends = [s for s, _ in merged], [e for _, e in merged]
    out = []
    for s, e, k in more:
        i = bisect.bisect_right(starts, s)
        if (i and ends[i - 1] > s) or (i < len(starts) and starts[i] < e):
            continue
        starts.insert(i, s)
        ends.insert(i, e)
        out.append((s, e, k))
    return out


def fit(docs: DataFrame) -> dict:
    """Count the votes on all candidates of all documents, estimate the labels, and learn the classifier from sampled spans.

    What reaches the driver are counts by kind and vote pattern, at most
    7 x 729 rows, and the features of about SAMPLE spans of each, whatever the
    size of docs.  Spans are chosen by a hash of themselves and what is around
    them.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    for s, e, k, ok in candidates(text):
                        seen[k, votes(text, s, e, k, ok)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "votes", "n"])

    rows = texts.mapInArrow(count, "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    counts = {(r.kind, r.votes): r.n for r in rows}

    def choose(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if text:
                    for s, e, k, ok in candidates(text):
                        v = votes(text, s, e, k, ok)
                        if zlib.crc32(text[max(0, s - LOOK) : e + LOOK].encode("utf-8", "surrogatepass")) * counts.get((k, v), 1) < SAMPLE << 32:
                            out.append((k, v, features(text, s, e, k, v)))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(list(columns[2]), pa.list_(pa.int32()))], ["kind", "votes", "x"])

    sample = [(r.kind, r.votes, list(r.x)) for r in texts.mapInArrow(choose, "kind string, votes string, x array<int>").collect()] if counts else []
    return learn(counts, sample)


def written(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def find_personal_data(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and
    n_added (spans beyond the base), one row for each row of docs; repeated
    rows stay.  A null or empty text has no spans (spans is ''; base_sha256 is
    the digest of '').  Spans count code points, end exclusive; spans of
    different base kinds may overlap, added ones overlap nothing.  Other
    columns of docs are not read.
    """
    model = model or fit(docs)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                every = spans(text, model)
                base = base_spans(text) if every else []
                base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
                n = Counter(k for _, _, k in base)
                rows.append((n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """docs with every span of personal data replaced by its kind in square brackets, all columns and rows kept; null texts stay null."""
    model = model or fit(docs.select(F.col(text).alias("text")))
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                found = spans(t, model)
                if found:
                    parts, past = [], 0
                    for s, e, k in found:
                        if s >= past:
                            parts += [t[past:s], f"[{k.upper()}]"]
                        past = max(past, e)
                    t = "".join([*parts, t[past:]])
                out.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


__all__ = ["find_personal_data", "fit", "redact"]

"""License scan: Aho-Corasick over words, and expressions of identifier tags by shunting-yard (operator 4)."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table, words

#: Phrases of the contract and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices that the method adds.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "the bsd license": "bsd",
    "2 clause bsd": "bsd-2",
    "3 clause bsd": "bsd-3",
    "isc license": "isc",
    "boost software license": "bsl-1",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license": "apache-2",
    "licensed under the mit license": "mit",
    "gnu general public license": "gpl",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "sil open font license": "ofl",
    "python software foundation license": "psf",
    "microsoft public license": "ms-pl",
    "server side public license": "sspl",
    "business source license": "busl",
    "artistic license": "artistic",
    "the unlicense": "unlicense",
    "zlib license": "zlib",
    "open database license": "odbl",
}
TAG = "spdx license identifier"
#: Identifiers whose label isn't their lower-case form.
SHORT = {"apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "mpl-2.0": "mpl-2", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3", "cc-by-sa-4.0": "cc-by-sa", "cc-by-4.0": "cc-by", "cc0-1.0": "cc0"}
TAGGED = re.compile(r"spdx[^\S\n]*-[^\S\n]*license[^\S\n]*-[^\S\n]*identifier[^\S\n]*:([^\n]*)", re.I)
TOKEN = re.compile(r"\s*(?:([A-Za-z0-9][A-Za-z0-9.+-]*)|([()]))")
#: How sure a hit of each kind is of the licence.
SURE = {"base": 0.9, "notice": 0.7, "tag": 0.95}
BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """A licence expression in postfix order, operators in lower case, by two stacks.

    ``with`` binds tightest, then ``and``, then ``or``.  Reading ends where
    the expression can't go on; an operator without its right side and
    brackets that stay open are dropped.  What isn't an expression gives [].
    """
    out: list[str] = []
    held: list[str] = []
    operand = True
    at = 0
    while m := TOKEN.match(expression, at):
        name, bracket = m.groups()
        op = name.lower() if name else ""
        if operand:
            if bracket == "(":
                held.append("(")
            elif name and op not in BINDS:
                out.append(SHORT.get(op.removesuffix("-only").removesuffix("-or-later").removesuffix("+"), op))
                operand = False
            else:
                break
        elif op in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[op]:
                out.append(held.pop())
            held.append(op)
            operand = True
        elif bracket == ")" and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            break
        at = m.end()
    if operand:  # an operator or a bracket waits for what never came
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    out += [op for op in reversed(held) if op != "("]
    return out if _balanced(out) else []


def _balanced(tokens: list[str]) -> bool:
    depth = 0
    for t in tokens:
        depth += -1 if t in BINDS else 1
        if depth < 1:
            return False
    return depth == 1


def allows(tokens: list[str], accepted) -> bool:
    """Whether a postfix expression can be met with accepted licences; an exception (``with``) never narrows its licence."""
    stack: list[bool] = []
    for t in tokens:
        if t in BINDS:
            right, left = stack.pop(), stack.pop()
            stack.append(left and right if t == "and" else left or right if t == "or" else left)
        else:
            stack.append(t in accepted)
    return bool(stack and stack[-1])


def names(tokens: list[str]) -> set[str]:
    """Licences of a postfix expression; exceptions (right sides of ``with``) aren't licences."""
    stack: list[set[str]] = []
    for t in tokens:
        if t in BINDS:
            right, left = stack.pop(), stack.pop()
            stack.append(left if t == "with" else left | right)
        else:
            stack.append({t})
    return stack[-1] if stack else set()


@lru_cache(maxsize=1)
def automaton():
    """All phrases between blanks, so that hits are whole words."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", ("base", len(phrase), label))
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", ("notice", len(phrase), label))
    found.add_word(f" {TAG} ", ("tag", len(TAG), ""))
    found.make_automaton()
    return found


def scan(text: str | None, accepted=frozenset({"mit", "apache-2", "bsd-2", "bsd-3", "isc"})) -> dict:
    """All hits of one text; accepted: licences that an expression is evaluated against."""
    found = words(text)
    starts, base, more, sure, allowed = [], set(), set(), 1.0, None
    if found:
        joined = f" {' '.join(found)} "
        seen_at, seen_words = 0, -1
        tagged = False
        hits = sorted((end - length - 1, kind, label) for end, (kind, length, label) in automaton().iter(joined))
        kinds = set()
        for start, kind, label in hits:
            seen_words += joined.count(" ", seen_at, start + 1)
            seen_at = start + 1
            if kind == "base":
                starts.append(seen_words)
                base.add(label)
            elif kind == "notice":
                more.add(label)
            tagged |= kind == "tag"
            if kind != "tag":
                kinds.add((kind, label))
        if tagged:
            for m in TAGGED.finditer(text):
                tokens = postfix(m[1])
                if tokens:
                    more |= names(tokens)
                    kinds |= {("tag", x) for x in names(tokens)}
                    allowed = allows(tokens, accepted) if allowed is None else allowed and allows(tokens, accepted)
        for kind, _ in kinds:
            sure *= 1 - SURE[kind]
    return {
        "n_words": len(found), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more)), "score": 1 - sure if base or more else 0.0, "allowed": allowed,
    }


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences that every whole text names.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and allowed (whether the text's tagged expressions can be
    met with permissive licences, null without a tag), one row for each row of
    docs; repeated rows stay.  A null or empty text has no words and no
    labels, and score 0.  Overlapping places all count.  Other columns of docs
    are not read.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, allowed boolean"
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "allowed": pa.bool_()}

    def run(batches):
        for batch in batches:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds.items())], ["doc_id", *kinds])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))

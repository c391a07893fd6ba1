"""Exact token counts by prefix dynamic programming (operator 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import bpe
from tallyforge.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """Tokens of every whole text, the table of its prefixes' counts, and where a limit of tokens ends.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit),
    fit_chars (characters of the longest prefix of at most limit tokens) and
    prefix_steps, one row for each row of docs; repeated rows stay.
    prefix_steps holds the exact token count of every prefix as differences, a
    signed byte for each character, so that any later question of length or
    truncation is a look-up (``fitting``) without the text.  A null text
    counts as an empty one: no bytes, no tokens, an empty table.  Other columns
    of docs are not read.
    """
    path = path or vocabulary()
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_steps binary"

    def count(batches):
        coder = bpe.load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            steps = [coder.steps(t) for t in texts]
            tokens = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            columns = [
                batch.column(0),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
                pa.array([len(s) if n <= limit and len(s) < limit else bpe.fit(s, limit) for s, n in zip(steps, tokens, strict=True)], pa.int64()),
                pa.array(steps, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_steps"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, schema)


def fitting(counted: DataFrame, budget: int) -> DataFrame:
    """Characters of each text that fit a budget of tokens, from the stored tables alone.

    counted(doc_id, prefix_steps) as token_counts gives it; returns doc_id and
    fit_chars, one row for each row.  A null table counts as an empty one;
    a budget below 0 fits nothing (-1).
    """
    schema = f"doc_id {dict(counted.dtypes)['doc_id']}, fit_chars long"

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.fit(s or b"", budget) for s in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fit_chars"])

    return counted.select("doc_id", "prefix_steps").mapInArrow(run, schema)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

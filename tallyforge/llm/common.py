"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts, after A-Z were lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RE = re.compile(WORD)
#: The same class turned round, for Spark's split().
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_TABLE = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(LOWER_TABLE)


def words(text: str | None) -> list[str]:
    """Words of a text; a null text has none."""
    return WORD_RE.findall(ascii_lower(text)) if text else []


def words_col(text):
    """Words of a text column as an array, never null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def fold(doc_id, k: int):
    """crc32 of the id as text, modulo k; a null id falls in fold 0 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def boxed(docs: DataFrame, **columns) -> DataFrame:
    """Each row of docs as one column, row, beside columns worked out from it: no name of docs can clash; select("row.*") opens it."""
    return docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(k) for k, c in columns.items()])


def two_hashes(*columns) -> tuple:
    """128 bits that tell rows of columns apart, as two columns of 64."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *reversed(columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets one on its machine; with any other
    master it must be set, as executors don't see each other's folders.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[0-9*,]+\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share (master {master})")
        at = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of tables that both grow with the input: sorted and merged, never broadcast, as a table broadcast stands in the driver several times over, and Spark goes by its packed size."""
    return left.join(right.hint("merge"), on, how)


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """What is stored inside, but for what is marked outer, is deleted at the end: it must not be read later."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(spark: SparkSession, df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: what was computed once is read again from a store
    that outlives executors, and rows that carry a task's own numbering stay as
    they were when that task committed.  outer: it outlives the scratch that
    it is written in.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = _SCRATCH[:-1] if outer else _SCRATCH
    if held:
        held[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)

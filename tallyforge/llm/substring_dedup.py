"""Passages that repeat across documents, by content-defined chunking (operator 2).

A gear hash rolls over the bytes of a text; a chunk ends where the hash is
larger than at any place nearby.  Whether a place is a cut depends on the
bytes around it alone, so a passage has the same cuts wherever it stands, and
what is inserted before it shifts nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import boxed, stored, table

#: Bytes on either side that a cut's hash is the largest among: chunks have RADIUS + 1 bytes at least, twice as many on average.
RADIUS = 24
#: Bytes of a chunk at most, about: a periodic stretch has no largest hash and is cut this often from its start on.
MOST = 1024
#: Bytes that the rolling hash sees (a doubling of 1).
SEEN = 16
#: Bytes of neighbouring repeated chunks from which they are a repeated passage.
LEAST = 64


def gear() -> np.ndarray:
    """A fixed random number for each byte."""
    return np.random.default_rng(16).integers(0, 1 << 32, 256, np.uint32)


def rolled(data: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum of the last SEEN bytes' numbers, each shifted by its distance, by doubling."""
    h, width = table_[data], 1
    while width < SEEN:
        h[width:] += h[:-width] << np.uint32(width)  # the right side is read before it is written
        width *= 2
    return h


def cuts(data: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends: the hash there is larger than at the RADIUS places before and after.

    Ties go to the later place, so equal hashes in a row cut nothing until
    they end; what is longer than MOST is cut at every MOST bytes from its
    start (or at the next start of a character).
    """
    n = len(data)
    if n <= RADIUS:
        return np.zeros(0, np.int64)
    h = rolled(data, table_) * np.uint32(0x9E3779B1)
    h[:-1][(data[1:] & 0xC0) == 0x80] = 0  # never inside a character
    # largest of the RADIUS places after and before each, by doubling windows
    ahead, width = h.copy(), 1
    while width < RADIUS:
        step = min(width, RADIUS - width)
        ahead[: n - step] = np.maximum(ahead[: n - step], ahead[step:])
        width += step
    after = np.zeros(n, np.uint32)
    after[: n - 1] = ahead[1:]
    before = np.zeros(n, np.uint32)
    before[RADIUS:] = ahead[: n - RADIUS]
    at = np.nonzero((h > after) & (h >= before))[0]
    at = at[(at >= RADIUS) & (at < n - RADIUS)] + 1
    ends = np.concatenate([[0], at, [n]])
    long = np.flatnonzero(np.diff(ends) > MOST)
    if len(long):
        more = np.concatenate([np.arange(ends[i] + MOST, ends[i + 1], MOST) for i in long])
        while (inside := (more < n) & (data[np.minimum(more, n - 1)] & 0xC0 == 0x80)).any():
            more[inside] += 1
        at = np.union1d(at, more[more < n])
    return at


def chunks(docs: DataFrame) -> DataFrame:
    """rid, doc_id, ordinal, start, length (bytes) and digest of every chunk of every whole text."""
    schema = f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, ordinal int, start long, length int, digest binary"

    def cut(batches):
        import xxhash

        own, digest = gear(), xxhash.xxh3_128_digest
        for batch in batches:
            which, ordinal, starts, sizes, digests = [], [], [], [], []

            def table_of():
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which, pa.int64())), batch.column(1).take(pa.array(which, pa.int64())), pa.array(ordinal, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())],
                    ["rid", "doc_id", "ordinal", "start", "length", "digest"],
                )

            for i, text in enumerate(batch.column(2).to_pylist()):
                raw = (text or "").encode()
                if raw:
                    ends = [*cuts(np.frombuffer(raw, np.uint8), own).tolist(), len(raw)]
                    start = 0
                    for k, end in enumerate(ends):
                        if end > start:
                            which.append(i)
                            ordinal.append(k)
                            starts.append(start)
                            sizes.append(end - start)
                            digests.append(digest(raw[start:end]))
                        start = end
                if len(which) > 200_000:
                    yield table_of()
                    which, ordinal, starts, sizes, digests = [], [], [], [], []
            if which:
                yield table_of()

    text = F.col("text").cast("string")
    return docs.select(F.xxhash64("doc_id", text).alias("rid"), "doc_id", text.alias("text")).mapInArrow(cut, schema)


def repeats(cut: DataFrame) -> DataFrame:
    """Repeated passages (rid, start, length, n_chunks): neighbouring chunks that stand earlier too, LEAST bytes or more together.

    The first place of a chunk, by doc_id, rid and start, is the one that
    stays.  A chunk's places are summed up before the shuffle, and only chunks
    of several places go on.
    """
    place = F.struct("doc_id", "rid", "start")
    first = cut.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.rid").alias("first_rid"), F.col("first.start").alias("first_start"))
    again = cut.join(first, "digest").where("rid <> first_rid or start <> first_start").select("rid", "ordinal", "start", "length").distinct()
    order = Window.partitionBy("rid").orderBy("ordinal")
    run = F.col("ordinal") - F.row_number().over(order)
    passages = again.withColumn("run", run).groupBy("rid", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.count("*").alias("n_chunks"))
    return passages.where(F.col("length") >= LEAST).drop("run")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """How much of every whole text repeats earlier text.

    Returns doc_id, n_bytes, n_spans (repeated passages), n_repeated (their
    bytes), spans (start:length in bytes, comma-joined) and repeated, one row
    for each row of docs.  Earlier means a smaller doc_id, then the text's
    hash, then the place; what stands first stays unmarked.  Repeated rows
    (the same id and text) are one text, marked alike.  Null and empty texts
    have no passages; texts of the same id are told apart.  Other columns are
    not read.
    """
    cut = stored(docs.sparkSession, chunks(docs), "chunks")
    found = repeats(cut).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    text = F.col("text").cast("string")
    every = docs.select(F.xxhash64("doc_id", text).alias("rid"), "doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    joined = every.join(found, "rid", "left")
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["length"])), ",")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    n = F.coalesce(F.size("spans"), F.lit(0)).cast("long")
    none = F.col("spans").isNull()
    return joined.select(
        "doc_id", "n_bytes", F.when(none, 0).otherwise(n).cast("long").alias("n_spans"), F.when(none, 0).otherwise(total).cast("long").alias("n_repeated"), F.when(none, "").otherwise(written).alias("spans"), (~none).alias("repeated")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of text, all columns and rows kept; null texts stay null."""
    cut = stored(docs.sparkSession, chunks(docs), "chunks")
    found = repeats(cut).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    text = F.col("text").cast("string")
    joined = boxed(docs, rid=F.xxhash64("doc_id", text), raw=text.cast("binary")).join(found, "rid", "left")
    # what stands before each passage, and what stands behind the last
    step = F.aggregate(
        "spans",
        F.struct(F.lit(b"").cast("binary").alias("out"), F.lit(0).cast("long").alias("past")),
        lambda a, s: F.struct(F.concat(a["out"], F.substring("raw", (a["past"] + 1).cast("int"), (s["start"] - a["past"]).cast("int"))).alias("out"), (s["start"] + s["length"]).alias("past")),
    )
    stepped = joined.select("row", "raw", step.alias("step"))
    cleaned = F.concat(F.col("step.out"), F.substring("raw", (F.col("step.past") + 1).cast("int"), F.octet_length("raw"))).cast("string")
    whole = F.when(F.col("step").isNull(), F.col("row.text")).otherwise(cleaned)
    return stepped.select(*[whole.alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))

"""Packing of documents into sequences by best fit and swap-based local search (operator 5).

The plan is made on lengths alone: there are at most ``size`` of them, and
bins with the same lengths in them are one pattern with a count.  So the plan
and the search for a better one are as large for ten documents as for ten
billion.  Documents then take the places of their length in a fixed order.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import bpe
from tallyforge.llm.common import stored, table
from tallyforge.llm.token_counts import vocabulary

SIZE = 1024
END = 2

Pattern = tuple[int, ...]


def best_fit(lengths: dict[int, int], size: int = SIZE) -> Counter[Pattern]:
    """Best fit, longest first, over counted lengths: pattern (lengths, longest first) -> bins."""
    room: dict[int, Counter[Pattern]] = {}
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            rest = next((r for r in range(length, size) if room.get(r)), size)
            if rest == size:
                each = size // length
                bins, odd = divmod(left, each)
                if bins:
                    room.setdefault(size - each * length, Counter())[(length,) * each] += bins
                if odd:
                    room.setdefault(size - odd * length, Counter())[(length,) * odd] += 1
                break
            pattern, bins = next(iter(room[rest].items()))
            each = min(rest // length, left)
            take = min(bins, left // each)
            if take == bins:
                del room[rest][pattern]
            else:
                room[rest][pattern] -= take
            room.setdefault(rest - each * length, Counter())[pattern + (length,) * each] += take
            left -= take * each
    return Counter({p: n for patterns in room.values() for p, n in patterns.items()})


def improve(bins: Counter[Pattern], size: int = SIZE) -> Counter[Pattern]:
    """Local search: move a document, or exchange one for one, two for one or one for two, between underfull bins.

    Each step takes tokens out of an emptier bin and into a fuller one, which
    increases the sum of squared fills, until bins are empty and go.  As that
    sum has a bound, the search ends: when no step helps, or when the bins are
    as few as their tokens allow.  A step is taken for all bins of its two
    patterns at once.
    """
    bins = Counter({p: n for p, n in bins.items() if n})
    tokens = sum(sum(p) * n for p, n in bins.items())
    fewest = -(-tokens // size)
    count = sum(bins.values())
    stuck: set[Pattern] = set()
    moved = False
    open_bins = {p for p in bins if sum(p) < size}
    while count > fewest:
        source = min((p for p in open_bins if p not in stuck), key=lambda p: (sum(p), p), default=None)
        if source is None:
            if not moved:
                break
            stuck, moved = set(), False  # once more, with what the steps have changed
            continue
        found = _exchange(source, open_bins, bins, size)
        if found is None:
            stuck.add(source)
            continue
        moved = True
        target, out, back = found
        times = min(bins[source], bins[target]) if target != source else bins[source] // 2
        new_source, new_target = _swap(source, out, back), _swap(target, back, out)
        for p, n in ((source, -times), (target, -times), (new_source, times), (new_target, times)):
            if p:
                bins[p] += n
                if not bins[p]:
                    del bins[p]
                if p in bins and sum(p) < size:
                    open_bins.add(p)
                else:
                    open_bins.discard(p)
        if not new_source:
            count -= times
    return bins


def _swap(pattern: Pattern, out: Pattern, into: Pattern) -> Pattern:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *into], reverse=True))


def _parts(pattern: Pattern) -> list[Pattern]:
    """One or two of a pattern's documents, each choice of lengths once."""
    ones = sorted(set(pattern), reverse=True)
    twos = {tuple(sorted((a, b), reverse=True)) for i, a in enumerate(pattern) for b in pattern[i + 1 :]}
    return [(a,) for a in ones] + sorted(twos, reverse=True)


def _exchange(source: Pattern, open_bins: set[Pattern], bins: Counter[Pattern], size: int):
    """The exchange that moves most tokens from source into a bin at least as full; one that fills a bin is taken at once."""
    fill = sum(source)
    choices = _parts(source)
    best, moved = None, 0
    for target in sorted(open_bins, key=lambda p: (-sum(p), p)):
        full = sum(target)
        if full < fill or target == source and bins[source] < 2:
            continue
        rest = size - full
        if rest <= moved:
            continue
        backs = [(), *_parts(target)]
        for out in choices:
            gives = sum(out)
            for back in backs:
                d = gives - sum(back)
                if len(out) + len(back) > 3 or d > rest or d <= moved:
                    continue
                best, moved = (target, out, back), d
                if d == rest:
                    return best
    return best


def plan(lengths: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Places by length: (length, first rank, end of ranks, sequence of the first rank, offset); the documents of one length are ranked from 0."""
    used: Counter[int] = Counter()
    out, sequence = [], 0
    for pattern, n in sorted(improve(best_fit(lengths, size), size).items(), reverse=True):
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return sorted(out)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, with the task (part) and the piece's number among those of its length there (place)."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * with_ids
    closing = int(end).to_bytes(4, "little")

    def cut(batches):
        from pyspark import TaskContext

        coder, part, seen = bpe.load(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, which = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = coder.ids(text or "") + closing
                n = len(ids) // 4
                at, to = 0, n % size or size
                piece = 0
                while at < n:
                    own = ids[4 * at : 4 * to]
                    rows.append((piece, at, to - at, zlib.crc32(own), seen[to - at], *[own] * with_ids))
                    seen[to - at] += 1
                    which.append(i)
                    at, to, piece = to, to + size, piece + 1
            c = list(zip(*rows, strict=True)) or [[]] * (5 + with_ids)
            columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(c[0], pa.int32()), *(pa.array(x, pa.int64()) for x in c[1:4]), pa.array([part] * len(rows), pa.int32()), pa.array(c[4], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            if with_ids:
                columns.append(pa.array(c[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most size tokens as the search finds.

    A document is its tokens and the end token; longer ones are cut into
    pieces of size tokens, the first of which may be shorter.  Returns doc_id,
    piece, start, length, ids_crc32, sequence_id and offset (and the piece's
    ids), one row for each piece; each row of docs is a document, so repeated
    rows are packed as often as they stand.  A null or empty text is the end
    token alone.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    cut = stored(spark, pieces(docs, path or vocabulary(), size, end, with_ids), "pieces")
    # a count for each task and length; the length's earlier tasks give the rank that a task's first piece has
    tasks = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    lengths = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = tasks.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    places = np.array(plan(lengths, size), np.int64).reshape(-1, 5)
    # the size of the plan follows from the number of lengths and patterns, not of documents
    shared = spark.sparkContext.broadcast((places[:, 0] << 44 | places[:, 1], places))
    ranked = cut.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"), *["ids"] * with_ids)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids

    def place(batches):
        keys, rows = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            columns = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                columns.append(batch.column("ids"))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (little-endian unsigned 32-bit) of whole sequences, from what pack gives with_ids; no rows from none."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

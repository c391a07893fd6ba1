"""Similarity join on word shingles with Bayesian candidate pruning (operator 6).

Texts with the same words are one representative.  Representatives whose
MinHash values agree on a band meet in a bucket; there pairs are compared a few
values at a time and dropped as soon as it is too unlikely that they reach the
threshold.  What survives ties texts into groups, every text's shingles go to
its group once, and there the pairs that survive the same test are verified on
their shingles (sets of 64-bit hashes).  Pairs are counted where they are
found and never listed.

Where it only matters which texts hang together, a large bucket or group is
compared with one of its members first; only what isn't near that one is
compared with all others, block by block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyforge.llm.common import boxed, joined, scratch, stored, table, two_hashes, words
from tallyforge.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
#: MinHash values of a text, values of a band, values compared before each decision.
VALUES, ROWS, STEP = 128, 4, 16
#: A pair is dropped when it reaches the threshold with less than this probability.
TOLERANCE = 1e-6
#: Texts of a block; a larger bucket or group is compared block by block.  Shingles of a block, about.
BLOCK, SHINGLES = 512, 4_000_000
#: Bytes of large buckets' or groups' first members up to which these are broadcast.
PIVOTS = 8_000_000
REMEMBER = 100_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word):
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = h
        return h


def shingles(found: list[str], hashes: _Hashes) -> np.ndarray:
    """Distinct hashes of runs of five words, sorted; a text of fewer words, but not none, is one run."""
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(SHINGLE, len(found))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ w[j : len(w) - k + 1 + j]) * PRIME
        out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    return random.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, VALUES, np.uint64)


def signature(x: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set, 16 bits of each."""
    a, b = permutations()
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512, None] * a + b).min(0), out=least)
    return ((least * MIX) >> np.uint64(48)).astype("<u2")


@lru_cache(maxsize=4)
def enough(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Agreeing values that a pair needs after n compared ones.

    With a uniform prior and m of n agreeing, the similarity reaches the
    threshold with the probability that n + 1 draws of that chance succeed at
    most m times.
    """
    t = Fraction(threshold).limit_denominator(1000)
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        total, m = Fraction(0), -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def plausible(sig: np.ndarray) -> np.ndarray:
    """Matrix of the pairs that pruning leaves: compared STEP values at a time, dropped when too few agree."""
    m = len(sig)
    agree = np.zeros((m, m), np.uint8)
    alive = ~np.eye(m, dtype=bool)
    need = enough()
    columns = np.ascontiguousarray(sig.T)
    for n in range(STEP, VALUES + 1, STEP):
        if m > 64 and n > 2 * STEP:
            i, j = np.nonzero(np.triu(alive))
            if len(i) * 8 < m * m:  # few are left: compare these alone
                counts = agree[i, j].astype(np.int64)
                for to in range(n, VALUES + 1, STEP):
                    counts += (sig[i, to - STEP : to] == sig[j, to - STEP : to]).sum(1)
                    ok = counts >= need[to]
                    i, j, counts = i[ok], j[ok], counts[ok]
                alive = np.zeros((m, m), bool)
                alive[i, j] = alive[j, i] = True
                return alive
        if m <= 64:
            agree += (sig[:, None, n - STEP : n] == sig[None, :, n - STEP : n]).sum(2, dtype=np.uint8)
        else:
            for c in columns[n - STEP : n]:
                agree += c[:, None] == c[None, :]
        alive &= agree >= need[n]
        if not alive.any():
            break
    return alive


def roots(near: np.ndarray) -> np.ndarray:
    """Number of the first member of each member's connected part."""
    m = len(near)
    out = np.full(m, -1)
    for start in range(m):
        if out[start] < 0:
            out[start] = start
            front = np.array([start])
            while len(front):
                reached = near[front].any(0) & (out < 0)
                out[reached] = start
                front = np.nonzero(reached)[0]
    return out


def verified(near: np.ndarray, sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Of the pairs in near, those whose sets reach the threshold, exactly."""
    t = Fraction(threshold).limit_denominator(1000)
    p, q = t.numerator, t.denominator
    size = np.array([len(s) for s in sets], np.int64)
    i, j = np.nonzero(np.triu(near))
    ok = q * np.minimum(size[i], size[j]) >= p * np.maximum(size[i], size[j])
    i, j = i[ok], j[ok]
    if len(i) > 4 * len(sets):
        shared = _intersections(sets)[i, j]
    else:
        shared = np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)), np.int64, len(i))
    ok = (p + q) * shared >= p * (size[i] + size[j])  # shared / (size i + size j - shared) >= p / q
    out = np.zeros_like(near)
    out[i[ok], j[ok]] = out[j[ok], i[ok]] = True
    return out


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, by products of parts of the incidence matrix."""
    m = len(sets)
    every, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    number = np.cumsum(n > 1) - 1
    keep = n[which] > 1
    owner, column = owner[keep], number[which[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((m, m))
    for first in range(0, int((n > 1).sum()), 2048):
        a, b = np.searchsorted(column, [first, first + 2048])
        x = np.zeros((m, 2048), np.float32)
        x[owner[a:b], column[a:b] - first] = 1
        total += x @ x.T
    return np.rint(total).astype(np.int64)


def runs(batches, key: str):
    """Rows of each key as one table, from batches sorted by key."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = held.column(key).to_numpy()
        cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None:
        yield held


def _signatures(sig: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), "<u2").reshape(-1, VALUES)


def signed(docs: DataFrame) -> DataFrame:
    """rid (a number for each row), hash_a and hash_b (128 bits of id and text), doc_id, key (digest of the words; null without words), n_shingles and sig of every whole text.

    The numbers hold once the table is stored.
    """
    schema = f"rid long, hash_a long, hash_b long, doc_id {dict(docs.dtypes)['doc_id']}, key binary, n_shingles long, sig binary"

    def sign(batches):
        import xxhash

        hashes = _Hashes()
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for text in batch.column(4).to_pylist():
                found = words(text)
                x = shingles(found, hashes)
                keys.append(xxhash.xxh3_128_digest(" ".join(found)) if found else None)
                sizes.append(len(x))
                sigs.append(signature(x).tobytes() if found else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["rid", "hash_a", "hash_b", "doc_id", "key", "n_shingles", "sig"])

    text = F.col("text").cast("string")
    a, b = two_hashes(F.col("doc_id"), text)
    return docs.select(F.monotonically_increasing_id().alias("rid"), a.alias("hash_a"), b.alias("hash_b"), "doc_id", text.alias("text")).mapInArrow(sign, schema)


def block_of(seed: int, k):
    return F.pmod(F.xxhash64("rep", F.lit(seed)), k)


def numbers(k):
    return F.explode(F.sequence(F.lit(0).cast("long"), k - 1))


def in_blocks(members: DataFrame, group: str, k) -> DataFrame:
    """members with block, and cell: what is compared together.  Of k blocks each meets each, so a member stands in k cells of two blocks (one where k is 1)."""
    cut = members.withColumn("block", block_of(1, k)).select("*", numbers(k).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return cut.withColumn("cell", F.xxhash64(group, low, high)).withColumn("own", low == high).withColumn("low", low).drop("other")


@dataclass
class Close:
    """Which members are close: matrix(group, allowed) of the allowed pairs (None: all) of a group, rows(a, b) of each row of a with that of b."""

    matrix: Callable[[pa.Table, np.ndarray | None], np.ndarray]
    rows: Callable[[pa.Table, pa.Table], np.ndarray]


def _plausible_rows(a: pa.Table, b: pa.Table) -> np.ndarray:
    agree = (_signatures(a.column("sig")) == _signatures(b.column("sig"))).reshape(a.num_rows, -1, STEP).sum(2).cumsum(1)
    return (agree >= np.array(list(enough().values()))).all(1)


def _verified_rows(a: pa.Table, b: pa.Table) -> np.ndarray:
    out = _plausible_rows(a, b)
    for i in np.flatnonzero(out):
        out[i] = verified(np.array([[False, True], [True, False]]), [np.frombuffer(t.column("x")[int(i)].as_py(), np.uint64) for t in (a, b)])[0, 1]
    return out


def _plausible_pairs(group: pa.Table, allowed: np.ndarray | None = None) -> np.ndarray:
    near = plausible(_signatures(group.column("sig")))
    return near if allowed is None else near & allowed


def _verified_pairs(group: pa.Table, allowed: np.ndarray | None = None) -> np.ndarray:
    return verified(_plausible_pairs(group, allowed), [np.frombuffer(x, np.uint64) for x in group.column("x").to_pylist()])


PLAUSIBLE = Close(_plausible_pairs, _plausible_rows)
VERIFIED = Close(_verified_pairs, _verified_rows)


def within_cells(cells: DataFrame, close: Close) -> DataFrame:
    """Edges (a, b) that join the members of each cell that chains of close pairs tie; in a cell that isn't own (with columns own, side) only pairs of different sides count."""

    def tie(batches):
        for group in runs(batches, "cell"):
            first = np.unique(group.column("rep").to_numpy(), return_index=True)[1]  # repeated rows are one
            group = group.take(pa.array(first))
            allowed = None
            if "own" in group.column_names and not group.column("own")[0].as_py():
                side = group.column("side").to_numpy()
                allowed = side[:, None] != side[None, :]
            rep, root = group.column("rep").to_numpy(), roots(close.matrix(group, allowed))
            at = np.nonzero(root != np.arange(len(root)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[root[at]])], ["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(tie, "a long, b long")


def around_pivots(spark, members: DataFrame, details: DataFrame, close: Close) -> DataFrame:
    """Edges (a, b) that join the members of large groups that chains of close pairs tie.

    members(grp, rep, k): k is the number of blocks of the group;
    details(rep, weight, ...): what close compares, and what a member weighs in
    blocks.  Every member is compared with the first one of its group; those
    that aren't close to it, the rest, are compared with each other and with
    those that are, block by block.  A group of n copies of its first member so
    takes n comparisons and no copies of its members.
    """
    columns = [c for c in details.columns if c != "rep"]
    full = joined(members, details, "rep")
    pivots = stored(spark, full.groupBy("grp").agg(F.min(F.struct("rep", *columns)).alias("pivot")), "pivots")
    few = pivots.agg(F.coalesce(F.sum(sum((F.length(f"pivot.{c}") for c, kind in details.dtypes if kind == "binary"), F.lit(64))), F.lit(0)).alias("bytes")).collect()[0]["bytes"] <= PIVOTS
    met = (full.join(F.broadcast(pivots), "grp") if few else joined(full, pivots, "grp")).select("grp", "k", "rep", "weight", "pivot", F.struct("rep", *columns).alias("own"))

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                mine, first = (pa.Table.from_struct_array(batch.column(c)) for c in ("own", "pivot"))
                rep = first.column("rep").combine_chunks()
                near = close.rows(mine, first) | (rep.to_numpy() == batch.column("rep").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "k", "rep", "weight")), rep, pa.array(near)], ["grp", "k", "rep", "weight", "first", "close"])

    starred = stored(spark, met.mapInArrow(compare, "grp long, k long, rep long, weight long, first long, close boolean"), "starred")
    star = starred.where("close and rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    far = ~F.col("close")
    count = lambda of: blocks(F.count_if(of), F.coalesce(F.sum(F.when(of, F.col("weight"))), F.lit(0).cast("long")))
    sizes = stored(spark, starred.groupBy("grp").agg(count(far).alias("parts"), count(~far).alias("stars")).where("parts > 0"), "rest")
    if sizes.isEmpty():
        return star
    sized = starred.join(sizes, "grp")
    rest = in_blocks(sized.where(far), "grp", F.col("parts")).withColumn("side", (F.col("block") == F.col("low")).cast("int"))
    i, j = block_of(1, F.col("parts")), block_of(1, F.col("stars"))
    across = sized.where(far).select("grp", "rep", i.alias("i"), numbers(F.col("stars")).alias("j"), F.lit(0).alias("side"))
    across = across.unionByName(sized.where(~far).select("grp", "rep", numbers(F.col("parts")).alias("i"), j.alias("j"), F.lit(1).alias("side")))
    across = across.select(F.xxhash64("grp", F.lit("across"), "i", "j").alias("cell"), F.lit(False).alias("own"), "side", "rep")
    cells = rest.select("cell", "own", "side", "rep").unionByName(across)
    return star.unionByName(within_cells(joined(cells, details, "rep"), close))


def blocks(n, weight):
    """Blocks that n members of so many shingles are cut into."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(weight / SHINGLES)).cast("long")


def ties(reps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all representatives between which a chain of plausible pairs runs."""
    spark = reps.sparkSession
    band = F.explode(F.sequence(F.lit(0), F.lit(VALUES // ROWS - 1))).alias("band")
    part = F.expr(f"substring(sig, band * {2 * ROWS} + 1, {2 * ROWS})")
    banded = reps.select("rep", "sig", band).select("rep", F.xxhash64("band", part).alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("n > 1")
    # bands that gather the same texts are one bucket
    once = full.groupBy("n", "who").agg(F.min("bucket").alias("bucket"))
    members = stored(spark, joined(banded, once.select("bucket", "n"), "bucket"), "buckets")
    details = reps.select("rep", F.lit(0).cast("long").alias("weight"), "sig")
    cells = joined(members.where(F.col("n") <= BLOCK).select(F.col("bucket").alias("cell"), "rep"), details, "rep")
    found = within_cells(cells, PLAUSIBLE)
    large = members.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        found = found.unionByName(around_pivots(spark, large.select(F.col("bucket").alias("grp"), "rep", blocks(F.col("n"), F.lit(0)).alias("k")), details, PLAUSIBLE))
    return found.distinct()


def shingled(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members(rep, hash_a, hash_b, ...) without the hashes, with x: the shingles of each one's text; rows that repeat an id and its text give several."""
    a, b = two_hashes(F.col("doc_id"), F.col("text").cast("string"))
    texts = docs.select(a.alias("hash_a"), b.alias("hash_b"), F.col("text").cast("string").alias("text"))
    held = joined(texts, members, ["hash_a", "hash_b"]).select(*[c for c in members.columns if c not in ("hash_a", "hash_b")], "text")
    kept_ = [f for f in held.schema.fields if f.name != "text"]
    at = held.columns.index("text")

    def shingle(batches):
        hashes = _Hashes()
        for batch in batches:
            x = [shingles(words(t), hashes).tobytes() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept_), pa.array(x, pa.binary())], [*(f.name for f in kept_), "x"])

    return held.mapInArrow(shingle, StructType([*kept_, StructField("x", BinaryType())]))


def grouped(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """rep, grp, k (blocks), and what links needs of every tied representative of groups(rep, grp)."""
    sizes = joined(groups, reps.select("rep", "n_shingles"), "rep").groupBy("grp").agg(blocks(F.count("*"), F.sum("n_shingles")).alias("k"))
    return joined(joined(groups, sizes, "grp"), reps.select("rep", "hash_a", "hash_b", "n_shingles", "sig", "copies"), "rep")


def links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """rep, root, n_links and whole for every cell that a representative stands in.

    members: as grouped() gives them.  root is the first representative that
    verified pairs of the cell tie it to, whole whether the cell is all of its
    group.
    """
    cells = in_blocks(shingled(docs, members.drop("n_shingles")), "grp", F.col("k"))

    def count(batches):
        for group in runs(batches, "cell"):
            first = np.unique(group.column("rep").to_numpy(), return_index=True)[1]  # repeated rows are one
            group = group.take(pa.array(first))
            rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
            allowed = None
            if not group.column("own")[0].as_py():
                block = group.column("block").to_numpy()
                allowed = block[:, None] != block[None, :]
            near = _verified_pairs(group, allowed)
            root = roots(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep), pa.array(rep[root]), pa.array((near * copies[None, :]).sum(1).astype(np.int64)), pa.array(group.column("k").to_numpy() == 1)],
                ["rep", "root", "n_links", "whole"],
            )

    return cells.select("cell", "own", "block", "rep", "k", "sig", "copies", "x").repartition("cell").sortWithinPartitions("cell").mapInArrow(count, "rep long, root long, n_links long, whole boolean")


def rooted(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node and root of every representative that verified pairs tie to others, without counting the pairs; members: as grouped() gives them."""
    spark = docs.sparkSession
    # small and large groups read the texts once
    held = stored(spark, shingled(docs, members.select("rep", "grp", "k", "hash_a", "hash_b", F.col("n_shingles").alias("weight"), "sig")), "shingles")
    edges = within_cells(held.where("k = 1").select("rep", F.col("grp").alias("cell"), "sig", "x"), VERIFIED)
    large = held.where("k > 1")
    if not large.isEmpty():
        # repeated rows are one
        details = large.groupBy("rep").agg(*[F.first(c).alias(c) for c in ("weight", "sig", "x")])
        edges = edges.unionByName(around_pivots(spark, large.select("grp", "rep", "k").distinct(), stored(spark, details, "details"), VERIFIED))
    return components(edges)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Texts whose sets of five-word runs have a Jaccard similarity of THRESHOLD or more.

    Returns doc_id, class_id (the smallest doc_id that chains of such links
    reach), n_links (other rows so similar, copies included) and n_copies
    (other rows with the same words), one row for each row of docs.  Rows that
    repeat an id and its text count as copies of each other.  A text without
    words, or null, has no links and is its own class; one of fewer than five
    words is similar to texts with the same words alone.  Other columns are
    not read.

    Two texts at the threshold share no band of their MinHash values with a
    probability of 5e-8, and pruning drops them with at most TOLERANCE at each
    step; what is counted is verified on the shingles themselves.
    """
    spark = docs.sparkSession
    every, reps, members = candidates(docs)
    with scratch(spark):
        cells = stored(spark, links(docs, members), "links")
        apart = cells.where("not whole and rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
        found = cells.where("whole and rep <> root").select(F.col("rep").alias("node"), "root").unionByName(components(apart))
        counted = cells.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
        linked = joined(joined(reps.select("key", "rep", "copies", "least_id"), counted, "rep", "left"), found.withColumnRenamed("node", "rep"), "rep", "left")
        linked = stored(spark, linked.withColumn("root", F.coalesce("root", "rep")), "linked")
        # classes are settled among representatives; both tables are stored, so that the join can split the rows of a large class
        ids = stored(spark, linked.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count("*").alias("n")).where("n > 1"), "classes")
        linked = joined(linked, ids.drop("n"), "root", "left")
        copies = F.col("copies") - 1
        settled = linked.select("key", F.coalesce("class_id", "least_id").alias("class_id"), (F.coalesce("n_links", F.lit(0).cast("long")) + copies).alias("n_links"), copies.alias("n_copies"))
        settled = stored(spark, settled, "settled", outer=True)
    rows = joined(every.where("key is not null").select("doc_id", "key"), settled, "key").drop("key")
    none = F.lit(0).cast("long")
    return rows.unionByName(every.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_copies")))


def kept(docs: DataFrame) -> DataFrame:
    """One row of docs of each class, all columns: that of the smallest doc_id; one without an id only where no row of the class has one.

    Rows that repeat an id and its text are one document.  Texts without words
    are all kept.  Links aren't counted, so that a group of n near copies takes
    n comparisons.
    """
    spark = docs.sparkSession
    every, reps, members = candidates(docs)
    with scratch(spark):
        found = stored(spark, rooted(docs, members).withColumnRenamed("node", "rep"), "rooted", outer=True)
    linked = joined(reps.select("rep", "first"), found, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    chosen = linked.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.hash_a").alias("kept_a"), F.col("first.hash_b").alias("kept_b"))
    chosen = chosen.unionByName(every.where("key is null").select(F.col("hash_a").alias("kept_a"), F.col("hash_b").alias("kept_b")).distinct())
    a, b = two_hashes(F.col("doc_id"), F.col("text").cast("string"))
    own = joined(boxed(docs, kept_a=a, kept_b=b), stored(spark, chosen, "kept"), ["kept_a", "kept_b"], "left_semi")
    return own.dropDuplicates(["kept_a", "kept_b"]).select("row.*")


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows signed, the representatives of equal words, and those that plausible pairs tie, by group."""
    spark = docs.sparkSession
    every = stored(spark, signed(docs), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "rid", "hash_a", "hash_b", "n_shingles", "sig")
    reps = every.where("key is not null").groupBy("key").agg(F.min(first).alias("f"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"))
    reps = reps.select("key", F.col("f.rid").alias("rep"), F.col("f.hash_a").alias("hash_a"), F.col("f.hash_b").alias("hash_b"), F.col("f.n_shingles").alias("n_shingles"), F.col("f.sig").alias("sig"), "copies", "least_id", F.struct("f.without", "f.doc_id", "f.rid", "f.hash_a", "f.hash_b").alias("first"))
    reps = stored(spark, reps, "representatives")
    with scratch(spark):
        groups = stored(spark, components(ties(reps)).select(F.col("node").alias("rep"), F.col("root").alias("grp")), "groups", outer=True)
    return every, reps, grouped(reps, groups)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Benchmark decontamination by a positional inverted index (operator 7), in DataFrame functions only.

One pass over the training texts stores the postings (text, place) of every
test term.  The lists of the rarest terms of each test window are shifted by
the terms' places in the window and intersected; what is left is met with the
lists of all its other terms, so that a match is exact.  The lists of an
item's rarest terms also give its proximity matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import LOWER, NOT_WORD, UPPER, boxed, scratch, stored, table, two_hashes, words_col

WINDOW = 10
#: Lists of a window's rarest terms that are intersected before all others are.
LISTS = 2
#: Rarest terms of an item that a proximity match has, and words that they stand within.
NEAR, WITHIN = 3, 30
#: Words of test items up to which tables made of them are broadcast (some 50 MB); larger ones are joined by shuffles.
BROADCAST_WORDS = 200_000
#: Texts up to which the ids of those with candidates are broadcast (some 30 MB).
BROADCAST_TEXTS = 500_000


@dataclass
class Index:
    """Test items and the postings of their terms.

    items(ikey, item_id, words), places(ikey, place, t): the terms of the
    items by number, terms(t, term, n): how often each stands in the training
    texts, postings(rid, t, pos), texts(rid, doc_id, n_words and what was
    kept).  small() marks a table made of test items alone for broadcasting,
    if there are few enough.
    """

    items: DataFrame
    places: DataFrame
    terms: DataFrame
    postings: DataFrame
    texts: DataFrame
    small: Callable[[DataFrame], DataFrame]


def build(docs: DataFrame, benchmark: DataFrame, **keep) -> Index:
    """Store the index of docs(doc_id, text) for the terms of benchmark(item_id, text).

    Every row of docs is a text of its own, by a number that its first writing
    fixes.  keep: further columns of texts, by name.  Items without words, and
    repeated items, are left out; a null id is an id like others.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", words_col(F.col("text").cast("string")).alias("words")).where("size(words) > 0").distinct()
    items = stored(spark, items.select(F.monotonically_increasing_id().alias("ikey"), "item_id", "words"), "items")
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).collect()[0].n
    small = F.broadcast if total <= BROADCAST_WORDS else lambda df: df
    named = items.select("ikey", F.posexplode("words").alias("place", "term"))
    terms = stored(spark, named.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")), "terms")
    # the parts between what isn't a word; the first and the last may be empty
    parts = F.split(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), NOT_WORD)
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), *[c.alias(k) for k, c in keep.items()], parts.alias("parts"))
    lead = F.when(F.get("parts", F.lit(0)) == "", 1).otherwise(0)
    trail = F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    kept = ["doc_id", *keep]
    own = own.select("rid", *kept, lead.alias("lead"), (F.size("parts") - lead - trail).cast("long").alias("n_words"), F.posexplode("parts").alias("at", "term"))
    first = F.col("at") == 0  # every text has this row, which also stands for the text itself
    met = own.join(small(terms), "term", "left").where(F.col("t").isNotNull() | first)
    rows = met.select("rid", *[F.when(first, F.col(c)).alias(c) for c in [*kept, "n_words"]], "t", (F.col("at") - F.col("lead")).alias("pos"))
    index = stored(spark, rows, "index")
    postings = index.where("t is not null").select("rid", "t", "pos")
    counted = stored(spark, postings.groupBy("t").agg(F.count("*").alias("n")), "frequencies")
    terms = terms.join(small(counted), "t")  # terms that no text has are gone
    return Index(items, named.join(small(terms), "term", "left").select("ikey", "place", "t", "n"), terms, postings, index.where("n_words is not null").drop("t", "pos"), small)


def windows(index: Index, window: int = WINDOW) -> DataFrame:
    """ikey, start, length, rarest (a place) and need (places) of the windows whose terms all occur.

    Windows are of so many words of one item; an item of fewer is one window.
    need are the places of its LISTS rarest terms.
    """
    size = F.size("words")
    cut = index.items.select("ikey", F.explode(F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)))).alias("start"), F.least(size, F.lit(window)).alias("length"))
    each = cut.select("*", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place")).join(index.places, ["ikey", "place"])
    order = Window.partitionBy("ikey", "start").orderBy(F.col("n").asc_nulls_last(), "place")
    rated = each.withColumn("r", F.row_number().over(order))
    grouped = rated.groupBy("ikey", "start", "length").agg(F.count("n").alias("known"), F.min(F.when(F.col("r") == 1, F.col("place"))).alias("rarest"), F.collect_set(F.when(F.col("r") <= LISTS, F.col("place"))).alias("need"))
    return grouped.where("known = length").drop("known")


def phrase_matches(index: Index, window: int = WINDOW) -> DataFrame:
    """Runs of words that an item and a training text share: rid, item_id, first and last (places in the text), each at least a window long.

    A posting at pos of the term at an item's place puts the item at
    pos - place of the text.  The lists of a window's rarest terms, so shifted,
    are intersected; every place of the windows that they agree on is then
    looked up in the list of its own term.
    """
    spark = index.items.sparkSession
    cut = stored(spark, windows(index, window), "windows")
    anchors = cut.select("ikey", F.explode("need").alias("place")).distinct().join(index.places, ["ikey", "place"]).select("ikey", "place", "t")
    shifted = index.postings.join(index.small(anchors), "t").select("rid", "ikey", (F.col("pos") - F.col("place")).alias("shift"), "place")
    met = shifted.groupBy("rid", "ikey", "shift").agg(F.collect_set("place").alias("have"))
    agreed = met.select("*", F.explode("have").alias("rarest")).join(index.small(cut), ["ikey", "rarest"]).where(F.size(F.array_except("need", "have")) == 0)
    wanted = agreed.select("rid", "ikey", "shift", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place")).distinct()
    wanted = wanted.join(index.small(index.places.select("ikey", "place", "t")), ["ikey", "place"]).select("rid", (F.col("shift") + F.col("place")).alias("pos"), "t", "ikey", "shift", "place")
    wanted = stored(spark, wanted, "candidates")
    texts = wanted.select("rid").distinct()
    lists = index.postings
    if texts.count() <= BROADCAST_TEXTS:
        lists = lists.join(F.broadcast(texts), "rid", "left_semi")
    found = wanted.join(lists, ["rid", "pos", "t"], "left_semi")
    order = Window.partitionBy("rid", "ikey", "shift").orderBy("place")
    runs = found.withColumn("run", F.col("place") - F.row_number().over(order)).groupBy("rid", "ikey", "run", "shift").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    least = index.items.select("ikey", "item_id", F.least(F.size("words"), F.lit(window)).alias("least"))
    return runs.join(index.small(least), "ikey").where(F.col("last") - F.col("first") + 1 >= F.col("least")).select("rid", "item_id", "first", "last")


def proximity_matches(index: Index, rare: int = NEAR, within: int = WITHIN) -> DataFrame:
    """Items whose rarest terms stand close together in a training text: rid, item_id, first and last (places of the first such group).

    An item's terms are its ``rare`` rarest ones that the training texts have
    (ties by the term); with fewer than two it has no match.  Null ids and
    repeated items: an item is an id and a text.  All terms must stand within
    ``within`` words, in any order.
    """
    each = index.places.where("n is not null").select("ikey", "t", "n").distinct().join(index.small(index.terms.select("t", "term")), "t")
    order = Window.partitionBy("ikey").orderBy("n", "term")
    chosen = each.withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < rare)
    chosen = chosen.withColumn("needed", F.count("*").over(Window.partitionBy("ikey"))).where("needed > 1").select("t", "ikey", "k", "needed")
    met = index.postings.join(index.small(chosen), "t")
    grouped = met.groupBy("rid", "ikey", "needed").agg(F.bit_or(F.expr("shiftleft(1, cast(k as int))")).alias("kinds"), F.collect_list(F.struct("pos", "k")).alias("at")).where(F.col("kinds") == F.expr("shiftleft(1, cast(needed as int)) - 1"))
    # the last place of each term so far: the group that ends at a place begins at the least of these
    far = F.lit(-(1 << 30))
    start = F.struct(F.array_repeat(far, rare).alias("past"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(a, x):
        past = F.transform(a["past"], lambda p, k: F.when(k == x["k"], x["pos"]).otherwise(p))
        oldest = F.array_min(F.slice(past, F.lit(1), F.col("needed").cast("int")))
        hit = a["first"].isNull() & (x["pos"] - oldest < within)
        return F.struct(past.alias("past"), F.when(hit, oldest).otherwise(a["first"]).alias("first"), F.when(hit, x["pos"]).otherwise(a["last"]).alias("last"))

    spans = grouped.select("rid", "ikey", F.aggregate(F.array_sort("at"), start, step).alias("span")).where("span.first is not null")
    return spans.join(index.small(index.items.select("ikey", "item_id")), "ikey").select("rid", "item_id", "span.first", "span.last")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """How much of every whole text stands in windows of test items, and which items it comes near.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near
    and near_items (ids of proximity matches, sorted as strings and
    comma-joined), one row for each row of docs; repeated rows stay.  Null and
    empty texts have no words and no hits; items without words never occur.
    Texts of one item id are one item in n_items and n_near.  Words in windows
    of an item without an id are hit, but such items aren't counted or named.
    With no items nothing is contaminated.  Other columns are not read.
    """
    index = build(docs, benchmark)
    place = lambda df, kind: df.select("rid", F.col("item_id").cast("string").alias("item"), "first", "last", F.lit(kind).alias("kind"))
    with scratch(docs.sparkSession):
        matches = place(phrase_matches(index, window), "phrase").unionByName(place(proximity_matches(index), "near"))
        matches = stored(docs.sparkSession, matches.distinct(), "matches", outer=True)
    phrase = F.col("kind") == "phrase"
    # runs of a text in order: what a run adds to the words that earlier ones have covered
    covered = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("past")),
        lambda a, r: F.struct((a["n"] + F.greatest(r["last"] - F.greatest(r["first"] - 1, a["past"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["past"], r["last"]).alias("past")),
    )["n"]
    grouped = matches.groupBy("rid").agg(
        F.collect_set(F.when(phrase, F.struct("first", "last"))).alias("runs"),
        F.array_sort(F.collect_set(F.when(phrase, F.col("item")))).alias("items"),
        F.array_sort(F.collect_set(F.when(~phrase, F.col("item")))).alias("near"),
    )
    hits = grouped.select("rid", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"), F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near_items"))
    joined = index.texts.join(hits, "rid", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", count("n_hit").alias("n_hit"), count("n_items").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (count("n_hit") > 0).alias("contaminated"), count("n_near").alias("n_near"), F.coalesce("near_items", F.lit("")).alias("near_items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that share no window with a test item, all columns kept; null texts stay.

    Rows are told apart by 128 bits of hashes of id and text.
    """
    keys = dict(zip(("matched_a", "matched_b"), two_hashes(F.col("doc_id"), F.col("text").cast("string")), strict=True))
    with scratch(docs.sparkSession):
        index = build(docs, benchmark, **keys)
        bad = index.texts.join(phrase_matches(index, window).select("rid").distinct(), "rid", "left_semi").select(*keys)
        bad = stored(docs.sparkSession, bad, "matched", outer=True)
    return boxed(docs, **keys).join(bad, list(keys), "left_anti").select("row.*")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The whole in SQL: windows of items met with windows of texts by their words; places of items' rarest terms met with each other.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
s AS (SELECT item_id, words, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS i FROM b WHERE len(words) > 0),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS k, array_to_string(words[i + 1 : i + least(len(words), 10)], ' ') AS g FROM s),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, words, k, unnest(range(0, len(words) - k + 1)) AS i FROM w, sizes WHERE len(words) >= k),
hit AS (SELECT d.doc_id, d.i, d.k, bw.item_id FROM dw d JOIN bw ON bw.k = d.k AND bw.g = array_to_string(d.words[d.i + 1 : d.i + d.k], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id),
post AS (SELECT doc_id, unnest(words) AS term, unnest(range(len(words))) AS p FROM w),
df AS (SELECT term, count(*) AS n FROM post GROUP BY 1),
it AS (SELECT DISTINCT item_id, words, unnest(words) AS term FROM b),
rk AS (SELECT item_id, words, term, row_number() OVER (PARTITION BY item_id, words ORDER BY n, term) AS k FROM it JOIN df USING (term)),
ch AS (SELECT item_id, words, max(CASE k WHEN 1 THEN term END) AS t1, max(CASE k WHEN 2 THEN term END) AS t2, max(CASE k WHEN 3 THEN term END) AS t3 FROM rk GROUP BY 1, 2 HAVING count(*) > 1),
two AS (SELECT x.doc_id, item_id, t3, least(x.p, y.p) AS lo, greatest(x.p, y.p) AS hi FROM ch JOIN post x ON x.term = t1 JOIN post y ON y.term = t2 AND y.doc_id = x.doc_id AND abs(x.p - y.p) < 30),
near AS (SELECT DISTINCT two.doc_id, item_id FROM two LEFT JOIN post z ON z.term = t3 AND z.doc_id = two.doc_id WHERE t3 IS NULL OR greatest(hi, z.p) - least(lo, z.p) < 30),
nr AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM near WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated,
CAST(coalesce(nr.n_near, 0) AS BIGINT) AS n_near, coalesce(nr.near_items, '') AS near_items
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)
"""

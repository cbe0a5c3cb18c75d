"""Document fingerprints by I-Match over several randomised lexicon subsets, in DataFrame functions only.

A term's document frequency is counted over the whole corpus; terms whose frequency lies in a band (the
same as a band of inverse document frequencies) form the lexicon.  For the upper end of the band the rows of a
large group of near copies count as one document together, so that such a group does not push its own terms
out; for the lower end every row counts.  The groups are those rows that share a sketch.  A text's distinct lexicon terms, in
order, are hashed once for the lexicon and for each of 48 random subsets of it.  These take from one in
16 to one in 1024 terms, so that for a text of any length some hang on only a few of its terms and
outlive an edit of the rest.  Likeness is the share of agreeing subset hashes among those not empty on both sides.

A term in at least a share ``low`` of the documents counts against every one of these, so the lexicon has
at most (mean distinct terms of a document) / ``low`` entries whatever the corpus' size: that bound is what
lets it be sent to all executors.

Contract: null texts are empty.  A text without lexicon terms has a hash of the whole text in place of
subset hashes, like only itself.  Documents are in descending order of doc_id, null ids last, equal ids by
text; the next one of the last is the first, and a lone document is its own next.  Repeated rows are kept.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Subset k takes one term in RATES[k]; the first is the whole lexicon.
RATES = [1] + 4 * [16] + 12 * [64, 128, 256] + 8 * [1024]
#: Runs of subsets that are looked for together, among the terms that are in any of them.
TIERS = [range(0, 1), range(1, 5), range(5, len(RATES))]
SUBSETS = len(RATES)
#: Pairs of constants; a sketch is the two least hashes of a text's terms after exclusive or with these.
SKETCHES = [(0x1B873593CC9E2D51, 0x2545F4914F6CDD1D), (0x369DEA0F31A53F85, 0x5851F42D4C957F2D), (0x14057B7EF767814F, 0x6A09E667F3BCC908), (0x3C6EF372FE94F82B, 0x510E527FADE682D1)]
#: Rows of a sketch that at least this share of all rows (and three) have are a large group: at most len(SKETCHES) / HOT of these.
HOT = 0.01
#: What a row that is in no large group weighs.
WHOLE = 1 << 32
#: What ``xxhash64`` gives for an empty array: its seed, which 64 bits keep apart from all others.
EMPTY = 42


def terms(text: Column) -> Column:
    """Lower-cased runs of characters other than white space and ASCII punctuation (and empty strings at the ends)."""
    return F.split(F.lower(text), r"[\s\p{Punct}]+")


def sketches(text: Column) -> Column:
    """A hash for each of SKETCHES; two texts that share a share s of their terms have one in common with probability 1 - (1 - s^2)^4."""
    least = lambda hs, c: F.array_min(F.transform(hs, lambda h: h.bitwiseXOR(F.lit(c).cast("long"))))
    # going over an array of one binds the hashes, which would otherwise be made anew for each constant
    hashes = F.array(F.transform(terms(text), lambda t: F.xxhash64(t)))
    return F.get(F.transform(hashes, lambda hs: F.array(*[F.xxhash64(F.lit(k), least(hs, a), least(hs, b)) for k, (a, b) in enumerate(SKETCHES)])), F.lit(0))


def weighted(documents: DataFrame, n: int) -> DataFrame:
    """text and weight: WHOLE, or its share of that for each row of a large group (the largest that it is in)."""
    docs = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select(F.explode(sketches(F.col("text"))).alias("sketch")).groupBy("sketch").agg(F.count("*").alias("size"))
    hot = found.where(F.col("size") >= max(3, math.ceil(HOT * n))).collect()
    if not hot:
        return docs.withColumn("weight", F.lit(WHOLE))
    sizes = F.create_map(*[F.lit(x).cast("long") for r in hot for x in (r["sketch"], r["size"])])
    largest = F.array_max(F.transform(sketches(F.col("text")), lambda k: F.coalesce(F.element_at(sizes, k), F.lit(1).cast("long"))))
    return docs.withColumn("weight", F.floor(F.lit(WHOLE) / largest).cast("long"))


def lexicon(documents: DataFrame, low: float = 0.001, high: float = 0.2) -> DataFrame:
    """term, id (a hash of the term) and mask (the subsets it is in) of the terms in the band."""
    n = documents.count()
    docs = weighted(documents, n)
    apart = (docs.agg(F.sum("weight")).first()[0] or 0) / WHOLE
    counted = docs.select("weight", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("weight").alias("mass"))
    band = counted.where((F.col("df") >= max(2, math.ceil(low * n))) & (F.col("mass") <= max(2, math.floor(high * apart)) * WHOLE) & (F.col("term") != ""))
    mask = F.lit(0).cast("long")
    for k in range(SUBSETS):
        mask = mask + F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(RATES[k])) == 0, F.lit(1 << k)).otherwise(0)
    return band.select("term", F.xxhash64("term").alias("id"), mask.alias("mask"))


def _bucket(documents: DataFrame, rows: int, most: int) -> Column:
    """Number of the range of doc_id that a row is in; about ``rows`` rows to one, at most ``most`` ranges."""
    n = documents.count()
    parts = min(most, max(1, n // rows))
    found = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 10 * most).alias("b")).first()["b"] if parts > 1 else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    size = math.isqrt(len(bounds)) + 1
    runs = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    below = lambda array: F.coalesce(F.size(F.filter(array, lambda x: x < F.col("doc_id"))), F.lit(0))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    run = below(longs([r[-1] for r in runs]))
    inner = F.get(F.array(*[longs(r) for r in runs]), run)
    return F.when(F.col("doc_id").isNull(), 0).otherwise(run * size + F.coalesce(F.size(F.filter(inner, lambda x: x < F.col("doc_id"))), F.lit(0)))


def _follows(heads: DataFrame) -> DataFrame:
    """From (bucket, ...) the same rows under ``of``: the bucket whose last row they follow.  One row a bucket."""
    down = Window.orderBy(F.col("bucket").desc())
    return heads.withColumn("of", F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(Window.orderBy(F.lit(1))))).drop("bucket")


def with_next(documents: DataFrame, rows: int = 1000, most: int = 4096) -> DataFrame:
    """bucket, place, doc_id, text and next_text, the text of the document that comes after in descending doc_id.

    Rows are dealt by ranges of doc_id, so each range is ordered by itself; the first row of each range
    goes to the range above it (one row a range).
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("bucket", _bucket(docs.select("doc_id"), rows, most))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    ordered = docs.withColumn("place", F.row_number().over(order)).withColumn("following", F.lead("text").over(order))
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    first = docs.join(F.broadcast(tops.withColumnRenamed("bucket", "__b")), (F.col("bucket") == F.col("__b")) & F.col("doc_id").eqNullSafe(F.col("top")))
    first = first.groupBy("bucket").agg(F.min("text").alias("head"))
    heads = _follows(first).withColumnRenamed("of", "bucket")
    return ordered.join(heads, "bucket", "left").select("bucket", "place", "doc_id", "text", F.coalesce("following", "head").alias("next_text"))


def subset_hashes(found: Column) -> Column:
    """One hash for each subset of the sorted distinct (id, mask) of a text's lexicon terms."""

    def tier(ks: range) -> Column:
        any_ = F.lit(sum(1 << k for k in ks)).cast("long")
        held = F.filter(found, lambda t: t["mask"].bitwiseAND(any_) != 0)
        one = lambda h, k: F.xxhash64(F.transform(F.filter(h, lambda t: F.call_function("shiftright", t["mask"], k).bitwiseAND(F.lit(1).cast("long")) == 1), lambda t: t["id"]))
        # going over an array of one binds ``held``, which inside the inner function would be made anew for each subset
        return F.get(F.transform(F.array(held), lambda h: F.transform(F.sequence(F.lit(ks.start), F.lit(ks.stop - 1)), lambda k: one(h, k))), F.lit(0))

    return F.concat(*[tier(ks) for ks in TIERS])


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing hashes among those that are not empty on both sides; 0 if all are."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    some = F.size(F.filter(pairs, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != EMPTY)))
    return F.when(some > 0, same / some).otherwise(0.0)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.when(h == EMPTY, "-").otherwise(F.lower(F.hex(h)))), ".")


@contextlib.contextmanager
def _larger_hash_tables(spark: SparkSession, groups: int = 20_000) -> Iterator[None]:
    """While a table is written, sets are gathered by hash for as many groups as a task's ranges hold, then by sorting as ever."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, groups)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fingerprints(documents: DataFrame, low: float = 0.001, high: float = 0.2) -> DataFrame:
    """Per document its fingerprint, that of its text edited with the next one's beginning, and their likeness."""
    known = cut(lexicon(documents, low, high), "lexicon")
    mark = documents.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("mask"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = with_next(documents).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third)))
    # the empty term stands for a text itself, so that texts without lexicon terms keep their row
    whole = F.struct(F.xxhash64("text").alias("text_hash"), F.xxhash64("edited").alias("edited_hash"))
    rows = rows.select("bucket", "place", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), whole.alias("whole"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("one"))
    rows = rows.select("bucket", "place", "doc_id", "n_chars", "edited_sha256", "whole.text_hash", "whole.edited_hash", "one.side", F.explode(F.concat(F.array(F.lit("")), terms(F.col("one.text")))).alias("term"))
    rows = rows.join(F.broadcast(known.union(mark)), "term")
    info = ["doc_id", "n_chars", "edited_sha256", "text_hash", "edited_hash"]
    rows = rows.select("bucket", "place", F.struct(*info).alias("info"), F.struct("side", "id", "mask").alias("t"))
    rows = rows.groupBy("bucket", "place").agg(F.first("info").alias("info"), F.collect_set("t").alias("found")).select("bucket", "place", "info.*", "found")
    mine = lambda which: F.array_sort(F.filter("found", lambda t: (t["side"] == which) & (t["id"] != 0)))
    rows = rows.withColumns({"found_0": mine(0), "found_1": mine(1)})

    def side(which: int, whole_hash: str) -> Column:
        mine = F.col(f"found_{which}")
        of_text = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: F.xxhash64(F.lit("whole"), whole_hash, k))
        return F.when(F.size(mine) > 0, subset_hashes(mine)).otherwise(of_text)

    made = rows.select("bucket", "place", "doc_id", "n_chars", "edited_sha256", side(0, "text_hash").alias("own"), side(1, "edited_hash").alias("changed"))
    with _larger_hash_tables(documents.sparkSession):
        made = cut(made, "fingerprints")
    order = Window.partitionBy("bucket").orderBy("place")
    heads = _follows(made.where("place = 1").select("bucket", F.col("own").alias("head"))).withColumnRenamed("of", "bucket")
    made = made.withColumn("following", F.lead("own").over(order)).join(heads, "bucket", "left").withColumn("following", F.coalesce("following", "head"))
    own, changed = F.col("own"), F.col("changed")
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, F.col("following")).alias("near_next"))

"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every document has a fixed 60-bit hash of its id. A source whose target is ``r`` times its size takes
all its documents ``floor(r)`` times, and once more those whose hash lies below a threshold. The
threshold comes from nested histograms: words are summed by source and hash bucket, the bucket in
which the running sum passes the budget is found, and only that bucket is summed again in finer
buckets, at last by whole hash values. No documents are sorted; what the steps shuffle is at most
one row for each source, bucket and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bits of each level but the last; the last takes the bits that are left.
LEVEL_BITS = (12, 14)
HASH_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text: the same on every engine and in every run."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row for each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times the
    whole. A target stops at ``most`` times its source's size; what is over goes to the others by
    weight until none is above. Filling in the order of size over weight finds that fixed point at
    once: the source in turn is capped exactly if an even share of what is left exceeds its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    filling = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        ranked.withColumn("budget", share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("budget") * F.col("weight") >= most * F.col("source_size") * F.col("left"))
    )
    # the first source that is not capped sees the budget and the weights that the uncapped ones share
    free = F.when(~F.col("capped"), F.struct("budget", "left"))
    water = F.first(free, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("capped"), most * F.col("source_size")).otherwise(F.col("water.budget") * F.col("weight") / F.col("water.left"))
    return level.withColumn("water", water).select("source", "source_size", target.cast("double").alias("target"))


def thresholds(rows: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``mix_source, source_size, target, whole, threshold`` for each source of ``rows`` (source, size, hash)."""
    targets = scratch.keep(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumnRenamed("source", "mix_source")
    # what is to come from documents below the threshold; sources at a whole multiple have none
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    bounds = targets.select(F.col("mix_source").alias("of"), F.lit(0).cast("long").alias("low"), rest.alias("budget")).filter("budget > 0")
    shift = HASH_BITS
    for bits in (*LEVEL_BITS, HASH_BITS - sum(LEVEL_BITS)):
        above, shift = shift, shift - bits
        bounds = scratch.keep(_refine(rows, bounds, above, shift), f"bound-{shift}")
    joined = targets.join(bounds.select("of", F.col("low").alias("threshold")), F.col("mix_source").eqNullSafe(F.col("of")), "left").drop("of")
    return scratch.keep(joined.withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long"))), "thresholds")


def mix(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """How often each document of ``docs`` (doc_id, text, source) goes into the mix.

    Returns ``doc_id, source, size, source_size, target, copies, taken`` for every row. ``taken`` is
    ``copies * size``; a source's sum is within half of one document of its target. Null or empty
    texts have size 0 and are taken as their hash says; rows that share an id are taken alike; a
    source without words takes nothing; an empty table gives an empty result. Other columns are left
    alone. Options are those of ``thresholds``.
    """
    rows = scratch.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")), "sizes")
    joined = rows.join(thresholds(rows, scratch, **options), F.col("source").eqNullSafe(F.col("mix_source")))
    copies = F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it. Only sizes and sums are shuffled, no texts.

    Null, empty and very long texts have the number of their words as size, rows without words go with their source's
    share; null sources are a source of their own; repeated rows are taken alike; an empty table gives an empty result.
    """
    rows = scratch.keep(docs.select("source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")), "sizes")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = packed.join(thresholds(rows, scratch, **options), F.col("row.source").eqNullSafe(F.col("mix_source")))
    copies = F.col("whole") + (id_hash(F.col("row.doc_id")) < F.col("threshold")).cast("long")
    # sequence(1, 0) would count down
    times = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<long>"))
    return joined.select("row", F.explode(times).alias("nth")).select("row.*")


def _refine(rows: DataFrame, bounds: DataFrame, above: int, shift: int) -> DataFrame:
    """The bound of each source within its bucket: ``low`` is where the finer bucket that passes the
    budget begins, ``budget`` what of it is left. At the last level the nearer edge is taken."""
    prefix = lambda c, n: F.shiftright(c, n)
    hit = F.col("source").eqNullSafe(F.col("of")) & (prefix(F.col("hash"), above) == prefix(F.col("low"), above))
    sums = rows.join(bounds, hit).groupBy("of", "budget", "low", prefix(F.col("hash"), shift).alias("bucket")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("of").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(running)).withColumn("before", F.col("upto") - F.col("words"))
    if shift:
        passes = sums.filter(F.col("upto") > F.col("budget")).groupBy("of").agg(F.min_by(F.struct("bucket", "before"), "bucket").alias("at"))
        found = passes.select(F.col("of").alias("found"), F.shiftleft("at.bucket", shift).alias("at_low"), F.col("at.before").alias("before"))
    else:
        # a bucket is one hash value here: take it if that comes nearer to the budget
        taken = sums.filter(F.col("upto") - F.col("budget") <= F.col("budget") - F.col("before"))
        found = taken.groupBy("of").agg((F.max("bucket") + 1).alias("at_low")).select(F.col("of").alias("found"), "at_low", F.lit(0).cast("long").alias("before"))
    joined = bounds.join(found, F.col("of").eqNullSafe(F.col("found")), "left")
    # a bucket that never passes the budget leaves its source at the bucket's end
    end = F.col("low") + F.lit(1 << above) if shift else F.col("low")
    low = F.coalesce(F.col("at_low"), end)
    return joined.select("of", low.alias("low"), (F.col("budget") - F.coalesce(F.col("before"), F.lit(0))).alias("budget"))

"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

A document's set is that of its word shingles, as 64-bit hashes. The sketch has ``t`` coordinates
and is filled in rounds: in each of the first ``t`` rounds every element falls into a hashed bin, in
each of the next ``t`` rounds all elements fall into the bin of that round, and a coordinate keeps
the least value ``round + fraction`` seen. Rounds stop once all bins are filled, after few of them
for large sets and after ``2 t`` at most, so every coordinate is filled and, unlike with one-pass
binning, coordinates agree with a probability equal to the Jaccard similarity, with concentration.

Bands of the sketch give candidate links; copies of a set are merged first, so that a bucket holds
different sets. Within a bucket all are compared with its smallest id. Documents of buckets whose
members are not yet in one class go on: pairs across classes are found among them by an exact prefix
filter on their rarest shingles, in which members of one class never meet. Every link is confirmed on
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import WordTable, map_rows, mix64, split_blocks, words_of

_MASK = (1 << 64) - 1
_FRACTION = np.uint64((1 << 52) - 1)


def _word_ids(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` word ids; of the whole run where there are fewer."""
    if not len(ids):
        return ids
    width = min(k, len(ids))
    h = np.full(len(ids) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = mix64(h + ids[i : i + len(h)])
    return np.unique(h)


def fast_similarity_sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The sketch of a non-empty array of distinct hashes: ``t`` values, each filled."""
    out = np.full(t, _MASK, dtype=np.uint64)
    n = len(elements)
    at_once = max(1, min(2 * t, 6 * t // n))  # later rounds never undercut earlier ones, so several may go together
    for start in range(0, 2 * t, at_once):
        rounds = np.arange(start, min(start + at_once, 2 * t), dtype=np.uint64)[:, None]
        h = mix64(elements[None, :] ^ mix64(rounds + np.uint64(0x5EED)))
        bins = np.where(rounds < t, ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32), rounds - np.uint64(t))
        np.minimum.at(out, bins.astype(np.intp).ravel(), ((rounds << np.uint64(52)) | (h & _FRACTION)).ravel())
        if out.max() != _MASK:
            break
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each run of ``rows`` coordinates, different for each band."""
    bands = sketch.reshape(-1, rows)
    h = np.arange(len(bands), dtype=np.uint64)
    for i in range(rows):
        h = mix64(h ^ bands[:, i]) + np.uint64(i)
    return h.view(np.int64)


def _sets(frames: Iterator[pd.DataFrame], k: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Blocks of rows with their shingle sets."""
    table = WordTable(_word_ids)
    for frame in frames:
        for part, words in split_blocks(frame, lambda texts: words_of(pc.ascii_lower(texts))):
            rows, ids = table.look_up(words)
            yield part, [shingle_hashes(ids[r], k) for r in rows]


def sketches(docs: DataFrame, k: int = 4, bands: int = 30, rows: int = 5) -> DataFrame:
    """``doc_id, n_shingles, fingerprint, bands`` of each row of ``docs`` (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, sets in _sets(frames, k):
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "fingerprint": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "bands": [band_keys(fast_similarity_sketch(s, bands * rows), rows) if len(s) else None for s in sets],
                }
            )

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, fingerprint binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, shingles``: the full sets, as hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, sets in _sets(frames, k):
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "shingles": [s.view(np.int64) for s in sets]})

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, shingles array<long>")


#: A key with more than this share of a table's rows is split; at most so many keys are. Few rows are no burden anyway.
HOT_KEYS, _LEAST_HOT = 2_000, 1_000


def _hot(counts: DataFrame, scratch: Scratch, total: int) -> DataFrame:
    """The keys of ``counts`` (key, c) with more than ``total / HOT_KEYS`` rows, and in how many ``parts`` to
    deal each: a table of ``HOT_KEYS`` rows at most, and as many parts again, whatever the input."""
    cut = max(_LEAST_HOT, total // HOT_KEYS)
    return scratch.keep(counts.filter(F.col("c") > cut).withColumn("parts", F.ceil(F.col("c") / cut).cast("int")), "hot")


def _by_key(rows: DataFrame, facts: DataFrame, key: str, scratch: Scratch, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``facts`` (key, c: number of rows, ...) of their key; rows of hot keys stay where
    they are. The others are merged, at small sizes as at large ones: their facts grow with the input. With ``how`` left,
    rows without facts stay."""
    hot = F.broadcast(_hot(facts.withColumnRenamed(key, "key"), scratch, total).drop("parts").withColumnRenamed("key", key))
    cold = facts.join(F.broadcast(hot.select(key)), key, "left_anti")
    few = rows.join(hot, key)
    return few.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key, how)).drop("c")


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 4, percent: int = 80, bands: int = 30, rows: int = 5) -> DataFrame:
    """Classes of documents linked by ``100 * |x & y| >= percent * |x | y|`` on their shingle sets.

    ``docs`` has doc_id and text. Returns ``doc_id, n_shingles, component_id, kept`` for each row:
    ``component_id`` is the smallest id reachable over links, ``kept`` marks that document. Ids name one
    text each; of rows with one id and several texts the least text stands for the id in comparisons. Null, empty and blank texts have no shingles and no links; a text shorter than ``k`` words is one shingle; rows
    that repeat an id and a text are returned as often; other columns are left alone. A null id is
    linked with nothing. A pair at the threshold is missed by all ``bands`` bands with a probability
    of ``(1 - 0.8 ** rows) ** bands``, 7e-6 by default; at 0.9 it is below 1e-11.
    """
    sketched = scratch.keep(sketches(docs, k, bands, rows), "sketches")
    usable = sketched.filter("n_shingles > 0 and doc_id is not null")
    # copies of a set are in one class; the smallest id stands for them
    rep = F.min_by(F.struct("doc_id", "n_shingles", "bands"), "doc_id")
    copies = usable.groupBy("fingerprint").agg(rep.alias("rep"), F.count(F.lit(1)).alias("c"))
    copies = scratch.keep(copies.select("fingerprint", "c", F.col("rep.doc_id").alias("rep"), F.col("rep.n_shingles").alias("n"), F.col("rep.bands").alias("bands")), "copies")
    members = scratch.keep(copies.select(F.col("rep").alias("doc_id"), "n", F.explode("bands").alias("bucket")), "members")
    heads = members.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.min_by("n", "doc_id").alias("head_n"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    heads = scratch.keep(heads, "heads")
    shared = scratch.keep(_by_key(members, heads, "bucket", scratch, members.count()), "shared")
    scratch.free(sketched, copies, shared)
    alike = F.greatest("n", "head_n") * percent <= F.least("n", "head_n") * 100
    stars = scratch.keep(shared.filter((F.col("doc_id") != F.col("head")) & alike).select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")

    wanted = scratch.keep(shared.select(F.col("doc_id").alias("wanted")).distinct(), "wanted")
    # an inner join, ids being distinct: a semi-join would be pushed below the filter and shuffle all texts
    texts = _perhaps(docs.select("doc_id", "text"), wanted).join(wanted.hint("merge"), F.col("doc_id") == F.col("wanted"))
    sets = scratch.keep(shingle_sets(texts.groupBy("doc_id").agg(F.min("text").alias("text")), k), "sets")
    links = scratch.keep(_confirmed(stars, sets, scratch, percent), "links")
    labels = components(links, scratch)

    # what the comparison with the heads leaves open
    labelled = shared.select("bucket", "doc_id", "n").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    labelled = scratch.keep(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo < hi").select("bucket", "c")
    left = scratch.keep(_by_key(labelled, scratch.keep(mixed, "mixed"), "bucket", scratch, labelled.count()).select("doc_id", "n", "label").distinct(), "open")
    pairs = scratch.keep(_across(left, sets, scratch, percent).join(stars, ["a", "b"], "left_anti"), "across")
    more = scratch.keep(_confirmed(pairs, sets, scratch, percent), "more")
    joined = components(more.select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch)
    scratch.free(sketched, copies, labels, joined)

    # representative -> class, then class -> joined class
    final = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    lone = joined.join(labels, joined["node"] == labels["node"], "left_anti").select("node", "component")
    classes = final.unionByName(lone)
    by_set = copies.join(classes, F.col("rep") == F.col("node"), "left").select("fingerprint", "c", F.coalesce("component", "rep").alias("class"))
    # the copies of one text may be a third of all rows; rows that are linked with nothing stay apart
    found = _by_key(usable.drop("bands"), scratch.keep(by_set, "classes"), "fingerprint", scratch, usable.count())
    alone = sketched.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("class"))
    component = F.col("class")
    out = found.select("doc_id", "n_shingles", "class").unionByName(alone)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


#: Bits of the filter for each id that is looked for, and binary logarithms of its least and largest size: up to two million words of 64 bits.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 12, 27


def _perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be among ``wanted``, by a filter of bits, so that the texts of few others are shuffled."""
    return flagged(docs, wanted).filter("flag").drop("flag")


def flagged(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` with ``flag``: whether their id may be among ``wanted`` (wanted).

    The filter is sized by the number of ids and broadcast as words of 64 bits, ``2 ** (MOST_BITS - 6)`` at most; where
    hundreds of millions of ids are wanted, more rows pass, which the join drops.
    """
    size = min(max((BITS_EACH * max(wanted.count(), 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)

    def place(c: str) -> Column:
        return F.xxhash64(c).bitwiseAND(F.lit((1 << size) - 1))

    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    bits = wanted.select(place("wanted").alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    # one column of its own keeps clear of the others' names
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    met = docs.select(row, place("doc_id").alias("place")).join(F.broadcast(bits), F.shiftright("place", 6) == F.col("word"), "left")
    flag = F.coalesce(F.col("bits").bitwiseAND(one) != 0, F.lit(False))
    return met.select("row", flag.alias("flag")).select("row.*", "flag")


def _confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose full sets are similar enough. The pairs of an id that has many, on either side,
    are dealt in parts, each with a copy of its set."""
    total = pairs.count()
    asked = pairs.select(F.col("a").alias("asked")).union(pairs.select("b")).distinct()
    sets = sets.join(asked, F.col("doc_id") == F.col("asked"), "left_semi")

    def with_set(pairs: DataFrame, own: str, other: str) -> DataFrame:
        hot = F.broadcast(_hot(counts[own], scratch, total).select(F.col("key").alias("hot"), "parts"))
        every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        side = sets.select(F.col("doc_id").alias(own), F.col("shingles").alias(f"set_{own}")).join(hot, F.col(own) == F.col("hot"), "left").select(own, f"set_{own}", every.alias("part"))
        dealt = pairs.join(hot, F.col(own) == F.col("hot"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0)).cast("int")).drop("hot", "parts")
        return dealt.join(side.hint("merge"), [own, "part"]).drop("part")  # sets are never small

    counts = {c: pairs.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("c")) for c in "ab"}
    both = with_set(with_set(pairs, "a", "b"), "b", "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    checked = both.withColumn("common", common).withColumn("whole", F.size("set_a") + F.size("set_b") - F.col("common"))
    return checked.filter(F.col("common") * 100 >= F.col("whole") * percent).select(*pairs.columns)


def _across(docs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs of ``docs`` (doc_id, n, label) of different labels that may be similar enough: ``a, b, la, lb``.

    With the shingles of each set in order of their number of documents, sets x and y that have
    ``need = percent / (100 + percent) * (|x| + |y|)`` in common share one among the first ``|x| - need + 1``
    of x and the first ``|y| - need + 1`` of y. Rows whose place rules out every partner at their shingle,
    and shingles that only one class still has there, go before the join, so members of one class never
    meet however many they are.
    """
    every = sets.select(F.col("doc_id").alias("of"), "shingles").hint("merge").join(docs, F.col("of") == F.col("doc_id")).select("doc_id", "n", "label", F.explode("shingles").alias("shingle"))
    every = scratch.keep(every, "shingles")
    # a shingle of one class leads nowhere, but keeps its place in the order; those of one document come first, uncounted
    frequency = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("c > 1")
    frequency = scratch.keep(frequency.withColumn("df", F.col("c")).withColumn("open", F.expr("lo < hi")).drop("lo", "hi"), "frequency")
    by_doc = Window.partitionBy("doc_id")
    counted = _by_key(every.select("doc_id", "shingle"), frequency, "shingle", scratch, every.count())
    counted = counted.withColumn("known", F.count(F.lit(1)).over(by_doc)).withColumn("nth", F.row_number().over(by_doc.orderBy("df", "shingle")))
    ranked = counted.join(docs, "doc_id").withColumn("place", F.col("n") - F.col("known") + F.col("nth") - 1).drop("known", "nth")
    first = scratch.keep(ranked.filter(F.col("open") & (F.col("place") * 100 <= F.col("n") * (100 - percent))).drop("df", "open"), "first")

    def fits(n: Column, place: Column, other: Column) -> Column:
        return (n - place) * (100 + percent) >= (n + other) * percent

    for _ in range(2):  # what goes for its place may leave a shingle to one class
        least = first.groupBy("shingle").agg(F.min("n").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo < hi").select("shingle", "least", "c")
        met = _by_key(first, scratch.keep(least, "least"), "shingle", scratch, first.count())
        first = scratch.keep(met.filter(fits(F.col("n"), F.col("place"), F.greatest("least", F.ceil(F.col("n") * percent / 100)))).drop("least"), "first")
    # rows of a hot shingle are dealt in parts on one side and go to all of them on the other
    hot = F.broadcast(_hot(first.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")), scratch, first.count()).select(F.col("shingle").alias("hot"), "parts"))
    dealt = first.join(hot, F.col("shingle") == F.col("hot"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("hot")
    x = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).alias("x")
    y = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.label") < F.col("y.label")) & fits(F.col("x.n"), F.col("x.place"), F.col("y.n")) & fits(F.col("y.n"), F.col("y.place"), F.col("x.n"))
    return x.join(y, met).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct()

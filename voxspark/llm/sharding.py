"""Sharding in Hilbert-curve order of several metadata columns. DataFrame functions only.

Each dimension is quantised to a few bits; the cell's index on the Hilbert curve and a hash of the
id order the rows; equal runs of that order are the shards, so that files cover small boxes of all
dimensions at once and their min/max statistics prune reads on any of them. The law is ``rows``:
shard sizes differ by one row at most, however many rows share a cell or a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows below one partition's part of a monotonically increasing id.
_ROW_BITS = 33


def quantise_log2(size: Column, bits: int) -> Column:
    """0 for 0, else 1 + floor(log2(size)), at most ``2**bits - 1``."""
    return F.least(F.length(F.bin(F.coalesce(size, F.lit(0)))) - (F.coalesce(size, F.lit(0)) == 0).cast("int"), F.lit((1 << bits) - 1)).cast("long")


#: Distinct values of a column, of the least hashes, from which the bounds of its cells are taken.
MOST_VALUES = 4_096


def value_bounds(docs: DataFrame, column: str, bits: int) -> list[str]:
    """Up to ``2**bits - 1`` values that cut the distinct values of a text column into even runs, in order.

    They come from all values where there are ``MOST_VALUES`` at most, else from that many by hash; the driver holds no more.
    """
    value = docs.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
    seen = sorted(r["value"] for r in value.orderBy(F.xxhash64("value"), "value").limit(MOST_VALUES).collect())
    cells = min((1 << bits) - 1, len(seen))  # cell 0 is that of nulls and of what sorts before the first bound
    return [seen[i * len(seen) // cells] for i in range(cells)]


def quantise_order(value: Column, bounds: list[str], bits: int) -> Column:
    """How many of ``bounds`` are at most the value, spread over ``2**bits`` cells: neighbouring cells hold neighbouring
    values. Nulls share cell 0."""
    upto = reduce(lambda a, b: a + b, [(value.cast("string") >= F.lit(b)).cast("long") for b in bounds], F.lit(0).cast("long"))
    spread = F.floor(upto * ((1 << bits) - 1) / max(1, len(bounds))).cast("long")
    return F.coalesce(spread, F.lit(0).cast("long"))


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell given by ``len(dims)`` coordinates of ``bits`` bits each.

    Follows Skilling's transform from axes to the transposed index, with an array as the state: for
    each bit from the top, coordinates are inverted or exchanged with the first, then Gray-coded.
    """
    n = len(dims)
    state, one = F.array(*[d.cast("long") for d in dims]), F.lit(1).cast("long")

    def at(x: Column, i: int) -> Column:
        return F.element_at(x, i + 1)

    def turn(i: int, level: int):
        mask = F.lit((1 << level) - 1).cast("long")

        def step(x: Column) -> Column:
            first, this = at(x, 0), at(x, i)
            inverted = F.shiftright(this, level).bitwiseAND(one) == 1
            swap = first.bitwiseXOR(this).bitwiseAND(mask)
            new_first = F.when(inverted, first.bitwiseXOR(mask)).otherwise(first.bitwiseXOR(swap))
            new_this = F.when(inverted, this).otherwise(this.bitwiseXOR(swap))
            return F.array(*[new_first if k == 0 else new_this if k == i else at(x, k) for k in range(n)])

        return step

    for level in range(bits - 1, 0, -1):
        for i in range(n):
            state = _let(state, turn(i, level))

    def gray(x: Column) -> Column:
        out = [at(x, 0)]
        for k in range(1, n):
            out.append(at(x, k).bitwiseXOR(out[k - 1]))
        return F.array(*out)

    state = _let(state, gray)

    def untwist(x: Column) -> Column:
        last, none = at(x, n - 1), F.lit(0).cast("long")
        masks = [F.when(F.shiftright(last, level).bitwiseAND(one) == 1, F.lit((1 << level) - 1).cast("long")).otherwise(none) for level in range(1, bits)]
        t = reduce(lambda a, b: a.bitwiseXOR(b), masks, none)
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    state = _let(state, untwist)

    def interleave(x: Column) -> Column:
        parts = [F.shiftleft(F.shiftright(at(x, k), level).bitwiseAND(one), level * n + n - 1 - k) for level in range(bits) for k in range(n)]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return F.element_at(F.transform(F.array(state), interleave), 1)


def _let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(docs: DataFrame, scratch: Scratch, rows: list[Column], shards: int, bits: int) -> DataFrame:
    """``rows``, columns of ``docs``, with ``hilbert, shard, slot``: one shuffle of just them, and a table of it."""
    text = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    dims = [quantise_order(F.col(c), value_bounds(docs, c, bits), bits) for c in ("source", "lang")]
    cell = hilbert_index([*dims, quantise_log2(text, bits)], bits)
    keyed = docs.select(F.struct(*rows).alias("row"), F.col("doc_id").alias("id"), cell.alias("hilbert"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("tie"))
    # one write fixes the range bounds; the hash lets them cut through a cell that holds many rows
    dealt = keyed.repartitionByRange("hilbert", "tie", "id").sortWithinPartitions("hilbert", "tie", "id").select("row", "hilbert")
    dealt = scratch.keep(dealt.withColumn("at", F.monotonically_increasing_id()), "dealt")
    part, inside = F.shiftright("at", _ROW_BITS), F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each partition, not for each document
    offsets = counts.select(
        "part",
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    ranked = dealt.withColumn("part", part).join(offsets, "part").withColumn("rank", F.col("offset") + inside)
    placed = ranked.withColumn("shard", F.expr(f"(rank * {shards}L) div total")).withColumn("first", F.expr(f"(shard * total + {shards - 1}L) div {shards}L"))
    return placed.select("row", "hilbert", F.col("shard").cast("int").alias("shard"), (F.col("rank") - F.col("first")).alias("slot"))


def shard(docs: DataFrame, scratch: Scratch, shards: int = 24, bits: int = 5) -> DataFrame:
    """A shard and a slot for each row of ``docs`` (doc_id, text, lang, source).

    Dimensions: source, language and size class. Returns ``doc_id, size, text_crc32, law, shard,
    slot, grown_shard, hilbert``. Shard ``k`` holds ranks ``ceil(k * n / shards)`` up to the next;
    slots count from 0 in it. Null text counts as no bytes and has no crc32; null metadata falls into
    cell 0; equal rows get neighbouring ranks; very long texts are one row like others; an empty table gives an empty result; other columns are left alone.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    placed = _placed(docs, scratch, [F.col("doc_id"), size.alias("size"), F.crc32("text").cast("long").alias("text_crc32")], shards, bits)
    return placed.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, scratch: Scratch, path: str, shards: int = 24, bits: int = 5) -> None:
    """``docs`` as Parquet in folders ``shard=k`` below ``path``, every row once and in curve order in each file."""
    if "shard" in docs.columns:
        raise ValueError("the documents have a column shard, which names the folders")
    _placed(docs, scratch, [docs[c] for c in docs.columns], shards, bits).select("shard", "row.*").write.partitionBy("shard").parquet(path)

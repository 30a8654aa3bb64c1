"""Divergence of sources by their term counts, on run-length columns.

For each language the terms of at least a few documents are its vocabulary, and each (language, source)
group has a column of counts over it. Terms with the same counts in every group are merged to one row
with their number; the rows are put in order of their counts, so that equal counts stand together, and cut into
slices. In a slice each column becomes runs of equal counts. For a pair of groups the ends of both
columns' runs are merged: between two ends both counts are constant, so the divergence is worked
out once and multiplied by the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import in_blocks

#: Scale of probabilities.
SCALE = 1_000_000_000
#: Bytes other than ASCII letters and what stands for characters beyond ASCII become blanks; A to Z become small.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Characters of text that are split at a time, rows of counts that a task holds back, and rows of a slice.
BLOCK_CHARS, HELD_ROWS, SLICE_ROWS = 4_000_000, 300_000, 20_000


def terms_of(texts: list[str | None]) -> pa.ListArray:
    """The terms of each text; none for null."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    folded = pa.py_buffer(b"".join(raw).translate(_LETTERS))
    whole = pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(ends.astype(np.int64)), folded)
    split = pc.ascii_split_whitespace(whole)
    return split


def _counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, d``: uses of each term in a group and its documents, summed within tasks as far as they hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_blocks([len(t or "") for t in texts], int, BLOCK_CHARS):
                made = count(batch.slice(a, b - a), texts[a:b])
                held.append(made)
                rows += made.num_rows
                if rows > HELD_ROWS:
                    held = [merged(held)]
                    if held[0].num_rows > HELD_ROWS // 2:
                        yield from held[0].to_batches()
                        held = []
                    rows = sum(t.num_rows for t in held)
                pa.default_memory_pool().release_unused()
        if held:
            yield from merged(held).to_batches()

    def count(part: pa.RecordBatch, texts: list) -> pa.Table:
        split = terms_of(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        flat = split.flatten()
        solid = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        code, terms = coded.indices.to_numpy()[solid].astype(np.int64), coded.dictionary
        owner = owner[solid]
        group = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"])
        names: dict = {}
        of = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in group.to_pylist()], np.int64)
        width = max(len(terms), 1)
        in_doc, uses = np.unique(owner * width + code, return_counts=True)
        key, place = np.unique(of[in_doc // width] * width + in_doc % width, return_inverse=True)
        langs, sources = [pa.array([n[k] for n in names], pa.string()) for k in (0, 1)]
        at = pa.array(key // width)
        return pa.table({"lang": langs.take(at), "source": sources.take(at), "term": terms.take(pa.array(key % width)).cast(pa.string()), "n": pa.array(np.bincount(place, uses, len(key)).astype(np.int64)), "d": pa.array(np.bincount(place, minlength=len(key)).astype(np.int64))})

    def merged(tables: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")])
        return whole.select(["lang", "source", "term", "n_sum", "d_sum"]).rename_columns(["lang", "source", "term", "n", "d"])

    return docs.mapInArrow(run, "lang string, source string, term string, n long, d long")


def scaled(counts: np.ndarray, whole: int) -> np.ndarray:
    """``1 + SCALE * (count + 1) // whole``, exact for counts of any size."""
    some, where = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 1) // whole for c in some], np.int64)[where]


def runs(rows: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and counts of the runs of a column that has ``counts`` at ``rows``, ascending, and 0 elsewhere.

    Row r spans the terms from ``ends[r]`` to ``ends[r + 1]``; adjoining runs of one count are one.
    """
    column = np.zeros(len(ends) - 1, np.int64)
    column[rows] = counts
    last = np.flatnonzero(np.append(column[1:] != column[:-1], True))
    return ends[1:][last], column[last]


def intersected(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the stretches in which two columns of runs are both constant, and the runs of each that they belong to."""
    ends = np.union1d(x[0], y[0])
    return np.diff(ends, prepend=0), np.searchsorted(x[0], ends), np.searchsorted(y[0], ends)


def _pairs(slices: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of f over a slice for each ordered pair of the language's groups."""
    out = []
    if len(slices) and len(groups):
        slices = slices.sort_values("place")
        ends = np.concatenate([[0], np.cumsum(slices["terms"].to_numpy())])
        sizes = slices["counts"].map(len).to_numpy()
        entries = [e for row in slices["counts"] for e in row]
        row = np.repeat(np.arange(len(slices)), sizes)
        group, n = (np.array([e[c] for e in entries], np.int64) for c in ("g", "n"))
        order = np.argsort(group, kind="stable")
        group, row, n = group[order], row[order], n[order]
        columns = {}
        for g, size, kept in groups[["g", "size", "kept"]].itertuples(index=False):
            a, b = np.searchsorted(group, g, "left"), np.searchsorted(group, g, "right")
            end, count = runs(row[a:b], n[a:b], ends)
            columns[g] = (end, scaled(count, int(size) + int(kept)))
        names = sorted(columns)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                length, x, y = intersected(columns[a], columns[b])
                p, q = columns[a][1][x], columns[b][1][y]
                square = (p - q) * (p - q)
                out += [(a, b, int((square // q * length).sum())), (b, a, int((square // p * length).sum()))]
    lang = groups["lang_of"].iloc[0] if len(groups) else ""
    return pd.DataFrame([(lang, *r) for r in out], columns=["lang", "g", "other", "f"])


def audit(docs: DataFrame, scratch: Scratch, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` for ``docs`` (text, lang, source).

    Part ``pair`` has, for each (lang, source) group, the divergence from each other source of the language, all
    ranks; part ``term`` the terms in which the group exceeds its language most, to rank ``most_terms``. With
    ``p = 1 + SCALE * (count + 1) // (N + V)`` of a term in a group (N its uses of kept terms, V the number of terms
    kept for the language), the value is ``(p - q) ** 2 // q``, summed over all terms for a pair. Ranks go by
    falling value, then by item in UTF-8 order.

    Null text, lang and source count as empty. Groups without terms take part in pairs with their counts of 0; a
    language with no term kept has pairs of value 0 and no terms. Each row is a document, repeated ones too; texts of
    any length are whole; an empty table gives an empty result; other columns are left alone.
    """
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = scratch.keep(_counted(plain).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "counted")
    # a number for each group of a language, in order of the source
    groups = plain.select("lang", "source").distinct().withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    groups = scratch.keep(groups, "groups")
    numbered = counted.join(groups, ["lang", "source"])
    terms = numbered.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.array_sort(F.collect_list(F.struct("g", "n"))).alias("counts")).filter(F.col("d") >= least_docs)
    terms = scratch.keep(terms.select("lang", "term", "counts"), "terms")
    vectors = scratch.keep(terms.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("terms")), "vectors")
    kept = vectors.groupBy("lang").agg(F.sum("terms").alias("kept"))
    entries = vectors.select("lang", "terms", F.explode("counts").alias("e"))
    size = entries.groupBy("lang", F.col("e.g").alias("g")).agg(F.sum(F.col("e.n") * F.col("terms")).alias("size"))
    facts = groups.join(size, ["lang", "g"], "left").join(kept, "lang", "left")
    facts = scratch.keep(facts.select("lang", "g", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("kept", F.lit(0)).alias("kept")), "facts")

    pairs = _divergences(vectors, facts, scratch)
    both = facts.select("lang", "g", "source").join(facts.select("lang", F.col("g").alias("other"), F.col("source").alias("item")), "lang").filter("g != other")
    value = both.join(pairs, ["lang", "g", "other"], "left").select("lang", "source", "item", F.coalesce("f", F.lit(0)).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = value.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    top = _terms(terms, facts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(top.select(*columns))


def _divergences(vectors: DataFrame, facts: DataFrame, scratch: Scratch) -> DataFrame:
    """``lang, g, other, f``: sums over all terms of each ordered pair of groups."""
    n = max(1, -(-vectors.count() // SLICE_ROWS))
    place = Window.partitionBy("lang", "slice").orderBy("counts")
    slices = scratch.keep(vectors.repartitionByRange(n, "lang", "counts").withColumn("slice", F.spark_partition_id()), "slices")
    ordered = slices.withColumn("place", F.row_number().over(place))
    # the group numbers and sizes of a language go to each of its slices
    every = slices.select("lang", "slice").distinct().join(facts.select("lang", "g", "size", "kept"), "lang").toDF("lang_of", "slice_of", "g", "size", "kept")
    parts = ordered.groupBy("lang", "slice").cogroup(every.groupBy("lang_of", "slice_of")).applyInPandas(_pairs, "lang string, g int, other int, f long")
    return parts.groupBy("lang", "g", "other").agg(F.sum("f").alias("f"))


def _terms(terms: DataFrame, facts: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms that a group uses more than its language does."""

    def probability(count: str, size: str):
        return F.expr(f"1 + (cast({SCALE} as decimal(20, 0)) * ({count} + 1)) div ({size} + kept)")

    whole = facts.groupBy("lang").agg(F.sum("size").alias("lang_size"))
    known = facts.join(whole, "lang")
    uses = terms.withColumn("all", F.aggregate("counts", F.lit(0).cast("long"), lambda s, e: s + e["n"])).select("lang", F.col("term").alias("item"), "all", F.inline("counts"))
    met = uses.join(known, ["lang", "g"]).withColumn("p", probability("n", "size")).withColumn("q", probability("all", "lang_size"))
    return met.filter("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))

"""Hard negatives by a vertical scan with branch and bound (BOND).

Vectors are stored in blocks, a column for each dimension with its least and greatest value. For an anchor
the columns of a block are read in the order of its own greatest magnitudes. After each few columns the
partial scores, together with the least and the most that the columns not yet read can add, leave a smaller bitmap of
candidates, until those that are left have exact scores. Two such scans follow each other: the first finds
the positives of each anchor, which set the windows of scores in which the second finds the negatives.

Row blocks meet blocks of anchors in the task that reads them; each task keeps the best it has seen, which
cut off what comes later, and gives a few rows for each anchor and window. Anchors go by in batches of
bounded size, so that neither a batch nor a task's state grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows of a block, anchors of a block, and bytes of anchor vectors that are broadcast at once.
BLOCK_ROWS, BLOCK_ANCHORS, BATCH_BYTES = 4096, 256, 8_000_000
#: Columns read between two looks at the bitmap.
STEP = 8
#: Bounds that no score reaches.
_LOW, _HIGH = -(1 << 60), 1 << 60


def eligible(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, q`` of the rows of ``vectors`` (vec_id, embedding, label) that take part.

    Rows with a null id, label or vector or a component that is null or not finite take none. Where the id is
    divisible by 7 the label is moved up by one of ten. ``q`` has ``floor(scale * x)`` of each component.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", "label").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
    return rows.select("vec_id", moved.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q"))


def is_anchor(vec_id: Column) -> Column:
    return vec_id % 100 == 0


def _unique(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each id, the least where there are several; vectors are shuffled only for ids that repeat."""
    rows = scratch.keep(rows, "rows")
    again = scratch.keep(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"), "repeated")
    if not again.limit(1).count():
        return rows
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")
    return scratch.keep(rows.join(again, "vec_id", "left_anti").unionByName(one), "unique")


def row_blocks(rows: DataFrame, dimensions: int) -> DataFrame:
    """Blocks of ``BLOCK_ROWS`` rows in order of label and id: ``ids, labels`` and, column after column, ``columns``, as bytes of
    doubles (sums of products stay far below 2**53, so they are exact), with the ``least`` and ``most`` of each. A shorter vector counts as if zeros followed it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held, n = [*held, frame], n + len(frame)
            while n >= BLOCK_ROWS:
                whole = pd.concat(held)
                yield block(whole.iloc[:BLOCK_ROWS])
                held, n = [whole.iloc[BLOCK_ROWS:]], n - BLOCK_ROWS
        if n:
            yield block(pd.concat(held))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["label", "vec_id"])
        columns = np.zeros((dimensions, len(frame)))
        for k, q in enumerate(frame["q"]):
            columns[: len(q), k] = q
        return pd.DataFrame({"ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "labels": [frame["label"].to_numpy(np.int64).tobytes()], "columns": [columns.tobytes()], "least": [columns.min(axis=1)], "most": [columns.max(axis=1)]})

    return rows.mapInPandas(run, "ids binary, labels binary, columns binary, least array<double>, most array<double>")


class Scan:
    """One anchor against one block: the candidates whose scores may still count, column after column."""

    def __init__(self, columns: np.ndarray, least: np.ndarray, most: np.ndarray, anchor: np.ndarray):
        self.columns, self.anchor = columns, anchor
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[self.order]
        ends = np.stack([a * least[self.order], a * most[self.order]])
        # what columns from each place of the order on add, at least and at most
        self.lower = np.concatenate([np.cumsum(ends.min(axis=0)[::-1])[::-1], [0]])
        self.upper = np.concatenate([np.cumsum(ends.max(axis=0)[::-1])[::-1], [0]])

    def scores(self, chosen: np.ndarray | None, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows ``chosen`` (all for None), those with ``low <= score <= high``, and their exact scores."""
        end = int(np.count_nonzero(self.anchor))  # zeros are last in the order and add nothing
        partial = np.zeros(self.columns.shape[1] if chosen is None else len(chosen))
        at = 0
        while True:
            kept = (partial >= low - self.upper[at]) & (partial <= high - self.lower[at])
            left = np.count_nonzero(kept)
            if at >= end or not left or left <= 0.75 * len(kept):
                chosen, partial = np.flatnonzero(kept) if chosen is None else chosen[kept], partial[kept]
            if at >= end or not left:
                return chosen, partial
            dims = self.order[at : min(at + STEP, end)]
            part = self.columns[dims] if chosen is None else self.columns[dims[:, None], chosen[None, :]]
            partial = partial + self.anchor[dims] @ part
            at += len(dims)


class Best:
    """The first ``k`` (score, id) of each of some keys, by falling score, then rising id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def least(self, key) -> int:
        """A score below which nothing more counts."""
        scores = self.held.get(key, ((), ()))[0]
        return int(scores[-1]) if len(scores) == self.k else _LOW

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        old = self.held.get(key)
        if old is not None:
            scores, ids = np.concatenate([old[0], scores]), np.concatenate([old[1], ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.held[key] = scores[first], ids[first]


def _scanned(blocks: DataFrame, anchors: DataFrame, numbers: range, dimensions: int, k: int, same: bool) -> DataFrame:
    """``anchor_id, window, vec_id, score``: for each task its best ``k`` rows of each window of each anchor.

    ``anchors`` has rows ``anchor_block, anchors`` of the ``numbers`` given, each with structs ``vec_id, label, q, low, high``;
    ``same`` asks for rows of the anchor's label, else of others.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(k)
        for frame in frames:
            for r in frame.itertuples():
                ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
                columns = np.frombuffer(r.columns).reshape(dimensions, -1)
                least, most = np.asarray(r.least), np.asarray(r.most)
                for x in r.anchors:
                    a, vector, label = x["vec_id"], np.zeros(dimensions), x["label"]
                    vector[: len(x["q"])] = x["q"]
                    low, high = np.asarray(x["low"], np.int64), np.asarray(x["high"], np.int64)
                    # ties at the least score held may still have smaller ids
                    cut = np.maximum(low, [best.least((a, w)) for w in range(len(low))])
                    first, last = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
                    chosen, scores = Scan(columns, least, most, vector).scores(np.arange(first, last) if same else None, cut.min(), high.max())
                    own = ids[chosen] == a if same else (chosen >= first) & (chosen < last)
                    chosen, scores = chosen[~own], scores[~own].astype(np.int64)
                    for w in range(len(low)):
                        within = (scores >= cut[w]) & (scores <= high[w])
                        best.add((a, w), scores[within], ids[chosen[within]])
        out = [(key[0], key[1], int(i), int(s)) for key, (scores, ids) in best.held.items() for s, i in zip(scores, ids)]
        yield pd.DataFrame(out, columns=["anchor_id", "window", "vec_id", "score"]).astype({"anchor_id": "int64", "window": "int32", "vec_id": "int64", "score": "int64"})

    met = blocks.withColumn("anchor_block", F.explode(F.sequence(F.lit(numbers[0]), F.lit(numbers[-1]))))
    met = met.join(F.broadcast(anchors), "anchor_block")  # BATCH_BYTES of vectors at most
    return met.select("ids", "labels", "columns", "least", "most", "anchors").mapInPandas(run, "anchor_id long, window int, vec_id long, score long")


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, scratch: Scratch, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vectors`` (vec_id, embedding, label).

    Anchors are the rows whose id is divisible by 100, scores are inner products of the integers of ``eligible``.
    The positives of an anchor are its first ``positives`` other rows of its label; for each, the first
    ``negatives`` rows of other labels with ``least_percent * p <= 100 * n <= most_percent * p`` are returned. Higher
    scores come first, then smaller ids. An anchor without positives or negatives gives no rows; a positive below zero has
    no negatives. Of rows that repeat an id the least (label, vector) counts; empty vectors score 0; an empty table
    gives an empty result; other columns are left alone. Vectors so long that a score would exceed a long are an error.
    """
    rows = _unique(eligible(vectors), scratch)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d"), F.max(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v)).alias("norm"), F.count_if(is_anchor(F.col("vec_id"))).alias("anchors")).first()
    dimensions = max(facts["d"] or 0, 1)
    if (facts["norm"] or 0) * dimensions >= 2.0**50:  # room for percentages and for bounds on sums of extremes
        raise ArithmeticError("scores of these vectors do not fit into long integers")
    spread = min(math.ceil(facts["n"] / BLOCK_ROWS), 8 * vectors.sparkSession.sparkContext.defaultParallelism)
    blocks = scratch.keep(row_blocks(rows, dimensions).repartition(max(spread, 1)), "blocks")
    n_blocks = max(1, math.ceil(facts["anchors"] / BLOCK_ANCHORS))
    at_once = max(1, BATCH_BYTES // (BLOCK_ANCHORS * dimensions * 8))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    anchors = scratch.keep(rows.filter(is_anchor(F.col("vec_id"))).withColumn("anchor_block", place), "anchors")

    def blocked(anchors: DataFrame, low: Column, high: Column) -> DataFrame:
        return anchors.groupBy("anchor_block").agg(F.collect_list(F.struct("vec_id", "label", "q", low.alias("low"), high.alias("high"))).alias("anchors"))

    def best(anchor_blocks: DataFrame, k: int, same: bool, label: str) -> DataFrame:
        found = None
        for a in range(0, n_blocks, at_once):
            numbers = range(a, min(a + at_once, n_blocks))
            batch = anchor_blocks.filter(F.col("anchor_block").between(numbers[0], numbers[-1]))
            part = scratch.keep(_ranked(_scanned(blocks, batch, numbers, dimensions, k, same), ["anchor_id", "window"], k), f"{label}-{a}")
            found = part if found is None else found.unionByName(part)
        return found

    wide = scratch.keep(blocked(anchors, F.array(F.lit(_LOW)), F.array(F.lit(_HIGH))), "anchor-blocks")
    top = best(wide, positives, True, "positives").select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    # windows of whole scores; those of positives below zero are empty, and last
    bounds = top.filter(p >= 0).withColumn("low", F.expr(f"({least_percent} * positive_score + 99) div 100")).withColumn("high", F.expr(f"({most_percent} * positive_score) div 100"))
    windows = bounds.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("window", "low", "high"))).alias("w"))
    asked = anchors.join(windows, F.col("vec_id") == F.col("anchor_id"))
    narrow = scratch.keep(blocked(asked, F.col("w.low"), F.col("w.high")), "windows")
    near = best(narrow, negatives, False, "negatives")
    return near.join(top, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

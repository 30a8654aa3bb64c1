"""Bounded samples of labelled texts, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, scratch: Scratch, most: dict[int, int], most_bytes: int) -> tuple[list[tuple], dict[int, int]]:
    """Rows ``(doc_id, label, lang, text)`` of ``docs`` (doc_id, text, lang) by ``labels`` (doc_id, ``label``), and how
    many ids each label has in the whole.

    Ids that are ``held_out`` are left out, and so are null ids and labels other than 0 and 1. The sample has at
    most ``most[y]`` ids of label ``y``, the first by a hash of the id, and ``most_bytes`` of text together; whole
    texts count. Of the rows of one id the least text stands, and the greatest label.
    """
    usable = labels.filter(~held_out & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias(label))
    usable = scratch.keep(usable, "labels")
    share = {r[label]: r["n"] for r in usable.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [usable.filter(F.col(label) == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    sample = scratch.keep(parts[0].unionAll(parts[1]).withColumnsRenamed({"doc_id": "of", label: "label"}), "sample")  # a few thousand rows of two numbers

    met = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), F.col("doc_id") == F.col("of"))
    met = met.groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "label", "t.lang", "t.text")
    met = scratch.keep(met, "texts")
    # a running sum over two numbers a row of the sample; texts that go beyond the bound are left out whole
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = scratch.keep(met.select(F.col("doc_id").alias("of"), upto.alias("upto")).filter(F.col("upto") <= most_bytes), "within")
    found = met.join(F.broadcast(within), F.col("doc_id") == F.col("of"), "left_semi")
    return [(r["doc_id"], r["label"], r["lang"], r["text"]) for r in found.collect()], share
